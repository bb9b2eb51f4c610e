"""File sources and sinks beyond Parquet: JSON lines, CSV, ORC, text, folders of files."""

from __future__ import annotations

import importlib.util
import io
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The fields of review, business, user, check-in, photo and tip records.
REVIEW = "review_id string, user_id string, business_id string, stars double, useful int, funny int, cool int, text string, date string"
BUSINESS = "business_id string, city string, state string, stars double, review_count int, is_open int, categories string, attributes map<string,string>, hours map<string,string>, longitude double, latitude double"
USER = "user_id string, yelping_since string, friends string, review_count int, useful int, fans int, average_stars double"
CHECKIN = "business_id string, time map<string,int>"
PHOTO = "business_id string, label string, caption string"
TIP = "user_id string, business_id string, likes int"


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines with a schema, so nothing is read twice; a broken line gives nulls."""
    return spark.read.schema(schema).json(path)


def csv(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = True, quote: str = '"') -> DataFrame:
    return spark.read.schema(schema).option("header", header).option("quote", quote).csv(path)


def points(spark: SparkSession, path: str) -> DataFrame:
    """``idx, vector`` of headerless lines ``idx,label,f1,..``; the label is dropped."""
    parts = F.split("value", ",")
    return spark.read.text(path).select(parts[0].cast("int").alias("idx"), F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))).cast("array<double>").alias("vector"))


def orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def folder_csv(spark: SparkSession, path: str, schema: str, glob: str = "*.csv") -> DataFrame:
    """All files of a folder that match ``glob``, with the number that starts each file's name as ``file_key``."""
    rows = spark.read.schema(schema).option("header", True).option("pathGlobFilter", glob).csv(path)
    return rows.withColumn("file_key", F.expr("try_cast(regexp_extract(_metadata.file_name, '^([0-9]+)', 1) AS INT)"))


def text_tree(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files below ``path`` with the file's folder and name, in order of lines within a file."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    names = whole.select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1).alias("folder"), F.col("_metadata.file_name").alias("file"), "value")
    return names.select("folder", "file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def _whole(spark: SparkSession, path: str, glob: str, schema: str, parse) -> DataFrame:
    """Frames that ``parse`` makes of whole files, in the columns of ``schema``; a file is read by one task."""
    names = [f.name for f in rows_of(spark, [], schema).schema.fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                yield parse(io.BytesIO(content))[names]

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("content").mapInPandas(run, schema)


def pickled(spark: SparkSession, path: str, schema: str, glob: str = "*.pkl") -> DataFrame:
    """Pickled pandas frames below ``path``. Unpickling runs what a file says: only for files of one's own."""
    return _whole(spark, path, glob, schema, pd.read_pickle)


def excel(spark: SparkSession, path: str, schema: str, sheet: str | int = 0, glob: str = "*.xls*") -> DataFrame:
    """One sheet of every workbook below ``path``; needs a workbook reader that pandas knows, else an ImportError says which."""
    if not any(importlib.util.find_spec(m) for m in ("openpyxl", "xlrd", "calamine", "python_calamine")):
        raise ImportError("reading workbooks needs openpyxl, xlrd or python-calamine")
    return _whole(spark, path, glob, schema, lambda f: pd.read_excel(f, sheet_name=sheet))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-blank lines, for a semi join."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def rows_of(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def write_json_summary(df: DataFrame, path: str) -> None:
    """A frame of one row as one JSON object."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, column: str, path: str, by: str | None = None) -> None:
    """A text column as lines, one folder for each value of ``by``."""
    rows = df.select(column, *([by] if by else []))
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).text(path)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Parquet with a folder per key; only the partitions that ``df`` has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_missing(df: DataFrame, path: str) -> None:
    """Write only where nothing is there yet."""
    df.write.mode("ignore").parquet(path)
