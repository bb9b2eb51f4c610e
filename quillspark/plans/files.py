"""Round trips of a table through every file source."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans.registry import Registry
from quillspark.session import shared_dir
from quillspark.sources import files
from quillspark.sources.tables import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
query = R.query
_SUPPLIER = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"
_SCHEMA = "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def _supplier(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@query("scan_json", _SUPPLIER)
def scan_json(spark: SparkSession, folder: str) -> DataFrame:
    path = _place(spark)
    _supplier(spark, folder).write.json(path)
    return files.json_lines(spark, path, _SCHEMA)


@query("scan_csv", _SUPPLIER)
def scan_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = _place(spark)
    files.write_csv(_supplier(spark, folder), path)
    return files.csv(spark, path, _SCHEMA)


@query("scan_orc", _SUPPLIER)
def scan_orc(spark: SparkSession, folder: str) -> DataFrame:
    path = _place(spark)
    _supplier(spark, folder).write.orc(path)
    return files.orc(spark, path)


@query("scan_glob", "SELECT s_suppkey, s_nationkey AS file_key FROM supplier")
def scan_glob(spark: SparkSession, folder: str) -> DataFrame:
    """A folder per nation, chosen by a glob, the key taken from the path."""
    path = _place(spark)
    rows = _supplier(spark, folder)
    rows.withColumn("key", F.col("s_nationkey")).write.partitionBy("key").option("header", True).csv(path)
    found = spark.read.schema(_SCHEMA).option("header", True).option("recursiveFileLookup", True).csv([f"{path}/key=[0-9]*"])
    return found.select("s_suppkey", F.regexp_extract(F.col("_metadata.file_path"), "key=([0-9]+)", 1).cast("int").alias("file_key"))


@query("write_partitioned", "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1")
def write_partitioned(spark: SparkSession, folder: str) -> DataFrame:
    path = _place(spark)
    files.write_partitioned(_supplier(spark, folder), path, ["s_nationkey"])
    return spark.read.parquet(path).groupBy("s_nationkey").agg(F.count("*").alias("n"))


@query("word_list_filter", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')")
def word_list_filter(spark: SparkSession, folder: str) -> DataFrame:
    path = _place(spark)
    files.write_lines(files.rows_of(spark, [("Brand#1",), (" Brand#2",), ("",)], "w string"), "w", path)
    return table(spark, folder, "part").join(files.word_list(spark, path), F.col("p_brand") == F.col("word"), "left_semi").select("p_partkey")
