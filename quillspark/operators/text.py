"""Sections of line texts and fixed-size word chunks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sections(lines: DataFrame, key: str, order: str, text: str, markers: Mapping[str, str], start: str = "none") -> DataFrame:
    """``lines`` with ``section``: the name of the last marker (a regular expression) at or before each line of its key."""
    hit = F.lit(None).cast("string")
    for name, pattern in reversed(list(markers.items())):
        hit = F.when(F.col(text).rlike(pattern), name).otherwise(hit)
    window = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.coalesce(F.last(hit, ignorenulls=True).over(window), F.lit(start)))


def word_chunks(docs: DataFrame, key: str, text: str, size: int = 460, keep_tail: bool = False) -> DataFrame:
    """``key, corpus_index, chunk`` of ``size`` words each; the remainder is dropped unless ``keep_tail``. Null texts have no chunk."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    counted = docs.select(key, words.alias("_w")).withColumn("_n", (F.ceil(F.size("_w") / size) if keep_tail else F.floor(F.size("_w") / size)).cast("int"))
    places = counted.where("_n > 0").select(key, "_w", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("corpus_index"))
    return places.select(key, "corpus_index", F.array_join(F.slice("_w", F.col("corpus_index") * size + 1, F.lit(size)), " ").alias("chunk"))


def truthy(value: Column) -> Column:
    """1 for a non-empty text other than false, none and no; null where missing."""
    return F.when(value.isNotNull(), (~F.lower(value).isin("", "false", "none", "no", "0")).cast("int"))


def weekly_hours(hours: Column) -> Column:
    """Open hours of a map day -> 'H:M-H:M'; a closing before the opening is the next day's."""
    one = lambda s: F.split_part(F.split_part(s, F.lit("-"), F.lit(2)), F.lit(":"), F.lit(1)).cast("int") - F.split_part(F.split_part(s, F.lit("-"), F.lit(1)), F.lit(":"), F.lit(1)).cast("int")
    return F.aggregate(F.map_values(hours), F.lit(0), lambda a, s: a + F.pmod(one(s), F.lit(24)))
