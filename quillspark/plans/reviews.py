"""Nested and delimited fields as review data has them, built from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import ml, neighbours, text
from quillspark.plans.models import _priced
from quillspark.plans.registry import Registry
from quillspark.sources.tables import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
query = R.query


@query(
    "checkin_sums",
    "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, count(*)::INT AS slots, sum(n)::BIGINT AS total, round_even(avg(n), 6) AS mean, sum(n * n)::BIGINT AS squares FROM c GROUP BY 1",
)
def checkin_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Size, sum, mean and sum of squares of a map's values per row."""
    counts = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("time"))
    add = lambda a, x: a + x
    total = F.aggregate(F.map_values("time"), F.lit(0).cast("long"), add)
    squares = F.aggregate(F.transform(F.map_values("time"), lambda x: x * x), F.lit(0).cast("long"), add)
    return maps.select("user_id", F.size("time").alias("slots"), total.alias("total"), F.bround(total / F.size("time"), 6).alias("mean"), squares.alias("squares"))


@query("weekly_hours", "SELECT s_suppkey, (2 * ((8 + s_suppkey % 12 - s_nationkey % 9 + 24) % 24))::INT AS hours, (s_nationkey % 2)::INT AS open FROM supplier")
def weekly_hours(spark: SparkSession, folder: str) -> DataFrame:
    start, end = (F.col("s_nationkey") % 9).cast("string"), (8 + F.col("s_suppkey") % 12).cast("string")
    span = F.concat(start, F.lit(":0-"), end, F.lit(":30"))
    rows = table(spark, folder, "supplier").select("s_suppkey", F.create_map(F.lit("Monday"), span, F.lit("Friday"), span).alias("hours"), F.when(F.col("s_nationkey") % 2 == 1, "True").otherwise("False").alias("flag"))
    return rows.select("s_suppkey", text.weekly_hours(F.col("hours")).alias("hours"), text.truthy(F.col("flag")).alias("open"))


@query("friends_and_age", "SELECT o_custkey, count(*)::INT AS friends, (2020 - min(year(o_orderdate)))::INT AS age FROM orders GROUP BY 1")
def friends_and_age(spark: SparkSession, folder: str) -> DataFrame:
    """Length of a delimited list, and years since a date."""
    rows = table(spark, folder, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(F.col("o_orderkey").cast("string")), ", ").alias("friends"), F.min("o_orderdate").alias("since"))
    return rows.select("o_custkey", F.size(F.split("friends", ", ")).alias("friends"), (2020 - F.year("since")).alias("age"))


@query(
    "composite_key_split",
    "SELECT o_orderkey, split_part(k, '|', 1)::BIGINT AS brand_id, split_part(k, '|', 2) AS campaign_id, split_part(k, '|', 3)::DATE AS start FROM (SELECT o_orderkey, o_custkey || '|' || o_orderpriority || '|' || o_orderdate::DATE AS k FROM orders)",
)
def composite_key_split(spark: SparkSession, folder: str) -> DataFrame:
    key = F.concat_ws("|", "o_custkey", "o_orderpriority", F.col("o_orderdate").cast("date").cast("string"))
    parts = F.split("k", "\\|")
    return table(spark, folder, "orders").select("o_orderkey", key.alias("k")).select("o_orderkey", parts[0].cast("long").alias("brand_id"), parts[1].alias("campaign_id"), parts[2].cast("date").alias("start"))


@query("row_wise_stats", "SELECT p_partkey, len(list_distinct([p_name, p_brand, p_type, p_name]))::INT AS kinds, round_even((p_size + p_retailprice) / 2, 4) AS mean FROM part")
def row_wise_stats(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", F.size(F.array_distinct(F.array("p_name", "p_brand", "p_type", "p_name"))).alias("kinds"), F.bround((F.col("p_size") + F.col("p_retailprice")) / 2, 4).alias("mean"))


@query("knn_impute")
def knn_impute(spark: SparkSession, folder: str) -> DataFrame:
    """Prices missing for every fifth part, from the five parts nearest in size and price."""
    rows = table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")).alias("price"), (F.col("p_partkey") % 97).cast("double").alias("shelf"))
    return neighbours.impute(rows, "p_partkey", ["size", "price", "shelf"])


@query("grid_search")
def grid_search(spark: SparkSession, folder: str) -> DataFrame:
    """Mean F1 of every point of a small grid over a forest, three folds of all training rows."""
    train, _ = _priced(spark, folder)
    model = ml.grid_search(train, "label", (2, 4), (5, 10))
    rows = [(int(p[next(k for k in p if k.name == "maxDepth")]), int(p[next(k for k in p if k.name == "numTrees")]), float(f)) for p, f in zip(model.getEstimatorParamMaps(), model.avgMetrics, strict=True)]
    return spark.createDataFrame(rows, "depth int, trees int, f1 double")


@query("out_of_fold_scores")
def out_of_fold_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy and F1 of a held-out quarter for four kinds of classifier."""
    train, test = _priced(spark, folder)
    rows = []
    for kind in ("forest", "tree", "logistic", "lasso"):
        scores = ml.report(ml.classifier(kind, "label").fit(train).transform(test), "label")
        rows.append((kind, float(scores["accuracy"]), float(scores["f1"])))
    return spark.createDataFrame(rows, "model string, accuracy double, f1 double")
