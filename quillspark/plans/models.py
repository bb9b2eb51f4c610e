"""Neighbours, clusters and models over embeddings, events and orders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import cluster, ml, neighbours
from quillspark.plans.registry import Registry
from quillspark.plans.statistics import ratings
from quillspark.session import cut, shared_dir
from quillspark.sources.tables import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
query = R.query

_DIST = "sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2))))"


@query(
    "knn_embeddings",
    f"SELECT query, neighbour, rank FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DIST}, b.vec_id)::INT AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= 5",
)
def knn_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """The stated query set, ids divisible by 50, against all rows."""
    e = table(spark, folder, "embeddings")
    return neighbours.nearest(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 5).select("query", "neighbour", "rank")


def _near(k: int, space: str = "embedding", name: str = "near") -> str:
    """A statement's part: the ``k`` nearest of every query in a slice of the vectors, ties by id."""
    dist = f"list_sum(list_transform(list_zip(a.{space}, b.{space}), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2)))"
    return f"{name} AS (SELECT query, neighbour, rank FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, row_number() OVER (PARTITION BY a.vec_id ORDER BY {dist}, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= {k})"


@query(
    "knn_overlap",
    f"WITH {_near(20, 'embedding', 'n0')}, {_near(20, 'embedding[1:32]', 'n1')}, {_near(20, 'embedding[33:64]', 'n2')} SELECT query, neighbour, count(*) AS votes FROM (SELECT query, neighbour FROM n0 UNION ALL SELECT query, neighbour FROM n1 UNION ALL SELECT query, neighbour FROM n2) GROUP BY 1, 2 HAVING count(*) >= 2",
)
def knn_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours that at least two of three spaces agree on: the whole vector and its halves."""
    e = table(spark, folder, "embeddings")
    spaces = [e, e.withColumn("embedding", F.slice("embedding", 1, 32)), e.withColumn("embedding", F.slice("embedding", 33, 32))]
    lists = [neighbours.nearest(s.where("vec_id % 50 = 0"), s, "vec_id", "embedding", 20).select("query", "neighbour") for s in spaces]
    return neighbours.vote(lists, ["query", "neighbour"])


@query(
    "knn_recommend",
    f"""
    WITH {_near(10)}, c AS (SELECT a.label AS "group", b.label AS other, count(*) AS n FROM near JOIN embeddings a ON a.vec_id = query JOIN embeddings b ON b.vec_id = neighbour WHERE a.label <> b.label GROUP BY 1, 2)
    SELECT "group", other, n FROM (SELECT c.*, row_number() OVER (PARTITION BY "group" ORDER BY n DESC, other) AS r FROM c) WHERE r <= 3
    """,
)
def knn_recommend(spark: SparkSession, folder: str) -> DataFrame:
    """Labels that stand most often beside each label's vectors."""
    e = table(spark, folder, "embeddings")
    near = neighbours.nearest(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 10)
    return neighbours.recommend(near, e, "vec_id", "label", 3)


@query(
    "knn_two_hop",
    f"""
    WITH {_near(5)}, d AS (SELECT vec_id AS a, (vec_id * 7 + 3) % 97 AS b FROM embeddings), p AS (SELECT query, b AS partner, min(rank) AS rank FROM near JOIN d ON neighbour = a WHERE b <> query GROUP BY 1, 2)
    SELECT query, partner, place FROM (SELECT query, partner, row_number() OVER (PARTITION BY query ORDER BY rank, partner)::INT AS place FROM p) WHERE place <= 3
    """,
)
def knn_two_hop(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    near = neighbours.nearest(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 5)
    deals = e.select(F.col("vec_id").alias("a"), F.pmod(F.col("vec_id") * 7 + 3, F.lit(97)).alias("b"))
    return neighbours.two_hop(deals, near, 3)


@query(
    "cluster_quota",
    "WITH p AS (SELECT p_brand, p_partkey, p_size FROM part), s AS (SELECT p_brand, max(p_size) AS s FROM p GROUP BY 1), b AS (SELECT p_brand FROM s WHERE s = (SELECT max(s) FROM s)) SELECT p_brand, p_partkey FROM (SELECT p.*, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM p SEMI JOIN b ON p.p_brand = b.p_brand) WHERE r <= round_even(60.0::DOUBLE / (SELECT count(*) FROM b), 0)",
)
def cluster_quota(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.cluster_quota(table(spark, folder, "part").select("p_brand", "p_partkey", "p_size"), "p_brand", F.max("p_size"), "p_partkey", 60)


@query("kmeans_elbow")
def kmeans_elbow(spark: SparkSession, folder: str) -> DataFrame:
    return cluster.elbow(table(spark, folder, "embeddings"), "vec_id", "embedding", range(1, 20))


@query("kmeans_centroids")
def kmeans_centroids(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    labels, _ = cluster.kmeans(e, "vec_id", "embedding", 6)
    return cluster.centroids(e.join(labels, "vec_id"), "cluster", "embedding")


@query("cluster_chunked")
def cluster_chunked(spark: SparkSession, folder: str) -> DataFrame:
    labels, _ = cluster.chunked_clusters(table(spark, folder, "embeddings"), "vec_id", "embedding", 10)
    return labels


@query("cluster_chunked_rounds")
def cluster_chunked_rounds(spark: SparkSession, folder: str) -> DataFrame:
    return cluster.chunked_clusters(table(spark, folder, "embeddings"), "vec_id", "embedding", 10)[1]


@query("k_prototypes")
def k_prototypes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").select("p_partkey", (F.col("p_size") / 50).alias("size"), (F.col("p_retailprice") / 2000).alias("price"), "p_type")
    return cluster.k_prototypes(rows, "p_partkey", ["size", "price"], ["p_type"], 8)[0]


@query("k_prototypes_costs")
def k_prototypes_costs(spark: SparkSession, folder: str) -> DataFrame:
    """The cost for 3 to 9 clusters of mixed columns."""
    rows = cut(table(spark, folder, "part").select("p_partkey", (F.col("p_size") / 50).alias("size"), (F.col("p_retailprice") / 2000).alias("price"), "p_type"))
    costs = [(k, cluster.k_prototypes(rows, "p_partkey", ["size", "price"], ["p_type"], k)[1]) for k in range(3, 10)]
    return spark.createDataFrame(costs, "k int, cost double")


def _rated(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Training and test ratings with features from training ratings alone, a row's own left out."""
    r = ratings(spark, folder)
    test = ml.hash_split(F.concat_ws(":", "user_id", "k"), 0.2)
    return ml.rating_features(r.where(~test), r.where(test), "user_id", "k", "v")


_FEATURES = list(ml.RATING_FEATURES)


@query("gbt_rmse")
def gbt_rmse(spark: SparkSession, folder: str) -> DataFrame:
    train, test = _rated(spark, folder)
    return ml.error(ml.boosted(ml.assemble(train, _FEATURES), ml.assemble(test, _FEATURES), "v"), "v")


@query("gbt_stacked")
def gbt_stacked(spark: SparkSession, folder: str) -> DataFrame:
    train, test = _rated(spark, folder)
    return ml.error(ml.stacked(train, test, F.concat_ws(":", "user_id", "k"), "v", _FEATURES[3:], _FEATURES[:3]), "v")


def _priced(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") > 50_000).cast("int").alias("label"))
    rows = ml.assemble(rows, ["l_quantity", "l_discount", "l_tax"])
    test = ml.hash_split(F.concat_ws(":", "l_orderkey", "l_linenumber"), 0.25)
    return rows.where(~test), rows.where(test)


def _fitted(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    train, test = _priced(spark, folder)
    return ml.confusion(ml.classifier(kind, "label").fit(train).transform(test), "label")


@query("rf_confusion")
def rf_confusion(spark: SparkSession, folder: str) -> DataFrame:
    return _fitted(spark, folder, "forest")


@query("tree_confusion")
def tree_confusion(spark: SparkSession, folder: str) -> DataFrame:
    return _fitted(spark, folder, "tree")


@query("logistic_confusion")
def logistic_confusion(spark: SparkSession, folder: str) -> DataFrame:
    return _fitted(spark, folder, "logistic")


@query("lasso_confusion")
def lasso_confusion(spark: SparkSession, folder: str) -> DataFrame:
    return _fitted(spark, folder, "lasso")


@query(
    "ols_t_values",
    """
    WITH s AS (SELECT count(*) AS n, sum(l_quantity * l_quantity) AS aa, sum(l_quantity * l_discount) AS ab, sum(l_discount * l_discount) AS bb, sum(l_quantity * l_extendedprice) AS ay, sum(l_discount * l_extendedprice) AS by_, sum(l_extendedprice * l_extendedprice) AS yy FROM lineitem),
    b AS (SELECT s.*, aa * bb - ab * ab AS det, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS x, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS y FROM s), v AS (SELECT b.*, (yy - x * ay - y * by_) / (n - 2) AS s2 FROM b)
    SELECT 'l_quantity' AS name, round_even(x, 3) AS coefficient, round_even(x / sqrt(s2 * bb / det), 3) AS t FROM v UNION ALL SELECT 'l_discount', round_even(y, 3), round_even(y / sqrt(s2 * aa / det), 3) FROM v
    """,
)
def ols_t_values(spark: SparkSession, folder: str) -> DataFrame:
    rows = ml.assemble(table(spark, folder, "lineitem"), ["l_quantity", "l_discount"])
    coefficients, t = ml.ols(rows, "l_extendedprice")
    found = spark.createDataFrame([(n, float(c), float(x)) for n, c, x in zip(("l_quantity", "l_discount"), coefficients, t, strict=True)], "name string, coefficient double, t double")
    return found.select("name", F.bround("coefficient", 3).alias("coefficient"), F.bround("t", 3).alias("t"))


@query("label_encode", "SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS code FROM customer")
def label_encode(spark: SparkSession, folder: str) -> DataFrame:
    return ml.label_encode(table(spark, folder, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "code").drop("c_mktsegment")


@query(
    "segment_models",
    """
    SELECT c_nationkey, l_returnflag, o_orderpriority, count(*) AS n, round_even(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round_even(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round_even(regr_r2(l_extendedprice, l_quantity), 6) AS r2
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3 HAVING count(*) >= 10
    """,
)
def segment_models(spark: SparkSession, folder: str) -> DataFrame:
    """A model of price by quantity for every nation, return flag and priority with ten rows or more, all from one grouped pass of sums."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity", "l_extendedprice")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    fits = rows.groupBy("c_nationkey", "l_returnflag", "o_orderpriority").agg(F.count("*").alias("n"), F.bround(F.regr_slope(y, x), 4).alias("slope"), F.bround(F.regr_intercept(y, x), 2).alias("intercept"), F.bround(F.regr_r2(y, x), 6).alias("r2"))
    return fits.where("n >= 10")


@query("segment_forests")
def segment_forests(spark: SparkSession, folder: str) -> DataFrame:
    """Boosted trees for every return flag, each trained on its own rows and tested on a held-out quarter."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    test = ml.hash_split(F.concat_ws(":", "l_orderkey", "l_linenumber"), 0.25)
    return ml.fan_out(rows.where(~test), rows.where(test), "l_returnflag", ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")


@query("model_saved")
def model_saved(spark: SparkSession, folder: str) -> DataFrame:
    """The confusion of a tree that was saved to the shared folder and loaded again."""
    train, test = _priced(spark, folder)
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    ml.save(ml.classifier("tree", "label").fit(train), path)
    return ml.confusion(ml.load(path).transform(test), "label")
