"""Clustering in chunks with bounded memory (sufficient statistics), and of mixed types."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import cut


def kmeans(points: DataFrame, key: str, vector: str, k: int, seed: int = 42, rounds: int = 20) -> tuple[DataFrame, float]:
    """``key, cluster`` and the cost."""
    rows = points.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=rounds).fit(rows)
    return model.transform(rows).select(key, F.col("prediction").alias("cluster")), float(model.summary.trainingCost)


def elbow(points: DataFrame, key: str, vector: str, ks: Sequence[int], seed: int = 42) -> DataFrame:
    """``k, cost`` for every k; one cluster costs the squared distances to the mean."""
    spark = points.sparkSession
    rows = cut(points.select(key, vector))
    return spark.createDataFrame([(k, kmeans(rows, key, vector, k, seed)[1] if k > 1 else _spread(rows, vector)) for k in ks], "k int, cost double")


def _spread(points: DataFrame, vector: str) -> float:
    parts = points.select(F.posexplode(F.col(vector).cast("array<double>")).alias("at", "x")).groupBy("at").agg((F.var_pop("x") * F.count("x")).alias("s"))
    return float(parts.agg(F.sum("s").alias("s")).first().s or 0.0)


def centroids(points: DataFrame, cluster: str, vector: str) -> DataFrame:
    """``cluster, n, centroid`` by a partial sum per dimension."""
    long = points.select(cluster, F.posexplode(F.col(vector).cast("array<double>")).alias("d", "x"))
    means = long.groupBy(cluster, "d").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return means.groupBy(cluster).agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("centroid"))


def _statistics(members: DataFrame) -> DataFrame:
    """``label, n, sum, sumsq`` of ``label, v``."""
    long = members.select("label", F.posexplode("v").alias("d", "x"))
    by_dim = long.groupBy("label", "d").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    packed = F.array_sort(F.collect_list(F.struct("d", "s", "q")))
    return by_dim.groupBy("label").agg(F.first("n").alias("n"), packed.alias("p")).select("label", "n", F.transform("p", lambda x: x["s"]).alias("sum"), F.transform("p", lambda x: x["q"]).alias("sumsq"))


def _merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sums of statistics with the same label."""
    add = lambda x, y: F.zip_with(x, y, lambda p, q: p + q)
    joined = a.join(b.select("label", F.col("n").alias("n2"), F.col("sum").alias("s2"), F.col("sumsq").alias("q2")), "label", "full_outer")
    return joined.select("label", (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"), F.coalesce(add("sum", "s2"), "sum", "s2").alias("sum"), F.coalesce(add("sumsq", "q2"), "sumsq", "q2").alias("sumsq"))


def _distance(v: str) -> Column:
    """Mahalanobis distance of ``v`` to the statistics of a row, with deviations floored."""
    return F.expr(f"sqrt(aggregate(zip_with({v}, zip_with(sum, sumsq, (s, q) -> named_struct('m', s / n, 's', greatest(1e-6D, sqrt(greatest(0D, q / n - (s / n) * (s / n)))))), (x, c) -> pow((x - c.m) / c.s, 2D)), 0D, (a, b) -> a + b))")


def _nearest_set(points: DataFrame, sets: DataFrame, limit: float) -> DataFrame:
    """``points`` with the label of the nearest set within ``limit``, else null. Sets are few: their number is bounded by the clusters asked for."""
    pairs = points.join(F.broadcast(sets)).select("id", "v", "label", _distance("v").alias("d")).where(F.col("d") < limit)
    near = pairs.groupBy("id").agg(F.min_by("label", F.struct("d", "label")).alias("label"))
    return points.join(near, "id", "left")


def chunked_clusters(points: DataFrame, key: str, vector: str, n_clusters: int, chunks: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``id, label`` (-1: outlier) and a row of counts for each chunk.

    The first chunk gives discard sets (k-means; tiny clusters go to the retained
    points). Each later point joins the nearest discard set, then the nearest
    compressed set, within twice the root of the dimension in Mahalanobis distance, else it is retained;
    retained points are clustered into compressed sets. After the last chunk compressed sets join
    the discard set nearest to their centre. Statistics are frozen within a chunk; labels of sets are never reused.
    """
    spark = points.sparkSession
    # 13,333 and 2,333,333 deal the points into chunks.
    rows = cut(points.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.pmod(13_333 * F.col(key).cast("long") + 3, F.lit(2_333_333)), F.lit(chunks)).alias("chunk")))
    first = rows.select(F.size("v").alias("d")).first()
    if first is None:
        return spark.createDataFrame([], "id bigint, label bigint"), spark.createDataFrame([], "chunk int, discarded bigint, n_compressed bigint, compressed bigint, retained bigint")
    limit = 2 * math.sqrt(first.d)
    counts: list[tuple] = []
    ds = cs = placed = retained = None
    next_label = n_clusters
    for c in range(chunks):
        now = rows.where(F.col("chunk") == c).select("id", "v")
        if ds is None:
            if now.isEmpty():
                continue
            rough, _ = kmeans(now, "id", "v", min(8 * n_clusters, max(2, now.count() // 4)), seed)
            small = rough.groupBy("cluster").agg(F.count("*").alias("n")).where("n = 1").select("cluster")
            lone = now.join(rough.join(small, "cluster").select("id"), "id", "left_semi")
            core = cut(now.join(lone.select("id"), "id", "left_anti"))
            fine, _ = kmeans(core, "id", "v", n_clusters, seed)
            members = core.join(fine, "id").select("id", "v", F.col("cluster").cast("long").alias("label"))
            ds = cut(_statistics(members))
            cs = cut(ds.limit(0))
            placed, retained = cut(members.select("id", "label")), cut(lone)
        else:
            near = cut(_nearest_set(now, ds, limit))
            to_ds = near.where("label IS NOT NULL")
            rest = near.where("label IS NULL").select("id", "v")
            near_cs = cut(_nearest_set(rest, cs, limit))
            to_cs = near_cs.where("label IS NOT NULL")
            ds, cs = cut(_merge(ds, _statistics(to_ds))), cut(_merge(cs, _statistics(to_cs)))
            placed = cut(placed.unionByName(to_ds.select("id", "label")).unionByName(to_cs.select("id", "label")))
            retained = cut(retained.unionByName(near_cs.where("label IS NULL").select("id", "v")))
        left = retained.count()
        if left > 3 * n_clusters:
            groups, _ = kmeans(retained, "id", "v", 3 * n_clusters, seed)
            many = groups.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
            fresh = retained.join(groups.join(many, "cluster"), "id").select("id", "v", (F.col("cluster").cast("long") + next_label).alias("label"))
            next_label += 3 * n_clusters
            cs = cut(cs.unionByName(_statistics(fresh)))
            placed = cut(placed.unionByName(fresh.select("id", "label")))
            retained = cut(retained.join(fresh.select("id"), "id", "left_anti"))
        t = ds.agg(F.sum("n").alias("n")).first().n or 0
        u = cs.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
        counts.append((c, int(t), int(u.k), int(u.n or 0), retained.count()))
    centres = cs.select(F.col("label").alias("old"), F.expr("transform(sum, s -> s / n)").alias("v"))
    moved = centres.join(F.broadcast(ds)).select("old", "label", _distance("v").alias("d")).where(F.col("d") < limit).groupBy("old").agg(F.min_by("label", F.struct("d", "label")).alias("new"))
    final = placed.join(moved, F.col("label") == F.col("old"), "left").select("id", F.coalesce("new", F.when(F.col("label") < n_clusters, F.col("label")).otherwise(F.lit(-1)), F.lit(-1)).cast("long").alias("label"))
    out = final.unionByName(retained.select("id", F.lit(-1).cast("long").alias("label")))
    return out, spark.createDataFrame(counts, "chunk int, discarded bigint, n_compressed bigint, compressed bigint, retained bigint")


def k_prototypes(rows: DataFrame, key: str, numeric: Sequence[str], text: Sequence[str], k: int, gamma: float = 1.0, rounds: int = 10) -> tuple[DataFrame, float]:
    """``key, cluster`` and the cost: squared distance of numbers plus ``gamma`` for each unequal category.

    Starts at the ``k`` rows of smallest key hash; centres are means and modes. Only ``k`` centres come to the driver.
    """
    rows = cut(rows.select(key, *numeric, *text))
    centres = [tuple(r) for r in rows.orderBy(F.xxhash64(key), key).select(*numeric, *text).limit(k).collect()]
    before, assigned, cost = None, None, 0.0
    for _ in range(rounds):
        terms = []
        for j, c in enumerate(centres):
            d = F.lit(0.0)
            for name, v in zip(numeric, c, strict=False):
                d = d + F.pow(F.col(name) - F.lit(float(v)), 2)
            for name, v in zip(text, c[len(numeric) :], strict=True):
                d = d + F.when(F.col(name).eqNullSafe(F.lit(v)), 0.0).otherwise(gamma)
            terms.append(F.struct(d.alias("d"), F.lit(j).alias("cluster")))
        assigned = rows.withColumn("_best", F.array_min(F.array(*terms))).withColumn("cluster", F.col("_best.cluster"))
        cost = assigned.agg(F.sum("_best.d").alias("c")).first().c or 0.0
        if before is not None and abs(before - cost) < 1e-9 * max(1.0, before):
            break
        before = cost
        new = {r.cluster: tuple(r)[1:] for r in assigned.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in numeric], *[F.mode(c, True).alias(c) for c in text]).collect()}
        centres = [new.get(j, c) for j, c in enumerate(centres)]
    return assigned.select(key, "cluster"), float(cost)
