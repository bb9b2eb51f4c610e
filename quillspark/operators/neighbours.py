"""Exact nearest neighbours of a stated query set, in blocks, and recommendations made of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import cut


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, most: int = 2_000_000) -> DataFrame:
    """``query, neighbour, distance, rank``: the ``k`` rows nearest to each query by Euclidean distance, itself left out, ties by key.

    The query block is sent to every task, so its size is checked first: beyond ``most``
    numbers the queries are worked off in several blocks. Each task keeps its
    ``k`` best per query before anything is shuffled.
    """
    spark = queries.sparkSession
    q = queries.select(F.col(key).alias("query"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    size = q.agg(F.sum(F.size("v")).alias("n")).first().n or 0
    blocks = max(1, -(-size // most))
    out = None
    for b in range(blocks):
        part = q.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).toPandas() if blocks > 1 else q.toPandas()
        shared = spark.sparkContext.broadcast((part["query"].tolist(), part["v"].tolist()))
        found = _block(shared, rows, key, vector, k)
        if blocks > 1:  # one block lies in the driver at a time
            found = cut(found)
            shared.unpersist()
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("query").orderBy("distance", "neighbour")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(shared, rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        names, vectors = shared.value
        if not names:
            return
        q = np.array(vectors, float)
        best: list[list[tuple[float, int]]] = [[] for _ in names]
        for frame in frames:
            frame = frame[frame["v"].notna()]
            if not len(frame):
                continue
            ids, x = frame["id"].to_numpy(), np.stack(frame["v"].to_numpy()).astype(float)
            square = np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * q @ x.T, 0)
            for i, name in enumerate(names):
                d = np.sqrt(square[i])
                near = np.argpartition(d, min(k + 1, len(d) - 1))[: k + 2] if len(d) > k + 2 else np.arange(len(d))
                limit = d[near].max() if len(near) else 0
                near = np.flatnonzero(d <= limit)  # ties at the edge stay
                best[i] = sorted(best[i] + [(float(d[j]), ids[j]) for j in near if ids[j] != name])[:k]
        flat = [(n, j, d) for n, own in zip(names, best, strict=True) for d, j in own]
        yield pd.DataFrame(flat, columns=["query", "neighbour", "distance"])

    return rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInPandas(run, f"query {kind}, neighbour {kind}, distance double")


def vote(lists: Sequence[DataFrame], key: Sequence[str], mode: str = "overlap") -> DataFrame:
    """Pairs that at least two lists have (``overlap``), any has (``all``), or exactly one has (``unique``), with ``votes``."""
    tagged = None
    for n, one in enumerate(lists):
        part = one.select(*key, F.lit(n).alias("_s"))
        tagged = part if tagged is None else tagged.unionByName(part)
    votes = tagged.groupBy(*key).agg(F.countDistinct("_s").alias("votes"))
    return votes.where({"overlap": "votes >= 2", "all": "votes >= 1", "unique": "votes = 1"}[mode])


def recommend(neighbours: DataFrame, owner: DataFrame, key: str, group: str, quantity: int) -> DataFrame:
    """``group, other, n``: the groups that stand most often among the neighbours of a group's rows, itself left out."""
    own = owner.select(F.col(key).alias("query"), F.col(group).alias("group"))
    theirs = owner.select(F.col(key).alias("neighbour"), F.col(group).alias("other"))
    counted = neighbours.join(own, "query").join(theirs, "neighbour").where("`group` <> other").groupBy("group", "other").agg(F.count("*").alias("n"))
    order = Window.partitionBy("group").orderBy(F.desc("n"), "other")
    return counted.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= quantity).drop("_k")


def two_hop(deals: DataFrame, near: DataFrame, quantity: int) -> DataFrame:
    """``query, partner``: past partners of a query's neighbours, in order of the neighbour's rank, without repeats, cut to ``quantity``.

    ``near`` has ``query, neighbour, rank``; ``deals`` has ``a, b``.
    """
    pairs = near.join(deals, F.col("neighbour") == F.col("a")).where("b <> query").groupBy("query", F.col("b").alias("partner")).agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("query").orderBy("rank", "partner")
    return pairs.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= quantity).select("query", "partner", F.col("_k").alias("place"))


def cluster_quota(scores: DataFrame, cluster: str, score: Column, item: str, quantity: int) -> DataFrame:
    """Items of the best clusters: equal best ones share the quantity, rounded half to even, each by item order."""
    per = scores.groupBy(cluster).agg(score.alias("_s"))
    best = F.broadcast(per.agg(F.max("_s").alias("_m")))
    chosen = per.join(best).where("_s = _m").select(cluster)
    count = F.broadcast(chosen.agg(F.count("*").alias("_c")))
    order = Window.partitionBy(cluster).orderBy(item)
    return scores.join(chosen, cluster).join(count).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= F.bround(quantity / F.col("_c"), 0)).select(cluster, item)


def impute(df: DataFrame, key: str, columns: Sequence[str], k: int = 5, most: int = 2_000_000) -> DataFrame:
    """``df`` with nulls of ``columns`` filled by the mean of the ``k`` nearest rows that have the column, ties by key.

    Distance is Euclidean over the columns that both rows have, scaled up for those they lack; a row that shares none gives nothing,
    and what no row can fill becomes the column's mean. Rows with a null are the query set. Those of equal values are one query, and of rows
    that are equal in the columns which a query has, the ``k`` of smallest key are enough. Queries are worked off in blocks of ``most`` numbers.
    """
    plain = df.select(F.col(key).alias("id"), *[_number(c).alias(c) for c in columns])
    gaps = cut(plain.where(" OR ".join(f"`{c}` IS NULL" for c in columns)).select(*columns).distinct())
    kind, found = df.schema[key].dataType.simpleString(), None
    for pattern in gaps.select(*[F.col(c).isNull().alias(c) for c in columns]).distinct().collect():
        have, lack = [c for c in columns if not pattern[c]], [c for c in columns if pattern[c]]
        asks = gaps.where(" AND ".join(f"`{c}` IS {'' if pattern[c] else 'NOT '}NULL" for c in columns)).select(*have)
        blocks = max(1, -(-asks.count() * len(columns) // most))
        for column in lack if have else ():
            order = Window.partitionBy(*have).orderBy("id")
            donors = cut(plain.where(F.col(column).isNotNull()).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).select("id", F.col(column).alias("_value"), *have))
            for b in range(blocks):
                part = asks.where(F.pmod(F.xxhash64(*have), F.lit(blocks)) == b) if blocks > 1 else asks
                shared = df.sparkSession.sparkContext.broadcast(part.toPandas().to_numpy(float))
                one = donors.mapInPandas(_donors(shared, have, len(columns), k), f"{', '.join(f'`{c}` double' for c in have)}, _donor {kind}, _distance double, _value double")
                order = Window.partitionBy(*have).orderBy("_distance", "_donor")
                one = one.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).groupBy(*have).agg(F.avg("_value").alias("_v"))
                one = one.select(*[F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in columns], F.lit(column).alias("_column"), "_v")
                if blocks > 1:  # one block lies in the driver at a time
                    one = cut(one)
                    shared.unpersist()
                found = one if found is None else found.unionByName(one)
    means = F.broadcast(plain.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns]))
    joined = df.join(means)
    if found is None:
        return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in columns}).select(*df.columns)
    wide = found.groupBy(*[F.col(c).alias(f"_q_{c}") for c in columns]).agg(*[F.max(F.when(F.col("_column") == c, F.col("_v"))).alias(f"_v_{c}") for c in columns])
    for c in columns:
        joined = joined.withColumn(f"_n_{c}", _number(c))
    joined = joined.join(wide, reduce(and_, [F.col(f"_n_{c}").eqNullSafe(F.col(f"_q_{c}")) for c in columns]), "left")
    return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_v_{c}"), F.col(f"_m_{c}")) for c in columns}).select(*df.columns)


def _number(column: str) -> Column:
    """The column as a double; what is no number is missing."""
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def _donors(shared, have: list[str], columns: int, k: int, cells: int = 2_000_000):
    """The ``k`` rows of a partition that are nearest to each query; some queries against a batch at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        q = shared.value
        best = None
        for frame in frames:
            frame = frame.sort_values("id")
            x = frame[have].to_numpy(float)
            n = (~np.isnan(x)).sum(axis=1)
            frame, x, n = frame[n > 0], x[n > 0], n[n > 0]
            if not len(x) or not len(q):
                continue
            near = [] if best is None else [best]
            for lo in range(0, len(q), max(1, cells // len(x))):
                part = q[lo : lo + max(1, cells // len(x))]
                d = np.zeros((len(part), len(x)))
                for c in range(len(have)):
                    d += np.nan_to_num((part[:, c, None] - x[:, c]) ** 2, nan=0.0)
                d = np.sqrt(d * columns / n)
                limit = np.partition(d, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
                ask, at = np.nonzero(d <= limit[:, None])  # ties at the edge stay
                near.append(pd.DataFrame({"ask": ask + lo, "_distance": d[ask, at], "_donor": frame["id"].to_numpy()[at], "_value": frame["_value"].to_numpy()[at]}))
            best = pd.concat(near).sort_values(["ask", "_distance", "_donor"]).groupby("ask").head(k)
        if best is not None:
            own = pd.DataFrame(q[best["ask"].to_numpy()], columns=have)
            yield own.assign(**{c: best[c].to_numpy() for c in ("_donor", "_distance", "_value")})

    return run
