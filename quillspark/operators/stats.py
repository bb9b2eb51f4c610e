"""Leave-one-out ratings, bootstrap errors, one-hot columns, cohorts."""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.stats import shrunk


def last_rating(df: DataFrame, user: str, item: str, value: str, order: str) -> DataFrame:
    """One rating for each user and item: the latest."""
    return df.groupBy(user, item).agg(F.max_by(value, order).alias(value))


def leave_one_out(ratings: DataFrame, key: str, value: str, shrink: bool) -> DataFrame:
    """``ratings`` with ``n, mean, sd`` of the key's other ratings, from sums alone.

    Without ``shrink`` they are null where there is no other rating. With it they
    are drawn towards the mean over all keys of the keys' means and deviations.
    """
    x = F.col(value)
    sums = ratings.groupBy(key).agg(F.count("*").alias("_n"), F.sum(value).alias("_s"), F.sum(x * x).alias("_q"))
    mu, var = F.col("_s") / F.col("_n"), F.greatest(F.lit(0.0), F.col("_q") / F.col("_n") - F.pow(F.col("_s") / F.col("_n"), 2))
    joined = ratings.join(sums, key)
    n = F.col("_n") - 1
    mean = F.try_divide(F.col("_s") - x, n)
    sd = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("_q") - x * x, n) - mean * mean))
    if shrink:
        overall = F.broadcast(sums.agg(F.avg(mu).alias("_M"), F.avg(F.sqrt(var)).alias("_SD")))
        joined = joined.join(overall)
        mean, sd = shrunk(n, mean, F.col("_M")), shrunk(n, sd, F.col("_SD"))
    return joined.select(*ratings.columns, n.alias("n"), mean.alias("mean"), sd.alias("sd"))


def leave_one_out_median(ratings: DataFrame, key: str, value: str) -> DataFrame:
    """``ratings`` with the median of the key's other ratings, from the middle order statistics of the key's histogram.

    Ranks come from running counts over a key's distinct values, so a key costs as
    many rows as it has distinct values.
    """
    counts = ratings.groupBy(key, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_hi", F.sum("_c").over(w)).withColumn("_lo", F.col("_hi") - F.col("_c") + 1)
    total = counts.groupBy(key).agg(F.sum("_c").alias("_n"))
    # without x the k-th smallest is the k-th, or the (k+1)-th where x ranks at or before it
    own = ranked.join(total, key).select(key, value, F.col("_lo").alias("_rank"), (F.col("_n") - 1).alias("_m"))
    half = F.floor((F.col("_m") + 1) / 2)
    want = own.select(key, value, "_m", F.explode(F.array_distinct(F.array(half, F.floor((F.col("_m") + 2) / 2)))).alias("_k"), "_rank").where("_m > 0").withColumn("_k", F.when(F.col("_rank") <= F.col("_k"), F.col("_k") + 1).otherwise(F.col("_k")))
    r = ranked.select(F.col(key).alias("_key"), F.col(value).alias("_v"), "_lo", "_hi")
    found = want.join(r, (F.col(key) == F.col("_key")) & F.col("_k").between(F.col("_lo"), F.col("_hi"))).groupBy(key, value).agg(F.avg("_v").alias("median"))
    return ratings.join(found, [key, value], "left")


def bootstrap(df: DataFrame, key: str, value: str, reps: int = 1000, seed: int = 0) -> DataFrame:
    """``mean, error`` of ``value`` by the Poisson bootstrap: every row counts a Poisson(1) number of times in every rep.

    Weights come from a hash of seed, rep and key, so they don't depend on the
    partitioning; sums are partial, and only the reps are shuffled.
    """
    rows = df.where(F.col(value).isNotNull()).select(key, value, F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    u = F.xxhash64(F.lit(seed), "rep", key) / F.lit(2.0**64) + 0.5
    weight, p, total = F.lit(0), 0.36787944117144233, 0.0
    for k in range(1, 9):
        total += p
        weight = F.when(u >= total, k).otherwise(weight) if k == 1 else weight + F.when(u >= total, 1).otherwise(0)
        p /= k
    means = rows.withColumn("_w", weight).groupBy("rep").agg(F.try_divide(F.sum(F.col("_w") * F.col(value)), F.sum("_w")).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("error"))


def parametric_bootstrap(df: DataFrame, value: str, kind: str, reps: int = 1000, seed: int = 0) -> DataFrame:
    """``mean, error`` of the means of ``reps`` samples as large as ``df`` from a distribution fitted to ``value``: ``normal``, ``bernoulli`` or ``poisson``.

    A sample's mean is drawn at once: the sum of ``n`` numbers of the fitted law is taken at its normal limit, for
    the two laws of whole numbers rounded to one. So a rep is one row, whatever the size of
    ``df``. Nulls don't count; no rows give nulls.
    """
    fit = df.agg(F.count(value).alias("n"), F.avg(value).alias("mu"), F.stddev_pop(value).alias("sd"))
    u = lambda k: F.xxhash64(F.lit(seed), F.lit(k), "rep") / F.lit(2.0**64) + 0.5
    z = F.sqrt(-2 * F.log(F.greatest(u(1), F.lit(1e-300)))) * F.cos(2 * math.pi * u(2))
    spread = {"normal": F.col("sd"), "bernoulli": F.sqrt(F.col("mu") * (1 - F.col("mu"))), "poisson": F.sqrt("mu")}[kind]
    total = F.col("mu") * F.col("n") + z * spread * F.sqrt("n")
    if kind != "normal":
        total = F.greatest(F.lit(0.0), F.round(total))
    if kind == "bernoulli":
        total = F.least(total, F.col("n").cast("double"))
    means = df.sparkSession.range(reps).withColumnRenamed("id", "rep").join(F.broadcast(fit)).select(F.try_divide(total, F.col("n")).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("error"))


def one_hot(df: DataFrame, column: str, values: Sequence[str], prefix: str, drop_first: bool = False) -> DataFrame:
    """A 0/1 column for each of ``values``, in their order."""
    return df.withColumns({f"{prefix}{k}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for k, v in enumerate(values) if k or not drop_first})


def multi_label(df: DataFrame, labels: Column, values: Sequence[str], prefix: str) -> DataFrame:
    """The same for a column of arrays; blanks around labels don't count."""
    clean = F.transform(labels, lambda x: F.trim(x))
    return df.withColumns({f"{prefix}{k}": F.coalesce(F.array_contains(clean, v).cast("int"), F.lit(0)) for k, v in enumerate(values)})
