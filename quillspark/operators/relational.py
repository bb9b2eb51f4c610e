"""Relational operators: frames in, frames out, every order made total by keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, key: str, k: int, count: str = "n") -> DataFrame:
    """The ``k`` most frequent keys, equal counts by key; partial counts, then a bounded heap in each task."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(count)).orderBy(F.desc(count), key).limit(k)


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every group; Spark cuts each group before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).drop("_rank")


def extreme_row(df: DataFrame, group: Sequence[str], order: Column, columns: Sequence[str], largest: bool = True) -> DataFrame:
    """One row per group: ``columns`` where ``order`` is largest (or smallest), by a partial aggregate rather than a sort."""
    pick = F.max_by if largest else F.min_by
    found = df.groupBy(*group).agg(pick(F.struct(*columns), order).alias("_row"))
    return found.select(*group, *[F.col(f"_row.{c}").alias(c) for c in columns])


def quantiles(df: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = (), accuracy: int = 100_000) -> DataFrame:
    """``by`` and an array ``_q`` of exact interpolated quantiles of ``column``; nulls don't count, without values the array is null.

    A sketch bounds every quantile first. Values below the bounds are only counted, those between them, about four in
    ``accuracy``, are gathered by value, so no task holds all distinct values.
    """
    x, keys = F.col(column), list(by)
    rows = df.select(*keys, x.cast("double").alias("_x")).where("_x IS NOT NULL")
    margin = [(max(0.0, q - 2 / accuracy), min(1.0, q + 2 / accuracy)) for q in shares]
    sketch = rows.groupBy(*keys).agg(F.percentile_approx("_x", [e for pair in margin for e in pair], accuracy).alias("_b"))
    held = F.broadcast(sketch.select(*[F.col(k).alias(f"_{k}") for k in keys], "_b"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    near = rows.join(held, reduce(lambda a, b: a & b, same)) if keys else rows.join(held)
    inside = lambda k: (F.col("_x") >= F.col("_b")[2 * k]) & (F.col("_x") <= F.col("_b")[2 * k + 1])
    each = lambda f: F.array(*[f(F.col("_b")[2 * k], F.col("_b")[2 * k + 1]) for k in range(len(shares))])
    counts = near.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        each(lambda lo, hi: F.count_if(F.col("_x") < lo)).alias("_below"),
        each(lambda lo, hi: F.max(F.when(F.col("_x") < lo, F.col("_x")))).alias("_before"),
        each(lambda lo, hi: F.min(F.when(F.col("_x") > hi, F.col("_x")))).alias("_after"),
    )
    which = F.filter(F.array(*[F.when(inside(k), F.lit(k)) for k in range(len(shares))]), lambda k: k.isNotNull())
    band = near.select(*keys, "_x", F.explode(which).alias("_k")).groupBy(*keys, "_k", "_x").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_k").orderBy("_x"))
    counted = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], "_n", "_below", "_before", "_after")
    placed = band.withColumn("_upto", upto)
    placed = placed.join(F.broadcast(counted), reduce(lambda a, b: a & b, same)) if keys else placed.join(F.broadcast(counted))
    rank = F.element_at(F.array(*[F.lit(float(q)) for q in shares]), F.col("_k") + 1) * (F.col("_n") - 1)
    below, before, after = (F.element_at(c, F.col("_k") + 1) for c in ("_below", "_before", "_after"))
    # a rank may lie one value outside the bounds
    at = lambda i: F.coalesce(F.min(F.when(i < below, before)), F.min(F.when(below + F.col("_upto") > i, F.col("_x"))), F.min(after))
    ends = placed.groupBy(*keys, "_k").agg(F.first(rank).alias("_r"), at(F.floor(rank)).alias("_lo"), at(F.ceil(rank)).alias("_hi"))
    value = F.when(F.floor("_r") == F.col("_r"), F.col("_lo")).otherwise((F.ceil("_r") - F.col("_r")) * F.col("_lo") + (F.col("_r") - F.floor("_r")) * F.col("_hi"))
    found = ends.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", value.alias("_v")))), lambda s: s["_v"]).alias("_q"))
    return found.select(*keys, F.when(F.size("_q") > 0, F.col("_q")).alias("_q"))


def iqr_filter(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Rows within ``k`` interquartile ranges of the quartiles (interpolated, exact); one row of bounds is broadcast."""
    bounds = quantiles(df, column, (0.25, 0.75))
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    return df.join(F.broadcast(bounds)).where((F.col(column) >= q1 - k * (q3 - q1)) & (F.col(column) <= q3 + k * (q3 - q1))).drop("_q")


def quantile_bins(df: DataFrame, column: str, out: str, parts: int = 4) -> DataFrame:
    """Number of the right-closed interval between exact interpolated quantiles, from 1; null stays null."""
    edges = quantiles(df, column, [k / parts for k in range(1, parts)]).withColumnRenamed("_q", "_edges")
    above = F.size(F.filter("_edges", lambda e: e < F.col(column)))
    return df.join(F.broadcast(edges)).withColumn(out, F.when(F.col(column).isNotNull(), above + 1).cast("int")).drop("_edges")


def custom_bins(column: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the right-closed interval; ``labels`` has one more than ``edges``."""
    out = F.when(column > edges[-1], labels[-1])
    for edge, label in reversed(list(zip(edges, labels, strict=False))):
        out = F.when(column <= edge, label).otherwise(out)
    return out


def adaptive_impute(df: DataFrame, numeric: Sequence[str], text: Sequence[str] = ()) -> DataFrame:
    """Fill nulls by their share: up to half the smallest mode, else the mean, 0 where all are null; text gets 'NA'.

    All statistics come from one pass; the row that holds them is broadcast. NaN counts as null.
    """
    clean = df.withColumns({c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c)) for c in numeric})
    stats = clean.agg(*[f for c in numeric for f in (F.avg(F.col(c).isNull().cast("int")).alias(f"_p_{c}"), F.mode(c, True).alias(f"_m_{c}"), F.avg(c).alias(f"_a_{c}"))])
    joined = clean.join(F.broadcast(stats))
    fill = {c: F.coalesce(F.col(c).cast("double"), F.when(F.col(f"_p_{c}") <= 0.5, F.col(f"_m_{c}").cast("double")).otherwise(F.col(f"_a_{c}")), F.lit(0.0)) for c in numeric}
    return joined.withColumns(fill | {c: F.coalesce(c, F.lit("NA")) for c in text}).select(*df.columns)


def mean_impute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    means = df.agg(*[F.avg(c).alias(f"_a_{c}") for c in columns])
    return df.join(F.broadcast(means)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_a_{c}")) for c in columns}).select(*df.columns)


def min_max(df: DataFrame, column: str, out: str) -> DataFrame:
    """Scaled to 0..1; 0 where all values are equal."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    return df.join(F.broadcast(ends)).withColumn(out, F.coalesce(F.try_divide(F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))).drop("_lo", "_hi")


def z_score(df: DataFrame, column: str, out: str) -> DataFrame:
    """Centred and divided by the population deviation; 0 where that is 0."""
    ends = df.agg(F.avg(column).alias("_mu"), F.stddev_pop(column).alias("_sd"))
    return df.join(F.broadcast(ends)).withColumn(out, F.coalesce(F.try_divide(F.col(column) - F.col("_mu"), F.nullif("_sd", F.lit(0.0))), F.lit(0.0))).drop("_mu", "_sd")
