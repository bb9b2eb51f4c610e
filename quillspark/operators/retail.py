"""Retail planning: segments, hub roll-up and shares, stock allocation and its cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.relational import quantiles
from quillspark.session import cut


def segments(daily: DataFrame, sku: str, day: str, qty: str, many: int = 168, few: int = 70, listed: DataFrame | None = None) -> DataFrame:
    """``sku, total, days, segment``: normal, long_tail or seasonal by the quartiles of total quantity and active days.

    Skus of ``listed`` that are neither long-tail nor seasonal by these rules join the normal ones.
    """
    per = daily.groupBy(sku).agg(F.sum(qty).alias("total"), F.countDistinct(day).alias("days"))
    cuts = F.broadcast(quantiles(per, "total", (0.25, 0.5)))
    normal = (F.col("total") >= F.col("_q")[1]) & (F.col("days") >= many)
    tail = (F.col("total") >= F.col("_q")[0]) & F.col("days").between(few, many)
    out = per.join(cuts).withColumn("segment", F.when(normal, "normal").when(tail, "long_tail").otherwise("seasonal")).drop("_q")
    if listed is not None:
        missing = listed.select(sku).distinct().join(out.select(sku), sku, "left_anti")
        out = out.unionByName(missing.select(sku, F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("days"), F.lit("normal").alias("segment")))
    return out


def first_hub(preferences: DataFrame, city: str, skip: Sequence[str] = ()) -> DataFrame:
    """``city, hub``: the best ranked hub that isn't skipped; ``preferences`` has ``city, hub, rank``, null ranks count for nothing."""
    open_ = preferences.where(F.col("rank").isNotNull() & ~F.col("hub").isin(*skip)) if skip else preferences.where(F.col("rank").isNotNull())
    return open_.groupBy(city).agg(F.min_by("hub", F.struct("rank", "hub")).alias("hub"))


def share_string(parts: Sequence[Column]) -> Column:
    """Shares of the parts in per cent to one place, joined by '/'; null parts count 0."""
    values = [F.coalesce(p, F.lit(0.0)) for p in parts]
    total = values[0]
    for v in values[1:]:
        total = total + v
    return F.concat_ws("/", *[F.format_string("%.1f", F.bround(F.coalesce(F.try_divide(100 * v, total), F.lit(0.0)), 1)) for v in values])


def depletion(need: Column, stock: Column, order: Window) -> Column:
    """What each row gets when rows take from ``stock`` one after the other: closed form of the loop by a running sum."""
    before = F.coalesce(F.sum(need).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return F.least(need, F.greatest(F.lit(0.0), stock - before))


def allocate(demand: DataFrame, stock: DataFrame, preferences: DataFrame, rounds: int = 3) -> DataFrame:
    """``city, sku, hub, round, taken, cost`` of serving ``demand`` (``city, sku, need``) from ``stock`` (``hub, sku, stock``).

    In round r every city asks its r-th hub of ``preferences`` (``city, hub, rank, price``)
    for what it still needs; within a hub and sku cities come in order of their key. What is left goes on to the next round.
    """
    open_need, open_stock, out = cut(demand), cut(stock), None
    for r in range(1, rounds + 1):
        asked = open_need.where("need > 0").join(F.broadcast(preferences.where(F.col("rank") == r)), "city").join(open_stock, ["hub", "sku"], "left").na.fill(0.0, ["stock"])
        order = Window.partitionBy("hub", "sku").orderBy("city")
        # each round reads the one before three times, so its lineage is cut
        served = cut(asked.withColumn("taken", depletion(F.col("need"), F.col("stock"), order)))
        rows = served.select("city", "sku", "hub", F.lit(r).alias("round"), "taken", (F.col("taken") * F.col("price")).alias("cost"))
        out = rows if out is None else out.unionByName(rows)
        if r < rounds:
            got = served.select("city", "sku", "taken")
            open_need = open_need.join(got, ["city", "sku"], "left").select("city", "sku", (F.col("need") - F.coalesce("taken", F.lit(0.0))).alias("need"))
            used = served.groupBy("hub", "sku").agg(F.sum("taken").alias("used"))
            open_stock = open_stock.join(used, ["hub", "sku"], "left").select("hub", "sku", (F.col("stock") - F.coalesce("used", F.lit(0.0))).alias("stock"))
    return out.where("taken > 0")


def accuracy(truth: str, guess: str) -> Column:
    """1 less the sum of absolute errors over the sum of the larger of both."""
    return 1 - F.try_divide(F.sum(F.abs(F.col(truth) - F.col(guess))), F.sum(F.greatest(truth, guess)))


def rmse(truth: str, guess: str) -> Column:
    return F.sqrt(F.avg(F.pow(F.col(truth) - F.col(guess), 2)))
