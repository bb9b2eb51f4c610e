"""Daily series: densified calendars, lag panels and calendar windows.

Frames count rows, so a series is made complete first (one row per day) and a
row offset is a day offset. All frames of a panel share one window key and order,
hence one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def densify(df: DataFrame, key: Sequence[str], day: str, values: Sequence[str], mode: str = "span") -> DataFrame:
    """One row per key and day; missing days get 0.

    ``span`` covers the first to the last day of a key, ``rowcount`` as many
    days from the first as the key has rows (days beyond keep their rows). The calendar is made per key from two
    aggregates, never by a product with a calendar table.
    """
    end = F.max(day) if mode == "span" else F.date_add(F.min(day), (F.count("*") - 1).cast("int"))
    span = df.groupBy(*key).agg(F.sequence(F.min(day), end).alias("_days")).select(*key, F.explode("_days").alias(day))
    how = "left" if mode == "span" else "full_outer"
    return span.join(df, [*key, day], how).withColumns({v: F.coalesce(v, F.lit(0).cast(df.schema[v].dataType)) for v in values})


def by_day(key: Sequence[str], day: str) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(day)


def full_frame(value: Column, window: WindowSpec, size: int, rows: int) -> Column:
    """``value`` where its frame holds ``size`` rows, else null."""
    return F.when(F.count(F.lit(1)).over(window.rowsBetween(-rows, -rows + size - 1)) == size, value)


def lags(column: str, window: WindowSpec, days: Sequence[int]) -> dict[str, Column]:
    return {f"lag_{d}": F.lag(column, d).over(window) for d in days}


def rolling(column: str, window: WindowSpec, days: int, skip: int = 0) -> dict[str, Column]:
    """Mean and sample deviation of ``days`` rows that end ``skip`` rows ago."""
    frame = window.rowsBetween(-skip - days + 1, -skip)
    return {f"mean_{days}_{skip}": F.avg(column).over(frame), f"sd_{days}_{skip}": F.stddev_samp(column).over(frame)}


def week_panel(column: str, window: WindowSpec, weeks: Sequence[int], width: int = 7, scale: float = 1.0, name: str = "w") -> dict[str, Column]:
    """Sums of ``width`` days that end ``7 * k`` days ago, for every k of ``weeks``, divided by ``scale``; null before the first day."""
    return {f"{name}{k}": F.sum(column).over(window.rowsBetween(-7 * k - width + 1, -7 * k)) / scale for k in weeks}


def calendar(spark, rows: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per date: of several names a real holiday wins over 'normal', then the first by name."""
    raw = spark.createDataFrame(list(rows), "day string, name string").select(F.to_date("day").alias("day"), "name")
    return raw.groupBy("day").agg(F.min_by("name", F.struct(F.col("name") == "normal", "name")).alias("name"))


def holiday_counts(days: DataFrame, day: str, holidays: DataFrame, within: int) -> DataFrame:
    """``days`` with the holidays in [d, d + within) and in [d - within, d); 'normal' days don't count.

    Every holiday is dealt to the days around it, so the range join is an equality join.
    """
    around = holidays.where("name <> 'normal'").select(F.explode(F.sequence(F.date_sub("day", within - 1), F.date_add("day", within))).alias("_d"), F.col("day").alias("_h"))
    near = around.groupBy("_d").agg(F.count_if(F.col("_h") >= F.col("_d")).alias("holidays_after"), F.count_if(F.col("_h") < F.col("_d")).alias("holidays_before"))
    return days.join(near, F.col(day) == F.col("_d"), "left").drop("_d").na.fill(0, ["holidays_after", "holidays_before"])
