"""Demand series over the star schema: sku is the brand, day the ship date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import timeseries as ops
from quillspark.plans.registry import Registry
from quillspark.sources.tables import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
query = R.query

# A small holiday calendar with a day of two names and a swapped working day.
HOLIDAYS = (
    ("1997-01-01", "new_year"),
    ("1997-02-07", "spring"),
    ("1997-02-14", "valentine"),
    ("1997-02-14", "normal"),
    ("1997-04-05", "qingming"),
    ("1997-05-01", "labor"),
    ("1997-06-09", "dragon_boat"),
    ("1997-06-18", "6.18"),
    ("1997-09-16", "moon_cake"),
    ("1997-10-01", "national"),
    ("1997-10-11", "normal"),
    ("1997-11-11", "do_11"),
)
_DAILY = """
daily AS (SELECT p_brand AS sku, l_shipdate::DATE AS day, sum(l_quantity) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
span AS (SELECT sku, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM daily GROUP BY sku),
dense AS (SELECT span.sku, span.day, coalesce(qty, 0) AS qty FROM span LEFT JOIN daily ON daily.sku = span.sku AND daily.day = span.day)
"""


def daily(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_shipdate", "l_quantity")
    part = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("sku"))
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("sku", F.col("l_shipdate").cast("date").alias("day")).agg(F.sum("l_quantity").alias("qty"))


def dense(spark: SparkSession, folder: str) -> DataFrame:
    return ops.densify(daily(spark, folder), ["sku"], "day", ["qty"])


def _w():
    return ops.by_day(["sku"], "day")


@query("densify_series", f"WITH {_DAILY} SELECT * FROM dense")
def densify_series(spark: SparkSession, folder: str) -> DataFrame:
    return dense(spark, folder)


@query(
    "densify_rowcount",
    """
    WITH f AS (SELECT o_custkey AS k, o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1, 2),
    s AS (SELECT k, unnest(generate_series(min(day)::TIMESTAMP, min(day)::TIMESTAMP + to_days((count(*) - 1)::INT), INTERVAL 1 DAY))::DATE AS day FROM f GROUP BY k)
    SELECT coalesce(s.k, f.k) AS k, coalesce(s.day, f.day) AS day, coalesce(n, 0) AS n FROM s FULL JOIN f ON s.k = f.k AND s.day = f.day
    """,
)
def densify_rowcount(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return ops.densify(rows, ["k"], "day", ["n"], mode="rowcount")


@query("lag_90_365", f"WITH {_DAILY} SELECT sku, day, lag(qty, 90) OVER w AS lag_90, lag(qty, 365) OVER w AS lag_365 FROM dense WINDOW w AS (PARTITION BY sku ORDER BY day)")
def lag_90_365(spark: SparkSession, folder: str) -> DataFrame:
    return dense(spark, folder).select("sku", "day", *[c.alias(n) for n, c in ops.lags("qty", _w(), (90, 365)).items()])


@query("rolling_7", f"WITH {_DAILY} SELECT sku, day, sum(qty) OVER (PARTITION BY sku ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS qty_week FROM dense")
def rolling_7(spark: SparkSession, folder: str) -> DataFrame:
    return dense(spark, folder).select("sku", "day", F.sum("qty").over(_w().rowsBetween(-6, 0)).alias("qty_week"))


def _frame(f: str, lo: int, hi: int) -> str:
    return f"{f} OVER (PARTITION BY sku ORDER BY day ROWS BETWEEN {lo} PRECEDING AND {hi} PRECEDING)"


@query(
    "rolling_after_lag",
    f"WITH {_DAILY} SELECT sku, day, "
    + ", ".join(f"round_even({_frame('avg(qty)', s + d - 1, s)}, 6) AS mean_{d}_{s}, round_even({_frame('stddev_samp(qty)', s + d - 1, s)}, 6) AS sd_{d}_{s}" for d, s in ((7, 90), (28, 365)))
    + " FROM dense",
)
def rolling_after_lag(spark: SparkSession, folder: str) -> DataFrame:
    panel = ops.rolling("qty", _w(), 7, 90) | ops.rolling("qty", _w(), 28, 365)
    return dense(spark, folder).select("sku", "day", *[F.bround(c, 6).alias(n) for n, c in panel.items()])


@query("weeks_ago_sum", f"WITH {_DAILY} SELECT sku, day, {', '.join(f'{_frame("sum(qty)", 7 * k + 6, 7 * k)} AS w{k}' for k in range(1, 14))} FROM dense")
def weeks_ago_sum(spark: SparkSession, folder: str) -> DataFrame:
    return dense(spark, folder).select("sku", "day", *[c.alias(n) for n, c in ops.week_panel("qty", _w(), range(1, 14)).items()])


@query("weeks_ago_mean4", f"WITH {_DAILY} SELECT sku, day, {', '.join(f'round_even({_frame("sum(qty)", 7 * k + 27, 7 * k)} / 28.0::DOUBLE, 6) AS m{k}' for k in range(1, 14))} FROM dense")
def weeks_ago_mean4(spark: SparkSession, folder: str) -> DataFrame:
    panel = ops.week_panel("qty", _w(), range(1, 14), 28, 28.0, "m")
    return dense(spark, folder).select("sku", "day", *[F.bround(c, 6).alias(n) for n, c in panel.items()])


@query("city_day_total", f"WITH {_DAILY} SELECT sku, day, qty, sum(qty) OVER (PARTITION BY day) AS city_day_total FROM daily")
def city_day_total(spark: SparkSession, folder: str) -> DataFrame:
    """The day's total comes from an aggregate joined back, so no day has to meet in one task."""
    rows = daily(spark, folder)
    return rows.join(rows.groupBy("day").agg(F.sum("qty").alias("city_day_total")), "day").select("sku", "day", "qty", "city_day_total")


@query(
    "city_total_weeks",
    f"WITH {_DAILY}, t AS (SELECT day, sum(qty) AS total FROM dense GROUP BY day) SELECT day, {', '.join(f'sum(total) OVER (ORDER BY day ROWS BETWEEN {7 * k + 6} PRECEDING AND {7 * k} PRECEDING) AS w{k}' for k in (1, 4, 13))} FROM t",
)
def city_total_weeks(spark: SparkSession, folder: str) -> DataFrame:
    """One row per day, so an unpartitioned window is bounded by the length of the calendar."""
    total = dense(spark, folder).groupBy("day").agg(F.sum("qty").alias("total"))
    return total.select("day", *[c.alias(n) for n, c in ops.week_panel("total", ops.by_day([], "day"), (1, 4, 13)).items()])


@query(
    "channel_rolling",
    f"""
    WITH {_DAILY}, t AS (SELECT day, sum(qty) AS total FROM dense GROUP BY day)
    SELECT day, CASE WHEN count(*) OVER w7 = 7 THEN round_even(avg(total) OVER w7, 6) END AS mean_7,
      CASE WHEN count(*) OVER w90 = 7 THEN round_even(avg(total) OVER w90, 6) END AS mean_7_90 FROM t
    WINDOW w7 AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w90 AS (ORDER BY day ROWS BETWEEN 96 PRECEDING AND 90 PRECEDING)
    """,
)
def channel_rolling(spark: SparkSession, folder: str) -> DataFrame:
    total = dense(spark, folder).groupBy("day").agg(F.sum("qty").alias("total"))
    w = ops.by_day([], "day")
    mean = lambda rows: ops.full_frame(F.bround(F.avg("total").over(w.rowsBetween(-rows, -rows + 6)), 6), w, 7, rows)
    return total.select("day", mean(6).alias("mean_7"), mean(96).alias("mean_7_90"))


@query(
    "lag_91",
    f"""
    WITH {_DAILY}, t AS (SELECT sku, day, qty, lag(qty, 91) OVER (PARTITION BY sku ORDER BY day) AS lag_91 FROM dense)
    SELECT sku, day, lag_91, round_even(avg(lag_91) OVER w, 6) AS mean, round_even(stddev_samp(lag_91) OVER w, 6) AS sd FROM t WINDOW w AS (PARTITION BY sku ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
    """,
)
def lag_91(spark: SparkSession, folder: str) -> DataFrame:
    """Sales of 91 days before, with the mean and deviation of seven such days."""
    rows = dense(spark, folder).withColumn("lag_91", F.lag("qty", 91).over(_w()))
    week = _w().rowsBetween(-6, 0)
    return rows.select("sku", "day", "lag_91", F.bround(F.avg("lag_91").over(week), 6).alias("mean"), F.bround(F.stddev_samp("lag_91").over(week), 6).alias("sd"))


@query(
    "last_year_sales",
    f"WITH {_DAILY.split('span AS')[0].rstrip().rstrip(',')} SELECT a.sku, a.day, a.qty, coalesce(b.qty, 0) AS last_year FROM daily a LEFT JOIN daily b ON a.sku = b.sku AND b.day = (a.day - INTERVAL 1 YEAR)::DATE WHERE month(a.day) = 11 AND day(a.day) BETWEEN 5 AND 18",
)
def last_year_sales(spark: SparkSession, folder: str) -> DataFrame:
    rows = daily(spark, folder)
    now = rows.where((F.month("day") == 11) & F.dayofmonth("day").between(5, 18)).withColumn("then", F.add_months("day", -12))
    before = rows.select(F.col("sku").alias("s"), F.col("day").alias("d"), F.col("qty").alias("last_year"))
    return now.join(before, (F.col("sku") == F.col("s")) & (F.col("then") == F.col("d")), "left").select("sku", "day", "qty", F.coalesce("last_year", F.lit(0.0)).alias("last_year"))


_VALUES = ", ".join(f"(DATE '{d}', '{n}')" for d, n in HOLIDAYS)


def _near(n: int) -> str:
    return f"""
    WITH c(day, name) AS (VALUES {_VALUES}), h AS (SELECT DISTINCT day FROM c WHERE name <> 'normal'), d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)
    SELECT d.day, count(CASE WHEN h.day >= d.day AND h.day < d.day + {n} THEN 1 END) AS holidays_after,
      count(CASE WHEN h.day < d.day AND h.day >= d.day - {n} THEN 1 END) AS holidays_before FROM d LEFT JOIN h ON TRUE GROUP BY d.day
    """


def _window_count(spark: SparkSession, folder: str, n: int) -> DataFrame:
    days = table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return ops.holiday_counts(days, "day", ops.calendar(spark, HOLIDAYS), n)


@query("holiday_window_count", _near(7))
def holiday_window_count(spark: SparkSession, folder: str) -> DataFrame:
    return _window_count(spark, folder, 7)


@query("holiday_window_count_3", _near(3))
def holiday_window_count_3(spark: SparkSession, folder: str) -> DataFrame:
    return _window_count(spark, folder, 3)


@query(
    "holiday_label_join",
    f"WITH c(day, name) AS (VALUES {_VALUES}), h AS (SELECT day, coalesce(min(CASE WHEN name <> 'normal' THEN name END), 'normal') AS name FROM c GROUP BY day) SELECT o_orderkey, coalesce(name, 'normal') AS label FROM orders LEFT JOIN h ON o_orderdate::DATE = day",
)
def holiday_label_join(spark: SparkSession, folder: str) -> DataFrame:
    holidays = F.broadcast(ops.calendar(spark, HOLIDAYS))  # a row per listed day
    return table(spark, folder, "orders").join(holidays, F.col("o_orderdate").cast("date") == F.col("day"), "left").select("o_orderkey", F.coalesce("name", F.lit("normal")).alias("label"))


@query(
    "append_future_days",
    f"WITH {_DAILY}, m AS (SELECT max(day) AS d FROM daily) SELECT sku, day, qty FROM daily WHERE day > (SELECT d - 30 FROM m) UNION ALL SELECT sku, (d + k::INT)::DATE AS day, 0 AS qty FROM (SELECT DISTINCT sku FROM daily), m, (SELECT unnest(generate_series(1, 14)) AS k)",
)
def append_future_days(spark: SparkSession, folder: str) -> DataFrame:
    rows = daily(spark, folder)
    last = F.broadcast(rows.agg(F.max("day").alias("last")))
    future = rows.select("sku").distinct().join(last).select("sku", F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", 14))).alias("day"), F.lit(0.0).alias("qty"))
    return rows.join(last).where(F.col("day") > F.date_sub("last", 30)).select("sku", "day", "qty").unionByName(future)


@query(
    "macro_join",
    "WITH m(q, gdp) AS (VALUES ('1997Q1', 6.1::DOUBLE), ('1997Q2', 6.4::DOUBLE), ('1997Q3', 6.2::DOUBLE), ('1997Q4', 6.6::DOUBLE)) SELECT o_orderkey, coalesce(gdp, 0) AS gdp FROM orders LEFT JOIN m ON q = year(o_orderdate) || 'Q' || ((month(o_orderdate) + 2) // 3)",
)
def macro_join(spark: SparkSession, folder: str) -> DataFrame:
    macro = F.broadcast(spark.createDataFrame([("1997Q1", 6.1), ("1997Q2", 6.4), ("1997Q3", 6.2), ("1997Q4", 6.6)], "q string, gdp double"))
    key = F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    return table(spark, folder, "orders").join(macro, key == F.col("q"), "left").select("o_orderkey", F.coalesce("gdp", F.lit(0.0)).alias("gdp"))


@query(
    "traffic_argmax",
    """
    WITH t AS (SELECT o_orderdate::DATE AS day, o_orderpriority AS device, o_orderstatus AS channel, sum(o_totalprice) AS traffic FROM orders GROUP BY 1, 2, 3)
    SELECT day, device, channel, round_even(total, 2) AS total FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY traffic DESC, device, channel) AS r, sum(traffic) OVER (PARTITION BY day) AS total FROM t) WHERE r = 1
    """,
)
def traffic_argmax(spark: SparkSession, folder: str) -> DataFrame:
    """Each day's total and the device and channel with the most traffic."""
    t = table(spark, folder, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("device"), F.col("o_orderstatus").alias("channel")).agg(F.sum("o_totalprice").alias("traffic"))
    top = t.groupBy("day").agg(F.min_by(F.struct("device", "channel"), F.struct(-F.col("traffic"), "device", "channel")).alias("top"), F.bround(F.sum("traffic"), 2).alias("total"))
    return top.select("day", "top.device", "top.channel", "total")
