"""Retail queries: city is the customer's nation, hub one of three, sku the brand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import retail as ops
from quillspark.operators import timeseries
from quillspark.plans.registry import Registry
from quillspark.plans.timeseries import _DAILY, daily, dense
from quillspark.sources.tables import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
query = R.query

_CITY = """
city_sales AS (SELECT c_nationkey AS city, p_brand AS sku, l_shipdate::DATE AS day, l_quantity AS qty
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
prefs AS (SELECT n_nationkey AS city, 'H' || h AS hub, (((n_nationkey + h) % 3) + 1)::INT AS rank, (1 + (n_nationkey * 7 + h * 3) % 5)::DOUBLE AS price FROM nation, (SELECT unnest([0, 1, 2]) AS h)),
home AS (SELECT city, hub FROM prefs WHERE rank = 1)
"""


def city_sales(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", F.col("l_shipdate").cast("date").alias("day"), F.col("l_quantity").alias("qty"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("city"))
    part = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("sku"))
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "city")
    return lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).select("city", "sku", "day", "qty")


def preferences(spark: SparkSession, folder: str) -> DataFrame:
    """A row per city and hub: two dimension tables, 75 rows."""
    n = table(spark, folder, "nation").select(F.col("n_nationkey").alias("city"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("h"))
    return n.select("city", F.concat(F.lit("H"), F.col("h").cast("string")).alias("hub"), ((F.col("city") + F.col("h")) % 3 + 1).cast("int").alias("rank"), (1 + (F.col("city") * 7 + F.col("h") * 3) % 5).cast("double").alias("price"))


@query(
    "sku_segments",
    """
    WITH p AS (SELECT l_partkey AS sku, sum(l_quantity) AS total, count(DISTINCT l_shipdate::DATE) AS days FROM lineitem GROUP BY 1),
    q AS (SELECT quantile_cont(total, 0.25) AS a, quantile_cont(total, 0.5) AS b FROM p)
    SELECT sku, total, days, CASE WHEN total >= b AND days >= 30 THEN 'normal' WHEN total >= a AND days BETWEEN 24 AND 30 THEN 'long_tail' ELSE 'seasonal' END AS segment FROM p, q
    """,
)
def sku_segments(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("sku"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_quantity").alias("qty"))
    return ops.segments(rows, "sku", "day", "qty", many=30, few=24)


@query("city_hub", f"WITH {_CITY} SELECT city, min_by(hub, rank) AS hub FROM prefs WHERE hub <> 'H1' GROUP BY city")
def city_hub(spark: SparkSession, folder: str) -> DataFrame:
    return ops.first_hub(preferences(spark, folder), "city", skip=("H1",))


@query(
    "hub_roll_up",
    f"WITH {_CITY} SELECT hub, sku, day, sum(qty) AS qty, round_even(avg(qty), 6) AS mean_qty, min(city) AS first_city FROM city_sales JOIN home USING (city) GROUP BY 1, 2, 3",
)
def hub_roll_up(spark: SparkSession, folder: str) -> DataFrame:
    home = F.broadcast(preferences(spark, folder).where("rank = 1").select("city", "hub"))
    return city_sales(spark, folder).join(home, "city").groupBy("hub", "sku", "day").agg(F.sum("qty").alias("qty"), F.bround(F.avg("qty"), 6).alias("mean_qty"), F.min("city").alias("first_city"))


@query("province_roll_up", f"WITH {_CITY} SELECT n_regionkey AS province, sku, day, sum(qty) AS qty FROM city_sales JOIN nation ON city = n_nationkey GROUP BY 1, 2, 3")
def province_roll_up(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("city"), F.col("n_regionkey").alias("province"))
    return city_sales(spark, folder).join(nation, "city").groupBy("province", "sku", "day").agg(F.sum("qty").alias("qty"))


_SHARES = " || '/' || ".join(f"printf('%.1f', round_even(100 * coalesce(sum(CASE WHEN hub = '{h}' THEN qty END), 0) / sum(qty), 1))" for h in ("H0", "H1", "H2"))


@query("hub_ratio", f"WITH {_CITY} SELECT sku, {_SHARES} AS ratio FROM city_sales JOIN home USING (city) GROUP BY sku")
def hub_ratio(spark: SparkSession, folder: str) -> DataFrame:
    home = F.broadcast(preferences(spark, folder).where("rank = 1").select("city", "hub"))
    wide = city_sales(spark, folder).join(home, "city").groupBy("sku").agg(*[F.sum(F.when(F.col("hub") == h, F.col("qty"))).alias(h) for h in ("H0", "H1", "H2")])
    return wide.select("sku", ops.share_string([F.col(h) for h in ("H0", "H1", "H2")]).alias("ratio"))


_MAY, _JUNE = "day BETWEEN DATE '1997-05-01' AND DATE '1997-05-31'", "day BETWEEN DATE '1997-06-01' AND DATE '1997-06-30'"


@query(
    "hub_split",
    f"""
    WITH {_CITY}, w AS (SELECT sku, sum(CASE WHEN hub = 'H0' AND {_MAY} THEN qty END) AS h0, sum(CASE WHEN hub = 'H1' AND {_MAY} THEN qty END) AS h1, sum(CASE WHEN hub = 'H2' AND {_MAY} THEN qty END) AS h2,
      coalesce(sum(CASE WHEN {_JUNE} THEN qty END), 0) AS total FROM city_sales JOIN home USING (city) GROUP BY sku)
    SELECT sku, unnest(['H0', 'H1', 'H2']) AS hub, round_even(total * unnest([coalesce(h0 / nullif(h0 + h1 + h2, 0), 1.0::DOUBLE / 3), coalesce(h1 / nullif(h0 + h1 + h2, 0), 1.0::DOUBLE / 3), coalesce(h2 / nullif(h0 + h1 + h2, 0), 1.0::DOUBLE / 3)]), 4) AS guess FROM w
    """,
)
def hub_split(spark: SparkSession, folder: str) -> DataFrame:
    """June's total of each sku dealt to the hubs by May's shares; a third each where May has no share."""
    home = F.broadcast(preferences(spark, folder).where("rank = 1").select("city", "hub"))
    rows = city_sales(spark, folder).join(home, "city")
    hubs = ("H0", "H1", "H2")
    may, june = F.expr(_MAY.replace("DATE '", "DATE'")), F.expr(_JUNE.replace("DATE '", "DATE'"))
    wide = rows.groupBy("sku").agg(*[F.sum(F.when((F.col("hub") == h) & may, F.col("qty"))).alias(h) for h in hubs], F.coalesce(F.sum(F.when(june, F.col("qty"))), F.lit(0.0)).alias("total"))
    every = F.col("H0") + F.col("H1") + F.col("H2")
    split = wide.select("sku", F.explode(F.array(*[F.struct(F.lit(h).alias("hub"), F.bround(F.col("total") * F.coalesce(F.try_divide(F.col(h), every), F.lit(1 / 3)), 4).alias("guess")) for h in hubs])).alias("x"))
    return split.select("sku", "x.hub", "x.guess")


def _round(r: int) -> str:
    return f"""
    a{r} AS (SELECT city, sku, hub, need, price, coalesce(stock, 0) AS stock, coalesce(sum(need) OVER (PARTITION BY hub, sku ORDER BY city ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM need{r} JOIN prefs USING (city) LEFT JOIN stock{r} USING (hub, sku) WHERE rank = {r} AND need > 0),
    t{r} AS (SELECT *, least(need, greatest(0, stock - before)) AS taken FROM a{r}),
    need{r + 1} AS (SELECT n.city, n.sku, n.need - coalesce(taken, 0) AS need FROM need{r} n LEFT JOIN t{r} ON n.city = t{r}.city AND n.sku = t{r}.sku),
    stock{r + 1} AS (SELECT s.hub, s.sku, s.stock - coalesce(used, 0) AS stock FROM stock{r} s LEFT JOIN (SELECT hub, sku, sum(taken) AS used FROM t{r} GROUP BY 1, 2) u ON s.hub = u.hub AND s.sku = u.sku)
    """


@query(
    "hub_alloc_cost",
    f"""
    WITH {_CITY}, need1 AS (SELECT city, sku, sum(qty) AS need FROM city_sales WHERE {_JUNE} GROUP BY 1, 2),
    stock1 AS (SELECT hub, sku, sum(qty) AS stock FROM city_sales JOIN home USING (city) WHERE {_MAY} GROUP BY 1, 2), {_round(1)}, {_round(2)}, {_round(3)}
    SELECT city, sku, hub, r AS "round", taken, taken * price AS cost FROM (SELECT *, 1 AS r FROM t1 UNION ALL SELECT *, 2 FROM t2 UNION ALL SELECT *, 3 FROM t3) WHERE taken > 0
    """,
)
def hub_alloc_cost(spark: SparkSession, folder: str) -> DataFrame:
    """June's demand served from stock as large as May's sales, in three rounds of preference."""
    sales, prefs = city_sales(spark, folder), preferences(spark, folder)
    need = sales.where(F.expr(_JUNE.replace("DATE '", "DATE'"))).groupBy("city", "sku").agg(F.sum("qty").alias("need"))
    home = F.broadcast(prefs.where("rank = 1").select("city", "hub"))
    stock = sales.where(F.expr(_MAY.replace("DATE '", "DATE'"))).join(home, "city").groupBy("hub", "sku").agg(F.sum("qty").alias("stock"))
    return ops.allocate(need, stock, prefs)


@query(
    "cross_hub_qty",
    f"""
    WITH {_CITY}, h AS (SELECT sku, hub, coalesce(sum(CASE WHEN {_MAY} THEN qty END), 0) AS guess, coalesce(sum(CASE WHEN {_JUNE} THEN qty END), 0) AS truth FROM city_sales JOIN home USING (city) GROUP BY 1, 2),
    t AS (SELECT sku, sum(guess) AS g, sum(truth) AS t FROM h GROUP BY 1)
    SELECT h.sku, round_even(sum(abs(coalesce(guess * (t / nullif(g, 0)), 0) - truth)) / 2, 6) AS crossed FROM h JOIN t ON h.sku = t.sku GROUP BY h.sku
    """,
)
def cross_hub_qty(spark: SparkSession, folder: str) -> DataFrame:
    home = F.broadcast(preferences(spark, folder).where("rank = 1").select("city", "hub"))
    part = lambda when: F.coalesce(F.sum(F.when(F.expr(when.replace("DATE '", "DATE'")), F.col("qty"))), F.lit(0.0))
    h = city_sales(spark, folder).join(home, "city").groupBy("sku", "hub").agg(part(_MAY).alias("guess"), part(_JUNE).alias("truth"))
    t = h.groupBy("sku").agg(F.sum("guess").alias("g"), F.sum("truth").alias("t"))
    off = F.abs(F.coalesce(F.col("guess") * F.try_divide("t", "g"), F.lit(0.0)) - F.col("truth"))
    return h.join(t, "sku").groupBy("sku").agg(F.bround(F.sum(off) / 2, 6).alias("crossed"))


@query(
    "leftover",
    f"WITH {_CITY}, h AS (SELECT sku, city % 2 AS channel, coalesce(sum(CASE WHEN {_MAY} THEN qty END), 0) AS guess, coalesce(sum(CASE WHEN {_JUNE} THEN qty END), 0) AS truth FROM city_sales GROUP BY 1, 2) SELECT sum(abs(guess - truth)) AS leftover, count(*) AS n FROM h",
)
def leftover(spark: SparkSession, folder: str) -> DataFrame:
    part = lambda when: F.coalesce(F.sum(F.when(F.expr(when.replace("DATE '", "DATE'")), F.col("qty"))), F.lit(0.0))
    h = city_sales(spark, folder).groupBy("sku", (F.col("city") % 2).alias("channel")).agg(part(_MAY).alias("guess"), part(_JUNE).alias("truth"))
    return h.agg(F.sum(F.abs(F.col("guess") - F.col("truth"))).alias("leftover"), F.count("*").alias("n"))


_GUESS = f"WITH {_DAILY}, g AS (SELECT sku, day, qty, avg(qty) OVER (PARTITION BY sku ORDER BY day ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS guess FROM dense)"


def _guesses(spark: SparkSession, folder: str) -> DataFrame:
    w = timeseries.by_day(["sku"], "day").rowsBetween(-28, -1)
    return dense(spark, folder).withColumn("guess", F.avg("qty").over(w)).where("guess IS NOT NULL")


@query("accuracy_metric", f"{_GUESS} SELECT sku, round_even(1 - sum(abs(qty - guess)) / sum(greatest(qty, guess)), 8) AS accuracy FROM g WHERE guess IS NOT NULL GROUP BY sku")
def accuracy_metric(spark: SparkSession, folder: str) -> DataFrame:
    return _guesses(spark, folder).groupBy("sku").agg(F.bround(ops.accuracy("qty", "guess"), 8).alias("accuracy"))


@query("rmse", f"{_GUESS} SELECT round_even(sqrt(avg(pow(qty - guess, 2))), 6) AS rmse, count(*) AS n FROM g WHERE guess IS NOT NULL")
def rmse(spark: SparkSession, folder: str) -> DataFrame:
    return _guesses(spark, folder).agg(F.bround(ops.rmse("qty", "guess"), 6).alias("rmse"), F.count("*").alias("n"))


@query(
    "vertical_report",
    f"WITH {_DAILY} SELECT sku, 'A' AS channel, greatest(0, round_even(sum(qty) / 10 - 100, 0)) AS qty FROM daily WHERE month(day) < 7 GROUP BY 1 UNION ALL SELECT sku, 'B', greatest(0, round_even(sum(qty) / 10 - 100, 0)) FROM daily WHERE month(day) >= 7 GROUP BY 1",
)
def vertical_report(spark: SparkSession, folder: str) -> DataFrame:
    """Forecasts of both channels, rounded and cut off at 0, under one another."""
    rows = daily(spark, folder)
    one = lambda when, tag: rows.where(when).groupBy("sku").agg(F.greatest(F.lit(0.0), F.bround(F.sum("qty") / 10 - 100, 0)).alias("qty")).select("sku", F.lit(tag).alias("channel"), "qty")
    return one(F.month("day") < 7, "A").unionByName(one(F.month("day") >= 7, "B"))
