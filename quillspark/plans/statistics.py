"""Cohorts, descriptive statistics, imputation, scaling and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import stats as fn
from quillspark.operators import relational, stats
from quillspark.plans.registry import Registry
from quillspark.sources.tables import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
query = R.query

_COHORT = """
f AS (SELECT o_custkey, min(o_orderdate) AS first FROM orders GROUP BY 1),
c AS (SELECT strftime(first, '%y-%m') AS cohort, round_even(floor((epoch(o_orderdate) - epoch(first)) / 86400) / 30, 0)::INT AS period, orders.o_custkey FROM orders JOIN f ON f.o_custkey = orders.o_custkey),
m AS (SELECT cohort, period, count(DISTINCT o_custkey) AS n FROM c GROUP BY 1, 2)
"""


def cohorts(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderdate")
    first = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"))
    rows = orders.join(first, "o_custkey").select("o_custkey", F.date_format("first", "yy-MM").alias("cohort"), fn.months_since(F.col("first"), F.col("o_orderdate")).alias("period"))
    return rows.groupBy("cohort", "period").agg(F.countDistinct("o_custkey").alias("n"))


@query(
    "cohort_matrix",
    f"""
    WITH {_COHORT}, g AS (SELECT c.cohort, p.period FROM (SELECT DISTINCT cohort FROM m) c, (SELECT unnest(generate_series(0, (SELECT max(period) FROM m))) AS period) p)
    SELECT g.cohort, string_agg(coalesce(n::VARCHAR, ''), ',' ORDER BY g.period) AS cells FROM g LEFT JOIN m ON m.cohort = g.cohort AND m.period = g.period GROUP BY g.cohort
    """,
)
def cohort_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """A line for each cohort with a cell for every period up to the last that any cohort has; cells without orders are empty."""
    m = cohorts(spark, folder)
    last = F.broadcast(m.agg(F.max("period").alias("last")))
    rows = m.groupBy("cohort").agg(F.map_from_entries(F.collect_list(F.struct("period", "n"))).alias("own")).join(last)
    cell = F.transform(F.sequence(F.lit(0), F.col("last").cast("int")), lambda p: F.coalesce(F.try_element_at("own", p.cast("int")).cast("string"), F.lit("")))
    return rows.select("cohort", F.array_join(cell, ",").alias("cells"))


@query("cohort_retention", f"WITH {_COHORT}, z AS (SELECT cohort, n AS n0 FROM m WHERE period = 0) SELECT m.cohort, period, n, round_even(n / n0, 6) AS retention FROM m JOIN z ON m.cohort = z.cohort")
def cohort_retention(spark: SparkSession, folder: str) -> DataFrame:
    m = cohorts(spark, folder)
    zero = m.where("period = 0").select("cohort", F.col("n").alias("n0"))
    return m.join(zero, "cohort").select("cohort", "period", "n", F.bround(F.col("n") / F.col("n0"), 6).alias("retention"))


@query("cohort_gap", "SELECT user_id, min(ts)::DATE AS first_day, round_even(floor((epoch(max(ts)) - epoch(min(ts))) / 86400) / 30, 0)::INT AS months, count(*) AS n FROM events GROUP BY 1")
def cohort_gap(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("user_id").agg(F.min("ts").cast("date").alias("first_day"), fn.months_since(F.min("ts"), F.max("ts")).alias("months"), F.count("*").alias("n"))


@query(
    "cohort_mean_gap",
    f"WITH {_COHORT} SELECT cohort, round_even(avg(period), 6) AS mean_period, count(*) AS n_orders FROM c GROUP BY 1",
)
def cohort_mean_gap(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderdate")
    first = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"))
    rows = orders.join(first, "o_custkey").select(F.date_format("first", "yy-MM").alias("cohort"), fn.months_since(F.col("first"), F.col("o_orderdate")).alias("period"))
    return rows.groupBy("cohort").agg(F.bround(F.avg("period"), 6).alias("mean_period"), F.count("*").alias("n_orders"))


@query("email_eda", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round_even(avg(value), 6) AS mean, round_even(stddev_samp(value), 6) AS sd, round_even(sum(value), 3) AS total, round_even(count(*) / (SELECT count(*) FROM events), 6) AS rate FROM events GROUP BY 1")
def email_eda(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    whole = F.broadcast(e.agg(F.count("*").alias("all")))
    per = e.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.bround(F.avg("value"), 6).alias("mean"), F.bround(F.stddev_samp("value"), 6).alias("sd"), F.bround(F.sum("value"), 3).alias("total"))
    return per.join(whole).withColumn("rate", F.bround(F.col("n") / F.col("all"), 6)).drop("all")


@query("null_rate", "SELECT round_even(avg(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END), 8) AS p_balance, round_even(avg(CASE WHEN c_nationkey > 20 THEN 1 ELSE 0 END), 8) AS p_nation FROM customer")
def null_rate(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").select(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"), F.when(F.col("c_nationkey") <= 20, F.col("c_nationkey")).alias("nation"))
    return rows.agg(*[F.bround(F.avg(F.col(c).isNull().cast("int")), 8).alias(f"p_{c}") for c in rows.columns])


@query(
    "two_level_mean_std",
    """
    WITH r AS (SELECT user_id, CAST(json_extract(props, '$.k') AS INT) AS k, max_by(value, event_id) AS v FROM events GROUP BY 1, 2), u AS (SELECT user_id, avg(v) AS m, stddev_pop(v) AS s FROM r GROUP BY 1)
    SELECT round_even(avg(m), 6) AS mean_of_means, round_even(avg(s), 6) AS mean_of_sds, count(*) AS n FROM u
    """,
)
def two_level_mean_std(spark: SparkSession, folder: str) -> DataFrame:
    per = ratings(spark, folder).groupBy("user_id").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return per.agg(F.bround(F.avg("m"), 6).alias("mean_of_means"), F.bround(F.avg("s"), 6).alias("mean_of_sds"), F.count("*").alias("n"))


_RATINGS = "r AS (SELECT user_id, CAST(json_extract(props, '$.k') AS INT) AS k, max_by(value, event_id) AS v FROM events GROUP BY 1, 2)"


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """One value for each user and item of the events: the latest."""
    e = table(spark, folder, "events").select("event_id", "user_id", F.expr("cast(get_json_object(props, '$.k') AS INT)").alias("k"), F.col("value").alias("v"))
    return stats.last_rating(e, "user_id", "k", "v", "event_id")


@query("user_item_stats", f"WITH {_RATINGS} SELECT k, count(*) AS n, round_even(avg(v), 6) AS mean, round_even(stddev_pop(v), 6) AS sd, round_even(median(v), 6) AS med, round_even(sum(v), 4) AS total FROM r GROUP BY 1")
def user_item_stats(spark: SparkSession, folder: str) -> DataFrame:
    return ratings(spark, folder).groupBy("k").agg(F.count("*").alias("n"), F.bround(F.avg("v"), 6).alias("mean"), F.bround(F.stddev_pop("v"), 6).alias("sd"), F.bround(F.median("v"), 6).alias("med"), F.bround(F.sum("v"), 4).alias("total"))


_LOO = f"""
WITH {_RATINGS}, s AS (SELECT user_id, count(*) AS c, sum(v) AS s, sum(v * v) AS q FROM r GROUP BY 1),
l AS (SELECT r.user_id, k, v, c - 1 AS n, (s - v) / nullif(c - 1, 0) AS m, sqrt(greatest(0, (q - v * v) / nullif(c - 1, 0) - pow((s - v) / nullif(c - 1, 0), 2))) AS sd FROM r JOIN s ON r.user_id = s.user_id)
"""


@query("loo_stats", f"{_LOO} SELECT user_id, k, n, round_even(m, 6) AS mean, round_even(CASE WHEN n > 0 THEN sd END, 5) AS sd FROM l")
def loo_stats(spark: SparkSession, folder: str) -> DataFrame:
    found = stats.leave_one_out(ratings(spark, folder), "user_id", "v", shrink=False)
    return found.select("user_id", "k", "n", F.bround("mean", 6).alias("mean"), F.bround(F.when(F.col("n") > 0, F.col("sd")), 5).alias("sd"))


@query(
    "loo_stats_shrunk",
    f"""
    {_LOO}, g AS (SELECT avg(s / c) AS gm, avg(sqrt(greatest(0, q / c - pow(s / c, 2)))) AS gs FROM s)
    SELECT user_id, k, n, round_even(CASE WHEN n = 0 THEN gm WHEN n < 3 THEN (gm + m) / 2 ELSE m END, 6) AS mean, round_even(CASE WHEN n = 0 THEN gs WHEN n < 3 THEN (gs + sd) / 2 ELSE sd END, 5) AS sd FROM l, g
    """,
)
def loo_stats_shrunk(spark: SparkSession, folder: str) -> DataFrame:
    found = stats.leave_one_out(ratings(spark, folder), "user_id", "v", shrink=True)
    return found.select("user_id", "k", "n", F.bround("mean", 6).alias("mean"), F.bround("sd", 5).alias("sd"))


@query("loo_median", f"WITH {_RATINGS}, n AS (SELECT a.user_id, a.k, median(b.v) AS m FROM r a JOIN r b ON a.user_id = b.user_id AND a.k <> b.k GROUP BY 1, 2) SELECT r.user_id, r.k, round_even(m, 6) AS median FROM r LEFT JOIN n ON r.user_id = n.user_id AND r.k = n.k")
def loo_median(spark: SparkSession, folder: str) -> DataFrame:
    return stats.leave_one_out_median(ratings(spark, folder), "user_id", "v").select("user_id", "k", F.bround("median", 6).alias("median"))


@query(
    "adaptive_impute",
    """
    WITH x AS (SELECT c_custkey, CASE WHEN c_nationkey > 4 THEN c_nationkey END AS a, CASE WHEN c_nationkey > 20 THEN c_acctbal END AS b, NULL::DOUBLE AS c, CASE WHEN c_nationkey > 10 THEN c_mktsegment END AS t FROM customer),
    m AS (SELECT min(a) AS a FROM (SELECT a, count(*) AS n FROM x WHERE a IS NOT NULL GROUP BY a QUALIFY rank() OVER (ORDER BY n DESC) = 1)), s AS (SELECT avg(b) AS b FROM x)
    SELECT c_custkey, coalesce(x.a, m.a)::DOUBLE AS a, round_even(coalesce(x.b, s.b), 6) AS b, 0.0::DOUBLE AS c, coalesce(t, 'NA') AS t FROM x, m, s
    """,
)
def adaptive_impute(spark: SparkSession, folder: str) -> DataFrame:
    nation = F.col("c_nationkey")
    rows = table(spark, folder, "customer").select("c_custkey", F.when(nation > 4, nation).alias("a"), F.when(nation > 20, F.col("c_acctbal")).alias("b"), F.lit(None).cast("double").alias("c"), F.when(nation > 10, F.col("c_mktsegment")).alias("t"))
    return relational.adaptive_impute(rows, ["a", "b", "c"], ["t"]).withColumn("b", F.bround("b", 6))


@query("mean_impute", "WITH x AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS b FROM customer) SELECT c_custkey, round_even(coalesce(b, (SELECT avg(b) FROM x)), 6) AS b FROM x")
def mean_impute(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("b"))
    return relational.mean_impute(rows, ["b"]).withColumn("b", F.bround("b", 6))


@query("qcut_quartile", "WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.5) AS b, quantile_cont(c_acctbal, 0.75) AS c FROM customer) SELECT c_custkey, (1 + (c_acctbal > a)::INT + (c_acctbal > b)::INT + (c_acctbal > c)::INT)::INT AS quartile FROM customer, q")
def qcut_quartile(spark: SparkSession, folder: str) -> DataFrame:
    return relational.quantile_bins(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "quartile").drop("c_acctbal")


@query("custom_bins", "SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'medium' ELSE 'large' END AS bin FROM part")
def custom_bins(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", relational.custom_bins(F.col("p_size"), [10, 30], ["small", "medium", "large"]).alias("bin"))


@query("minmax_scale", "SELECT c_custkey, round_even((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 8) AS scaled FROM customer")
def minmax_scale(spark: SparkSession, folder: str) -> DataFrame:
    return relational.min_max(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "x").select("c_custkey", F.bround("x", 8).alias("scaled"))


@query("zscore", "SELECT c_custkey, round_even((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 7) AS z FROM customer")
def zscore(spark: SparkSession, folder: str) -> DataFrame:
    return relational.z_score(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "x").select("c_custkey", F.bround("x", 7).alias("z"))


@query("l2_normalize", "SELECT vec_id, round_even((embedding[1] / sqrt(list_dot_product(embedding, embedding)))::DOUBLE, 4) AS first, round_even((embedding[64] / sqrt(list_dot_product(embedding, embedding)))::DOUBLE, 4) AS last FROM embeddings")
def l2_normalize(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    norm = F.sqrt(F.aggregate(F.transform("e", lambda x: x * x), F.lit(0.0), lambda a, x: a + x))
    return e.withColumn("norm", norm).select("vec_id", F.bround(F.col("e")[0] / F.col("norm"), 4).alias("first"), F.bround(F.col("e")[63] / F.col("norm"), 4).alias("last"))


@query("onehot", "SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT AS seg_1, (c_mktsegment = 'FURNITURE')::INT AS seg_2, (c_mktsegment = 'MACHINERY')::INT AS seg_3 FROM customer")
def onehot(spark: SparkSession, folder: str) -> DataFrame:
    """Columns for the sorted segments but the first."""
    rows = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return stats.one_hot(rows, "c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"], "seg_", drop_first=True).drop("c_mktsegment")


@query("multilabel", "SELECT p_partkey, list_contains(string_split(p_type, ' '), 'STEEL')::INT AS tag_0, list_contains(string_split(p_type, ' '), 'SMALL')::INT AS tag_1 FROM part")
def multilabel(spark: SparkSession, folder: str) -> DataFrame:
    return stats.multi_label(table(spark, folder, "part").select("p_partkey", "p_type"), F.split("p_type", " "), ["STEEL", "SMALL"], "tag_").drop("p_type")


_X = "(mean - 25.0::DOUBLE) / error"


@query(
    "wald_chi2",
    f"""
    WITH g AS (SELECT l_returnflag, avg(l_quantity) AS mean, stddev_samp(l_quantity) / sqrt(count(*)) AS error FROM lineitem GROUP BY 1)
    SELECT l_returnflag, round_even({_X}, 4) AS wald, round_even(1 - {fn.normal_cdf_sql(f'abs({_X})')}, 5) AS p_wald, round_even(pow({_X}, 2), 3) AS chi2, round_even(2 * (1 - {fn.normal_cdf_sql(f'abs({_X})')}), 5) AS p_chi2,
      round_even(mean - 1.2815515655446004::DOUBLE * error, 6) AS ci_lo, round_even(mean + 1.2815515655446004::DOUBLE * error, 6) AS ci_hi FROM g
    """,
)
def wald_chi2(spark: SparkSession, folder: str) -> DataFrame:
    """Wald and chi-square statistics of the mean against 25, and the interval from the 0.90 quantile."""
    from statistics import NormalDist

    q = F.col("l_quantity")
    g = table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.avg(q).alias("mean"), (F.stddev_samp(q) / F.sqrt(F.count(q))).alias("error"))
    w, z = fn.wald(F.col("mean"), F.lit(25.0), F.col("error")), NormalDist().inv_cdf(0.9)
    return g.select(
        "l_returnflag", F.bround(w, 4).alias("wald"), F.bround(fn.wald_p(w), 5).alias("p_wald"), F.bround(w * w, 3).alias("chi2"), F.bround(fn.chi2_p(w * w), 5).alias("p_chi2"), F.bround(F.col("mean") - z * F.col("error"), 6).alias("ci_lo"), F.bround(F.col("mean") + z * F.col("error"), 6).alias("ci_hi")
    )


@query(
    "diff_tests",
    " UNION ALL ".join(
        f"SELECT '{n}' AS measure, round_even(avg({d}), 6) AS mean, round_even(stddev_samp({d}), 6) AS sd, round_even(avg({d}) / (stddev_samp({d}) / sqrt(count(*))), 4) AS wald FROM lineitem"
        for n, d in (("discount_tax", "l_discount - l_tax"), ("quantity_line", "l_quantity - l_linenumber"))
    ),
)
def diff_tests(spark: SparkSession, folder: str) -> DataFrame:
    """Paired differences of several attributes, tested against 0 in one pass."""
    rows = table(spark, folder, "lineitem").select((F.col("l_discount") - F.col("l_tax")).alias("discount_tax"), (F.col("l_quantity") - F.col("l_linenumber")).alias("quantity_line"))
    long = rows.unpivot([], ["discount_tax", "quantity_line"], "measure", "d")
    g = long.groupBy("measure").agg(F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), F.count("d").alias("n"))
    return g.select("measure", F.bround("mean", 6).alias("mean"), F.bround("sd", 6).alias("sd"), F.bround(F.col("mean") / (F.col("sd") / F.sqrt("n")), 4).alias("wald"))


@query("bootstrap_se")
def bootstrap_se(spark: SparkSession, folder: str) -> DataFrame:
    return stats.bootstrap(table(spark, folder, "customer"), "c_custkey", "c_acctbal", reps=1000)


@query("bootstrap_parametric")
def bootstrap_parametric(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of a mean from samples drawn of a fitted normal, Bernoulli and Poisson distribution."""
    rows = table(spark, folder, "customer").select("c_acctbal", (F.col("c_acctbal") > 0).cast("double").alias("positive"), (F.col("c_nationkey") * 1.0).alias("nation"))
    kinds = (("normal", "c_acctbal"), ("bernoulli", "positive"), ("poisson", "nation"))
    parts = [stats.parametric_bootstrap(rows, column, kind).select(F.lit(kind).alias("kind"), "mean", "error") for kind, column in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("utility_score", "SELECT p_partkey, round_even(p_size * 10 - p_retailprice / 10, 4) AS score FROM part ORDER BY p_size * 10 - p_retailprice / 10 DESC, p_partkey LIMIT 10")
def utility_score(spark: SparkSession, folder: str) -> DataFrame:
    score = F.col("p_size") * 10 - F.col("p_retailprice") / 10
    return table(spark, folder, "part").select("p_partkey", score.alias("raw")).orderBy(F.desc("raw"), "p_partkey").limit(10).select("p_partkey", F.bround("raw", 4).alias("score"))


@query("ols_no_intercept", "SELECT round_even(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 4) AS slope, round_even(regr_slope(l_extendedprice, l_quantity), 4) AS slope_i, round_even(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round_even(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def ols_no_intercept(spark: SparkSession, folder: str) -> DataFrame:
    """Least squares through the origin and with an intercept, from sums."""
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, folder, "lineitem").agg(F.bround(F.sum(x * y) / F.sum(x * x), 4).alias("slope"), F.bround(F.regr_slope(y, x), 4).alias("slope_i"), F.bround(F.regr_intercept(y, x), 2).alias("intercept"), F.bround(F.regr_r2(y, x), 6).alias("r2"))


@query("heat_frames", "WITH s AS (SELECT min(value) AS a, max(value) AS b FROM events) SELECT event_id, round_even((value - a) / (b - a), 6) AS score, strftime(ts, '%Y-%m-%d %H:00') AS frame, CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0.001::DOUBLE END AS weight FROM events, s")
def heat_frames(spark: SparkSession, folder: str) -> DataFrame:
    rows = relational.min_max(table(spark, folder, "events"), "value", "x")
    return rows.select("event_id", F.bround("x", 6).alias("score"), F.date_format("ts", "yyyy-MM-dd HH:00").alias("frame"), F.when(F.col("event_type") == "click", 1.0).otherwise(0.001).alias("weight"))
