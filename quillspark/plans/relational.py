"""Relational queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import bytes_number
from quillspark.operators import relational as ops
from quillspark.plans.registry import Registry
from quillspark.sources.tables import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
query = R.query


@query("scan_parquet", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def scan_parquet(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


@query("project", "SELECT l_orderkey AS order_key, l_quantity * l_extendedprice AS gross, l_returnflag || '-' || l_linestatus AS flags FROM lineitem")
def project(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("order_key"), (F.col("l_quantity") * F.col("l_extendedprice")).alias("gross"), F.concat_ws("-", "l_returnflag", "l_linestatus").alias("flags"))


@query("filter_year_count", "SELECT count(*) AS n_orders FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'")
def filter_year_count(spark: SparkSession, folder: str) -> DataFrame:
    when = F.col("o_orderdate")
    return table(spark, folder, "orders").where((when >= F.lit("1998-01-01").cast("timestamp_ntz")) & (when < F.lit("1999-01-01").cast("timestamp_ntz"))).agg(F.count("*").alias("n_orders"))


@query("filter_in_not_in", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
def filter_in_not_in(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").where(F.col("o_orderstatus").isin("F", "O") & ~F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).select("o_orderkey", "o_orderpriority")


@query("filter_range", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_discount BETWEEN 0.03 AND 0.05")
def filter_range(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").where((F.col("l_quantity") >= 10) & (F.col("l_quantity") < 20) & F.col("l_discount").between(0.03, 0.05)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("indicator_counts", "SELECT l_returnflag, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)::BIGINT AS n_high, count(*) AS n FROM lineitem GROUP BY 1")
def indicator_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_discount") > 0.05).alias("n_high"), F.count("*").alias("n"))


@query("having_group_size", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def having_group_size(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


@query("recode_values", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' WHEN c_mktsegment = '' THEN 'None' ELSE 'other' END AS segment, greatest(c_acctbal, 0) AS balance, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS overdrawn FROM customer")
def recode_values(spark: SparkSession, folder: str) -> DataFrame:
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "B").when(F.col("c_mktsegment") == "", "None").otherwise("other")
    return table(spark, folder, "customer").select("c_custkey", segment.alias("segment"), F.greatest("c_acctbal", F.lit(0.0)).alias("balance"), (F.col("c_acctbal") < 0).cast("int").alias("overdrawn"))


@query("fill_sentinel", "SELECT c_custkey, coalesce(nullif(c_acctbal, c_acctbal::INT::DOUBLE), -1) AS filled, coalesce(CASE WHEN c_nationkey > 12 THEN c_nationkey END, 0) AS nation FROM customer")
def fill_sentinel(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").select("c_custkey", F.when(F.col("c_acctbal") != F.bround("c_acctbal", 0), F.col("c_acctbal")).alias("filled"), F.when(F.col("c_nationkey") > 12, F.col("c_nationkey")).alias("nation"))
    return rows.na.fill({"filled": -1.0, "nation": 0})


@query("november_calendar", "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE month(o_orderdate) = 11 AND day(o_orderdate) BETWEEN 5 AND 18")
def november_calendar(spark: SparkSession, folder: str) -> DataFrame:
    day = F.col("o_orderdate")
    return table(spark, folder, "orders").where((F.month(day) == 11) & F.dayofmonth(day).between(5, 18)).select("o_orderkey", day.cast("date").alias("day"))


@query(
    "review_summary",
    "SELECT count(*) AS n_review, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS n_click, count(DISTINCT user_id) AS n_user, count(DISTINCT json_extract_string(props, '$.k')) AS n_item FROM events",
)
def review_summary(spark: SparkSession, folder: str) -> DataFrame:
    item = F.get_json_object("props", "$.k")
    return table(spark, folder, "events").agg(F.count("*").alias("n_review"), F.count_if(F.col("event_type") == "click").alias("n_click"), F.countDistinct("user_id").alias("n_user"), F.countDistinct(item).alias("n_item"))


@query("top10_users", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10")
def top10_users(spark: SparkSession, folder: str) -> DataFrame:
    return ops.top_k(table(spark, folder, "orders"), "o_custkey", 10)


@query("top10_items", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 10")
def top10_items(spark: SparkSession, folder: str) -> DataFrame:
    return ops.top_k(table(spark, folder, "lineitem"), "l_suppkey", 10)


@query(
    "group_avg_sorted",
    """
    SELECT n_name, c_mktsegment, round_even(avg(o_totalprice), 4) AS avg_price
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY n_name, c_mktsegment
    """,
)
def group_avg_sorted(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_custkey", "o_totalprice")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name", "c_mktsegment")
        .agg(F.bround(F.avg("o_totalprice"), 4).alias("avg_price"))
        .orderBy(F.desc("avg_price"), "n_name", "c_mktsegment")
    )


@query("group_stats", "SELECT l_returnflag, count(l_quantity) AS n, round_even(avg(l_quantity), 6) AS mean, round_even(stddev_samp(l_quantity), 6) AS sd, min(l_quantity) AS lo, max(l_quantity) AS hi, round_even(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def group_stats(spark: SparkSession, folder: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.count(q).alias("n"), F.bround(F.avg(q), 6).alias("mean"), F.bround(F.stddev_samp(q), 6).alias("sd"), F.min(q).alias("lo"), F.max(q).alias("hi"), F.bround(F.sum("l_extendedprice"), 2).alias("total"))


@query("group_sets", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_kinds, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS kinds FROM orders GROUP BY 1")
def group_sets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("s")).select("o_custkey", F.size("s").cast("long").alias("n_kinds"), F.array_join(F.array_sort("s"), ",").alias("kinds"))


@query("partition_profile", "SELECT (ascii(upper(left(c_name, 1))) + c_custkey) % 7 AS bucket, count(*) AS n_rows FROM customer GROUP BY 1")
def partition_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that a partitioner by the first character's code and the key puts into each of seven buckets."""
    return table(spark, folder, "customer").groupBy(F.pmod(F.ascii(F.upper(F.left("c_name", F.lit(1)))) + F.col("c_custkey"), F.lit(7)).alias("bucket")).agg(F.count("*").alias("n_rows"))


@query("explode_top20", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1 ORDER BY n DESC, word LIMIT 20")
def explode_top20(spark: SparkSession, folder: str) -> DataFrame:
    return ops.top_k(table(spark, folder, "part").select(F.explode(F.split("p_name", " ")).alias("word")), "word", 20)


@query(
    "iqr_filter",
    """
    WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, q WHERE l_extendedprice >= a - 1.5::DOUBLE * (b - a) AND l_extendedprice <= b + 1.5::DOUBLE * (b - a)
    """,
)
def iqr_filter(spark: SparkSession, folder: str) -> DataFrame:
    return ops.iqr_filter(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice")


@query("quantiles", "SELECT l_returnflag, round_even(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round_even(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round_even(quantile_cont(l_extendedprice, 0.9), 4) AS q90 FROM lineitem GROUP BY 1")
def quantiles(spark: SparkSession, folder: str) -> DataFrame:
    found = ops.quantiles(table(spark, folder, "lineitem"), "l_extendedprice", (0.25, 0.5, 0.9), ["l_returnflag"])
    return found.select("l_returnflag", *[F.bround(F.col("_q")[k], 4).alias(n) for k, n in enumerate(("q25", "q50", "q90"))])


_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "summary_stats",
    " UNION ALL ".join(
        f"SELECT '{c}' AS measure, count({c}) AS n, round_even(avg({c}), 6) AS mean, round_even(stddev_samp({c}), 6) AS sd, min({c}) AS lo, round_even(quantile_cont({c}, 0.5), 6) AS median, max({c}) AS hi FROM lineitem" for c in _MEASURES
    ),
)
def summary_stats(spark: SparkSession, folder: str) -> DataFrame:
    one = lambda c: F.struct(F.lit(c).alias("measure"), F.count(c).alias("n"), F.bround(F.avg(c), 6).alias("mean"), F.bround(F.stddev_samp(c), 6).alias("sd"), F.min(c).alias("lo"), F.bround(F.percentile(c, F.lit(0.5)), 6).alias("median"), F.max(c).alias("hi"))
    return table(spark, folder, "lineitem").agg(F.array(*[one(c) for c in _MEASURES]).alias("rows")).select(F.inline("rows"))


@query("corr_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round_even(corr({a}, {b}), 6) AS r FROM lineitem" for a in _MEASURES for b in _MEASURES if a < b))
def corr_matrix(spark: SparkSession, folder: str) -> DataFrame:
    pairs = [(a, b) for a in _MEASURES for b in _MEASURES if a < b]
    return table(spark, folder, "lineitem").agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.bround(F.corr(a, b), 6).alias("r")) for a, b in pairs]).alias("rows")).select(F.inline("rows"))


@query("semi_join", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_join(spark: SparkSession, folder: str) -> DataFrame:
    urgent = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")
    return table(spark, folder, "customer").select("c_custkey", "c_name").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("anti_join", "SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey")
    return table(spark, folder, "orders").select("o_orderkey", "o_totalprice").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("left_default", "SELECT c_custkey, coalesce(n, 0) AS n_orders, round_even(coalesce(total, 0), 2) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def left_default(spark: SparkSession, folder: str) -> DataFrame:
    totals = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return table(spark, folder, "customer").join(totals, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.bround(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query("right_fill", "SELECT n_nationkey, coalesce(n, 0) AS n_rich FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9900 GROUP BY 1) RIGHT JOIN nation ON c_nationkey = n_nationkey")
def right_fill(spark: SparkSession, folder: str) -> DataFrame:
    rich = table(spark, folder, "customer").where("c_acctbal > 9900").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return rich.join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "right").select("n_nationkey", F.coalesce("n", F.lit(0)).alias("n_rich"))


@query(
    "full_outer_join",
    """
    SELECT coalesce(a.k, b.k) AS nation, coalesce(a.n, 0) AS n_customers, coalesce(b.n, 0) AS n_suppliers
    FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1) a
    FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey % 4 <> 0 GROUP BY 1) b ON a.k = b.k
    """,
)
def full_outer_join(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "customer").where("c_nationkey % 3 <> 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n_customers"))
    b = table(spark, folder, "supplier").where("s_nationkey % 4 <> 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n_suppliers"))
    return a.join(b, "nation", "full_outer").na.fill(0, ["n_customers", "n_suppliers"])


@query("lookup_default", "SELECT c_custkey, coalesce(CASE WHEN n_regionkey < 3 THEN n_name END, 'nation ' || c_nationkey) AS city FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def lookup_default(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "nation").where("n_regionkey < 3").select("n_nationkey", "n_name")
    return table(spark, folder, "customer").join(known, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"))).alias("city"))


@query("first_match_join", "SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) ON o_custkey = c_custkey AND r = 1")
def first_match_join(spark: SparkSession, folder: str) -> DataFrame:
    first = ops.extreme_row(table(spark, folder, "orders"), ["o_custkey"], F.struct("o_orderdate", "o_orderkey"), ["o_orderkey"], largest=False)
    return table(spark, folder, "customer").join(first, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@query("set_union", "SELECT c_nationkey AS nation, 'customer' AS side FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def set_union(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("side"))
    return a.unionByName(table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("side")))


@query("set_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def set_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("set_vote", "SELECT k AS nation, count(DISTINCT s) AS votes FROM (SELECT c_nationkey AS k, 1 AS s FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT s_nationkey, 2 FROM supplier UNION ALL SELECT n_nationkey, 3 FROM nation WHERE n_regionkey < 2) GROUP BY 1 HAVING count(DISTINCT s) >= 2")
def set_vote(spark: SparkSession, folder: str) -> DataFrame:
    """Values that at least two of three sources have."""
    tag = lambda df, c, s: df.select(F.col(c).alias("nation"), F.lit(s).alias("s"))
    every = tag(table(spark, folder, "customer").where("c_acctbal > 5000"), "c_nationkey", 1).unionByName(tag(table(spark, folder, "supplier"), "s_nationkey", 2)).unionByName(tag(table(spark, folder, "nation").where("n_regionkey < 2"), "n_nationkey", 3))
    return every.groupBy("nation").agg(F.countDistinct("s").alias("votes")).where("votes >= 2")


@query("pivot_flags", "SELECT l_suppkey, round_even(coalesce(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 0), 2) AS A, round_even(coalesce(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 0), 2) AS N, round_even(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0), 2) AS R FROM lineitem GROUP BY 1")
def pivot_flags(spark: SparkSession, folder: str) -> DataFrame:
    wide = table(spark, folder, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity")).na.fill(0.0)
    return wide.select("l_suppkey", *[F.bround(c, 2).alias(c) for c in ("A", "N", "R")])


@query("unpivot_measures", " UNION ALL ".join(f"SELECT s_suppkey, '{c}' AS measure, {c}::DOUBLE AS value FROM supplier" for c in ("s_nationkey", "s_acctbal")))
def unpivot_measures(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("s_nationkey"), "s_acctbal")
    return rows.unpivot("s_suppkey", ["s_nationkey", "s_acctbal"], "measure", "value")


@query(
    "category_pivot",
    """
    SELECT user_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS click, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)::BIGINT AS "view",
      greatest(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END), sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END))::BIGINT AS most, count(*) AS total FROM events GROUP BY 1
    """,
)
def category_pivot(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, folder, "events").groupBy("user_id").agg(F.count_if(kind == "click").alias("click"), F.count_if(kind == "view").alias("view"), F.count("*").alias("total")).withColumn("most", F.greatest("click", "view"))


@query("combinations_2", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
def combinations_2(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs within a region, by an equality join on the region."""
    n = table(spark, folder, "nation")
    a, b = n.select("n_regionkey", F.col("n_name").alias("a")), n.select("n_regionkey", F.col("n_name").alias("b"))
    return a.join(b, "n_regionkey").where("a < b").select("a", "b")


@query("sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sort_limit(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("argmax_per_day", "SELECT day, o_orderkey, price FROM (SELECT o_orderdate::DATE AS day, o_orderkey, o_totalprice AS price, row_number() OVER (PARTITION BY o_orderdate::DATE ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def argmax_per_day(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_orderkey", F.col("o_totalprice").alias("price"))
    return ops.extreme_row(rows, ["day"], F.struct("price", -F.col("o_orderkey")), ["o_orderkey", "price"])


@query("topn_per_group", "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 5")
def topn_per_group(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return ops.top_n_per_group(rows, ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 5)


@query("last_row_per_group", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def last_row_per_group(spark: SparkSession, folder: str) -> DataFrame:
    return ops.extreme_row(table(spark, folder, "orders"), ["o_custkey"], F.struct("o_orderdate", "o_orderkey"), ["o_orderkey", "o_orderstatus"])


@query("order_dedup", "SELECT k, min(pos) AS pos FROM (SELECT unnest([3,1,3,2,1,5,4]) AS k, unnest([0,1,2,3,4,5,6])::INT AS pos) GROUP BY 1 ORDER BY pos LIMIT 4")
def order_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct values in the order of their first place, cut to four."""
    rows = spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in (3, 1, 3, 2, 1, 5, 4)])).alias("pos", "k"))
    return rows.groupBy("k").agg(F.min("pos").alias("pos")).orderBy("pos").limit(4)


@query("weighted_rank", "SELECT s_suppkey, (3 * rank() OVER (ORDER BY s_acctbal) + rank() OVER (ORDER BY s_nationkey))::BIGINT AS score FROM supplier")
def weighted_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted sum of ranks over a dimension table; ranks come from counts of smaller values, summed by distinct value."""
    rows = table(spark, folder, "supplier")

    def ranks(c: str) -> DataFrame:
        from pyspark.sql import Window

        counts = rows.groupBy(c).agg(F.count("*").alias("n"))
        before = Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
        return counts.select(c, (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).alias(f"rank_{c}"))

    return rows.join(ranks("s_acctbal"), "s_acctbal").join(ranks("s_nationkey"), "s_nationkey").select("s_suppkey", (3 * F.col("rank_s_acctbal") + F.col("rank_s_nationkey")).alias("score"))


@query("sha256_mask", "SELECT c_custkey, sha256(c_name) AS masked FROM customer")
def sha256_mask(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", F.sha2("c_name", 256).alias("masked"))


@query("linear_hash_bucket", "SELECT (13333 * c_custkey + 3) % 2333333 % 5 AS bucket, count(*) AS n FROM customer GROUP BY 1")
def linear_hash_bucket(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").groupBy(F.pmod(F.pmod(13333 * F.col("c_custkey") + 3, F.lit(2333333)), F.lit(5)).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "text_number",
    "SELECT c_custkey, list_reduce(list_transform(generate_series(1, length(c_name)), lambda i: ascii(substr(c_name, i, 1))::BIGINT), lambda a, x: (a * 256 + x) % 233333) AS number FROM customer",
)
def text_number(spark: SparkSession, folder: str) -> DataFrame:
    """A name's bytes as one large number, modulo a prime."""
    return table(spark, folder, "customer").select("c_custkey", bytes_number(F.col("c_name"), 233_333).alias("number"))


@query("utc_times", "SELECT event_id, timezone('UTC', timezone('America/New_York', ts)) AS utc FROM events")
def utc_times(spark: SparkSession, folder: str) -> DataFrame:
    """Local times of a zone with summer time as UTC."""
    return table(spark, folder, "events").select("event_id", F.to_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York").cast("timestamp_ntz").alias("utc"))


@query("user_tips", "SELECT user_id, count(*) AS n, round_even(sum(value), 4) AS total FROM events GROUP BY 1")
def user_tips(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.bround(F.sum("value"), 4).alias("total"))


@query(
    "scalar_strings",
    "SELECT p_partkey, upper(left(p_name, 3)) AS head, right(p_type, 4) AS tail, replace(trim(p_brand), 'Brand', 'B') AS brand, split_part(p_type, ' ', 1) AS kind, p_brand || '|' || p_size AS key FROM part",
)
def scalar_strings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        "p_partkey",
        F.upper(F.substring("p_name", 1, 3)).alias("head"),
        F.right("p_type", F.lit(4)).alias("tail"),
        F.replace(F.trim("p_brand"), F.lit("Brand"), F.lit("B")).alias("brand"),
        F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind"),
        F.concat_ws("|", "p_brand", "p_size").alias("key"),
    )


@query(
    "scalar_dates",
    "SELECT o_orderkey, (isodow(o_orderdate) - 1)::INT AS weekday, dayofyear(o_orderdate)::INT AS yearday, year(o_orderdate)::INT AS year, strftime(o_orderdate, '%y-%m') AS month, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, (o_orderdate::DATE + 7) AS later, date_diff('day', o_orderdate::DATE, DATE '1999-01-01')::INT AS age FROM orders",
)
def scalar_dates(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.weekday(d).alias("weekday"),
        F.dayofyear(d).alias("yearday"),
        F.year(d).alias("year"),
        F.date_format(d, "yy-MM").alias("month"),
        F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string")).alias("quarter"),
        F.date_add(d.cast("date"), 7).alias("later"),
        F.datediff(F.lit("1999-01-01").cast("date"), d.cast("date")).alias("age"),
    )


@query(
    "scalar_math",
    "SELECT c_custkey, round_even(c_acctbal, 0) AS even, round_even(sqrt(abs(c_acctbal)), 6) AS root, round_even(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 6) AS log, coalesce(c_nationkey / nullif(c_custkey % 3, 0), 1.0::DOUBLE / 3)::DOUBLE AS safe FROM customer",
)
def scalar_math(spark: SparkSession, folder: str) -> DataFrame:
    x = F.col("c_acctbal")
    return table(spark, folder, "customer").select(
        "c_custkey", F.bround(x, 0).alias("even"), F.bround(F.sqrt(F.abs(x)), 6).alias("root"), F.bround(F.when(x > 0, F.ln(x)), 6).alias("log"), F.coalesce(F.try_divide(F.col("c_nationkey").cast("double"), F.nullif(F.col("c_custkey") % 3, F.lit(0)).cast("double")), F.lit(1 / 3)).alias("safe")
    )


@query("scalar_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, CASE WHEN json_extract(props, '$.missing') IS NULL THEN 0 ELSE 1 END AS has FROM events")
def scalar_json(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.expr("try_cast(get_json_object(props, '$.k') AS INT)").alias("k"), F.get_json_object("props", "$.missing").isNotNull().cast("int").alias("has"))


@query("scalar_binary", "SELECT c_custkey, CASE WHEN c_custkey = 0 THEN 64 ELSE bit_count((c_custkey & -c_custkey) - 1) END::INT AS zeros, bin(c_custkey) AS bits FROM customer")
def scalar_binary(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, folder, "customer").select("c_custkey", F.when(k == 0, 64).otherwise(F.bit_count(k.bitwiseAND(-k) - 1)).alias("zeros"), F.bin(k).alias("bits"))


@query(
    "vector_math",
    "SELECT vec_id, round_even(list_sum(embedding)::DOUBLE, 4) AS total, round_even(sqrt(list_dot_product(embedding, embedding))::DOUBLE, 3) AS norm, round_even(list_max(embedding)::DOUBLE, 6) AS top FROM embeddings",
)
def vector_math(spark: SparkSession, folder: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    add = lambda a, x: a + x
    return table(spark, folder, "embeddings").select("vec_id", F.bround(F.aggregate(e, F.lit(0.0), add), 4).alias("total"), F.bround(F.sqrt(F.aggregate(F.transform(e, lambda x: x * x), F.lit(0.0), add)), 3).alias("norm"), F.bround(F.array_max(e), 6).alias("top"))
