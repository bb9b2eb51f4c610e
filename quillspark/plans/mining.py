"""Itemsets, similar items and recommendations from orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.stats import amplify
from quillspark.operators import mining as ops
from quillspark.operators import ml
from quillspark.plans.registry import Registry
from quillspark.plans.statistics import _RATINGS, ratings
from quillspark.sources.tables import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
query = R.query


def baskets(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, folder, "part").select("p_partkey", "p_brand")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand").distinct()


def _support(spark: SparkSession, folder: str, share: float) -> int:
    """A count that follows the number of orders."""
    return max(2, int(table(spark, folder, "orders").count() * share))


_BASKETS = "b AS (SELECT DISTINCT l_orderkey AS o, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _sets(where: str, share: float) -> str:
    return f"""
    WITH {_BASKETS}, s AS (SELECT greatest(2, floor(count(*) * {share}))::BIGINT AS s FROM orders), k AS (SELECT o FROM b GROUP BY o HAVING {where}), c AS (SELECT b.* FROM b SEMI JOIN k ON b.o = k.o)
    SELECT i AS items, count(*) AS support FROM c GROUP BY 1 HAVING count(*) >= (SELECT s FROM s)
    UNION ALL SELECT x.i || ',' || y.i, count(*) FROM c x JOIN c y ON x.o = y.o AND x.i < y.i GROUP BY x.i, y.i HAVING count(*) >= (SELECT s FROM s)
    UNION ALL SELECT x.i || ',' || y.i || ',' || z.i, count(*) FROM c x JOIN c y ON x.o = y.o AND x.i < y.i JOIN c z ON x.o = z.o AND y.i < z.i GROUP BY x.i, y.i, z.i HAVING count(*) >= (SELECT s FROM s)
    """


@query("fim_brand", _sets("true", 0.02))
def fim_brand(spark: SparkSession, folder: str) -> DataFrame:
    sets = ops.frequent_itemsets(baskets(spark, folder), "l_orderkey", "p_brand", _support(spark, folder, 0.02))
    return sets.select(F.array_join("items", ",").alias("items"), "support")


@query("fim_filtered", _sets("count(*) > 4", 0.02))
def fim_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Only baskets of more than four items count."""
    rows = baskets(spark, folder)
    large = rows.groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n > 4").select("l_orderkey")
    sets = ops.frequent_itemsets(rows.join(large, "l_orderkey", "left_semi"), "l_orderkey", "p_brand", _support(spark, folder, 0.02))
    return sets.select(F.array_join("items", ",").alias("items"), "support")


_PAIRS = "p AS (SELECT DISTINCT user_id AS u, CAST(json_extract(props, '$.k') AS INT) AS k FROM events), n AS (SELECT k, count(*) AS n FROM p GROUP BY 1)"


def user_items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("user_id", F.expr("cast(get_json_object(props, '$.k') AS INT)").alias("k")).distinct()


@query("jaccard_pairs_exact", f"WITH {_PAIRS}, c AS (SELECT x.k AS a, y.k AS b, count(*) AS m FROM p x JOIN p y ON x.u = y.u AND x.k < y.k GROUP BY 1, 2) SELECT a, b, round_even(m / (n1.n + n2.n - m), 8) AS jaccard FROM c JOIN n n1 ON a = n1.k JOIN n n2 ON b = n2.k WHERE m / (n1.n + n2.n - m) >= 0.4")
def jaccard_pairs_exact(spark: SparkSession, folder: str) -> DataFrame:
    return ops.jaccard(user_items(spark, folder), "k", "user_id", 0.4).withColumn("jaccard", F.bround("jaccard", 8))


#: Bands of two rows each: at a likeness of 0.4 a pair shares none of a hundred once in ten million times.
LEAST, ROWS = 0.4, 2


@query("jaccard_lsh", f"WITH {_PAIRS}, c AS (SELECT x.k AS a, y.k AS b, count(*) AS m FROM p x JOIN p y ON x.u = y.u AND x.k < y.k GROUP BY 1, 2) SELECT a, b, round_even(m / (n1.n + n2.n - m), 8) AS jaccard FROM c JOIN n n1 ON a = n1.k JOIN n n2 ON b = n2.k WHERE m / (n1.n + n2.n - m) >= {LEAST}")
def jaccard_lsh(spark: SparkSession, folder: str) -> DataFrame:
    """The bands' candidates, verified; the statement has all true pairs, which so many bands are meant to find."""
    return ops.banded_minhash(user_items(spark, folder), "k", "user_id", LEAST, bands=ops.HASHES // ROWS).withColumn("jaccard", F.bround("jaccard", 8))


_SIM = f"""
{_RATINGS}, q AS (SELECT x.k AS i, y.k AS j, count(*) AS n, regr_sxx(x.v, y.v) AS syy, regr_syy(x.v, y.v) AS sxx, regr_sxy(x.v, y.v) AS sxy FROM r x JOIN r y ON x.user_id = y.user_id AND x.k <> y.k GROUP BY 1, 2),
sim AS (SELECT i, j, n, CASE WHEN n = 1 OR sxx <= 1e-6 OR syy <= 1e-6 THEN 0 ELSE sxy / sqrt(sxx * syy) END AS s FROM q)
"""


@query("pearson_pairs", f"WITH {_SIM} SELECT i, j, n, round_even(s, 5) AS similarity FROM sim WHERE n >= 2 AND i < j")
def pearson_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return ops.pearson(ratings(spark, folder), "user_id", "k", "v", 2).where("i < j").select("i", "j", "n", F.bround("similarity", 5).alias("similarity"))


@query(
    "cf_simfeat",
    f"WITH {_SIM}, a AS (SELECT i, s * pow(abs(s), 1.5) AS s FROM sim WHERE n >= 2) SELECT i, count(*) AS n, round_even(avg(s), 5) AS mean, round_even(stddev_pop(s), 5) AS sd, round_even(min(s), 5) AS lo, round_even(max(s), 5) AS hi FROM a GROUP BY 1",
)
def cf_simfeat(spark: SparkSession, folder: str) -> DataFrame:
    s = ops.pearson(ratings(spark, folder), "user_id", "k", "v", 2).select("i", amplify(F.col("similarity")).alias("s"))
    return s.groupBy("i").agg(F.count("*").alias("n"), F.bround(F.avg("s"), 5).alias("mean"), F.bround(F.stddev_pop("s"), 5).alias("sd"), F.bround(F.min("s"), 5).alias("lo"), F.bround(F.max("s"), 5).alias("hi"))


def _split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Train and test ratings by a hash rule that SQL can repeat."""
    rows = ratings(spark, folder)
    test = (F.col("user_id") * 31 + F.col("k") * 17) % 10 == 0
    return rows.where(~test), rows.where(test)


_CF = f"""
WITH {_RATINGS.replace("r AS", "r0 AS", 1)}, r AS (SELECT * FROM r0 WHERE (user_id * 31 + k * 17) % 10 <> 0), te AS (SELECT user_id, k FROM r0 WHERE (user_id * 31 + k * 17) % 10 = 0), q AS {_SIM.split(", q AS", 1)[1]},
a AS (SELECT i, j, round_even(s * pow(abs(s), 1.5), 9) AS s FROM sim WHERE n >= 2), nr AS (SELECT te.user_id AS u, te.k AS i, r.v, a.s, row_number() OVER (PARTITION BY te.user_id, te.k ORDER BY {{order}}, r.k) AS rn FROM te JOIN r ON r.user_id = te.user_id AND r.k <> te.k JOIN a ON a.i = te.k AND a.j = r.k),
w AS (SELECT u, i, count(*) AS c, avg(s) AS ms, sum(s * v) / nullif(sum(abs(s)), 0) AS w FROM nr WHERE rn <= 5 GROUP BY 1, 2), mu AS (SELECT user_id AS u, avg(v) AS mu FROM r GROUP BY 1), mi AS (SELECT k AS i, avg(v) AS mi FROM r GROUP BY 1), m AS (SELECT avg(v) AS m FROM r),
z AS (SELECT te.user_id, te.k, mu, mi, m, w, c >= 3 AND ms > 0.2 AND w IS NOT NULL AS good FROM te LEFT JOIN w ON w.u = te.user_id AND w.i = te.k LEFT JOIN mu ON mu.u = te.user_id LEFT JOIN mi ON mi.i = te.k, m),
p AS (SELECT *, CASE WHEN mi IS NULL THEN m WHEN mu IS NULL THEN mi WHEN good THEN w ELSE mu END AS raw, CASE WHEN mi IS NULL THEN 'overall' WHEN mu IS NULL THEN 'item' WHEN good THEN 'neighbours' ELSE 'user' END AS step FROM z)
SELECT user_id, k, round_even(CASE WHEN raw <= 0 AND mi IS NOT NULL THEN mi ELSE raw END, 9) AS prediction, step FROM p
"""


@query("cf_item", _CF.format(order="a.s DESC"))
def cf_item(spark: SparkSession, folder: str) -> DataFrame:
    train, test = _split(spark, folder)
    return ops.item_cf(train, test, "user_id", "k", "v").withColumn("prediction", F.bround("prediction", 9))


@query("cf_item_lowest", _CF.format(order="a.s"))
def cf_item_lowest(spark: SparkSession, folder: str) -> DataFrame:
    """With the neighbours of the lowest similarity."""
    train, test = _split(spark, folder)
    return ops.item_cf(train, test, "user_id", "k", "v", largest=False).withColumn("prediction", F.bround("prediction", 9))


@query("cf_hybrid")
def cf_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    """Collaborative filtering blended with boosted trees over leave-one-out statistics, by how much the user rated."""
    train, test = _split(spark, folder)
    cf = ops.item_cf(train, test, "user_id", "k", "v")
    known, asked = ml.rating_features(train, test, "user_id", "k", "v")
    scored = ml.boosted(ml.assemble(known, ml.RATING_FEATURES), ml.assemble(asked, ml.RATING_FEATURES), "v", rounds=70)
    model = scored.select("user_id", "k", F.col("v").alias("truth"), F.col("prediction").alias("model"), F.col("u_n").alias("n"))
    return cf.join(model, ["user_id", "k"]).select("user_id", "k", "truth", ops.hybrid(F.col("prediction"), F.col("model"), F.col("n")).alias("prediction"))


@query("cf_rmse")
def cf_rmse(spark: SparkSession, folder: str) -> DataFrame:
    from quillspark.operators.retail import rmse

    return cf_hybrid(spark, folder).agg(rmse("truth", "prediction").alias("rmse"), F.count("*").alias("n"))


@query("jaccard_recall")
def jaccard_recall(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the true pairs the bands find: pairs found, true pairs, recall and precision."""
    pairs = user_items(spark, folder)
    found = ops.banded_minhash(pairs, "k", "user_id", LEAST, bands=ops.HASHES // ROWS)
    return ops.recall(found, ops.jaccard(pairs, "k", "user_id", LEAST), ["a", "b"])


@query(
    "pcy_buckets",
    "WITH b AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem) SELECT ((x.p + y.p) % 10)::BIGINT AS bucket, count(*) AS n FROM b x JOIN b y ON x.o = y.o AND x.p < y.p GROUP BY 1",
)
def pcy_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of parts in an order by the bucket of their sum, as the first pass over baskets counts them."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey").distinct()
    other = rows.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"))
    pairs = rows.join(other, (F.col("l_orderkey") == F.col("o")) & (F.col("l_partkey") < F.col("p")))
    return pairs.groupBy(ops.pair_bucket(F.col("l_partkey"), F.col("p")).alias("bucket")).agg(F.count("*").alias("n"))


_QUOTED = "list_aggregate(list_transform({0}, lambda x: chr(39) || x || chr(39)), 'string_agg', ', ')"
_LEVELS = f"""
{_BASKETS}, s AS (SELECT greatest(2, floor(count(*) * 0.05))::BIGINT AS s FROM orders), f1 AS (SELECT i FROM b GROUP BY 1 HAVING count(*) >= (SELECT s FROM s)),
c2 AS (SELECT x.i AS i, y.i AS j FROM f1 x, f1 y WHERE x.i < y.i), n2 AS (SELECT x.i, y.i AS j, count(*) AS n FROM b x JOIN b y ON x.o = y.o AND x.i < y.i GROUP BY 1, 2),
f2 AS (SELECT n2.i, n2.j FROM n2 JOIN c2 ON c2.i = n2.i AND c2.j = n2.j WHERE n >= (SELECT s FROM s))
"""


def _lines(rows: str) -> str:
    return f"WITH {_LEVELS}, t AS ({rows}) SELECT part, size, string_agg('(' || {_QUOTED.format('own')} || ')', ',' ORDER BY '(' || {_QUOTED.format('own')} || ')') AS line FROM t GROUP BY part, size"


_FREQUENT = "SELECT 'Frequent Itemsets:' AS part, 1 AS size, [i] AS own FROM f1 UNION ALL SELECT 'Frequent Itemsets:', 2, [i, j] FROM f2"


@query("fim_candidates", _lines(f"SELECT DISTINCT 'Candidates:' AS part, 1 AS size, [i] AS own FROM b UNION ALL SELECT 'Candidates:', 2, [i, j] FROM c2 UNION ALL {_FREQUENT}"))
def fim_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The report with both halves: candidates of every level, and those of them that are frequent."""
    return ops.candidate_report(baskets(spark, folder), "l_orderkey", "p_brand", _support(spark, folder, 0.05))


@query("fim_report", f"SELECT size, line FROM ({_lines(_FREQUENT)})")
def fim_report(spark: SparkSession, folder: str) -> DataFrame:
    return ops.itemset_report(ops.frequent_itemsets(baskets(spark, folder), "l_orderkey", "p_brand", _support(spark, folder, 0.05)))
