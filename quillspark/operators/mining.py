"""Frequent itemsets, similar items and item-based recommendation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.stats import amplify
from quillspark.session import cut

# The modulus of the hash family and its 200 functions in 50 bands.
PRIME = 233_333
HASHES, BANDS = 200, 50


def frequent_itemsets(baskets: DataFrame, basket: str, item: str, support: int, largest: int | None = None, seen: list[DataFrame] | None = None) -> DataFrame:
    """``items`` (sorted array), ``support`` for every set in at least ``support`` baskets, of ``largest`` items at most if given.

    ``seen`` gets the candidates of every level.

    Level k joins level k-1 with itself on all but the last item, drops candidates with
    an infrequent subset, and counts the rest in the baskets: the frequent sets of level k-1 that a
    basket holds are extended by its larger items and kept where they are candidates.
    """
    rows = baskets.select(F.col(basket).alias("b"), F.col(item).cast("string").alias("i")).where("b IS NOT NULL AND i IS NOT NULL").distinct()
    if seen is not None:
        seen.append(rows.select(F.array("i").alias("items")).distinct())
    single = rows.groupBy("i").agg(F.count("*").alias("support")).where(F.col("support") >= support)
    level = cut(single.select(F.array("i").alias("items"), "support"))
    singles = cut(rows.join(single.select("i"), "i", "left_semi").select("b", "i"))
    held = singles.select("b", F.array("i").alias("items"))
    out, k = level, 1
    while (largest is None or k < largest) and level.count() > k:
        k += 1
        left = level.select("items", F.slice("items", 1, k - 2).alias("head"), F.element_at("items", -1).alias("x"))
        right = level.select(F.slice("items", 1, k - 2).alias("head"), F.element_at("items", -1).alias("y"))
        pairs = left.join(right, "head").where("x < y").select(F.concat("items", F.array("y")).alias("items"))
        if k > 2:
            subsets = pairs.select("items", F.explode(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda j: F.filter("items", lambda x, p: p != j - 1))).alias("s"))
            whole = subsets.join(level.select(F.col("items").alias("s")), "s").groupBy("items").agg(F.count("*").alias("n")).where(F.col("n") == k).select("items")
            pairs = pairs.join(whole, "items", "left_semi")
        pairs = cut(pairs)
        if seen is not None and not pairs.isEmpty():
            seen.append(pairs)
        longer = held.join(singles, "b").where(F.col("i") > F.element_at("items", -1)).select("b", F.concat("items", F.array("i")).alias("items"))
        found = longer.join(pairs.select("items"), "items", "left_semi")
        level = cut(found.groupBy("items").agg(F.count("*").alias("support")).where(F.col("support") >= support))
        if largest is None or k < largest:
            held = cut(found.join(level.select("items"), "items", "left_semi").select("b", "items"))
        out = out.unionByName(level)
    return out


def itemset_report(sets: DataFrame) -> DataFrame:
    """A line for each size: the sets as quoted tuples in lexical order."""
    text = F.format_string("(%s)", F.array_join(F.transform("items", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "))
    return sets.select(F.size("items").alias("size"), text.alias("t")).groupBy("size").agg(F.array_join(F.array_sort(F.collect_list("t")), ",").alias("line"))


def candidate_report(baskets: DataFrame, basket: str, item: str, support: int) -> DataFrame:
    """``part, size, line``: for each size the candidates, and the frequent sets among them, as quoted tuples in lexical order.

    Candidates of one item are all items; larger ones join frequent sets that agree on all but the
    last item and have no infrequent subset, so they don't depend on how the baskets are dealt.
    """
    seen: list[DataFrame] = []
    frequent = frequent_itemsets(baskets, basket, item, support, seen=seen)
    every = seen[0]
    for more in seen[1:]:
        every = every.unionByName(more)
    lines = itemset_report(every).withColumn("part", F.lit("Candidates:")).unionByName(itemset_report(frequent).withColumn("part", F.lit("Frequent Itemsets:")))
    return lines.select("part", "size", "line")


def pair_bucket(a: Column, b: Column, buckets: int = 10) -> Column:
    """The bucket of a pair of numbered items: their sum, modulo the number of buckets."""
    return F.pmod(a + b, F.lit(buckets)).cast("long")


def recall(found: DataFrame, true: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row ``found, expected, hits, recall, precision`` of rows told apart by ``key``; null where there is nothing to count."""
    rows = found.select(*key).distinct().withColumn("f", F.lit(1)).join(true.select(*key).distinct().withColumn("t", F.lit(1)), list(key), "full")
    sums = rows.agg(F.sum("f").alias("found"), F.sum("t").alias("expected"), F.sum(F.col("f") * F.col("t")).alias("hits"))
    n = lambda c: F.coalesce(c, F.lit(0))
    return sums.select(n("found").alias("found"), n("expected").alias("expected"), n("hits").alias("hits"), F.try_divide(n("hits"), "expected").alias("recall"), F.try_divide(n("hits"), "found").alias("precision"))


def overlap_pairs(pairs: DataFrame, item: str, user: str) -> DataFrame:
    """``a, b, both, size_a, size_b`` for items with a common user, by an equality join on the user."""
    rows = pairs.select(F.col(item).alias("i"), F.col(user).alias("u")).distinct()
    sizes = rows.groupBy("i").agg(F.count("*").alias("n"))
    left, right = rows.select(F.col("i").alias("a"), "u"), rows.select(F.col("i").alias("b"), "u")
    both = left.join(right, "u").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    return both.join(sizes.select(F.col("i").alias("a"), F.col("n").alias("size_a")), "a").join(sizes.select(F.col("i").alias("b"), F.col("n").alias("size_b")), "b")


def jaccard(pairs: DataFrame, item: str, user: str, least: float) -> DataFrame:
    share = F.col("both") / (F.col("size_a") + F.col("size_b") - F.col("both"))
    return overlap_pairs(pairs, item, user).withColumn("jaccard", share).where(F.col("jaccard") >= least).select("a", "b", "jaccard")


def banded_minhash(pairs: DataFrame, item: str, user: str, least: float, hashes: int = HASHES, bands: int = BANDS) -> DataFrame:
    """``a, b, jaccard`` of items that share a band of their signatures and reach ``least`` exactly.

    Function h maps a user to ``(a x + b) mod PRIME`` with fixed a >= 1; a signature
    is the least value over an item's users, from one partial aggregate. A bucket's
    items meet by an equality join on band and bucket.
    """
    rows = pairs.select(F.col(item).alias("i"), F.pmod(F.xxhash64(user), F.lit(PRIME)).alias("x"), F.col(user).alias("u")).distinct()
    # Multiplier and shift of function h.
    rule = [(3 * h + 1, h + 12) for h in range(hashes)]
    least_of = rows.groupBy("i").agg(*[F.min(F.pmod(F.lit(a) * F.col("x") + F.lit(b), F.lit(PRIME))).alias(f"h{k}") for k, (a, b) in enumerate(rule)])
    width = hashes // bands
    keys = F.array(*[F.struct(F.lit(k).alias("band"), F.xxhash64(*[F.col(f"h{k * width + j}") for j in range(width)]).alias("bucket")) for k in range(bands)])
    banded = least_of.select("i", F.inline(keys))
    left, right = banded.select(F.col("i").alias("a"), "band", "bucket"), banded.select(F.col("i").alias("b"), "band", "bucket")
    candidates = left.join(right, ["band", "bucket"]).where("a < b").select("a", "b").distinct()
    sizes = rows.groupBy("i").agg(F.count_distinct("u").alias("n"))
    users = rows.select("i", "u")
    both = candidates.join(users.withColumnRenamed("i", "a"), "a").join(users.select(F.col("i").alias("b"), F.col("u").alias("v")), "b").where("u = v").groupBy("a", "b").agg(F.count("*").alias("both"))
    sized = both.join(sizes.select(F.col("i").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("i").alias("b"), F.col("n").alias("nb")), "b")
    return sized.withColumn("jaccard", F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).where(F.col("jaccard") >= least).select("a", "b", "jaccard")


def pearson(ratings: DataFrame, user: str, item: str, value: str, common: int = 1) -> DataFrame:
    """``i, j, n, similarity`` over users that rated both, both directions; 0 where either side doesn't vary."""
    rows = ratings.select(F.col(user).alias("u"), F.col(item), F.col(value))
    left, right = rows.select("u", F.col(item).alias("i"), F.col(value).alias("x")), rows.select("u", F.col(item).alias("j"), F.col(value).alias("y"))
    x, y = F.col("x"), F.col("y")
    sums = left.join(right, "u").where("i < j").groupBy("i", "j").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    n = F.col("n")
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    flat = (vx <= 1e-9 * F.col("sxx")) | (vy <= 1e-9 * F.col("syy"))
    half = sums.where(n >= common).select("i", "j", "n", F.when(flat, 0.0).otherwise(cov / F.sqrt(vx * vy)).alias("similarity"))
    return half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "n", "similarity"))


def item_cf(train: DataFrame, targets: DataFrame, user: str, item: str, value: str, neighbours: int = 5, item_threshold: int = 3, common: int = 2, least: float = 0.2, largest: bool = True) -> DataFrame:
    """``targets`` (``user, item``) with ``prediction`` and which ``step`` of the ladder gave it.

    Neighbours are the ``neighbours`` items with the largest (or smallest)
    amplified similarity among those the user rated. The weighted mean counts with ``item_threshold``
    neighbours and a mean similarity over ``least``; else the user's mean, for an unknown
    user the item's, for neither the overall mean. A prediction of 0 or less gives way to the item's mean.
    """
    wanted = targets.select(F.col(user).alias("u"), F.col(item).alias("i")).distinct()
    rated = train.select(F.col(user).alias("u"), F.col(item).alias("j"), F.col(value).alias("r"))
    similar = pearson(train, user, item, value, common).select("i", "j", F.bround(amplify(F.col("similarity")), 9).alias("s"))  # equal up to rounding is a tie
    near = wanted.join(rated, "u").where("i <> j").join(similar, ["i", "j"])
    order = Window.partitionBy("u", "i").orderBy(F.desc("s") if largest else F.asc("s"), "j")
    best = near.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= neighbours)
    weighed = best.groupBy("u", "i").agg(F.count("*").alias("c"), F.avg("s").alias("ms"), F.try_divide(F.sum(F.col("s") * F.col("r")), F.sum(F.abs("s"))).alias("w"))
    users = rated.groupBy("u").agg(F.avg("r").alias("mu"))
    items = rated.groupBy(F.col("j").alias("i")).agg(F.avg("r").alias("mi"))
    overall = F.broadcast(rated.agg(F.avg("r").alias("m")))
    joined = wanted.join(weighed, ["u", "i"], "left").join(users, "u", "left").join(items, "i", "left").join(overall)
    good = (F.col("c") >= item_threshold) & (F.col("ms") > least) & F.col("w").isNotNull()
    raw = F.when(F.col("mu").isNull() & F.col("mi").isNull(), F.col("m")).when(F.col("mi").isNull(), F.col("m")).when(F.col("mu").isNull(), F.col("mi")).when(good, F.col("w")).otherwise(F.col("mu"))
    step = F.when(F.col("mi").isNull(), "overall").when(F.col("mu").isNull(), "item").when(good, "neighbours").otherwise("user")
    fixed = F.when((raw <= 0) & F.col("mi").isNotNull(), F.col("mi")).otherwise(raw)
    return joined.select(F.col("u").alias(user), F.col("i").alias(item), fixed.alias("prediction"), step.alias("step"))


def hybrid(cf: Column, model: Column, n: Column) -> Column:
    """``a cf + (1 - a) model`` with ``a = exp(-n)``."""
    a = F.exp(-n)
    return a * cf + (1 - a) * model
