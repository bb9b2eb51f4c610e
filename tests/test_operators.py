"""Small hand-made frames: ties, gaps, empty inputs and the defined corner cases."""

import math

import pytest
from pyspark.sql import functions as F

from quillspark.functions import stats as fn
from quillspark.operators import cluster, graph, mining, neighbours, relational, retail, stats, text, timeseries
from quillspark.streaming import sketches


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_top_k_breaks_ties_by_key(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "k string")
    assert [tuple(r) for r in relational.top_k(df, "k", 2).collect()] == [("a", 2), ("b", 2)]


def test_quantile_bins_are_right_closed(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,), (None,)], "x double")
    assert [r.b for r in relational.quantile_bins(df, "x", "b").orderBy("x").collect()] == [None, 1, 2, 2, 4]


def test_adaptive_impute_by_share_of_nulls(spark):
    df = spark.createDataFrame([(1, 5.0, None, float("nan"), None), (2, 5.0, 7.0, None, "x"), (3, None, None, None, None), (4, 1.0, None, None, None)], "i int, a double, b double, c double, t string")
    got = {r.i: r for r in relational.adaptive_impute(df, ["a", "b", "c"], ["t"]).collect()}
    assert got[3].a == 5.0 and got[1].b == 7.0 and got[2].c == 0.0 and got[4].t == "NA"


def test_densify_modes_differ_on_a_hole(spark):
    df = spark.createDataFrame([("a", "2020-01-01", 1), ("a", "2020-01-05", 2)], "k string, d string, n int").withColumn("d", F.to_date("d"))
    assert timeseries.densify(df, ["k"], "d", ["n"]).count() == 5
    kept = {str(r.d): r.n for r in timeseries.densify(df, ["k"], "d", ["n"], "rowcount").collect()}
    assert kept == {"2020-01-01": 1, "2020-01-02": 0, "2020-01-05": 2}


def test_calendar_keeps_one_row_per_day(spark):
    cal = timeseries.calendar(spark, [("2018-06-18", "dragon_boat"), ("2018-06-18", "6.18"), ("2016-02-14", "valentine"), ("2016-02-14", "normal")])
    assert [(str(r.day), r.name) for r in cal.orderBy("day").collect()] == [("2016-02-14", "valentine"), ("2018-06-18", "6.18")]


def test_holiday_counts_at_the_edges(spark):
    hol = timeseries.calendar(spark, [("2020-01-10", "x"), ("2020-01-11", "normal")])
    days = spark.createDataFrame([("2020-01-03",), ("2020-01-04",), ("2020-01-10",), ("2020-01-11",), ("2020-01-17",), ("2020-01-18",)], "s string").select(F.to_date("s").alias("d"))
    got = {str(r.d): (r.holidays_after, r.holidays_before) for r in timeseries.holiday_counts(days, "d", hol, 7).collect()}
    assert got == {"2020-01-03": (0, 0), "2020-01-04": (1, 0), "2020-01-10": (1, 0), "2020-01-11": (0, 1), "2020-01-17": (0, 1), "2020-01-18": (0, 0)}


def test_depletion_equals_the_loop(spark):
    need = spark.createDataFrame([(1, "s", 3.0), (2, "s", 4.0), (3, "s", 1.0)], "city int, sku string, need double")
    stock = spark.createDataFrame([("H", "s", 5.0)], "hub string, sku string, stock double")
    prefs = spark.createDataFrame([(c, "H", 1, 2.0) for c in (1, 2, 3)], "city int, hub string, rank int, price double")
    assert rows(retail.allocate(need, stock, prefs, 1).select("city", "taken", "cost")) == [(1, 3.0, 6.0), (2, 2.0, 4.0)]


def test_leave_one_out_branches(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("b", 1, 1.0), ("b", 2, 3.0), ("c", 1, 1.0), ("c", 2, 2.0), ("c", 3, 3.0), ("c", 4, 4.0)], "u string, i int, v double")
    got = {(r.u, r.i): r for r in stats.leave_one_out(df, "u", "v", True).collect()}
    overall = (5.0 + 2.0 + 2.5) / 3
    assert got["a", 1].mean == pytest.approx(overall) and got["b", 1].mean == pytest.approx((overall + 3) / 2) and got["c", 1].mean == pytest.approx(3.0)
    assert stats.leave_one_out(df, "u", "v", False).where("u = 'a'").first().mean is None
    assert {(r.u, r.i): r.median for r in stats.leave_one_out_median(df, "u", "v").collect()} == {("a", 1): None, ("b", 1): 3.0, ("b", 2): 1.0, ("c", 1): 3.0, ("c", 2): 3.0, ("c", 3): 2.0, ("c", 4): 2.0}


def test_pearson_degenerate_is_zero(spark):
    df = spark.createDataFrame([("u", "i", 1.0), ("v", "i", 1.0), ("u", "j", 1.0), ("v", "j", 2.0), ("u", "k", 2.0), ("v", "k", 4.0), ("w", "l", 1.0)], "u string, i string, v double")
    got = {(r.i, r.j): r.similarity for r in mining.pearson(df, "u", "i", "v").collect()}
    assert got["i", "j"] == 0 and got["j", "k"] == pytest.approx(1.0) and ("i", "l") not in got


def test_itemsets_equal_brute_force(spark):
    from itertools import combinations

    baskets = {1: "abc", 2: "abd", 3: "abce", 4: "bce", 5: "ace", 6: "abcde"}
    df = spark.createDataFrame([(b, i) for b, s in baskets.items() for i in s], "b int, i string")
    want = {c: n for k in range(1, 6) for c in combinations("abcde", k) if (n := sum(set(c) <= set(s) for s in baskets.values())) >= 2}
    assert {tuple(r["items"]): r.support for r in mining.frequent_itemsets(df, "b", "i", 2).collect()} == want


def test_minhash_is_within_the_exact_pairs(spark):
    df = spark.createDataFrame([(f"u{u}", i) for i in range(12) for u in range(i % 4, 30 + i % 3)], "u string, i int")
    exact, found = rows(mining.jaccard(df, "i", "u", 0.9).select("a", "b")), rows(mining.banded_minhash(df, "i", "u", 0.9).select("a", "b"))
    assert set(found) <= set(exact) and len(found) >= 0.95 * len(exact) > 0


def test_cf_ladder(spark):
    train = spark.createDataFrame([("u", "a", 3.0), ("u", "b", 5.0), ("v", "a", 4.0)], "u string, i string, v double")
    asked = spark.createDataFrame([("u", "a"), ("x", "a"), ("x", "z"), ("u", "z")], "u string, i string")
    got = {(r.u, r.i): (r.prediction, r.step) for r in mining.item_cf(train, asked, "u", "i", "v").collect()}
    assert got == {("u", "a"): (4.0, "user"), ("x", "a"): (3.5, "item"), ("x", "z"): (4.0, "overall"), ("u", "z"): (4.0, "overall")}


BRIDGE = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6)]


def test_bridge_has_the_greatest_betweenness(spark):
    e = spark.createDataFrame(BRIDGE, "src long, dst long")
    got = {(r.src, r.dst): r.score for r in graph.betweenness(e).collect()}
    assert got[3, 4] == pytest.approx(9.0) and got[1, 2] == pytest.approx(1.0) and got[1, 3] == pytest.approx(4.0)
    labels, q, _ = graph.girvan_newman(e, most=2)
    assert rows(graph.communities(labels).select("members")) == [("1, 2, 3",), ("4, 5, 6",)] and q == pytest.approx(5 / 14)


def test_components_of_paths_loops_and_nothing(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 100), (200, 201), (201, 200)], "src long, dst long")
    got = dict(rows(graph.connected_components(e)))
    assert set(got[k] for k in range(41)) == {0} and got[201] == 200 and 100 not in got
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_label_propagation_takes_the_smallest_of_ties(spark):
    e = spark.createDataFrame([(1, 2)], "src long, dst long")
    assert rows(graph.label_propagation(e, 2)) == [(1, 1), (2, 2)]


@pytest.mark.parametrize(("n", "plain", "tail"), [(459, 0, 1), (460, 1, 1), (921, 2, 3), (0, 0, 0)])
def test_word_chunks(spark, n, plain, tail):
    df = spark.createDataFrame([(1, " ".join(["w"] * n)), (2, None)], "d int, t string")
    assert text.word_chunks(df, "d", "t").count() == plain and text.word_chunks(df, "d", "t", keep_tail=True).count() == tail


def test_hours_and_truth(spark):
    df = spark.createDataFrame([({"Mon": "9:0-17:0", "Fri": "20:0-2:0"}, "False")], "h map<string,string>, b string")
    assert tuple(df.select(text.weekly_hours(F.col("h")), text.truthy(F.col("b"))).first()) == (14, 0)


def test_normal_distribution(spark):
    df = spark.createDataFrame([(x / 4,) for x in range(-16, 17)], "x double").select("x", fn.normal_cdf(F.col("x")).alias("p"))
    assert all(abs(r.p - 0.5 * (1 + math.erf(r.x / math.sqrt(2)))) < 1e-6 for r in df.collect())


def test_bootstrap_error_is_near_the_analytic_one(spark):
    df = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 10).cast("double").alias("v"))
    got = stats.bootstrap(df, "k", "v", reps=200).first()
    assert abs(got.mean - 4.5) < 0.1 and abs(got.error - 2.872 / math.sqrt(2000)) < 0.015


def test_nearest_equals_brute_force_in_several_blocks(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5), float(i % 3)]) for i in range(60)], "id long, v array<double>")
    data = {r.id: r.v for r in df.collect()}
    want = sorted((q, n, k + 1) for q in range(0, 60, 10) for k, n in enumerate(sorted((i for i in data if i != q), key=lambda i: (math.dist(data[q], data[i]), i))[:4]))
    for most in (2_000_000, 4):
        assert rows(neighbours.nearest(df.where("id % 10 = 0"), df, "id", "v", 4, most).select("query", "neighbour", "rank")) == want


def test_vote_modes(spark):
    lists = [spark.createDataFrame([(x,) for x in xs], "x int") for xs in ([1, 2], [2, 3], [2, 4])]
    assert [rows(neighbours.vote(lists, ["x"], m).select("x")) for m in ("overlap", "all", "unique")] == [[(2,)], [(1,), (2,), (3,), (4,)], [(1,), (3,), (4,)]]


def test_chunked_clusters_place_every_point(spark):
    pts = spark.createDataFrame([(i, [float(i % 3) * 50 + (i % 11) * 0.1, float(i % 3) * 50 + (i % 7) * 0.1]) for i in range(600)] + [(1000, [5000.0, -5000.0])], "id long, v array<double>")
    labels, counts = cluster.chunked_clusters(pts, "id", "v", 3)
    assert labels.count() == 601 == labels.select("id").distinct().count()
    last = counts.orderBy(F.desc("chunk")).first()
    assert last.discarded + last.compressed + last.retained == 601


def test_bloom_has_no_false_negatives(spark):
    users = spark.createDataFrame([(f"u{i}",) for i in range(200)], "u string")
    bits = users.select(F.explode(sketches.bloom_bits("u")).alias("bit")).distinct()
    again = sketches.bloom_batch(users, bits, spark.createDataFrame([], "u string"), "u").first()
    assert again.checked == 200 == again.false_positives


def test_distinct_estimate_of_zero_and_of_a_hash_of_zero(spark):
    assert tuple(sketches.distinct_estimate(spark.createDataFrame([], "u string"), "u").first()) == (0, 0.0)
    assert spark.range(1).select(sketches.trailing_zeros(F.lit(0)), sketches.trailing_zeros(F.lit(12))).first()[:] == (10, 2)


def test_reservoirs_of_parts_merge(spark):
    a, b = spark.range(0, 500), spark.range(500, 1000)
    whole = rows(sketches.reservoir(a.union(b), "id", 50).select("id"))
    parts = sketches.reservoir(a, "id", 50).select("id").union(sketches.reservoir(b, "id", 50).select("id"))
    assert len(whole) == 50 and rows(sketches.reservoir(parts, "id", 50).select("id")) == whole


def test_impute_takes_the_nearest_rows_that_have_the_column(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 1.1, 10.0), (3, 1.2, 20.0), (4, 9.0, 90.0), (5, None, None)], "id long, a double, b double")
    got = {r.id: (r.a, r.b) for r in neighbours.impute(df, "id", ["a", "b"], 2).collect()}
    assert got[1] == (1.0, 15.0) and got[5] == (pytest.approx(3.075), pytest.approx(40.0)) and got[4] == (9.0, 90.0)
    assert {r.id: r.b for r in neighbours.impute(df, "id", ["a", "b"], 2, most=1).collect()}[1] == 15.0


def test_quantiles_are_exact(spark):
    import random

    rng = random.Random(6)
    for n in (0, 1, 2, 3, 7, 50, 900):
        data = [(k % 3, None if rng.random() < 0.1 else float(rng.choice([rng.randint(0, 5), rng.random() * 100]))) for k in range(n)]
        df = spark.createDataFrame(data, "g long, x double")
        shares = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
        for accuracy in (100_000, 100):
            got, want = relational.quantiles(df, "x", shares, accuracy=accuracy).first()[0], df.agg(F.percentile("x", F.array(*map(F.lit, shares)))).first()[0]
            assert got == (None if want is None else pytest.approx(want))
        grouped = {r.g: r._q for r in relational.quantiles(df, "x", shares, ["g"]).collect()}
        want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, shares))).alias("q")).where("q IS NOT NULL").collect()}
        assert grouped == {g: pytest.approx(q) for g, q in want.items()}
