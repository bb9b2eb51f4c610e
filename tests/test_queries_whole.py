"""Queries that once looked at a part of their tables, and features that once saw the answers."""

import pickle
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from quillspark.functions.text import bytes_number
from quillspark.operators import graph, ml, stats
from quillspark.plans import graphs, mining, models, reviews
from quillspark.sources import files

SF = str(DATA / "sf0.001")


def test_grid_search_takes_all_training_rows(spark, monkeypatch):
    seen, whole = [], ml.grid_search
    monkeypatch.setattr(reviews.ml, "grid_search", lambda train, *rest: seen.append(train.count()) or whole(train.limit(200), *rest))
    reviews.QUERIES["grid_search"](spark, SF)
    assert seen == [models._priced(spark, SF)[0].count()] and seen[0] > 4000


def test_itemsets_do_not_end_at_triples(spark, monkeypatch):
    rows = spark.createDataFrame([(o, b) for o in range(3) for b in "abcde"], "l_orderkey long, p_brand string")
    monkeypatch.setattr(mining, "baskets", lambda *_: rows)
    monkeypatch.setattr(mining, "_support", lambda *_: 3)
    for name in ("fim_brand", "fim_filtered"):
        got = {r["items"]: r.support for r in mining.QUERIES[name](spark, SF).collect()}
        assert len(got) == 31 and got["a,b,c,d,e"] == 3
    assert {r["size"] for r in mining.QUERIES["fim_report"](spark, SF).collect()} == {1, 2, 3, 4, 5}


def test_lsh_finds_the_true_pairs(spark):
    assert mining.QUERIES["jaccard_recall"](spark, str(DATA / "sf0.01")).first().recall >= 0.9


def test_graphs_have_every_customer_pair(spark):
    e = graphs.edges(spark, SF)
    assert e.agg(F.max("dst")).first()[0] > 120


@pytest.mark.parametrize("seed", [1, 2])
def test_girvan_newman_by_matrices_and_by_joins(spark, seed):
    rng = random.Random(seed)
    pairs = {(a, b) for a in range(14) for b in range(a + 1, 14) if rng.random() < (0.6 if a // 7 == b // 7 else 0.06)}
    e = spark.createDataFrame(sorted(pairs), "src long, dst long")
    one, two = graph.girvan_newman(e, most=4), graph.girvan_newman(e, most=4, small=0)
    members = lambda x: sorted(r.members for r in graph.communities(x[0]).collect())
    assert members(one) == members(two) and one[1] == pytest.approx(two[1]) and one[2] == two[2]


def test_features_never_see_test_labels_nor_the_own_one(spark):
    rng = random.Random(3)
    rows = [(u, i, float(rng.randint(1, 5))) for u in range(12) for i in range(8) if rng.random() < 0.6]
    train, test = spark.createDataFrame(rows[10:], "u long, i long, v double"), rows[:10] + [(99, 99, 1.0)]
    other = [(u, i, 1000.0 + k) for k, (u, i, _) in enumerate(test)]
    frame = lambda x: spark.createDataFrame(x, "u long, i long, v double")
    facts = lambda df: sorted(tuple(r) for r in df.drop("v").collect())
    a, b = ml.rating_features(train, frame(test), "u", "i", "v"), ml.rating_features(train, frame(other), "u", "i", "v")
    assert facts(a[0]) == facts(b[0]) and facts(a[1]) == facts(b[1])
    u, i, v = rows[10]
    changed = spark.createDataFrame([(u, i, v + 100), *rows[11:]], "u long, i long, v double")
    own = lambda df: df.where((F.col("u") == u) & (F.col("i") == i)).select("u_n", "i_n").first()
    assert own(a[0]) == own(ml.rating_features(changed, frame(test), "u", "i", "v")[0])
    mean = [x for p, _, x in rows[10:] if p == u]
    if len(mean) > 3:
        assert a[0].where((F.col("u") == u) & (F.col("i") == i)).first().u_mean == pytest.approx((sum(mean) - v) / (len(mean) - 1))


def test_models_are_saved_and_fanned_out(spark, tmp_path):
    df = ml.assemble(spark.range(200).select((F.col("id") % 10).alias("x"), ((F.col("id") % 10) > 4).cast("int").alias("label"), F.when(F.col("id") < 100, "a").otherwise("b").alias("s")), ["x"])
    model = ml.classifier("tree", "label").fit(df)
    ml.save(model, str(tmp_path / "m"))
    assert ml.load(str(tmp_path / "m")).transform(df).where("prediction <> label").count() == 0
    plain = df.drop("features")
    assert [(r.s, r.n) for r in ml.fan_out(plain, plain, "s", ["x"], "label").orderBy("s").collect()] == [("a", 100), ("b", 100)]


def test_bytes_as_a_number(spark):
    texts = ["", "a", "Ü€x", "long text " * 9, None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", bytes_number(F.col("t"), 69_997).alias("n")).collect()
    assert [r.n for r in got] == [None if t is None else int(t.encode().hex() or "0", 16) % 69_997 for t in texts]


def test_parametric_bootstrap_gives_the_standard_error(spark):
    rows = spark.range(400).select((F.col("id") % 2).cast("double").alias("b"), (F.col("id") % 7).cast("double").alias("x"))
    for kind, column, sd in (("normal", "x", 2.0), ("bernoulli", "b", 0.5), ("poisson", "x", 3**0.5)):
        r = stats.parametric_bootstrap(rows, column, kind).first()
        assert r.error == pytest.approx(sd / 20, rel=0.15)


def test_whole_file_sources(spark, tmp_path):
    frame = pd.DataFrame({"k": [1, 2], "v": ["x", None], "more": [0, 0]})
    (tmp_path / "a.pkl").write_bytes(pickle.dumps(frame))
    assert sorted((r.k, r.v) for r in files.pickled(spark, str(tmp_path), "k long, v string").collect()) == [(1, "x"), (2, None)]
    if not any(__import__("importlib.util").util.find_spec(m) for m in ("openpyxl", "xlrd", "calamine", "python_calamine")):
        with pytest.raises(ImportError):
            files.excel(spark, str(tmp_path), "k long")


def test_candidates_of_every_level(spark):
    from quillspark.operators import mining as ops

    rows = [(o, x) for o, basket in enumerate(["abc", "abc", "abd", "e"]) for x in basket]
    got = {(r.part, r["size"]): r.line for r in ops.candidate_report(spark.createDataFrame(rows, "o long, i string"), "o", "i", 2).collect()}
    assert got["Candidates:", 1] == "('a'),('b'),('c'),('d'),('e')" and got["Frequent Itemsets:", 1] == "('a'),('b'),('c')"
    assert got["Candidates:", 2] == got["Frequent Itemsets:", 2] == "('a', 'b'),('a', 'c'),('b', 'c')" and got["Candidates:", 3] == got["Frequent Itemsets:", 3] == "('a', 'b', 'c')"
