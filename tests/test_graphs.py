"""Graph queries that count, search and cut without writing what they count."""

import os
import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from quillspark.operators import graph
from quillspark.plans import graphs
from quillspark.session import leaf_bytes, shared_dir


def _written(spark):
    """Bytes in the folder of checkpoints."""
    return sum(p.stat().st_size for p in Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")).rglob("*") if p.is_file())


@pytest.mark.parametrize("share,block,sorted_,packed", [(0.9, 32_000_000, 4_000_000, 250_000), (0.0, 3, 7, 1), (0.5, 50, 1, 10), (0.999, 500, 20, 40)])
def test_edges_in_blocks_are_those_of_the_join(spark, monkeypatch, share, block, sorted_, packed):
    for name, value in (("BLOCK_PAIRS", block), ("SORTED_PAIRS", sorted_), ("PACKED_ROWS", packed)):
        monkeypatch.setattr(graph, name, value)
    rng = random.Random(block)
    rows = [(rng.choice([-(2**62), 2**62 + rng.randint(0, 9), rng.randint(0, 30)]), rng.randint(0, 25)) for _ in range(300)] + [(None, 1), (3, None)]
    df = spark.createDataFrame(rows, "u long, i long")
    weighed = graph.shared_edges(df, "u", "i")
    least = weighed.agg(F.percentile("n", F.lit(share))).first()[0]
    want = sorted(tuple(r) for r in weighed.where(F.col("n") >= least).select("src", "dst").collect())
    assert sorted(tuple(r) for r in graph.top_shared_edges(df, "u", "i", share).collect()) == want


def test_edges_of_no_pairs(spark):
    for rows in ([], [(1, 1), (2, 2)]):
        assert graph.top_shared_edges(spark.createDataFrame(rows, "u int, i long"), "u", "i", 0.9).collect() == []


def test_edges_write_no_pair_that_is_none(spark):
    graphs.edges(spark, str(DATA / "sf0.001"))
    before = _written(spark)
    e = graphs.edges(spark, str(DATA / "sf0.01"))
    assert e.count() == 879 and _written(spark) - before < 300_000  # 580,012 pairs have common parts


def _by_search(pairs):
    """Betweenness of edges, source by source, with parallel edges as they are."""
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    score = {}
    for s in near:
        depth, paths, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in near[v]:
                if w not in depth:
                    depth[w], paths[w] = depth[v] + 1, 0
                    order.append(w)
                paths[w] += paths[v] if depth[w] == depth[v] + 1 else 0
        credit = dict.fromkeys(order, 1.0)
        for w in reversed(order):
            for v in near[w]:
                if depth[v] == depth[w] - 1:
                    share = credit[w] * paths[v] / paths[w]
                    credit[v] += share
                    score[min(v, w), max(v, w)] = score.get((min(v, w), max(v, w)), 0) + share / 2
    return score


@pytest.mark.parametrize("each,few,cells", [(1 << 25, 1 << 20, 2_000_000), (1, 0, 1), (400, 100, 300)])
def test_betweenness_in_blocks_of_sources(spark, monkeypatch, each, few, cells):
    monkeypatch.setattr(graph, "CELLS", cells)  # of tasks in this process; others take their own
    rng = random.Random(few)
    pairs = [(rng.randint(0, 30) + c, rng.randint(0, 30) + c) for c in (0, 100) for _ in range(45)] + [(200 + k, 201 + k) for k in range(12)] + [(300, 301), (301, 300), (400, 400)]
    got = {(r.src, r.dst): r.score for r in graph.betweenness(spark.createDataFrame(pairs, "src long, dst long"), each, few).collect()}
    assert got == pytest.approx(_by_search(pairs))
    names, at = np.unique(pairs[:45], return_inverse=True)
    src, dst = at.reshape(-1, 2).T
    keep = src != dst
    flow = graph._flow(src[keep], dst[keep], len(names), np.arange(len(names))) / 2
    summed = {}
    for a, b, x in zip(names[src[keep]].tolist(), names[dst[keep]].tolist(), flow.tolist(), strict=True):
        summed[min(a, b), max(a, b)] = summed.get((min(a, b), max(a, b)), 0) + x
    assert summed == pytest.approx(_by_search(pairs[:45]))


def test_betweenness_writes_no_row_per_source_and_vertex(spark):
    star = spark.createDataFrame([(0, k) for k in range(1, 701)], "src long, dst long")
    before = _written(spark)
    got = {r.dst: r.score for r in graph.betweenness(star).collect()}
    assert got == pytest.approx(dict.fromkeys(range(1, 701), 700.0)) and _written(spark) - before < 1_000_000


@pytest.mark.parametrize("held", [0, 2_000_000])
def test_betweenness_by_joins_and_in_one_task(spark, held):
    rng = random.Random(4)
    pairs = [(rng.randint(0, 30) + c, rng.randint(0, 30) + c) for c in (0, 100) for _ in range(35)] + [(500 + k // 2, 501 + k) for k in range(20)] + [(600, 601), (601, 600), (601, 602), (700, 700)]
    got = {(r.src, r.dst): r.score for r in graph.betweenness(spark.createDataFrame(pairs, "src int, dst int"), 400, 100, held).collect()}
    assert got == pytest.approx(_by_search(pairs))


def test_trees_are_counted_without_a_search(spark, monkeypatch):
    flow, sizes = graph._flow, []
    monkeypatch.setattr(graph, "_flow", lambda src, dst, n, *a: sizes.append((n, len(src))) or flow(src, dst, n, *a))
    pairs = [(0, 1), (1, 2), (2, 0)] + [(k, 3 * k) for k in range(1, 60)]  # a triangle with trees on it, and trees alone
    names, at = np.unique(pairs, return_inverse=True)
    src, dst = at.reshape(-1, 2).T
    label = graph._joined(src, dst, len(names))[src]
    got = {(min(a, b), max(a, b)): x for (a, b), x in zip(pairs, graph._rescored(spark, src, dst, label).tolist(), strict=True)}
    assert got == pytest.approx(_by_search(pairs)) and sizes == [(3, 3)]


def test_betweenness_leaves_its_edges_alone(spark):
    tables, _ = _tables(spark)
    chain = spark.createDataFrame([(k, k + 1) for k in range(50)], "src long, dst long")
    assert graph.betweenness(chain).count() == 50 and _tables(spark)[0] == tables + 1  # components by joins write more


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_girvan_newman_by_lists_cuts_as_by_matrices(spark, monkeypatch, seed):
    rescored = graph._rescored
    monkeypatch.setattr(graph, "_rescored", lambda *a: rescored(*a, alone=(1 << 23) * (seed > 1)))
    rng = random.Random(seed)
    pairs = {(a + c, b + c) for c in (0, 50) for a in range(14) for b in range(a + 1, 14) if rng.random() < (0.6 if a // 7 == b // 7 else 0.06)}
    e = spark.createDataFrame(sorted(pairs), "src long, dst long")
    one, two = graph.girvan_newman(e, most=25), graph.girvan_newman(e, most=25, small=0)
    found = lambda x: sorted(r.members for r in graph.communities(x[0]).collect())
    assert found(one) == found(two) and one[1] == pytest.approx(two[1]) and one[2] == two[2]


@pytest.mark.parametrize("exact,weighed", [(2.0**50, 1 << 20), (2.0**50, 40), (0, 1 << 20)])
def test_cuts_of_a_task_are_those_of_new_searches(monkeypatch, exact, weighed):
    monkeypatch.setattr(graph, "EXACT", exact)
    monkeypatch.setattr(graph, "WEIGHED", weighed)
    rng = random.Random(weighed)
    for n, share in ((9, 0.2), (30, 0.06), (30, 0.12), (50, 0.03), (50, 0.05)):
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < share]
        names, at = np.unique(pairs, return_inverse=True)
        src, dst = at.reshape(-1, 2).T
        got, rest, cuts = list(graph._course(src, dst, len(names), 1000)), pairs, 0
        while rest:
            score = _by_search(rest)
            gone = [p for p in pairs if score.get(p, 0) >= graph._least(max(score.values()))]
            assert got[cuts][0] == pytest.approx(max(score.values())) and [pairs[k] for k in got[cuts][1]] == gone
            rest = [p for p in rest if p not in gone]
            cuts += 1
        assert len(got) == cuts


@pytest.mark.parametrize("ahead,most,stale", [(2, 1000, 30), (250, 7, 30), (3, 1000, 2)])
def test_components_are_cut_in_one_order_whoever_follows_them(spark, monkeypatch, ahead, most, stale):
    monkeypatch.setattr(graph, "AHEAD", ahead)
    monkeypatch.setattr(graph, "SMALL_VERTICES", 5)  # of the driver: more groups
    rng = random.Random(most)
    pairs = sorted({(a + c, b + c) for c, n in ((0, 14), (50, 9), (100, 14), (200, 4)) for a in range(n) for b in range(a + 1, n) if (a * b) % 5 < 2 or rng.random() < 0.1 * (c > 100)})
    guided, followed = (f(spark, np.array(pairs), most, stale) for f in (graph._guided, graph._followed))
    assert followed[1].tolist() == guided[1].tolist() and followed[2:] == (pytest.approx(guided[2]), guided[3])


def test_cuts_search_no_component_anew_in_the_driver(spark, monkeypatch):
    pairs = [(a + c, b + c) for c in (0, 10) for a in range(6) for b in range(a + 1, 6)] + [(0, 10)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    monkeypatch.setattr(graph, "_rescored", None)
    assert sorted(r.first for r in graph.communities(graph.girvan_newman(e, most=4, small=0)[0]).collect()) == [0, 10]
    monkeypatch.undo()
    monkeypatch.setattr(graph, "CORE", 11)  # too many vertices on cycles for a task
    assert sorted(r.first for r in graph.communities(graph.girvan_newman(e, most=4, small=0)[0]).collect()) == [0, 10]


def test_girvan_newman_writes_nothing_for_a_cut(spark):
    rng = random.Random(9)
    e = spark.createDataFrame(sorted({(a, b) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.1}), "src long, dst long")
    size = []
    for most in (1, 4):
        before = _written(spark)
        graph.girvan_newman(e, most=most, small=0)
        size.append(_written(spark) - before)
    assert size[0] == pytest.approx(size[1], rel=0.1)


def test_components_of_customers_write_no_pair(spark):
    before = _written(spark)
    assert graphs.QUERIES["graph_cc"](spark, str(DATA / "sf0.01")).count() == 625 and _written(spark) - before < 1_000_000


def _tables(spark):
    """How many tables and checkpoints the shared folder has, and their bytes."""
    checkpoints = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    found = {*checkpoints.iterdir(), *Path(shared_dir(spark).removeprefix("file://")).iterdir()} - {checkpoints}
    return len(found), sum(p.stat().st_size for f in found for p in f.rglob("*") if p.is_file())


def _dealt(spark):
    """Bytes of shuffle files."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(os.path.getsize(f"{d}/{f}") for folder in folders for d, _, files in os.walk(folder.getPath()) for f in files if f.startswith("shuffle_"))


@pytest.mark.parametrize("joined,places,block", [(1 << 30, 64_000_000, 5), (500, 1, 5), (200, 100, 60)])
def test_edges_in_parts_and_rounds_are_those_of_the_join(spark, monkeypatch, tmp_path, joined, places, block):
    for name, value in (("JOINED_BYTES", joined), ("DEALT_PLACES", places), ("DEALT_TIMES", places), ("BLOCK_PAIRS", block), ("PACKED_ROWS", 40)):
        monkeypatch.setattr(graph, name, value)
    tables, rng = _tables(spark)[0], random.Random(places)
    rows = [(rng.choice([-(2**62), 2**62 + rng.randint(0, 9), rng.randint(0, 15)]), rng.randint(-12, 12)) for _ in range(250)] + [(None, 1), (3, None), (7, 99)]
    spark.createDataFrame(rows, "u long, i long").coalesce(1).write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    assert (leaf_bytes(df) > joined) == (places < 1000)  # parts and rounds, or one of each
    weighed = graph.shared_edges(df, "u", "i")
    least = weighed.agg(F.percentile("n", F.lit(0.9))).first()[0]
    want = sorted(tuple(r) for r in weighed.where(F.col("n") >= least).select("src", "dst").collect())
    assert sorted(tuple(r) for r in graph.top_shared_edges(df, "u", "i", 0.9).collect()) == want
    assert _tables(spark)[0] == tables + 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rounds_after_the_first_are_counted_once(spark, monkeypatch, seed):
    for name, value in (("DEALT_PLACES", 400), ("DEALT_TIMES", 1), ("BLOCK_PAIRS", 100)):
        monkeypatch.setattr(graph, name, value)
    packed, quantiles, rounds, rng = graph._packed, [], [], random.Random(seed)
    monkeypatch.setattr(graph, "_packed", lambda blocks, of, now, labels: rounds.append((now, of)) or packed(blocks, of, now, labels))
    df = spark.createDataFrame([(rng.randint(0, 60), rng.randint(0, 40)) for _ in range(400)], "u long, i long")
    weighed = graph.shared_edges(df, "u", "i")
    for share in (0.5, 0.9, 0.97):
        rounds.clear()
        least = weighed.agg(F.percentile("n", F.lit(share))).first()[0]
        want = sorted(tuple(r) for r in weighed.where(F.col("n") >= least).select("src", "dst").collect())
        assert sorted(tuple(r) for r in graph.top_shared_edges(df, "u", "i", share).collect()) == want
        assert rounds[0][1] > 2  # rounds
        quantiles.append(len(rounds) - rounds[0][1])
        assert quantiles[-1] in (1, rounds[0][1])
    assert 1 in quantiles


def test_components_leave_one_table(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(300)], "src long, dst long")
    tables, _ = _tables(spark)
    found = graph.connected_components(chain)
    assert _tables(spark)[0] == tables + 1 and {r.component for r in found.collect()} == {0} and found.count() == 301


def test_components_of_customers_leave_no_shuffle_files(spark):
    spark._jvm.System.gc()
    time.sleep(2)
    (tables, kept), before = _tables(spark), _dealt(spark)
    found = graphs.QUERIES["graph_cc"](spark, str(DATA / "sf0.01"))
    time.sleep(1)  # they are removed in the background
    assert _dealt(spark) - before < 100_000 and found.count() == 625
    assert _tables(spark)[0] == tables + 2 and _tables(spark)[1] - kept < 300_000


def test_labels_of_customers_write_no_pair(spark):
    before = _written(spark)
    assert graphs.QUERIES["graph_lpa"](spark, str(DATA / "sf0.01")).count() == 187 and _written(spark) - before < 1_000_000


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_labels_of_one_task_are_those_of_joins(spark, monkeypatch, seed):
    rng, tables = random.Random(seed), []
    moved = graph.moved
    monkeypatch.setattr(graph, "moved", lambda df, name: tables.append(name) or moved(df, name))
    e = spark.createDataFrame([(rng.randint(-20, 40), 2 * rng.randint(-20, 40)) for _ in range(90)] + [(7, 7), (7, 9)] * 2, "src int, dst int")
    for rounds in (0, 1, 5):
        found = []
        for held in (0, 2_000_000):
            tables.clear()
            found.append(sorted(tuple(r) for r in graph.label_propagation(e, rounds, held).collect()))
            assert len(tables) == (2 if held else 2 + rounds)
        assert found[0] == found[1] and found[0]


def test_labels_leave_one_table_after_any_rounds(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(30)], "src long, dst long")
    for rounds in (0, 1, 4):
        tables, _ = _tables(spark)
        found = graph.label_propagation(chain, rounds)
        assert _tables(spark)[0] == tables + 1 and found.count() == 31


def test_labels_of_customers_leave_no_shuffle_files(spark):
    spark._jvm.System.gc()
    time.sleep(2)
    (tables, kept), before = _tables(spark), _dealt(spark)
    found = graphs.QUERIES["graph_lpa"](spark, str(DATA / "sf0.01"))
    time.sleep(1)  # they are removed in the background
    assert _dealt(spark) - before < 100_000 and found.count() == 187
    assert _tables(spark)[0] == tables + 2 and _tables(spark)[1] - kept < 300_000
