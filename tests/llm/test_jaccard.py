"""The tiled product against plain set intersection, links counted, and no row for each pair."""

import random

import numpy as np
import pytest

from quillspark.llm import jaccard_join as j


def links_of(sets, num=75, den=100):
    return {(a, b) for a in sets for b in sets if a != b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}


def shingles(t):
    w = (t or "").split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def want(texts):
    links = links_of({i: shingles(t) for i, t in texts.items()})
    top = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if top[a] > top[b]:
                top[a], changed = top[b], True
    return {i: (len(shingles(t)), top[i], sum(a == i for a, _ in links)) for i, t in texts.items()}


def got(spark, texts, **more):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in j.classes(docs, **more).collect()}


@pytest.mark.parametrize("dense", [1, 64, 10**9])
def test_product_equals_intersections(monkeypatch, dense):
    monkeypatch.setattr(j, "DENSE", dense)
    monkeypatch.setattr(j, "CHUNK", 7)
    monkeypatch.setattr(j, "PRODUCTS", 50)
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = ([np.flatnonzero(rng.random(60) < p) for p in rng.choice([0.1, 0.5, 0.9], n)] for n in rng.integers(1, 30, 2))
        flat = lambda rows: (np.concatenate(rows).astype(np.uint64), np.repeat(np.arange(len(rows)), [len(r) for r in rows]))
        for other in (b, None):
            right = other or a
            need = rng.integers(1, 40, (len(a), len(right)))
            alive = rng.random(need.shape) < 0.7
            both = np.array([[len(set(x.tolist()) & set(y.tolist())) for y in right] for x in a])
            if other is None:
                alive &= np.tri(len(a), k=-1, dtype=bool).T
            assert (j.product(flat(a), flat(other) if other else None, need, alive) == (alive & (both >= need))).all()


def near_copies(rng, n, base, first):
    out = {}
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out[first + i] = " ".join(w)
    return out


@pytest.mark.parametrize("side", [1024, 6])
def test_links_are_counted_across_tiles(spark, monkeypatch, side):
    monkeypatch.setattr(j, "SIDE", side)
    rng = random.Random(5)
    line = " ".join(f"l{k}" for k in range(12))
    texts = near_copies(rng, 40, [f"a{k}" for k in range(60)], 0) | near_copies(rng, 15, [f"b{k}" for k in range(30)] + line.split(), 100)
    texts |= {200 + k: f"{line} z{k}" for k in range(20)} | {300 + k: texts[k % 3] for k in range(9)} | {400: None, 401: "", 402: "two words", 403: "two words"}
    assert got(spark, texts) == want(texts)


def test_rows_that_share_much_but_link_little_stay_in_their_tile(spark, monkeypatch):
    rng = random.Random(1)
    lines = [" ".join(f"s{k}w{i}" for i in range(10)) for k in range(40)]
    texts = {i: " ".join(rng.sample(lines, 30)) for i in range(150)}
    made, whole = [], j._bundled
    monkeypatch.setattr(j, "_bundled", lambda leads: made.append(whole(leads)) or made[-1])
    assert got(spark, texts) == want(texts)
    assert made[0].count() < 150 * 20  # of 11,175 pairs


def test_one_doc_id_with_several_texts(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(5, text), (5, "another text that has only a few words"), (7, text), (7, text), (9, "another text that has only a few words"), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r.doc_id or -1, r.n_shingles, r.component_id, r.n_links) for r in j.classes(docs).collect()), key=str)
    assert len(found) == 6 and (-1, 26, None, 0) in found
    by = {}
    for i, _, c, n in found:
        by.setdefault(i, set()).add((c, n))
    assert by[5] in ({(5, 1)},) and (by[7], by[9]) in (({(5, 1)}, {(9, 0)}), ({(7, 0)}, {(5, 1)}))


def test_reserved_names_of_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1, 2), (2, "a b c d e f", 1, 2), (3, "x", 1, 2)], "doc_id long, text string, _later long, component_id long")
    kept = j.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
