"""The seeds against all patterns of substitutions, and the operator against a comparison without seeds."""

from itertools import combinations
from math import ceil

import numpy as np
import pytest

from quillspark.llm import decontamination as d


def holds(masks, n, pattern):
    """Whether one of the masks stands whole somewhere in a pattern of ``n`` words."""
    return any(pattern & (bits << at) == bits << at for m in masks for bits in [sum(1 << k for k, c in enumerate(m) if c == "#")] for at in range(n - len(m) + 1))


@pytest.mark.parametrize("least, share, most", [(13, 0.8, 25), (8, 0.75, 15), (5, 0.8, 9)])
def test_seeds_miss_no_pattern(least, share, most):
    masks = d.seeds_for(least, share)
    for n in range(least, most + 1):
        for gone in combinations(range(n), n - ceil(round(share * 100) * n / 100)):
            assert holds(masks, n, (1 << n) - 1 - sum(1 << k for k in gone)), (n, gone)


def best(text, item, least, share):
    """The most equal words of any stretch on any diagonal; 0 if none counts."""
    found, need = 0, min(least, len(item))
    for shift in range(-len(item) + 1, len(text)):
        lo, hi = max(0, shift), min(len(text), shift + len(item))
        same = [text[k] == item[k - shift] for k in range(lo, hi)]
        sums = np.concatenate([[0], np.cumsum(same)])
        for s in range(len(same)):
            for e in range(s + need, len(same) + 1):
                if 100 * (sums[e] - sums[s]) >= round(100 * share) * (e - s):
                    found = max(found, int(sums[e] - sums[s]))
    return found if found >= d.FEWEST else 0


@pytest.mark.parametrize("least, share", [(13, 0.8), (8, 0.75)])
def test_equals_a_comparison_without_seeds(spark, least, share):
    rng = np.random.default_rng(7)
    items = {100 + k: [f"w{rng.integers(0, 60)}" for _ in range(int(rng.integers(6, 36)))] for k in range(12)}
    items[300] = items[100] + items[101]  # passages that several items share
    texts = {}
    for i in range(60):
        item = items[100 + i % 12]
        at = int(rng.integers(0, max(1, len(item) - least)))
        own = [w if rng.random() < rng.choice([0.7, 0.8, 0.9, 1.0]) else f"x{k}" for k, w in enumerate(item[at:])]
        texts[i] = [f"f{rng.integers(0, 9)}" for _ in range(int(rng.integers(0, 9)))] + own + [f"w{rng.integers(0, 60)}" for _ in range(6)]
    want = {(i, k, n) for i, t in texts.items() for k, w in items.items() if (n := best(t, w, least, share))}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.n_equal) for r in d.contaminated(docs, bench, least, share).collect()} == want
    assert {(r.doc_id, r.item_id, r.n_equal) for r in d.contaminated(docs, bench, least, share, sent=300).collect()} == want  # several parts
    kept = {r.doc_id for r in d.clean(docs, bench, least, share, sent=300).collect()}
    assert kept == set(texts) - {i for i, _, _ in want}


def test_one_seed_in_many_items(spark, monkeypatch):
    monkeypatch.setattr(d, "PAIRS", 50)
    line = " ".join(f"c{k}" for k in range(20))
    bench = spark.createDataFrame([(k, f"{line} own{k} more{k}") for k in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"before {line} after{k}") for k in range(5)], "doc_id long, text string")
    got = d.contaminated(docs, bench).collect()
    assert len(got) == 200 and {r.n_equal for r in got} == {20}
