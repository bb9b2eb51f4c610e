"""Hot anchors, slices of long texts and buckets against all windows, and spans that were planted."""

import hashlib
import random

import numpy as np
import pytest

from quillspark.llm import suffix_dedup as d


def plain(texts, length):
    seen, want = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = True
            seen.add(w)
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        want[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return want


def words(rng, n):
    return " ".join(f"{rng.randrange(10**6):x}" for _ in range(n))


def texts(seed):
    rng = random.Random(seed)
    lines = [words(rng, k) for k in (20, 28, 45)]
    out = {}
    for i in range(160):
        parts = [words(rng, rng.randint(0, 30))]
        for line in lines:
            if rng.random() < 0.6:
                cut = rng.choice([0, 0, 0, 30])
                parts += [line[cut:], words(rng, rng.randint(0, 6))]
        out[i] = " ".join(parts)
    return out | {500: out[3], 501: out[3] + "x", 502: "ab" * 300, 503: "b" + "ab" * 300, 504: None, 505: "ü" * 90}


@pytest.mark.parametrize("hot", [0, 5, 40, d.HOT])
def test_every_bound_of_hot_anchors_gives_all_windows(spark, hot):
    own = texts(hot)
    docs = spark.createDataFrame(list(own.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in d.remove_repeats(docs, each=3_000, hot=hot).collect()}
    assert got == plain(own, 100)


def test_slices_of_a_long_text_give_the_same_anchors(monkeypatch):
    data = np.frombuffer((words(random.Random(1), 4_000) + "ab" * 700 + words(random.Random(1), 500)).encode(), np.uint8)
    offsets = np.array([0, len(data)])
    whole = d.anchors(data, offsets, 100)
    for size in (101, 1_000, 7_777):
        monkeypatch.setattr(d, "SLICE", size)
        for a, b in zip(whole, d.anchors(data, offsets, 100), strict=True):
            assert (a == b).all()


def test_a_text_of_twenty_megabytes(spark):
    rng = np.random.default_rng(2)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    raw = letters[rng.integers(0, 27, 20 << 20)].copy()
    raw[19_000_000:19_000_500] = raw[1_000_000:1_000_500]
    other = letters[rng.integers(0, 27, 3_000)].copy()
    other[1_000:1_150] = raw[18_000_000:18_000_150]
    docs = spark.createDataFrame([(1, raw.tobytes().decode()), (2, other.tobytes().decode())], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in d.remove_repeats(docs).collect()}
    # a byte beside a planted passage agrees by chance now and then
    assert got[1][0] == 20 << 20 and 500 <= got[1][1] <= 504 and got[1][2] == 1 and 150 <= got[2][1] <= 154 and got[2][2] == 1
