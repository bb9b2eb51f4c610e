"""Labels and scores of the licence scan against every block of every text."""

import random
import re

from conftest import DATA
from quillspark.llm import license_scan

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))


def plain(text, threshold=0.9):
    w = words(text)
    half = max(len(words(t)) for t in [*license_scan.PHRASES.values(), *license_scan.NOTICES.values()])
    labels, score = set(), 0.0
    for name, phrase in license_scan.PHRASES.items():
        p = words(phrase)
        if any(w[k : k + len(p)] == p for k in range(len(w) - len(p) + 1)):
            labels.add(name)
            score = 1.0
    for name, notice in license_scan.NOTICES.items():
        own = set(words(notice))
        for b in range(0, max(1, len(w)), half):
            share = len(own & set(w[b : b + 2 * half])) / len(own)
            if share >= threshold - 1e-9:
                labels.add(name)
                score = max(score, share)
    return ",".join(sorted(labels)), round(score, 9)


def test_labels_and_scores(spark):
    rng = random.Random(8)
    texts = {r.doc_id: r.text for r in spark.read.parquet(str(DATA / "sf0.001" / "documents.parquet")).collect()}
    for k, notice in enumerate(list(license_scan.NOTICES.values()) * 12):
        own = words(notice)
        for at in rng.sample(range(len(own)), rng.randint(0, max(1, len(own) // 6))):
            own[at] = f"other{at}"
        fill = [f"fill{rng.randint(0, 99)}" for _ in range(rng.randint(0, 300))]
        texts[10_000 + k] = " ".join(fill + own + fill[::-1]).upper() if k % 2 else " ".join(fill + own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in license_scan.scan(docs).collect()}
    assert got == {i: plain(t) for i, t in texts.items()} and sum(bool(x) for x, _ in got.values()) > 20
