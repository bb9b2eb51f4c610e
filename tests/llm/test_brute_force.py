"""Every query against a plain version over the smallest tables, and the pipeline's stages."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import DATA
from quillspark.llm import registry

SF = str(DATA / "sf0.001")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_op1_base_labels(spark, docs):
    word, phrases = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
    for r in run(spark, "op1_license_scan"):
        w = word.findall((docs[r.doc_id].text or "").translate(LOW))
        at = [(i, k) for k, p in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None)
        assert r.base_labels == ",".join(sorted({k for _, k in at})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}


def test_op2_finds_every_verbatim_item(spark, docs):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r for r in run(spark, "op2_benchmark_decontamination")}
    for i, d in docs.items():
        text = " " + " ".join(words(d.text)) + " "
        for k, w in items.items():
            if " " + " ".join(w) + " " in text:
                assert (i, k) in got and got[i, k].n_equal == len(w)
    assert all(r.n_equal >= 0.8 * r.n_words for r in got.values())


def shingles(t):
    w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(docs):
    sets, parent = {i: shingles(d.text) for i, d in docs.items()}, {i: i for i in docs}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            inverted[g].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in inverted[g] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: (len(sets[i]), top(i)) for i in docs}


def test_op3_components(spark, docs):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, "op3_ngram_jaccard_join")} == components(docs)


def test_op4_ids_and_fill(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, total = {}, 0
    for i, d in docs.items():
        ids = np.array(tokenizer.encode(d.text or "", add_special_tokens=False).ids + [1], "<u4")
        total += len(ids)
        for k in range(0, len(ids), 4096):
            want[i, k // 4096] = (k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes()))
    got = run(spark, "op4_best_fit_packing")
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    assert len({r.sequence_id for r in got}) <= 1.02 * -(-total // 4096) + 1


def test_op5_likeness_is_near_the_true_one(spark, docs):
    order = sorted(docs, reverse=True)
    plain = lambda t: (lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))(t.split())
    off = []
    for r in run(spark, "op5_document_fingerprints"):
        own, nxt = docs[r.doc_id].text, docs[order[(order.index(r.doc_id) + 1) % len(order)]].text
        edited = own[: len(own) - len(own) // 3] + nxt[: len(own) // 3]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(own)
        a, b = plain(own), plain(edited)
        off.append(abs(r.near_edited - len(a & b) / max(1, len(a | b))))
    assert np.mean(off) < 0.05 and max(off) < 0.25


def test_op6_finds_planted_secrets(spark, docs):
    found = {(r.doc_id, r.secret_sha256) for r in run(spark, "op6_secret_scan") if r.is_secret}
    for i, d in docs.items():
        for m in re.finditer(r'\b(AKIA[A-Z0-9]{16})\b|password=([0-9a-f]+)|token = "([0-9a-f]+)"', d.text or ""):
            assert (i, hashlib.sha256((m[1] or m[2] or m[3]).encode()).hexdigest()) in found


def test_op7_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(str(DATA / "sf0.01" / "labels.parquet")).collect()}
    got = registry.QUERIES["op7_quality_classifier"](spark, str(DATA / "sf0.01")).collect()
    assert all(r.held_out == held_out(r.doc_id) and r.predicted == int(r.score >= 0.7) for r in got)
    right = [r.predicted == labels[r.doc_id] for r in got if r.held_out and r.doc_id in labels]
    assert np.mean(right) > 0.93


def test_op8_against_all_windows(spark, docs):
    seen, want = set(), {}
    for i in sorted(docs):
        b = (docs[i].text or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = True
            seen.add(w)
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        want[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, "op8_suffix_dedup")} == want


def test_op9_round_trip(spark):
    firsts, want = {}, {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect():
        raw = (r.html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want[r.page_id] = (len(raw), digest, "revisit" if digest in firsts else "response", firsts.get(digest), True)
        firsts.setdefault(digest, r.page_id)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.body_ok) for r in run(spark, "op9_warc")} == want


def test_op10_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(str(DATA / "sf0.01" / "documents.parquet")).collect()}
    got = registry.QUERIES["op10_language_id"](spark, str(DATA / "sf0.01")).collect()
    assert len(got) == len(lang) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) > 0.98


def test_pipeline_stages(spark, docs):
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    now = before = spark.read.parquet(f"{SF}/documents.parquet")
    names = []
    for name, stage in corpus_pipeline.STAGES:
        names.append(name)
        now = stage(spark, before, SF)
        if name != "packing":
            assert now.columns == before.columns
            now.persist()
        if name == "near_duplicates":
            own = {r.doc_id: r for r in before.collect()}
            assert {r.doc_id for r in now.collect()} == {i for i, (_, c) in components(own).items() if c == i}
        if name == "decontamination":
            assert not [1 for r in now.collect() for b in bench if b in r.text]
        if name == "secrets":
            assert now.count() == before.count() and not now.where(now.text.rlike("AKIA[A-Z0-9]{16}|password=[0-9a-f]{12}")).count()
        if name == "packing":
            assert {r.doc_id for r in now.collect()} == {r.doc_id for r in before.collect()}
        before = now
    assert names == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
