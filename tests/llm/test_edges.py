"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontamination, fingerprints, jaccard_join, language_id, license_scan, packing, quality, secret_scan, suffix_dedup, warc

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(20_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, label int, `found` string, n long"


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows, with columns named like the operators' own."""
    texts = [None, "", " \n\t ", "one", "one two three four", "Same text here with six words", "Same text here with six words", LONG, "ünï çödé ßtraße 漢字   x" * 20, "\x00\x01 control", LONG[:-5], "a" * 5000]
    rows = [(i, t, "en", "src0", 1, 7, 1, "x", 3) for i, t in enumerate(texts)] + [(None, "null id text with five words", None, None, None, None, None, None, None), (None, None, "en", None, None, None, None, None, None), (5, "Same text here with six words", "en", "s", 1, 1, 1, "x", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_license_scan(docs, empty):
    got = license_scan.scan(docs)
    assert got.count() == 15 and got.where("n_base > 0 OR score > 0").count() == 0 and license_scan.scan(empty).count() == 0
    assert {r.doc_id: r.n_words for r in got.collect()}[7] == 20_000


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, LONG[:400]), (1, LONG[:400]), (2, None), (3, ""), (None, "null id text with five words and more of them here now"), (4, "short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {(7, 1), (10, 1)}
    left = decontamination.clean(docs, bench)
    assert left.columns == docs.columns and left.count() == 13
    assert decontamination.contaminated(empty, bench).count() == 0 and decontamination.clean(docs, bench.limit(0)).count() == 15
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench, sent=200).collect()} == got  # several passes


def test_jaccard_join(docs, empty):
    got = sorted((tuple(r) for r in jaccard_join.classes(docs).collect()), key=str)
    assert len(got) == 15 and jaccard_join.classes(empty).count() == 0
    by = {r[0]: r for r in got if r[0] is not None}
    assert [by[i][1] for i in (0, 1, 2, 3, 4, 5)] == [0, 0, 0, 1, 1, 2] and by[6][2] == 5 and by[5][2] == 5 and by[10][2] == 7 and by[3][2] == 3
    assert sorted((r[1], r[2]) for r in got if r[0] is None) == [(0, None), (2, None)]
    left = jaccard_join.one_of_each(docs)
    assert left.columns == docs.columns and left.count() == 13


def test_packing(docs, empty):
    got = packing.packed(packing.pieces(docs, VOCABULARY), each=4).collect()
    assert packing.packed(packing.pieces(empty, VOCABULARY)).count() == 0
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096
    ones = [r for r in got if r.doc_id in (0, 1, 2)]
    assert [(r.piece, r.start, r.length, r.ids_crc32) for r in ones] == [(0, 0, 1, zlib.crc32(b"\x01\0\0\0"))] * 3
    long = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 7)
    assert long[0] == (0, 0, 4096) and all(a[1] + a[2] == b[1] for a, b in zip(long, long[1:]))


def test_fingerprints(docs, empty):
    got = fingerprints.compared(docs).collect()
    assert len(got) == 15 and fingerprints.compared(empty).count() == 0
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[0].fingerprint == "" and by[5].fingerprint == by[6].fingerprint != by[4].fingerprint and by[0].n_chars == 0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got) and by[6].near_next == 1.0
    texts = {r.doc_id: r.text or "" for r in docs.where("doc_id IS NOT NULL").collect()}
    n = len(texts[10])
    assert by[10].edited_sha256 == hashlib.sha256((texts[10][: n - n // 3] + texts[9][: n // 3]).encode()).hexdigest()


def test_secret_scan(spark, docs, empty):
    model = secret_scan.train(secret_scan.labelled_findings(spark, 1800))
    key = "AKIA" + "Q7ZK2M9XW4RT8BNV"
    more = docs.unionByName(spark.createDataFrame([(50, f"see {key} and {key} then", "en", "src", 3, 1, 1, "y", 2)], SCHEMA))
    assert secret_scan.findings(empty, model).count() == 0 and secret_scan.redacted(empty, model).count() == 0
    found = [r for r in secret_scan.findings(more, model).collect() if r.is_secret]
    assert [(r.doc_id, r.word) for r in sorted(found, key=lambda r: r.word)] == [(50, 1), (50, 3)]
    clean = secret_scan.redacted(more, model)
    assert clean.columns == more.columns and clean.count() == 16
    assert clean.where("doc_id = 50").first().text == "see [secret] and [secret] then"
    assert clean.where("doc_id <> 50").exceptAll(more.where("doc_id <> 50")).count() == 0


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(3, 1), (4, 1), (5, 1), (7, 0), (11, 0), (10, 0), (None, 1), (4, None), (99, 0)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 15 and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(empty, labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.accepted(docs, labels, least=0.0).count() == 15 and quality.accepted(empty, labels).columns == docs.columns


def test_suffix_dedup(docs, empty):
    got = suffix_dedup.remove_repeats(docs, keep_text=True).collect()
    assert len(got) == 15 and suffix_dedup.remove_repeats(empty).count() == 0
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[0].n_bytes == 0 and by[0].kept_sha256 == hashlib.sha256(b"").hexdigest() and by[11].n_removed == 4999 and by[10].n_removed == by[10].n_bytes
    assert by[5].n_removed == 0  # under 100 bytes


def test_warc(spark):
    pages = spark.createDataFrame([(3, "http://a", "<p>x</p>"), (1, None, "<p>x</p>"), (2, "http://b\r\nX: y", None), (4, "http://c", ""), (None, "http://d", "<p>x</p>"), (5, "http://é", "ü" * 100_000), (3, "http://a", "<p>x</p>")], "page_id long, url string, html string")
    index = warc.write(pages)
    got = sorted(((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to, r.body_ok) for r in warc.read(index).collect()), key=str)
    assert got == sorted([(1, 8, "response", None, True), (3, 8, "revisit", 1, True), (3, 8, "revisit", 1, True), (2, 0, "response", None, True), (4, 0, "revisit", 2, True), (-1, 8, "response", None, True), (5, 200_000, "response", None, True)], key=str)
    assert warc.read(warc.write(pages.limit(0))).count() == 0
    some = warc.read(index.where("page_id IN (1, 5)"))
    assert sorted(r.page_id for r in some.collect()) == [1, 5]
    assert {r.record_type for r in warc.read(warc.write(pages, least=9)).where("payload_bytes < 9").collect()} == {"response"}


def test_language_id(spark, docs, empty):
    known = spark.createDataFrame([(i, "the quick brown fox and the lazy dog were there " * 4, "en") for i in range(9)] + [(i + 20, "der schnelle braune Fuchs und der faule Hund waren da " * 4, "de") for i in range(9)] + [(50, None, "en"), (51, "what", None)], "doc_id long, text string, lang string")
    model, limits = language_id.fit(known)
    got = {r.doc_id: r for r in language_id.predict(docs, model, limits, reject=False).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[0].score == 0 and got[4].lang_pred in ("de", "en")
    assert language_id.predict(empty, model, limits).count() == 0
    two = spark.createDataFrame([(1, "und der Hund"), (2, "and the dog"), (3, "12 34 !")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.predict(two, model, limits, reject=False).collect()} == {1: "de", 2: "en", 3: "und"}
    assert language_id.predict(docs, *language_id.fit(known.limit(0))).count() == 15
    foreign = spark.createDataFrame([(1, "漢字漢字 仮名仮名 漢字 仮名 漢字漢字")], "doc_id long, text string")
    assert language_id.predict(foreign, model, limits).first().lang_pred == "und"
