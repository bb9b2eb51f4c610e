"""One query for each corpus operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontamination, fingerprints, jaccard_join, language_id, license_scan, packing, quality, secret_scan, suffix_dedup, warc
from quillspark.plans.registry import Registry
from quillspark.sources.tables import table

R = Registry()
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@R.query("op4_best_fit_packing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(packing.pieces(table(spark, folder, "documents"), VOCABULARY))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


@R.query("op1_license_scan")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents"))


@R.query("op10_language_id")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model, limits = language_id.fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    found = language_id.predict(docs.select("doc_id", "text"), model, limits, reject=False)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cost", "rejected")


@R.query("op7_quality_classifier")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"), ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@R.query("op2_benchmark_decontamination")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


#: SHA-1 as base32 from its 40 hexadecimal digits, five of which make four characters.
_BASE32 = "list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (k // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (k % 4))::BIGINT) & 31)::INT + 1, 1)), 'string_agg', '')"


@R.query(
    "op9_warc",
    f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY 1)
    SELECT page_id, strlen(t) AS payload_bytes, {_BASE32.replace("substr(h,", "substr(p.h,")} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, true AS body_ok
    FROM p JOIN f ON p.h = f.h
    """,
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return warc.read(warc.write(table(spark, folder, "pages"), least=0))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@R.query(
    "op3_ngram_jaccard_join",
    f"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * m >= 75 * (a.n + b.n - m)),
    r(id, z) AS (SELECT x, y FROM l UNION SELECT r.id, l.y FROM r JOIN l ON r.z = l.x), c AS (SELECT id, min(z) AS top FROM r GROUP BY 1), k AS (SELECT x, count(*) AS k FROM l GROUP BY 1)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.top, d.doc_id)) AS component_id, coalesce(k.k, 0) AS n_links FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id LEFT JOIN k ON k.x = d.doc_id
    """,
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.classes(table(spark, folder, "documents"))


@R.query("op8_suffix_dedup")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents"), length=100)


@R.query("op5_document_fingerprints")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compared(table(spark, folder, "documents"))


@R.query("op6_secret_scan")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.findings(table(spark, folder, "documents"), secret_scan.train(secret_scan.labelled_findings(spark)))
