"""The corpus pipeline: each stage works on all that the one before it kept.

Every stage takes null and empty texts, null doc_ids, repeated rows, empty tables, texts of any length and columns of any
name, and hands on all columns of the rows that it keeps; what it does with such rows is said with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontamination, jaccard_join, packing, quality, secret_scan
from quillspark.session import compact, stored
from quillspark.sources.tables import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are scored like others; repeated rows share their fate."""
    return compact(quality.accepted(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays.

    Texts without a word and rows without a doc_id have no copies and stay; rows of one doc_id stay or go together.
    """
    return compact(jaccard_join.one_of_each(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go. Null and empty texts stay; an empty benchmark lets all stay."""
    return compact(decontamination.clean(docs, table(spark, sf_dir, "benchmark")))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark and ``n_chars`` is counted anew; every row stays, null and empty texts as they were."""
    return compact(secret_scan.redacted(docs, secret_scan.train(secret_scan.labelled_findings(spark))))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every row gets its place in a training sequence; a null or empty text is one end mark."""
    return packing.packed(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: No SQL for the classifier, the join and the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
