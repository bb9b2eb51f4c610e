"""Text queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import text as ops
from quillspark.plans.registry import Registry
from quillspark.sources.tables import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
query = R.query


@query(
    "doc_sections",
    "SELECT conv_id, turn, role, coalesce(last_value(CASE WHEN role = 'user' THEN 'question' WHEN role = 'system' THEN 'definitions' END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'none') AS section FROM conversations",
)
def doc_sections(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "conversations").select("conv_id", "turn", "role")
    return ops.sections(lines, "conv_id", "turn", "role", {"question": "^user$", "definitions": "^system$"})


_WORDS = "w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)"


@query("word_chunks", f"WITH {_WORDS}, c AS (SELECT doc_id, w, unnest(range(0, len(w) // 460)) AS i FROM w) SELECT doc_id, i::INT AS corpus_index, array_to_string(w[i * 460 + 1 : i * 460 + 460], ' ') AS chunk FROM c")
def word_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return ops.word_chunks(table(spark, folder, "documents"), "doc_id", "text")


@query("word_chunks_tail", f"WITH {_WORDS}, c AS (SELECT doc_id, w, unnest(range(0, (len(w) + 459) // 460)) AS i FROM w) SELECT doc_id, i::INT AS corpus_index, array_to_string(w[i * 460 + 1 : i * 460 + 460], ' ') AS chunk FROM c")
def word_chunks_tail(spark: SparkSession, folder: str) -> DataFrame:
    return ops.word_chunks(table(spark, folder, "documents"), "doc_id", "text", keep_tail=True)


@query("top_words", f"WITH {_WORDS} SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM w) GROUP BY 1 ORDER BY n DESC, word LIMIT 20")
def top_words(spark: SparkSession, folder: str) -> DataFrame:
    from quillspark.operators.relational import top_k

    words = table(spark, folder, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")).where("word <> ''")
    return top_k(words, "word", 20)
