from pyspark.sql import functions as F

from quillspark.llm import idblocks


def test_blocks_keep_the_order_and_are_even(spark):
    ids = spark.range(0, 20_000).select((F.col("id") * F.col("id")).alias("doc_id")).union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    for n, ranges in ((1, 10), (13, 100), (64, 8), (5, 1)):
        own = idblocks.blocks(ids, n, ranges=ranges).of(F.col("doc_id"), F.col("doc_id"))
        got = ids.select("doc_id", own.alias("b")).orderBy(F.asc_nulls_first("doc_id")).collect()
        assert [r.b for r in got] == sorted(r.b for r in got) and got[0].b == 0
        if ranges >= 8:
            counts = ids.groupBy(own.alias("b")).agg(F.count("*").alias("n")).collect()
            assert len(counts) >= 0.9 * n and max(r.n for r in counts) <= 3 * 20_000 / n + 1
    assert idblocks.blocks(ids.where("doc_id < 0"), 4).of(F.col("doc_id"), F.col("doc_id")) is not None


def test_null_keys_have_blocks_by_their_share(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("text"))
    own = idblocks.blocks(rows, 30)
    counts = rows.groupBy(own.of(F.col("doc_id"), F.col("text")).alias("b"), F.col("doc_id").isNull().alias("lost")).count().collect()
    lost = {r.b: r["count"] for r in counts if r.lost}
    assert own.nulls == 10 and set(lost) == set(range(10)) and max(lost.values()) < 200 and min(r.b for r in counts if not r.lost) == 10
