"""Streaming sketches: a Bloom filter, distinct counts, a reservoir, and event-time windows.

Micro-batch i of a stream is its ``batch_id``. Hash functions are fixed by
number, so a replayed batch gives the same rows; state lives in tables that each batch
replaces as a whole, named by batch, so a repeated batch finds what it found before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import shared_dir

# Size and modulus of the bit array, and the distinct counter's hash family.
BITS, BLOOM_HASHES, BLOOM_PRIME = 69_997, 2, 23_333_333
FM_HASHES, FM_GROUPS, FM_WIDTH = 30, 10, 1024


def linear_hash(column: Column, number: int, modulus: int) -> Column:
    """Hash function ``number`` of a fixed family: ``(a x + b) mod p mod modulus`` over a 64-bit hash of the value."""
    a, b = 2 * number + 12_347, 7_919 * (number + 1)
    return F.pmod(F.pmod(F.pmod(F.xxhash64(column), F.lit(BLOOM_PRIME)) * a + b, F.lit(BLOOM_PRIME)), F.lit(modulus))


def bloom_bits(column: str, hashes: int = BLOOM_HASHES) -> Column:
    return F.array(*[linear_hash(F.col(column), k, BITS) for k in range(hashes)])


def bloom_batch(batch: DataFrame, seen_bits: DataFrame, seen_users: DataFrame, column: str) -> DataFrame:
    """One row ``checked, false_positives, fpr``: new users whose bits were all set before the batch."""
    users = batch.select(column).where(F.col(column).isNotNull()).distinct()
    new = users.join(seen_users, column, "left_anti")
    set_ = new.select(column, F.explode(bloom_bits(column)).alias("bit")).join(seen_bits, "bit", "left_semi").groupBy(column).agg(F.count("*").alias("n"))
    full = set_.where(F.col("n") == BLOOM_HASHES).agg(F.count("*").alias("false_positives"))
    return new.agg(F.count("*").alias("checked")).join(full).withColumn("fpr", F.coalesce(F.try_divide(F.col("false_positives"), F.col("checked")), F.lit(0.0)))


def trailing_zeros(x: Column, width: int = 10) -> Column:
    """Zeros at the end of the binary form; ``width`` for 0."""
    return F.when(x == 0, width).otherwise(F.bit_count(x.bitwiseAND(-x) - 1))


def distinct_estimate(batch: DataFrame, column: str) -> DataFrame:
    """One row ``truth, estimate``: the median over groups of the mean of 2^R of each hash, R its most trailing zeros."""
    rows = batch.select(column).where(F.col(column).isNotNull())
    most = rows.agg(F.countDistinct(column).alias("truth"), *[F.max(trailing_zeros(linear_hash(F.col(column), k, FM_WIDTH))).alias(f"r{k}") for k in range(FM_HASHES)])
    size = FM_HASHES // FM_GROUPS
    means = F.array_sort(F.array(*[sum((F.pow(F.lit(2.0), F.col(f"r{g * size + j}")) for j in range(size)), F.lit(0.0)) / size for g in range(FM_GROUPS)]))
    return most.select("truth", F.coalesce((F.element_at(means, FM_GROUPS // 2) + F.element_at(means, FM_GROUPS // 2 + 1)) / 2, F.lit(0.0)).alias("estimate"))


def reservoir(rows: DataFrame, key: str, size: int = 100, seed: int = 553) -> DataFrame:
    """A uniform sample of ``size`` rows: those with the smallest seeded hash, so samples of parts merge into one of the whole."""
    return rows.withColumn("_u", F.xxhash64(F.lit(seed), F.col(key))).orderBy("_u", key).limit(size)


class BatchLog:
    """Runs a function for each micro-batch and gathers the rows it returns, a folder per batch."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def state(self, kind: str, batch: int, empty: DataFrame) -> DataFrame:
        return self.spark.read.schema(empty.schema).parquet(f"{self.path}/{kind}/{batch}") if batch >= 0 else empty

    def keep(self, kind: str, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{kind}/{batch}")

    def run(self, stream: DataFrame, step) -> DataFrame:
        """``step(batch, batch_id) -> DataFrame`` for every batch that is available now; all its rows with ``batch``."""

        def write(batch: DataFrame, number: int) -> None:
            step(batch, number).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{self.path}/out/part={number}")

        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return self.spark.read.parquet(f"{self.path}/out").drop("part")


def bloom_stream(spark: SparkSession, stream: DataFrame, column: str) -> DataFrame:
    """``batch, checked, false_positives, fpr`` for each micro-batch."""
    log = BatchLog(spark, "bloom")

    def step(batch: DataFrame, number: int) -> DataFrame:
        kind = batch.schema[column].dataType.simpleString()
        bits = log.state("bits", number - 1, spark.createDataFrame([], "bit bigint"))
        users = log.state("users", number - 1, spark.createDataFrame([], f"{column} {kind}"))
        now = batch.select(column).where(F.col(column).isNotNull()).distinct()
        log.keep("bits", number, bits.unionByName(now.select(F.explode(bloom_bits(column)).alias("bit"))).distinct())
        log.keep("users", number, users.unionByName(now).distinct())
        return bloom_batch(batch, bits, users, column)

    return log.run(stream, step)


def distinct_stream(spark: SparkSession, stream: DataFrame, column: str) -> DataFrame:
    return BatchLog(spark, "distinct").run(stream, lambda batch, _: distinct_estimate(batch, column))


def reservoir_stream(spark: SparkSession, stream: DataFrame, key: str, size: int = 100, seed: int = 553) -> DataFrame:
    """After every batch the rows seen and the sample's places 0, 20, 40, 60, 80."""
    log = BatchLog(spark, "reservoir")

    def step(batch: DataFrame, number: int) -> DataFrame:
        rows = batch.select(key, F.lit(1).cast("long").alias("seen"))
        before = log.state("sample", number - 1, rows.limit(0))
        counted = log.state("count", number - 1, spark.createDataFrame([(0,)], "n bigint"))
        total = counted.unionByName(rows.agg(F.count("*").alias("n"))).agg(F.sum("n").alias("n"))
        log.keep("count", number, total)
        log.keep("sample", number, reservoir(before.unionByName(rows), key, size, seed).select(key, "seen"))
        sample = log.state("sample", number, rows.limit(0)).agg(F.sort_array(F.collect_list(key)).alias("s"))
        places = [F.get("s", F.lit(k)).alias(f"s{k}") for k in (0, 20, 40, 60, 80)]
        return log.state("count", number, total).select("n").join(sample).select("n", *places)

    return log.run(stream, step)


def tumbling(stream: DataFrame, time: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """Counts by event-time window and keys, with a watermark of ``late``; for a stream or a table."""
    rows = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return rows.groupBy(F.window("_t", width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")

