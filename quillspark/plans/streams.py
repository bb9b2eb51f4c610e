"""Structured Streaming queries over the events, dealt into files as micro-batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans.registry import Registry
from quillspark.session import shared_dir
from quillspark.sources.tables import table
from quillspark.streaming import sketches

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
query = R.query
BATCHES = 5


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a stream of ``BATCHES`` micro-batches in order of time."""
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    events.repartitionByRange(BATCHES, "ts").sortWithinPartitions("ts", "event_id").write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("stream_bloom")
def stream_bloom(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.bloom_stream(spark, event_stream(spark, folder), "user_id")


@query("stream_fm")
def stream_fm(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.distinct_stream(spark, event_stream(spark, folder), "user_id")


@query("stream_reservoir")
def stream_reservoir(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.reservoir_stream(spark, event_stream(spark, folder), "event_id")


@query("stream_tumbling", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    """Daily event-time windows of the stream, written once the watermark closes them or the stream ends."""
    log = sketches.BatchLog(spark, "tumbling")
    counts = sketches.tumbling(event_stream(spark, folder), "ts", "1 day", "1 hour", ["event_type"])

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log.path}/out/{number}")

    run = counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{log.path}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    last = run.lastProgress["batchId"]
    return spark.read.parquet(f"{log.path}/out/{last}").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("batch_accounting", f"WITH b AS (SELECT ntile({BATCHES}) OVER (ORDER BY ts, event_id) AS b FROM events) SELECT count(*) AS n, count(DISTINCT b) AS batches FROM b")
def batch_accounting(spark: SparkSession, folder: str) -> DataFrame:
    """Every event falls into exactly one micro-batch."""
    counted = sketches.BatchLog(spark, "accounting").run(event_stream(spark, folder), lambda batch, _: batch.agg(F.count("*").alias("n")))
    return counted.agg(F.sum("n").alias("n"), F.countDistinct("batch").alias("batches"))
