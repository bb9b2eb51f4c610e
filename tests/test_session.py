from pyspark.sql import functions as F

from quillspark import session as own


def test_hash_is_the_partitioners(spark):
    got = spark.range(2000).select(F.col("id").cast("int").alias("x"), F.expr("hash(cast(id AS int))").alias("h")).collect()
    import numpy as np

    assert own._hashed(np.array([r.x for r in got])).tolist() == [r.h for r in got]


def test_groups_are_dealt_evenly_and_in_order(spark):
    for groups in (2, 9, 62, 300):
        df = spark.range(groups * 10).select(own.even((F.col("id") % groups).cast("int"), groups, spark).alias("block"))
        parts = own.dealt(df, groups, "block").select(F.spark_partition_id().alias("p"), "block").distinct().groupBy("p").count().collect()
        assert sum(r["count"] for r in parts) == groups and max(r["count"] for r in parts) <= -(-groups // own._parts(spark, groups))
        labels = own.even_labels(groups, own._parts(spark, groups))
        assert labels == sorted(set(labels))
    assert spark.range(3).select(own.even(F.col("id"), 10**6, spark).alias("x")).agg(F.max("x")).first()[0] == 2


def test_rounds_of_a_loop_do_not_blow_up_the_estimate(spark):
    df = spark.range(20).withColumnRenamed("id", "a")
    for _ in range(12):
        df = own.cut(df.join(df.withColumnRenamed("a", "b"), F.col("a") == F.col("b")).join(df.withColumnRenamed("a", "c"), F.col("a") == F.col("c")).select("a"))
    assert df.count() == 20 and own.input_bytes(df) < 1 << 70


def test_swept_takes_own_folders_of_an_age(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(own, "shared_dir", lambda _: f"file://{tmp_path}")
    (tmp_path / "other").mkdir()
    before = own.stored(spark.range(3), "some-table")
    folder = before.inputFiles()[0].rsplit("/", 2)[1]
    assert own.OWN.fullmatch(folder) and own.swept(spark, 1) == 0 and before.count() == 3
    assert own.swept(spark, -1) == 1 and [x.name for x in tmp_path.iterdir()] == ["other"]
