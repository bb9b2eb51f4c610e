"""Session settings and durable intermediate tables."""

from __future__ import annotations

import math
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Catalyst's estimate for frames that no file backs is far beyond any table.
UNKNOWN = 1 << 50


def session(app: str = "quillspark", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A folder of this machine is used only on a local master where the setting is absent and no
    checkpoint folder was set before, as in tests; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        present = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not present.isDefined() and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = present.get() if present.isDefined() else f"file://{tempfile.mkdtemp(prefix='quill-')}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Names of this library's folders in the shared one.
OWN = re.compile(r"[a-z]+(-[a-z]+)*-[0-9a-f]{32}")
#: Partitions of one shuffle at most, and groups that one holds where there are more of them than cores.
PARTITIONS, GROUPS = 100_000, 4
#: Groups that get names which spread them evenly.
LABELLED = 4096


def _tasks(spark: SparkSession, wanted: int) -> int:
    """``wanted``, but at least two for each core, so that fewer and larger files leave no core idle."""
    return max(2 * spark.sparkContext.defaultParallelism, wanted)


def _parts(spark: SparkSession, groups: int, each: int = GROUPS) -> int:
    return min(groups, PARTITIONS, _tasks(spark, -(-groups // each)))


def dealt(df: DataFrame, groups: int, *keys: str, each: int = GROUPS) -> DataFrame:
    """``df`` dealt by ``keys`` into partitions of about ``each`` groups, which are worked off one by one."""
    return df.repartition(_parts(df.sparkSession, groups, each), *keys)


def _hashed(x: np.ndarray) -> np.ndarray:
    """What Spark's partitioner makes of int keys (32-bit Murmur3 with seed 42)."""
    U = np.uint32
    turn = lambda v, r: (v << U(r)) | (v >> U(32 - r))
    k = turn(x.astype(U) * U(0xCC9E2D51), 15) * U(0x1B873593)
    h = (turn(U(42) ^ k, 13) * U(5) + U(0xE6546B64)) ^ U(4)
    h = (h ^ (h >> U(16))) * U(0x85EBCA6B)
    h = (h ^ (h >> U(13))) * U(0xC2B2AE35)
    return (h ^ (h >> U(16))).view(np.int32)


def even_labels(groups: int, parts: int) -> list[int]:
    """``groups`` rising numbers whose hashes fall into ``parts`` partitions evenly."""
    room, found, at, step = np.full(parts, -(-groups // parts)), [], 0, 4 * groups + 64
    while len(found) < groups:
        x = np.arange(at, at + step)
        for number, part in zip(x.tolist(), (_hashed(x) % parts).tolist(), strict=True):
            if room[part]:
                room[part] -= 1
                found.append(number)
        at += step
    return found[:groups]


def even(number: Column, groups: int, spark: SparkSession, each: int = GROUPS) -> Column:
    """The int ``number`` below ``groups``, renamed in the same order so that ``dealt`` with the same ``each`` spreads the groups evenly.

    Beyond ``LABELLED`` groups numbers stay; a partition holds many of them then and chance evens them out.
    """
    if not 1 < groups <= LABELLED:
        return number
    labels = even_labels(groups, _parts(spark, groups, each))
    return F.element_at(F.array(*[F.lit(x) for x in labels]), number.cast("int") + 1)


def compact(df: DataFrame, each: int = 64 << 20) -> DataFrame:
    """``df`` in fewer partitions of about ``each`` input bytes, without a shuffle, for writing."""
    return df.coalesce(_tasks(df.sparkSession, shares(df, each, 1)))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, for small frames inside loops.

    A checkpoint keeps Catalyst's estimate of its size, which every join multiplies, so that after
    some rounds of a loop the estimate alone fills the driver; here it starts anew.
    """
    spark = df.sparkSession
    shared_dir(spark)
    held = df.checkpoint(eager=True)._jdf
    rows = held.queryExecution().logical().rdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, held.schema(), False), spark)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    path = fresh(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Whether Spark removes the shuffle files of a statement when it ends, and not when the driver next collects garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Statements that are made and run inside leave no shuffle files behind; frames for later use are made outside."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def added(df: DataFrame, path: str) -> DataFrame:
    """Add ``df`` to the Parquet table in ``path``, whose rows are given; no shuffle file stays."""
    with freed(df.sparkSession):
        df.write.mode("append").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(spark: SparkSession, name: str) -> str:
    """The path of a new table of this library in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def moved(df: DataFrame, name: str) -> DataFrame:
    """As ``stored``, and no shuffle file stays."""
    return added(df, fresh(df.sparkSession, name))


def dropped(df: DataFrame) -> None:
    """Delete the tables of this library that ``df`` reads and nothing else does any more."""
    jvm = df.sparkSession.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if OWN.fullmatch(folder.rsplit("/", 1)[1]):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def swept(spark: SparkSession, hours: float = 24.0) -> int:
    """Delete the tables of ``stored`` and other folders of this library in the shared folder that are older than ``hours``; how many went.

    Frames that were made of them can't be read afterwards, so call it when their results are written.
    """
    jvm, root = spark.sparkContext._jvm, shared_dir(spark)
    path = jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    oldest, gone = (time.time() - 3600 * hours) * 1000, 0
    for status in store.listStatus(path) if store.exists(path) else []:
        if OWN.fullmatch(status.getPath().getName()) and status.getModificationTime() <= oldest:
            gone += bool(store.delete(status.getPath(), True))
    return gone


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes that ``df`` reads; no job is run."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def leaf_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes of all tables that ``df`` reads, whatever joins make of it; frames that no file backs don't count."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    return sum(x for x in sizes if x < UNKNOWN)


def shares(df: DataFrame, each: int, least: int = 8) -> int:
    """How many partitions of about ``each`` input bytes hold ``df``; the shuffle's own number where Catalyst has no size."""
    size = input_bytes(df)
    if size >= UNKNOWN:
        return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, math.ceil(size / each))
