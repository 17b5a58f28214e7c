"""Shared helpers: staged tables, partition counts, text statistics, worker caches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.staging import forget, length

#: Rows and bytes in one Arrow batch: texts can be long and staged blobs are, so far fewer than Spark's defaults.
ARROW_ROWS, ARROW_BYTES = "512", "8m"


def settle(spark: SparkSession) -> SparkSession:
    """Keeps Arrow batches of long texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for staged tables; a temporary one only where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None) or None
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
        return found
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and reads it back: lineage ends at the written table.

    Spark's cleaner deletes shuffle files when the driver collects what refers to them, else
    only twice an hour: the files behind a large written table go at once, with those of smaller ones before it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if length(spark, path) > 16 << 20:
        forget(spark)
    return spark.read.schema(df.schema).parquet(path), path


def result(df: DataFrame, *paths: str) -> DataFrame:
    """The final rows, checkpointed in the shared folder; the staged tables behind them go."""
    shared_dir(df.sparkSession)
    out = df.checkpoint()
    drop(df.sparkSession, *paths)
    return out


def drop(spark: SparkSession, *paths: str) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def blocks(df: DataFrame, mb: int = 16) -> int:
    """How many blocks of about so many MB the files have that df reads."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    # sources without files say that they are larger than anything
    return min(sum(x for x in sizes if x < 1 << 50) // (mb << 20) + 1, 1 << 17)


def parts(df: DataFrame, mb: int = 16) -> int:
    """Partitions so that one holds about so many MB of the files that df reads, at least the session's own count."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks(df, mb))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(spark).read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: str = "doc_id"):
    """True for rows whose labels are never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


#: what empties the caches that a worker process keeps from task to task
HELD: list = []


def lean() -> None:
    """Called where a task begins that needs none of the caches that earlier operators left in this worker: they go,
    and the C library gives large freed arrays back to the system at once, where it can."""
    import ctypes

    for empty in HELD:
        empty()
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # arrays from 1 MB on are mapped by themselves
        libc.malloc_trim(0)
    except (OSError, AttributeError):
        pass


#: characters from which a unit of text is not remembered
LONG = 512


class Cache:
    """Two generations of a bounded map: the older goes when the younger is full."""

    def __init__(self, limit: int = 500_000):
        self.limit, self.young, self.old = limit, {}, {}

    def turn(self) -> None:
        self.old, self.young = self.young, {}

    def clear(self) -> None:
        self.old, self.young = {}, {}
