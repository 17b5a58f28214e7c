"""Tables that several branches of one plan read, computed once."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def forget(spark: SparkSession) -> None:
    """Lets the driver collect finished plans, once listeners have seen their last events, which refer to them: their shuffle files go."""
    try:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    except Exception:  # slow listeners: the files go later
        pass
    for _ in range(2):  # what the first pass lets go of still refers to the rest
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def length(spark: SparkSession, path: str) -> int:
    """Bytes of the files in a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def kept(df: DataFrame, free: bool = False) -> DataFrame:
    """df, written to the session's checkpoint folder, by columns and compressed: lineage ends there, and lost executors lose nothing.

    The folder is the one that spark.checkpoint.dir names; a temporary one only on a local master.
    free: the shuffle files behind a large table go at once, else when the driver happens to collect what refers to them.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        found = spark.conf.get("spark.checkpoint.dir", None) or None
        if not found:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        context.setCheckpointDir(found)
    at = f"{context._jsc.sc().getCheckpointDir().get()}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    if free and length(spark, at) > 8 << 20:
        forget(spark)
    return spark.read.schema(df.schema).parquet(at)
