"""Places in a total order without a task that sorts all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.staging import kept


def numbered(rows: DataFrame, *by, name: str = "n") -> DataFrame:
    """rows with their place from 1 in the order of by, whose values should be a key.

    Ranges of the order are sorted each by itself; a place is the rows of the ranges before plus
    the place inside. The ranges are drawn once and written, so that each row keeps its range.
    """
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    ranged = kept(ranged)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_m"))
    before = sizes.select(F.col("_part"), (F.sum("_m").over(Window.orderBy("_part")) - F.col("_m")).alias("_ahead"))  # a row for each range
    inside = F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33)
    return ranged.join(F.broadcast(before), "_part").withColumn(name, inside + F.col("_ahead") + 1).drop("_part", "_at", "_ahead")
