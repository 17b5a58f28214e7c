"""Connected components by alternating stars over a staged edge table; hubs never meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import util


def components(edges: DataFrame, *, rounds: int = 60) -> tuple[DataFrame, str]:
    """edges(a, b) to a staged (node, component): the smallest node that can be reached.

    Each round points every neighbour above a node to the least one near it (large star), then
    every neighbour below (small star). The least neighbour is a partial aggregate and comes
    back by a join, which Spark splits where one node holds many edges. Ends when nothing moves.
    """
    spark = edges.sparkSession
    both = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, path = util.staged(both.distinct(), "edges")
    mark = None
    for _ in range(rounds):
        around = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = around.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # what lies below a node: its least neighbour there stands for itself
        large = large.unionByName(least.where("m < u").select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(below, F.col("a") == F.col("u"))
        small = small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(below.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        new, at = util.staged(small, "edges")
        seen = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        util.drop(spark, path)
        now, path = new, at
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("the components didn't settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")), path
