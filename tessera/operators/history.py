"""Prefix windows over ordered sessions: what was played and said before a turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOVES, DOES_NOT = "MOVES", "DOES_NOT"


def before(last: int | None = None):
    """The rows of a session strictly before the current one, or the last of them."""
    return Window.partitionBy("session").orderBy("pos").rowsBetween(-last if last else Window.unboundedPreceding, -1)


def last_n(plays: DataFrame, n: int, value: str = "item", out: str = "history") -> DataFrame:
    """The last n values before each row, oldest first; fewer where the session is young."""
    return plays.withColumn(out, F.collect_list(value).over(before(n)))


def shifted_feedback(plays: DataFrame) -> DataFrame:
    """Feedback given at a turn judges the item before it: ``judged`` is the next row's label."""
    return plays.withColumn("judged", F.lead("label").over(Window.partitionBy("session").orderBy("pos")))


def running_feedback(plays: DataFrame) -> DataFrame:
    """moves, rejected (both before the row), rejected_part (at most 10, of 10), tail (run of rejections that ends before the row) and last_liked."""
    n = F.count(F.lit(1)).over(before())
    other = F.max(F.when(F.coalesce(F.col("label"), F.lit("")) != DOES_NOT, F.col("pos"))).over(before())
    count = lambda x: F.coalesce(F.sum((F.col("label") == x).cast("long")).over(before()), F.lit(0))
    return plays.withColumn("moves", count(MOVES)).withColumn("rejected", count(DOES_NOT)).withColumn("rejected_part", F.least(F.col("rejected"), F.lit(10)) / 10).withColumn("tail", n - F.coalesce(other, F.lit(0))).withColumn("last_liked", F.last(F.when(F.col("label") == MOVES, F.col("item")), ignorenulls=True).over(before()))


def positive_history(history: Column) -> Column:
    """Of array<struct<item, label>>: without rejected items; all items where nothing would be left."""
    kept = F.filter(history, lambda x: F.coalesce(x["label"], F.lit("")) != DOES_NOT)
    return F.transform(F.when(F.size(kept) == 0, history).otherwise(kept), lambda x: x["item"])


def goal_slot(goal: Column, last_liked: Column, rejected_tail: Column, drop_after: int) -> Column:
    """The goal as the query's slot: the latest liked item's text, else nothing after so many rejections, else the goal."""
    return F.when(last_liked.isNotNull(), last_liked).when(rejected_tail >= drop_after, F.lit("")).otherwise(goal)
