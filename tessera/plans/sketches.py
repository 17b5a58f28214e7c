"""Sketches that are kept for each day and merged later (D29, D15, D8): distinct counts, quantiles, frequent items.

Each query says whether the merged sketch is within its stated error of the exact value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.base import PLAYS, query
from tessera.sources import tables as t
from tessera.sources.staging import kept

#: buckets of a distinct count (2 ** 12: a standard error of 1.04 / 64), size of a quantile sketch, items of a frequency sketch
BUCKETS, QUANTILES, ITEMS = 12, 400, 1 << 16


def daily_distinct(rows: DataFrame, day, by: list[str], value: str) -> DataFrame:
    """A sketch of the distinct values for each day and group."""
    return rows.groupBy(day.alias("day"), *by).agg(F.hll_sketch_agg(value, F.lit(BUCKETS)).alias("sketch"))


def merged_distinct(days: DataFrame, by: list[str]) -> DataFrame:
    return days.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


@query("d29_sketch_union", "SELECT event_type, count(DISTINCT user_id) AS users, true AS within FROM events GROUP BY 1")
def d29_union(spark, d):
    """Users of each event type from daily sketches, beside the exact count: within three standard errors."""
    rows = t.table(spark, d, "events")
    days = kept(daily_distinct(rows, F.to_date("ts"), ["event_type"], "user_id"))
    exact = rows.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    both = exact.join(merged_distinct(days, ["event_type"]), "event_type")
    error = 3 * 1.04 / 2 ** (BUCKETS / 2)
    return both.select("event_type", "users", (F.abs(F.col("estimate") - F.col("users")) <= F.greatest(F.lit(1.0), error * F.col("users"))).alias("within"))


SHARES = (0.1, 0.5, 0.9, 0.99)


@query("d15_sketch_quantiles", "SELECT event_type, p, n, true AS within FROM (SELECT event_type, count(value) AS n FROM events GROUP BY 1), (SELECT unnest([0.1, 0.5, 0.9, 0.99]::DOUBLE[]) AS p)")
def d15_sketch(spark, d):
    """Quantiles of the events' values by type from daily sketches; within: the true rank of the answer is right to one hundredth."""
    rows = t.table(spark, d, "events").where("value IS NOT NULL")
    days = kept(rows.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.kll_sketch_agg_double("value", F.lit(QUANTILES)).alias("sketch")))
    whole = days.groupBy("event_type").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    answers = whole.select("event_type", F.inline(F.array(*[F.struct(F.lit(p).alias("p"), F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias("x")) for p in SHARES])))
    # a few rows for each type: true ranks come from one pass over the values
    ranks = rows.join(F.broadcast(answers), "event_type").groupBy("event_type", "p").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("value") < F.col("x"), 1)).alias("below"), F.count(F.when(F.col("value") <= F.col("x"), 1)).alias("upto"))
    near = (F.col("below") <= (F.col("p") + 0.01) * F.col("n")) & (F.col("upto") >= (F.col("p") - 0.01) * F.col("n"))
    return ranks.select("event_type", "p", "n", near.alias("within"))


@query("d8_sketch_top_items", "SELECT row_number() OVER (ORDER BY n DESC, item) AS rank, n AS plays, true AS within FROM (SELECT item, count(*) AS n FROM plays GROUP BY 1) QUALIFY rank <= 20", PLAYS)
def d8_sketch(spark, d):
    """The 20 largest play counts, and whether the frequency sketches of 16 shares, combined, give the items of those
    ranks with counts that are right to 3.5 parts in the tracked number of all plays. Where no count is above its error
    the sketch names fewer items; one that it doesn't name counts as 0."""
    rows = t.plays(spark, d).select("session", "item")
    shares = kept(rows.groupBy((F.col("session") % 16).alias("share")).agg(F.expr(f"approx_top_k_accumulate(item, {ITEMS})").alias("state")))
    found = shares.agg(F.expr(f"approx_top_k_combine(state, {ITEMS})").alias("state")).select(F.explode(F.expr("approx_top_k_estimate(state, 20)")).alias("x")).select(F.col("x.item").alias("item"), F.col("x.count").alias("estimate"))
    counts = rows.groupBy("item").agg(F.count(F.lit(1)).alias("plays"))
    error = rows.agg((F.count(F.lit(1)) * 3.5 / ITEMS).alias("error"))
    place = lambda c, *more: F.row_number().over(Window.orderBy(F.desc(c), *more))  # noqa: E731  over 20 rows
    found = found.join(counts, "item").withColumn("place", place("estimate", "item")).select("place", "estimate", F.col("plays").alias("own"))
    first = counts.orderBy(F.desc("plays"), "item").limit(20).withColumn("rank", place("plays", "item"))
    both = first.join(found, F.col("rank") == F.col("place"), "left").crossJoin(F.broadcast(error)).fillna(0, ["estimate", "own"])
    near = (F.abs(F.col("estimate") - F.col("own")) <= F.col("error")) & (F.abs(F.col("own") - F.col("plays")) <= F.col("error"))
    return both.select(F.col("rank").cast("long").alias("rank"), "plays", near.alias("within"))
