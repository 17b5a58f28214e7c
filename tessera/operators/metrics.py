"""Ranking metrics over long tables of (query, item, rank) and gold items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import ranking, text


def gold_ranks(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """query, gold, rank (null where it isn't listed)."""
    hit = ranked.select(F.col("query").alias("_q"), F.col("item").alias("_i"), F.col("rank"))
    return gold.join(hit, (F.col("query") == F.col("_q")) & (F.col("gold") == F.col("_i")), "left").drop("_q", "_i")


def by_turn(ranks: DataFrame, turn: str, ks=(1, 10, 20)) -> DataFrame:
    return ranks.groupBy(turn).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(ranking.ndcg(F.col("rank"), k)), 6).alias(f"ndcg{k}") for k in ks], *[F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), 6).alias(f"hit{k}") for k in ks])


def macro(ranks: DataFrame, turn: str, k: int = 20) -> DataFrame:
    """Mean of the turns' means."""
    turns = ranks.groupBy(turn).agg(F.avg(ranking.ndcg(F.col("rank"), k)).alias("x"))
    return turns.agg(F.round(F.avg("x"), 6).alias("macro_ndcg"), F.count(F.lit(1)).alias("turns"))


def distinct_2(texts: DataFrame, column: str = "text") -> DataFrame:
    pairs = texts.select(F.explode(text.bigrams(F.filter(F.split(column, r"\s+"), lambda w: w != ""))).alias("b"))
    return pairs.agg(F.count_distinct("b").alias("different"), F.count(F.lit(1)).alias("n")).withColumn("distinct_2", F.round(F.col("different") / F.col("n"), 6))


def pareto(rows: DataFrame, size: str, gain: str) -> DataFrame:
    """Rows that beat every smaller one."""
    best = F.max(gain).over(Window.orderBy(size, F.desc(gain)).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_best", best).where(F.col("_best").isNull() | (F.col(gain) > F.col("_best"))).drop("_best")
