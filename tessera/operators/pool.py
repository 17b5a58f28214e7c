"""Candidate pools: union of sources with provenance, scores and list rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import ranking


def union_sources(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """query, item, sources (sorted), n_sources, position (of the first insertion), best_rank of (name, rows(query, item, rank))."""
    rows = None
    for i, (name, s) in enumerate(sources):
        s = s.select("query", "item", "rank", F.lit(name).alias("source"), F.lit(i).alias("ord"))
        rows = s if rows is None else rows.unionByName(s)
    return rows.groupBy("query", "item").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count_distinct("source").alias("n_sources"), F.min(F.col("ord") * 1_000_000 + F.col("rank")).alias("position"), F.min("rank").alias("best_rank"))


def weighted(pool: DataFrame, weights: dict[str, float]) -> DataFrame:
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.coalesce(F.col(name), F.lit(0.0)) * w
    return pool.withColumn("score", total)


def rrf(left: DataFrame, right: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal ranks of two lists (query, item, rank from 1); an absent rank counts as the list's length."""
    n = lambda d, c: d.groupBy("query").agg(F.max("rank").alias(c))
    both = left.select("query", "item", F.col("rank").alias("a")).join(right.select("query", "item", F.col("rank").alias("b")), ["query", "item"], "full")
    both = both.join(n(left, "na"), "query", "left").join(n(right, "nb"), "query", "left")
    part = lambda r, m: 1 / (k + F.coalesce(F.col(r), F.col(m), F.lit(0)))
    return both.select("query", "item", F.round(part("a", "na") + part("b", "nb"), 9).alias("score"))


def capped(ranked: DataFrame, group: str, cap: int, k: int) -> DataFrame:
    """At most cap of a group in rank order, filled up with the overflow; new_rank from 1."""
    nth = F.row_number().over(Window.partitionBy("query", group).orderBy("rank"))
    order = Window.partitionBy("query").orderBy((F.col("_nth") > cap).cast("int"), "rank")
    return ranked.withColumn("_nth", nth).withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k).drop("_nth")


def boosted(ranked: DataFrame, match: Column, head: int = 400) -> DataFrame:
    """Rows of the head that match come first, otherwise in rank order."""
    order = Window.partitionBy("query").orderBy(F.desc((match & (F.col("rank") <= head)).cast("int")), "rank")
    return ranked.withColumn("new_rank", F.row_number().over(order))


def suppressed(ranked: DataFrame, hit: Column, k: int) -> DataFrame:
    """Hits go to the end if k others remain."""
    others = F.sum((~hit).cast("int")).over(Window.partitionBy("query"))
    order = Window.partitionBy("query").orderBy((hit & (others >= k)).cast("int"), "rank")
    return ranked.withColumn("new_rank", F.row_number().over(order))


def blended(ranked: DataFrame, score: str, alpha: float, head: int) -> DataFrame:
    """alpha * (n - i) / n + (1 - alpha) * min-max of score over the head; the tail keeps its order."""
    inside = F.col("rank") <= head
    part = Window.partitionBy("query", inside)
    n = F.count(F.lit(1)).over(part)
    mix = alpha * ranking.linear(F.col("rank") - 1, n) + (1 - alpha) * ranking.min_max(F.col(score), part)
    rows = ranked.withColumn("blend", F.when(inside, F.round(mix, 9)))
    order = Window.partitionBy("query").orderBy((~inside).cast("int"), F.desc("blend"), "rank")
    return rows.withColumn("new_rank", F.row_number().over(order))


def padded(first: DataFrame, rest: DataFrame, k: int) -> DataFrame:
    """first(query, item, rank), filled up from rest in its order."""
    rows = first.select("query", "item", "rank", F.lit(0).alias("src")).unionByName(rest.join(first.select("query", "item"), ["query", "item"], "left_anti").select("query", "item", "rank", F.lit(1).alias("src")))
    order = Window.partitionBy("query").orderBy("src", "rank", "item")
    return rows.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k)


def mmr(ranked: DataFrame, lam: float, k: int) -> DataFrame:
    """Greedy diversity: query, item, new_rank of rows(query, item, score, v); a query's candidates are few and meet in one task."""

    def pick(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["score", "item"], ascending=[False, True])
        v = np.array(pdf.v.tolist(), np.float64)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        s = pdf.score.to_numpy()
        rel = (s - s.min()) / (s.max() - s.min()) if s.max() > s.min() else np.ones(len(s))
        near, left, out = np.zeros(len(s)), np.ones(len(s), bool), []
        for _ in range(min(k, len(s))):
            gain = np.where(left, np.round(lam * rel - (1 - lam) * near, 9), -np.inf)
            at = int(gain.argmax())
            out.append(at)
            left[at] = False
            near = np.maximum(near, v @ v[at]) if len(out) > 1 else v @ v[at]
        return pd.DataFrame({"query": pdf["query"].iloc[0], "item": pdf.item.to_numpy()[out], "new_rank": range(1, len(out) + 1)})

    return ranked.select("query", "item", "score", "v").groupBy("query").applyInPandas(pick, "query long, item long, new_rank int")
