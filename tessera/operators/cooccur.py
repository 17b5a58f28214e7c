"""Weighted co-occurrence of plays within a window, and what it expands to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: weights of the distances 1, 2 and 3
DECAY = [1.0, 0.5, 0.25]


def _one_way(plays: DataFrame, decay: list[float]) -> DataFrame:
    """src, dst, w: a play and each of the next ones; the same item twice is no pair. Leads replace a self-join."""
    order = Window.partitionBy("session").orderBy("pos")
    ahead = F.array(*[F.struct(F.lead("item", d).over(order).alias("dst"), F.lit(w).alias("w")) for d, w in enumerate(decay, 1)])
    return plays.select(F.col("item").alias("src"), ahead.alias("ahead")).select("src", F.explode("ahead").alias("x")).select("src", F.col("x.dst").alias("dst"), F.col("x.w").alias("w")).where("dst IS NOT NULL AND src != dst")


def _both_ways(one: DataFrame) -> DataFrame:
    return one.select(F.inline(F.array(F.struct("src", "dst", "w"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))))


def pairs(plays: DataFrame, decay: list[float] = DECAY) -> DataFrame:
    """src, dst, w of plays within the window, both ways."""
    return _both_ways(_one_way(plays, decay))


def neighbours(plays: DataFrame, *, decay: list[float] = DECAY, least: float = 1.0, top: int = 300, of: DataFrame | None = None) -> DataFrame:
    """src, dst, w, rank: summed weights of at least ``least``, the ``top`` of each src; of(item): of these src only.

    Weights are the same both ways, so that a pair is summed once, under its smaller item. With
    ``of``, up to two million items go to the pairs, and what begins with no other is summed.
    """
    one = _one_way(plays, decay)
    if of is None:
        one = one.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w")
        sums = _both_ways(one.groupBy("src", "dst").agg(F.sum("w").alias("w")).where(F.col("w") >= least))
    else:
        asked = of.select(F.col("item").alias("src")).distinct()
        asked = F.broadcast(asked) if asked.count() <= 2_000_000 else asked
        sums = _both_ways(one).join(asked, "src", "left_semi").groupBy("src", "dst").agg(F.sum("w").alias("w")).where(F.col("w") >= least)
    order = Window.partitionBy("src").orderBy(F.desc("w"), "dst")
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def expanded(history: DataFrame, table: DataFrame, ks: list[int]) -> DataFrame:
    """history(turn, back, item), back 1 = latest: of the neighbours that the turn hasn't played, the first ks[back - 1] of each
    place; turn, item, rank (the best place in a neighbour list from 0, played items counted), w, n_from."""
    limit = F.coalesce(*[F.when(F.col("back") == i, F.lit(k)) for i, k in enumerate(ks, 1)], F.lit(0))
    # a turn's latest plays go to the neighbour lists with what it has played, so that only what is taken becomes rows
    near = table.groupBy("src").agg(F.array_sort(F.collect_list(F.struct((F.col("rank") - 1).alias("rank"), F.col("dst").alias("item"), "w"))).alias("near"))
    played = history.groupBy("turn").agg(F.collect_set("item").alias("played"), F.collect_list(F.when(F.col("back") <= len(ks), F.struct("back", F.col("item").alias("src")))).alias("latest"))
    asked = played.select("turn", "played", F.inline("latest"))
    new = F.filter("near", lambda x: ~F.array_contains("played", x["item"]))
    taken = asked.join(near, "src").select("turn", F.inline(F.slice(new, F.lit(1), limit)))
    return taken.groupBy("turn", "item").agg(F.min("rank").alias("rank"), F.max("w").alias("w"), F.count(F.lit(1)).alias("n_from"))
