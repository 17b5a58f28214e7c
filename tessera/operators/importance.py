"""What a ranker loses when one column says nothing: its values go to other candidates of the same turn.

The candidates of a turn stand in the order of a hash; each takes the column's value from the
next one, the last one from the first. So a column keeps its distribution within the turn, the
result is the same on every run, and all columns are tried in one pass over the rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import lambdamart
from tessera.operators.lambdamart import Ranker


def linear(rows: DataFrame, columns: list[str], weights: dict[str, float], *, by: str = "query", item: str = "item", label: str = "label") -> DataFrame:
    """place, name, importance: how much the mean squared error of a weighted sum grows, column by column; 0 where nothing changes.

    Missing values are 0. A window over each turn, then one aggregate that is combined before
    its shuffle. Without rows there is no importance (null).
    """
    order = Window.partitionBy(by).orderBy(F.sha2(F.concat_ws("/", F.col(by).cast("string"), F.col(item).cast("string")), 256), item)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    used = [c for c in columns if weights.get(c)]
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in used]
    x = rows.select(by, item, F.col(label).cast("double").alias("_y"), F.struct(F.lit(0.0).alias("_"), *values).alias("_x"))
    x = x.withColumn("_o", F.coalesce(F.lead("_x").over(order), F.first("_x").over(whole)))
    off = -F.col("_y")
    for c in used:
        off = off + weights[c] * F.col(f"_x.{c}")
    x = x.withColumn("_off", off)
    moved = lambda c: F.col("_off") + weights[c] * (F.col(f"_o.{c}") - F.col(f"_x.{c}"))
    lost = lambda c: F.avg(moved(c) * moved(c) - F.col("_off") * F.col("_off")) if c in used else F.when(F.count(F.lit(1)) > 0, 0.0)
    parts = [F.struct(F.lit(i).alias("place"), F.lit(c).alias("name"), lost(c).alias("importance")) for i, c in enumerate(columns, 1)]
    return x.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def trees(ranker: Ranker, turns: DataFrame, top: int = 20) -> DataFrame:
    """place, name, splits, importance: splits of the final model by column, and the mean nDCG that a turn loses without the column.

    turns are those of lambdamart.grouped. A task hands on one sum for each column and batch.
    Turns without a relevant candidate lose nothing and count like the others.
    """
    import pyarrow as pa

    width, final = len(ranker.columns), ranker.final
    used = sorted({int(c) for t in final for c in t.column if c >= 0})

    def run(batches):
        for batch in batches:
            lost, n = np.zeros(width), 0
            for query, _, items, labels, bins, _ in lambdamart._read(batch, width):
                order = sorted(range(len(labels)), key=lambda i: (hashlib.sha256(f"{query}/{items[i].as_py()}".encode()).hexdigest(), i))
                other = np.empty(len(order), np.int64)
                other[order] = np.roll(order, -1)
                base = lambdamart.ndcg(labels, lambdamart._scored(final, bins), top)
                for c in used:
                    swapped = bins.copy()
                    swapped[:, c] = bins[other, c]
                    lost[c] += base - lambdamart.ndcg(labels, lambdamart._scored(final, swapped), top)
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(lost.tolist()).cast(pa.float64()), pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64())], names=["lost", "col", "n"])

    got = turns.mapInArrow(run, "lost double, col int, n long").groupBy("col").agg((F.sum("lost") / F.sum("n")).alias("importance"))
    splits = [sum(int((t.column == i).sum()) for t in final) for i in range(width)]
    names = turns.sparkSession.createDataFrame([(i, i + 1, c, s) for i, (c, s) in enumerate(zip(ranker.columns, splits))], "col int, place int, name string, splits int")
    return names.join(got, "col", "left").select("place", "name", "splits", "importance")
