"""Uncentred truncated SVD of a vector column, from the sum of the rows' outer products."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: the sum has the square of so many numbers and is solved on the driver
MOST = 2048


def gram(rows: DataFrame, dims: int, column: str = "v") -> np.ndarray:
    """The sum of v v' over all rows: each task adds up its own, the sums meet cell by cell."""
    import pyarrow as pa

    if dims > MOST:
        raise ValueError(f"vectors have {MOST} dimensions at most")

    def summed(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            total += x.T @ x
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "sums"])

    cells = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("array<double>")).mapInArrow(summed, "i int, sums array<double>")
    cells = cells.select("i", F.posexplode("sums").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    out = np.zeros((dims, dims))
    for r in cells.collect():  # dims x dims numbers
        out[r["i"], r["j"]] = r["x"]
    return (out + out.T) / 2


def _matrix(column, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * dims:
        raise ValueError(f"a vector has not {dims} numbers")
    return np.nan_to_num(np.asarray(flat, np.float64)).reshape(-1, dims)


def leading(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All energies, largest first, and the first k directions; the largest number of a direction is positive."""
    energy, vectors = np.linalg.eigh(sums)
    energy, vectors = np.maximum(energy[::-1], 0.0), vectors[:, ::-1][:, :k].T
    sign = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])
    return energy, vectors * sign[:, None]


def projected(rows: DataFrame, directions: np.ndarray, column: str = "v") -> DataFrame:
    """item and the vector's coordinates, and the squared length of what they leave out; null vectors go."""
    import pyarrow as pa

    dims = directions.shape[1]

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            y = x @ directions.T
            left = ((x - y @ directions) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(y), pa.list_(pa.float64())), pa.array(left)], names=["item", "v", "left"])

    return rows.where(F.col(column).isNotNull()).select(F.col("item").cast("long"), F.col(column).cast("array<double>")).mapInArrow(run, "item long, v array<double>, left double")
