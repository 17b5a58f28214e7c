"""Scores and rewriting keys used by several operators."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def rank_signal(rank: Column) -> Column:
    """1 / log2(rank + 2) of a rank from 0; 0 where there is none."""
    return F.coalesce(1 / F.log2(rank + 2), F.lit(0.0))


def reciprocal(rank: Column, k: int = 1) -> Column:
    return 1 / (rank + k)


def linear(rank: Column, n: Column) -> Column:
    return (n - rank) / n


def clipped(n: Column, top: int = 10) -> Column:
    return F.least(n, F.lit(top)) / top


def min_max(s: Column, over: WindowSpec, flat: float = 1.0) -> Column:
    lo, span = F.min(s).over(over), F.max(s).over(over) - F.min(s).over(over)
    return F.when(span > 0, (s - lo) / span).otherwise(F.lit(flat))


def max_scaled(s: Column, over: WindowSpec) -> Column:
    top = F.max(s).over(over)
    return s / F.when(top <= 1e-8, F.lit(1.0)).otherwise(top)


def ndcg(rank: Column, k: int = 20) -> Column:
    """Gain of one relevant item at a rank from 1; 0 beyond k or absent."""
    return F.when(rank.between(1, k), 1 / F.log2(rank + 1)).otherwise(F.lit(0.0))


def hash_unit(key: Column) -> Column:
    """[0, 1] from the first 32 bits of the SHA-256 digest."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") / 4294967295


def hash_bucket(key: Column, n: int) -> Column:
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % n
