"""Vector arithmetic on array columns, in double precision; lambdas over arrays are interpreted, element by element."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    # the norm is an element of an array of one, so that it is computed once and not for each number
    return F.element_at(F.transform(F.array(F.greatest(norm(a), F.lit(1e-8))), lambda n: F.transform(a, lambda x: x / n)), 1)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def residual(a: Column, centre: Column) -> Column:
    return F.zip_with(a, centre, lambda x, y: x - y)


def repaired(a: Column, dims: int) -> Column:
    """Vectors of another length or null become zeros; all are scaled to length 1."""
    good = F.when(F.size(a) == dims, F.transform(a, lambda x: F.coalesce(x, F.lit(0.0)))).otherwise(F.array_repeat(F.lit(0.0), dims))
    return unit(F.coalesce(good, F.array_repeat(F.lit(0.0), dims)))
