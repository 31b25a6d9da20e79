"""Functions on vectors held as arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))


def issues(dense: Column, sparse: Column | None = None) -> Column:
    """What is wrong with a vector: missing, NaN, all zero, norm outside (0.95, 1.05); sparse weights missing."""
    x, length = doubles(dense), norm(dense)
    found = [
        F.when(dense.isNull(), F.lit("missing dense")),
        F.when(F.exists(x, lambda v: F.isnan(v)), F.lit("nan")),
        F.when(F.forall(x, lambda v: F.abs(v) <= 1e-8), F.lit("zero")),
        F.when((length <= 0.95) | (length >= 1.05), F.lit("norm")),
    ]
    if sparse is not None:
        found.append(F.when(sparse.isNull(), F.lit("missing sparse")))
    return F.array_compact(F.array(*found))
