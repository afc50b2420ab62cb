"""Vector arithmetic on array columns, in double precision, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def truncate(v: Column, dim: int) -> Column:
    return F.slice(v, 1, dim)


def l2_normalize(v: Column) -> Column:
    """Unit length; an empty or zero vector stays."""
    scale = lambda s: F.when(s > 0, F.transform(v, lambda x: x / F.sqrt(s))).otherwise(v)
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x, scale)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def similarity(distance: Column) -> Column:
    """1 - distance within [0, 1]; none for a missing distance."""
    return F.when(distance.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance)))


def problem(v: Column, dim: int) -> Column:
    """Why a vector can't be stored, or null."""
    return F.when(v.isNull(), "missing").when(F.size(v) != dim, "dimension").when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not finite")
