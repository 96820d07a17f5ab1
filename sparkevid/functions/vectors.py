"""Vector and score expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Zero where a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def scaled(v: Column, low: Column, high: Column) -> Column:
    """Scaled to 0..1 between a group's bounds; 0 where the group has one value."""
    return F.when(high > low, (v - low) / (high - low)).otherwise(F.lit(0.0))
