"""Vector expressions, all in double precision and in order of the components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(double(a), double(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths or without direction."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(double(a), lambda x: x / n)).otherwise(double(a))
