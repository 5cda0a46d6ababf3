"""Columns over dense vectors, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column, floor: float = 1e-12, added: float = 0.0) -> Column:
    """The vector divided by its length: by no less than ``floor``, with ``added`` for good measure."""
    n = F.greatest(norm(v), F.lit(floor)) + F.lit(added)
    return F.transform(v, lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one has no length."""
    m, n = norm(a), norm(b)
    return F.when((m < 1e-12) | (n < 1e-12), F.lit(0.0)).otherwise(dot(a, b) / (m * n))
