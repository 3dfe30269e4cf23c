"""Vector columns (array<double>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)


def norm(u: Column) -> Column:
    return F.sqrt(F.aggregate(u, F.lit(0.0), lambda a, x: a + x * x))


def manhattan(u: Column, v: Column) -> Column:
    """Sum of absolute differences."""
    return F.aggregate(F.zip_with(u, v, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, x: a + x)


def cosine_distance(u: Column, v: Column) -> Column:
    """1 - cosine of two vectors; 0 if either has no length (the rule for single pairs)."""
    return F.when((norm(u) < EPS) | (norm(v) < EPS), 0.0).otherwise(1 - dot(u, v) / (norm(u) * norm(v)))


def unit(u: Column) -> Column:
    """The vector at length 1; one without length stays, so that its distance to any other is 1 (the rule for matrices)."""
    n = norm(u)
    return F.when(n < EPS, u).otherwise(F.transform(u, lambda x: x / n))
