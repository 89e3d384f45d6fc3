"""Arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from storegrain.functions.columns import as_column


def dot(a, b) -> Column:
    products = F.zip_with(as_column(a), as_column(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a, b) -> Column:
    """1 - cosine; null for a zero vector."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a) -> Column:
    length = norm(a)
    return F.transform(as_column(a), lambda x: F.try_divide(x.cast("double"), length))
