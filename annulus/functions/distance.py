"""Inner-product distance as column expressions. Components are doubles before they are multiplied."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def inner_product(a: Column, b: Column) -> Column:
    """Null for null vectors; vectors of different length give null, as the rest of the longer has no partner."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def ip_distance(a: Column, b: Column) -> Column:
    """1 - inner product: not clamped, so it can be negative."""
    return F.lit(1.0) - inner_product(a, b)


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded for output, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)
