"""Expressions over array columns of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def squared_distance(a: Column, b: Column) -> Column:
    """Sum of squared differences, in double, of two arrays of equal length."""
    differences = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x - y)
    return F.aggregate(differences, F.lit(0.0), lambda total, d: total + d * d)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)
