"""Vector expressions over ARRAY<DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine_similarity(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 where a vector has no length; vectors of different sizes raise an error."""
    product = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    same = F.when(F.size(a) == F.size(b), dot(a, b)).otherwise(F.raise_error(F.lit("vectors differ in size")).cast("double"))
    return F.when(product == 0, F.lit(0.0)).otherwise(same / product)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)
