"""Vector arithmetic on arrays, in double precision and inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def _checked(a: Column, b: Column, value: Column) -> Column:
    unlike = F.raise_error(F.lit("vectors of unlike dimensions")).cast("double")
    return F.when(F.size(a) != F.size(b), unlike).otherwise(value)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero; unlike dimensions are an error."""
    size = norm(a) * norm(b)
    return _checked(a, b, F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size))


def euclidean(a: Column, b: Column) -> Column:
    return _checked(a, b, F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))))


def normalize(v: Column) -> Column:
    """To length 1; a zero vector stays."""
    size = norm(v)
    return F.when(size == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / size))


def is_normalized(v: Column, tolerance: float = 1e-5) -> Column:
    return F.abs(norm(v) - 1) < tolerance
