"""Vector columns (array<double>), JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_vector(value: Column) -> Column:
    return value.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """The vector scaled to length 1; NULL for the zero vector.

    The length is repeated as an array, because a lambda would work it out again for every element.
    """
    scaled = F.zip_with(a, F.array_repeat(norm(a), F.size(a)), lambda x, length: x / length)
    return F.when(F.exists(a, lambda x: x != 0), scaled)


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def vector_from_json(text: Column, dim: int) -> Column:
    """JSON array text as a vector; NULL when it is not ``dim`` numbers."""
    parsed = F.from_json(text, "array<double>")
    whole = (F.size(parsed) == dim) & ~F.exists(parsed, lambda x: x.isNull())
    return F.when(whole, parsed)
