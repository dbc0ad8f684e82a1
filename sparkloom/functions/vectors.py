"""Vector arithmetic on array columns, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """The unit vector along ``v``; a zero vector becomes the first axis."""
    n = norm(v)
    axis = F.transform(v, lambda _, i: F.when(i == 0, 1.0).otherwise(0.0))
    return F.when(n == 0, axis).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle between two vectors; zero vectors count as the first axis."""
    return dot(normalized(a), normalized(b))


def certainty(cos: Column) -> Column:
    """A cosine on the scale 0 to 1."""
    return (cos + 1) / 2


def valid(v: Column, dim: int, tolerance: float = 1e-5) -> Column:
    """Whether ``v`` has ``dim`` finite components and unit length within the tolerance."""
    finite = ~F.exists(v, lambda x: F.isnan(x) | x.isNull())
    return F.coalesce((F.size(v) == dim) & finite & (F.abs(norm(v) - 1) <= tolerance), F.lit(False))
