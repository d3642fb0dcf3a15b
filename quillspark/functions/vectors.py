"""Vectors in array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column) -> Column:
    """Null if either is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    """Of length one; zero stays zero."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def rms_distance(a: Column, b: Column, scale: Column) -> Column:
    """Root of the mean squared difference, each in units of its scale (1e-8 at least)."""
    parts = F.zip_with(minus(a, b), scale, lambda d, s: F.pow(d / F.greatest(s, F.lit(1e-8)), F.lit(2.0)))
    return F.sqrt(_sum(parts) / F.size(a))


def angle(u: Column, v: Column) -> Column:
    """Between two steps; null where either is shorter than 1e-10."""
    cos = F.try_divide(dot(u, v), norm(u) * norm(v))
    return F.when((norm(u) >= 1e-10) & (norm(v) >= 1e-10), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def clamp_score(c: Column) -> Column:
    """1 to 10, halves to the even number; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(10), F.bround(c, 0).cast("int"))))


def from_map(m: Column, dims: list[str]) -> Column:
    """Numbers of a map in the order of dims; an absent one raises an error."""
    return F.transform(F.array(*map(F.lit, dims)), lambda d: F.coalesce(F.try_element_at(m, d), F.raise_error(F.concat(F.lit("no value for "), d)).cast("double")))
