"""Vectors as arrays of double: products, norms, cosines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once: inside a lambda an expression would be evaluated again for each element."""
    return F.transform(F.array(value), use)[0]


def unit(v: Column) -> Column:
    """The vector at length one; null if it is null, not finite or shorter than 1e-12."""

    def scaled(w: Column) -> Column:
        bad = F.exists(w, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return _bound(norm(w), lambda length: F.when(~bad & (length > 1e-12), F.transform(w, lambda x: x / length)))

    return _bound(v, scaled)


def cosine(a: Column, b: Column) -> Column:
    """Product of unit vectors, clipped to -1 .. 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
