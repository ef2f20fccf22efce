"""Vector functions over array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is evaluated once a row; inside a lambda it would be for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(v: Column) -> Column:
    """v over its length; a zero vector stays as it is."""
    length = lambda w: F.when(norm(w) == 0, F.lit(1.0)).otherwise(norm(w))
    return once(v, lambda w: once(length(w), lambda n: F.transform(w, lambda x: x / n)))


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors, within [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def pad(v: Column, size: int) -> Column:
    """V5: v followed by size zeros of its own type."""
    return F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), size))


def half_precision(c: Column) -> Column:
    """A value as half-precision storage would keep it: eleven significant bits."""
    e = F.floor(F.log2(F.abs(c)))
    step = F.pow(F.lit(2.0), F.greatest(e, F.lit(-14)) - 10)
    return F.when(c == 0, c).otherwise(F.rint(c / step) * step)
