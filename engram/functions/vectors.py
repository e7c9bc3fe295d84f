"""Column expressions on vectors (arrays of numbers), summed in order so that results repeat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    norms = l2_norm(a) * l2_norm(b)
    return F.when(norms > 0, dot(a, b) / norms)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once a row however often it is used, within lambdas above all."""
    return F.transform(F.array(value), use)[0]


def l2_normalize(a: Column) -> Column:
    return once(a, lambda v: once(l2_norm(v), lambda norm: F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))))


def mixed(a: Column, b: Column, share: Column) -> Column:
    """a + share * b, scaled to length 1."""
    return l2_normalize(F.zip_with(a, b, lambda x, y: x.cast("double") + share * y.cast("double")))
