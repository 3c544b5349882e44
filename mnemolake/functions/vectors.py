"""Vector arithmetic on array columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products in double precision; null where lengths differ."""
    a, b = _col(a), _col(b)
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where lengths differ or a vector is zero."""
    size = norm(a) * norm(b)
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(0.0))


def l2_normalize(a: Column | str) -> Column:
    """A zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(_col(a), lambda x: x.cast("double") / n)).otherwise(F.transform(_col(a), lambda x: x.cast("double")))


def is_finite(a: Column | str) -> Column:
    return ~F.exists(_col(a), lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
