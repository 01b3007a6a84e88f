"""Vector columns: ``array<float>`` in, double precision inside."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))


def l2_normalise(v: Column | str) -> Column:
    norm = l2_norm(v)
    return F.transform(_c(v), lambda x: F.try_divide(x.cast("double"), norm).cast("float"))
