"""Columns over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Column, factor: Column) -> Column:
    return F.transform(a, lambda x: x * factor)


def unit(a: Column) -> Column:
    """a over its norm; a zero vector stays zero."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def wide_to_array(names: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in sorted(names)])


def array_to_wide(a: Column, d: int) -> list[Column]:
    return [F.get(a, i).cast("float").alias(f"dim_{i:03d}") for i in range(d)]


def first_argmax(p: Column) -> Column:
    """1-based place of the largest element, the first of equals."""
    return F.array_position(p, F.array_max(p)).cast("int")


def log_sum_exp(x: Column) -> Column:
    m = F.array_max(x)
    return m + F.log(F.aggregate(F.transform(x, lambda v: F.exp(v - m)), F.lit(0.0), lambda s, v: s + v))


def spherical_cauchy_log_density(cos: Column, rho: Column, d: int) -> Column:
    """(d - 1) (log1p(-rho^2) - log1p(rho^2 - 2 rho cos)) up to the sphere's area."""
    return (d - 1) * (F.log1p(-rho * rho) - F.log1p(rho * rho - 2 * rho * cos))
