"""Expressions over dense vectors held as array<double>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, also where body uses it per element."""
    return F.transform(F.array(value), body)[0]


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def scale(xs: Column, by: Column) -> Column:
    return F.transform(xs, lambda x: x * by)


def divide(xs: Column, by: Column) -> Column:
    """Elements divided by a number; null elements where it is 0."""
    return F.transform(xs, lambda x: x / F.nullif(by, F.lit(0)))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def squares(xs: Column) -> Column:
    return F.transform(xs, lambda x: x * x)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def sum_of(xs: Column, dim: int) -> Column:
    """Aggregate: element-wise sum of vectors of known length, combined map-side."""
    return F.array(*[F.sum(xs[i]) for i in range(dim)])


def sum_of_squares(xs: Column, dim: int) -> Column:
    return F.array(*[F.sum(xs[i] * xs[i]) for i in range(dim)])


def mean_of(xs: Column, dim: int) -> Column:
    return F.array(*[F.avg(xs[i]) for i in range(dim)])
