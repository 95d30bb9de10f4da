"""Vector-valued features: whitening, dot products, ranks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def array_mean(a: Column) -> Column:
    """Mean of the elements; NULL for an empty array."""
    return let(a, lambda v: F.try_divide(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double")), F.size(v).cast("double")))


def whiten(a: Column) -> Column:
    """The array less its mean, over its (population) deviation: the mean product of two whitened arrays is their correlation.

    Elements are NULL where the deviation is 0.
    """
    spread = lambda c: F.sqrt(F.try_divide(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x * x), F.size(c).cast("double")))
    centred = lambda v: let(array_mean(v), lambda m: F.transform(v, lambda x: x.cast("double") - m))
    return let(a, lambda v: let(centred(v), lambda c: let(spread(c), lambda d: F.transform(c, lambda x: F.try_divide(x, d)))))


def ordinal_ranks(a: Column) -> Column:
    """Rank of each element from 0, ties in order of place (no averaging)."""
    placed = F.array_sort(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    ranked = F.array_sort(F.transform(placed, lambda r, k: F.struct(r["i"].alias("i"), k.alias("k"))))
    return F.transform(ranked, lambda r: r["k"].cast("double"))
