"""Numeric rules in which the engine differs from Spark's defaults: NaN is unknown, division follows IEEE."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def known(expr: Column, df: DataFrame) -> Column:
    """``expr`` over ``df`` with NaN turned to NULL, if it is floating point."""
    kind = df.select(expr.alias("x")).schema["x"].dataType
    return F.when(F.isnan(expr), F.lit(None).cast(kind)).otherwise(expr) if isinstance(kind, (T.DoubleType, T.FloatType)) else expr


def nan_to_null(df: DataFrame, skip: Iterable[str] = ()) -> DataFrame:
    """``df`` with NaN turned to NULL in every float and double column: Spark ranks NaN above all numbers and counts it."""
    skip = set(skip)
    return df.select(
        *[
            F.when(F.isnan(f"`{f.name}`"), F.lit(None).cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in skip
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def known_cells(df: DataFrame, columns: Iterable[str]) -> Column:
    """How many of the columns are known in a row: neither NULL nor NaN."""
    one = lambda c: known(F.col(f"`{c}`"), df).isNotNull().cast("int")
    return sum((one(c) for c in columns), F.lit(0))


def ieee_div(a: Column, b: Column) -> Column:
    """a / b as IEEE doubles, with 0/0 unknown: x/0 is an infinity of x's sign, never an error."""
    a, b = a.cast("double"), b.cast("double")
    at_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def value_in(col: Column, values: object) -> Column:
    """True where ``col`` is one of ``values``; a string is one value; None or NaN among them matches unknown cells."""
    if isinstance(values, str) or not isinstance(values, Iterable):
        values = [values]
    values = list(values)
    some = [v for v in values if v is not None and v == v]
    hit = F.coalesce(col.isin(some), F.lit(False)) if some else F.lit(False)
    return hit | col.isNull() if len(some) < len(values) else hit
