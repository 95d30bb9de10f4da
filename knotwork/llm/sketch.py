"""Percentiles from counts in signed logarithmic buckets (the relative-error sketch of Masson, Rim and Lee, 2019).

A sketch is an ordinary table: group keys, bucket, count. Sketches of partitions, days or sources are combined by adding
the counts of equal buckets, in any order and grouping, with no loss: the combined sketch is the sketch of all values.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Magnitudes below the smallest normal double count as zero.
TINY = 2.2250738585072014e-308


def _log_width(accuracy: float) -> float:
    if not 0 < accuracy < 1:
        raise ValueError("accuracy lies between 0 and 1")
    return math.log((1 + accuracy) / (1 - accuracy))


def _lowest(accuracy: float) -> int:
    return math.floor(math.log(TINY) / _log_width(accuracy)) - 1


def bucket_of(x: Column, accuracy: float = 0.01) -> Column:
    """Signed bucket number, growing with x: 0 for zero, NULL for NULL and NaN; infinities have a bucket beyond all others."""
    width, low = _log_width(accuracy), _lowest(accuracy)
    x = x.cast("double")
    size = F.abs(x)
    top = math.ceil(math.log(1.7976931348623157e308) / width) - low + 2
    at = F.when(size == math.inf, F.lit(top)).otherwise(F.ceil(F.log(size) / width) - low).cast("int")
    return F.when(x.isNull() | F.isnan(x), F.lit(None).cast("int")).when(size < TINY, F.lit(0)).when(x > 0, at).otherwise(-at)


def bucket_value(bucket: Column, accuracy: float = 0.01) -> Column:
    """The value that is within ``accuracy`` (relative) of every value in the bucket."""
    width, low = _log_width(accuracy), _lowest(accuracy)
    top = math.ceil(math.log(1.7976931348623157e308) / width) - low + 2
    size = F.exp((F.abs(bucket) + low) * width) * (2 / (math.exp(width) + 1))
    size = F.when(F.abs(bucket) >= top, F.lit(math.inf)).otherwise(size)
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.signum(bucket) * size)


def sketch(df: DataFrame, keys: Sequence[str], value: Column | str, accuracy: float = 0.01) -> DataFrame:
    """(keys, bucket, n): how many values fall in each bucket.

    NULL and NaN values are left out; NULL keys form a group; an empty input gives an empty sketch. Tasks add up their
    own counts before the shuffle, so a group holding most rows sends a few thousand counts per task at most.
    """
    x = F.expr(value) if isinstance(value, str) else value
    if clash := {"bucket", "n"} & set(keys):
        raise ValueError(f"rename the keys {sorted(clash)}")
    return df.select(*keys, bucket_of(x, accuracy).alias("bucket")).where(F.col("bucket").isNotNull()).groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))


def combine(sketches: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One sketch from several of the same accuracy; ``keys`` may be fewer than theirs, which rolls up."""
    every = reduce(DataFrame.unionByName, [s.select(*keys, "bucket", "n") for s in sketches])
    return every.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, keys: Sequence[str], wanted: Mapping[str, float], accuracy: float = 0.01) -> DataFrame:
    """(keys, n_values, a column per wanted percentile) from a sketch made with the same ``accuracy``.

    The q-percentile of n values is the one with rank floor(q (n - 1)), counted from 0 in rising order; the result is
    within ``accuracy`` of it, relative to its size. A group without values has no row.
    """
    if bad := [q for q in wanted.values() if not 0 <= q <= 1]:
        raise ValueError(f"not between 0 and 1: {bad}")
    by = W.partitionBy(*[F.col(k) for k in keys])  # at most one row per bucket and group: bounded by the range of doubles
    ranked = counts.withColumn("__upto", F.sum("n").over(by.orderBy("bucket"))).withColumn("__all", F.sum("n").over(by))
    ranked = ranked.withColumn("__v", bucket_value(F.col("bucket"), accuracy))
    picks = [F.min(F.when(F.col("__upto") > F.floor((F.col("__all") - 1) * F.lit(float(q))), F.col("__v"))).alias(name) for name, q in wanted.items()]
    return ranked.groupBy(*keys).agg(F.sum("n").alias("n_values"), *picks).where("n_values > 0")
