"""Labels for nodes: bins, parts of the day and of the year, dense codes; and histograms."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .band import is_time
from .skew import skew_join


def bin_edges(df: DataFrame, col: str, bins: int | Sequence[float] = 10, log_bins: int | bool = False, floor: bool = False) -> list[float]:
    """Edges for binning a column: ``bins`` evenly spaced edges (so bins - 1 intervals), or the given ones.

    ``log_bins``: so many edges per factor of ten, evenly spaced in the logarithm; needs values above 0. ``floor``: edges
    rounded down, repeats removed, the last one kept at the largest value. A column without known values has no edges.
    """
    if log_bins is False and not isinstance(bins, (int, np.integer)):
        return [float(b) for b in bins]
    lo, hi = (None if x is None else float(x) for x in df.agg(F.min(col), F.max(col)).first())
    if lo is None:
        return []
    if log_bins is not False:
        if lo <= 0 or lo == hi:
            raise ValueError("logarithmic bins need different values above 0")
        n = int(np.ceil((np.log10(hi) - np.log10(lo)) * log_bins))
        edges = np.logspace(np.log10(lo), np.log10(hi), n)
    else:
        edges = np.linspace(lo, hi, int(bins))
    if floor:
        edges = np.unique(np.floor(edges))
    edges[-1] = hi
    return [float(x) for x in edges]


def digitize(x: Column, edges: Sequence[float]) -> Column:
    """How many edges are passed: 0 below the first, len(edges) from the last on and for unknown values. Falling edges count from above."""
    if not len(edges):
        return F.lit(0).cast("bigint")
    arr = F.array(*[F.lit(float(e)) for e in edges])
    falling = len(edges) > 1 and edges[0] > edges[-1]
    passed = F.size(F.filter(arr, (lambda e: e > x) if falling else (lambda e: e <= x))).cast("bigint")
    return F.when(x.isNull() | F.isnan(x.cast("double")), F.lit(len(edges)).cast("bigint")).otherwise(passed)


def histogram(df: DataFrame, col: str, bins: int | Sequence[float] = 10, log_bins: int | bool = False, density: bool = False, floor: bool = False) -> DataFrame:
    """(bin, left, right, center, count): every interval of the edges, the last one closed; count is NULL where nothing lies.

    ``density``: counts divided by their sum and the width of the bin. Unknown values and values beyond the edges don't count.
    """
    edges = bin_edges(df, col, bins, log_bins, floor)
    n = len(edges) - 1
    if n < 1:
        raise ValueError("a histogram needs two different edges")
    x = F.col(col).cast("double")
    at = F.least(digitize(x, edges), F.lit(n).cast("bigint"))
    counts = df.where((x >= edges[0]) & (x <= edges[-1]) & ~F.isnan(x)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = df.sparkSession.createDataFrame([(k + 1, edges[k], edges[k + 1], (edges[k] + edges[k + 1]) / 2) for k in range(n)], "bin bigint, left double, right double, center double")
    out = every.join(F.broadcast(counts), "bin", "left")  # a row per bin
    if density:
        whole = counts.agg(F.sum("count").alias("__n"))
        out = out.crossJoin(F.broadcast(whole)).withColumn("count", F.col("count") / F.col("__n") / (F.col("right") - F.col("left"))).drop("__n")
    return out


def time_of_day(col: Column) -> Column:
    """0 to 3: night, morning, afternoon, evening, six hours each."""
    return F.floor(F.hour(col) / 6).cast("tinyint")


def met_season(col: Column) -> Column:
    """0 to 3: meteorological winter (December to February), spring, summer, autumn."""
    return F.floor((F.month(col) % 12) / 3).cast("tinyint")


def with_datetime_categories(df: DataFrame, col: str = "time", timeofday: str | bool | None = None, season: str | bool | None = None) -> DataFrame:
    """Columns with the part of the day and the season of ``col``; True names them ``<col>_timeofday`` and ``<col>_season``; what isn't asked for isn't made."""
    if not is_time(df.schema[col].dataType):
        raise TypeError(f"{col} holds no dates")
    if timeofday:
        df = df.withColumn(timeofday if isinstance(timeofday, str) else f"{col}_timeofday", time_of_day(F.col(col)))
    if season:
        df = df.withColumn(season if isinstance(season, str) else f"{col}_season", met_season(F.col(col)))
    return df


def with_codes(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """``df`` with a dense code 0, 1, ... of the sorted distinct (tuples of) values; -1 where one of them is unknown.

    A column that has the name already is replaced, unless it is one of those coded.

    Only the distinct values are ranked, by a distributed sort, and joined back; values that many rows hold are salted.
    """
    from ..plans.positions import with_position

    if name in columns:
        raise ValueError(f"{name} can't be coded into itself")
    df = df.drop(name)
    some = df.select(*columns).distinct()
    for c in columns:
        some = some.where(F.col(c).isNotNull())
    codes = with_position(some, list(columns), name)
    return skew_join(df, codes, list(columns), "left").na.fill({name: -1}).select(*df.columns, name)
