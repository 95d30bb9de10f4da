"""Dense row positions without a single-partition window.

Edge orientation and pair ranges are defined by row order, which a DataFrame lacks. A range-partitioned sort gives
each row a place inside its partition; adding the sizes of the partitions before it gives the dense position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its lower 33 bits


def with_position(df: DataFrame, order_by: Sequence[str | Column], name: str = "pos", partitions: int | None = None) -> DataFrame:
    """``df`` with a 0-based dense bigint ``name`` following ``order_by``.

    The order must be total for a repeatable result (add an id as tie-break). The sorted rows are written once, since
    range boundaries come from sampling and may differ between two evaluations. Only one count per partition reaches
    the driver; their sum stays with the frame as ``_knotwork_rows``. An empty input gives an empty output.
    """
    if name in df.columns:
        raise ValueError(f"column {name} exists already")
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    placed = materialize(
        ranged.sortWithinPartitions(*order)
        .withColumn("__at", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__at", _ROW_BITS))
        .withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))),
        "pos",
    )
    sizes = {r[0]: r[1] for r in placed.groupBy("__part").count().collect()}
    start, offsets = 0, []
    for part in range(max(sizes, default=-1) + 1):
        offsets.append(start)
        start += sizes.get(part, 0)
    base = F.array(*[F.lit(o).cast("bigint") for o in offsets or [0]])
    out = placed.withColumn(name, F.get(base, F.col("__part").cast("int")) + F.col("__at")).drop("__part", "__at")
    out._knotwork_rows = start  # known by now, which spares a count
    return out


def pair_index(n: Column, i: Column, j: Column) -> Column:
    """Row-major index of (i, j), i < j, in the strict upper triangle of n rows."""
    i, j, n = i.cast("bigint"), j.cast("bigint"), n.cast("bigint")
    return F.shiftright(i * (n * 2 - i - 1), 1) + (j - i - 1)


def first_row_of(n: int, k: int) -> int:
    """The row i of the triangle that holds linear index k: used to prune source rows before a range-limited join."""
    lo, hi = 0, max(n - 1, 0)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if mid * (2 * n - mid - 1) // 2 <= k:
            lo = mid
        else:
            hi = mid - 1
    return lo
