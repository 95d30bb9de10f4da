"""Clusters of a stream: runs of rows of one key whose gaps stay below a limit, kept as custom state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_clusters(stream: DataFrame, key: str, time: str, gap_seconds: float, delay: str) -> DataFrame:
    """(key, started, ended, n_nodes): closed clusters of each key. A row at most the gap from an open cluster joins it.

    An open cluster is emitted once the watermark has passed its end by the gap. Rows of one micro-batch may come in any
    order; rows may lie before an open cluster or bridge two of them, which then become one.
    """
    kind = stream.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("started", T.TimestampType()), T.StructField("ended", T.TimestampType()), T.StructField("n_nodes", T.LongType())])
    state_type = T.StructType([T.StructField("clusters", T.ArrayType(T.ArrayType(T.LongType())))])  # (start, end, rows) in microseconds
    gap = int(gap_seconds * 1e6)

    def step(k: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [list(c) for c in state.get[0]] if state.exists else []
        for frame in frames:
            held += [[t, t, 1] for t in frame["t"]]
        merged: list[list[int]] = []
        for lo, hi, n in sorted(held):
            if merged and lo - merged[-1][1] <= gap:
                merged[-1][1] = max(merged[-1][1], hi)
                merged[-1][2] += n
            else:
                merged.append([lo, hi, n])
        mark = state.getCurrentWatermarkMs() * 1000
        done = [c for c in merged if c[1] + gap < mark]
        left = [c for c in merged if c[1] + gap >= mark]
        if left:
            state.update((left,))
            state.setTimeoutTimestamp(max(int(mark // 1000) + 1, (min(c[1] for c in left) + gap) // 1000 + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({key: [k[0]] * len(done), "started": pd.to_datetime([c[0] for c in done], unit="us"), "ended": pd.to_datetime([c[1] for c in done], unit="us"), "n_nodes": [c[2] for c in done]})

    at = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).where(F.col(key).isNotNull())
    rows = at.select(key, time, F.unix_micros(time).alias("t"))
    return rows.groupBy(key).applyInPandasWithState(step, out, state_type, "append", GroupStateTimeout.EventTimeTimeout)
