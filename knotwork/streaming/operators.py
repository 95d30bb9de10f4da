"""Structured Streaming forms of the band join, the partition and of dropping redelivered rows.

All are plain streaming plans: state is bounded by the watermark, late rows beyond it are dropped, and a restart from the
checkpoint continues where it stopped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _zoned(df: DataFrame, time: str) -> DataFrame:
    return df.withColumn(time, F.col(time).cast("timestamp"))


def stream_once(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """The stream without redelivered rows: of equal keys the first row is kept, remembered for ``delay``."""
    return _zoned(stream, time).withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_band_edges(stream: DataFrame, node_id: str, time: str, within_seconds: float, delay: str, on: Sequence[str] = (), features: Sequence[str] = (), source: str = "s", target: str = "t") -> DataFrame:
    """Edges between rows of a stream at most ``within_seconds`` apart in ``time``, the earlier one (ties: the smaller id) as source.

    An interval join of the stream with itself by buckets of time, as in the batch band join; both sides keep rows only as
    long as a partner may come. ``ft_r`` is the distance in seconds. Nodes of unknown time have no edge.
    """
    width = max(1, int(within_seconds * 1e6))
    both = _zoned(stream, time).withWatermark(time, delay).where(F.col(time).isNotNull()).withColumn("__b", F.floor(F.unix_micros(time) / width))
    cols = list(dict.fromkeys([node_id, time, *on, *features]))
    side = lambda end, bucket: both.select(*[F.col(c).alias(f"{c}_{end}") for c in cols], bucket.alias(f"__b_{end}"))
    a, b = side("s", F.explode(F.array(F.col("__b"), F.col("__b") + 1))), side("t", F.col("__b"))
    ts, tt, ids, idt = F.col(f"{time}_s"), F.col(f"{time}_t"), F.col(f"{node_id}_s"), F.col(f"{node_id}_t")
    reach = F.make_dt_interval(secs=F.lit(width / 1e6).cast("decimal(18,6)"))
    cond = (F.col("__b_s") == F.col("__b_t")) & (tt >= ts) & (tt <= ts + reach) & ((tt > ts) | (idt > ids))
    for k in on:
        cond = cond & (F.col(f"{k}_s") == F.col(f"{k}_t"))
    gap = (F.unix_micros(tt) - F.unix_micros(ts)) / F.lit(1e6)
    moved = [f"{f}_{end}" for f in features for end in "st"]
    return a.join(b, cond).select(ids.alias(source), idt.alias(target), gap.alias("ft_r"), *moved)


def stream_partition(stream: DataFrame, keys: Sequence[str], time: str, window: str, delay: str, slide: str | None = None, aggs: Mapping[str, Column] | None = None) -> DataFrame:
    """Super nodes per time window: rows of known keys grouped by window and keys, their number and further aggregates."""
    at = _zoned(stream, time).withWatermark(time, delay)
    for k in keys:
        at = at.where(F.col(k).isNotNull())
    w = F.window(time, window, slide) if slide else F.window(time, window)
    out = at.groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n_nodes"), *[c.alias(n) for n, c in (aggs or {}).items()])
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n_nodes", *(aggs or {}))
