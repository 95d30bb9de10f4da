"""What plots show, as tables: points, arrows, frames of an animation, rectangles, raster rows. Drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .partition import with_end_features
from .skew import skew_join


def points(v: DataFrame, node_id: str, x: str, y: str, z: str | None = None, more: Sequence[str] = ()) -> DataFrame:
    axes = [F.col(x).alias("x"), F.col(y).alias("y"), *([F.col(z).alias("z")] if z else [])]
    return v.select(node_id, *axes, *more)


def arrows(v: DataFrame, e: DataFrame, node_id: str, source: str, target: str, x: str, y: str, z: str | None = None, color: str | None = None, split_zero: bool = False) -> DataFrame:
    """Edges as arrows: start (xs, ys[, zs]), extent (dx, dy[, dz]) and, if wanted, color; ``split_zero`` marks those whose color is 0."""
    axes = [x, y, *([z] if z else [])]
    at = with_end_features(e.select(source, target, *([F.col(color).alias("color")] if color else [])), v, node_id, source, target, axes, axes)
    out = [source, target]
    out += [F.col(f"{a}_s").alias(f"{n}s") for a, n in zip(axes, "xyz")]
    out += [(F.col(f"{a}_t") - F.col(f"{a}_s")).alias(f"d{n}") for a, n in zip(axes, "xyz")]
    out += ["color"] if color else []
    out += [(F.col("color") == 0).alias("zero")] if color and split_zero else []
    return at.select(*out)


def axis_limits(v: DataFrame, columns: Sequence[str], margin: float = 0.05) -> DataFrame:
    """(axis, low, high) over all nodes, widened by ``margin`` of the range on both sides."""
    one = v.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    stack = ", ".join(f"'{c}', cast(`lo_{c}` as double), cast(`hi_{c}` as double)" for c in columns)
    wide = one.selectExpr(f"stack({len(columns)}, {stack}) as (axis, lo, hi)")
    room = (F.col("hi") - F.col("lo")) * margin
    return wide.select("axis", (F.col("lo") - room).alias("low"), (F.col("hi") + room).alias("high"))


def frames(v: DataFrame, e: DataFrame, node_id: str, source: str, target: str, by: str, x: str, y: str, color: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All frames of an animation at once: points with their group, and arrows whose ends lie in one group."""
    shown = v.select(node_id, F.col(by).alias("frame"), F.col(x).alias("x"), F.col(y).alias("y")).where("frame is not null")
    at = with_end_features(e, v, node_id, source, target, [by], [by]).where(F.col(f"{by}_s") == F.col(f"{by}_t"))
    arrow = arrows(v, at, node_id, source, target, x, y, color=color)
    key = v.select(F.col(node_id).alias(source), F.col(by).alias("frame"))
    return shown, skew_join(arrow, key, source)


def frame_generator(v: DataFrame, e: DataFrame, node_id: str, source: str, target: str, by: str, x: str, y: str, color: str | None = None) -> Iterator[tuple[object, DataFrame, DataFrame]]:
    """(group, points, arrows) group by group, in sorted order, for a caller that draws one picture after the other.

    All frames are written once, in the order of the groups, so that each is read by itself from the few row groups that hold it.
    """
    shown, arrow = (materialize(t.repartitionByRange("frame").sortWithinPartitions("frame"), "frames") for t in frames(v, e, node_id, source, target, by, x, y, color))
    for (value,) in shown.select("frame").distinct().orderBy("frame").toLocalIterator():
        yield value, shown.where(F.col("frame") == F.lit(value)), arrow.where(F.col("frame") == F.lit(value))


def color_limits(e: DataFrame, color: str) -> DataFrame:
    """(axis, low, high) of an edge color over all edges, one row with axis 'color': the same for every picture of a series."""
    return e.agg(F.min(color).cast("double").alias("low"), F.max(color).cast("double").alias("high")).select(F.lit("color").alias("axis"), "low", "high")


def rects_label_numeric(v: DataFrame, node_id: str, label: str, left: str, right: str, height: float = 1.2) -> DataFrame:
    """Rectangles from ``left`` to ``right`` in a row per label code; the row is centred on the code."""
    return v.select(node_id, F.col(left).alias("x"), (F.col(label) - height / 2).alias("y"), (F.col(right) - F.col(left)).alias("width"), F.lit(height).alias("height"))


def rects_numeric_numeric(v: DataFrame, node_id: str, left: str, right: str, bottom: str, top: str) -> DataFrame:
    return v.select(node_id, F.col(left).alias("x"), F.col(bottom).alias("y"), (F.col(right) - F.col(left)).alias("width"), (F.col(top) - F.col(bottom)).alias("height"))


def raster(v: DataFrame, label: str, time: str) -> DataFrame:
    """(row, label, time): events of each label on a row of their own, rows in sorted order of the labels."""
    from .labels import with_codes

    known = v.select(F.col(label).alias("label"), F.col(time).alias("time")).where("label is not null and time is not null")
    return with_codes(known, ["label"], "row").select("row", "label", "time")
