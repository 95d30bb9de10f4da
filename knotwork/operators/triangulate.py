"""Ear clipping of polygon rings given as vertex lists."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A difference of products of doubles is trusted beyond this share of the products' size.
_SAFE = 8e-16


def _turn(a: tuple, b: tuple, c: tuple) -> int:
    """Sign of the turn a-b-c, exact: 1 left, -1 right, 0 straight."""
    p, q = (b[0] - a[0]) * (c[1] - a[1]), (b[1] - a[1]) * (c[0] - a[0])
    d = p - q
    if abs(d) > _SAFE * (abs(p) + abs(q)):
        return 1 if d > 0 else -1
    ax, ay, bx, by, cx, cy = map(Fraction, (*a, *b, *c))
    d = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (d > 0) - (d < 0)


def _holds(a: tuple, b: tuple, c: tuple, others: list[tuple]) -> bool:
    """Whether the closed triangle a-b-c (turning left) holds any of the other points."""
    xs = np.array([p[0] for p in others])
    ys = np.array([p[1] for p in others])
    box = (xs >= min(a[0], b[0], c[0])) & (xs <= max(a[0], b[0], c[0])) & (ys >= min(a[1], b[1], c[1])) & (ys <= max(a[1], b[1], c[1]))
    return any(all(_turn(p, q, others[k]) >= 0 for p, q in ((a, b), (b, c), (c, a))) for k in np.flatnonzero(box))


def unwrap_ring(lats: np.ndarray, lons: np.ndarray) -> list[tuple[float, float]] | None:
    """Vertices (x, y) of a ring whose edges take the shorter way in longitude; None if it turns around a pole.

    x runs on beyond 180 where the ring crosses the date line; its smallest value lies in [-180, 180).
    """
    shift, turns = 0, []
    for k, lon in enumerate(lons):
        if k:
            step = lon + 360 * shift - (lons[k - 1] + 360 * turns[-1])
            shift -= int(np.floor((step + 180) / 360))
        turns.append(shift)
    end = lons[0] - (lons[-1] + 360 * turns[-1])
    if int(np.floor((end + 180) / 360)) != 0:
        return None
    low = min(lon + 360 * m for lon, m in zip(lons, turns))
    back = int(np.floor((low + 180) / 360))
    return [(float(lon + 360 * (m - back)) if m != back else float(lon), float(lat)) for lon, lat, m in zip(lons, lats, turns)]


def ear_clip(ring: list[tuple[float, float]]) -> list[tuple]:
    """Triangles (a, b, c, ab, bc, ca) of a simple ring: corners turning left, and whether each side lies on the ring.

    Repeated vertices and a closing vertex are dropped; fewer than three left, or a ring that crosses itself, give none.
    """
    pts = [p for k, p in enumerate(ring) if p != ring[k - 1]]
    if len(pts) < 3:
        return []
    area = sum(Fraction(p[0]) * Fraction(q[1]) - Fraction(q[0]) * Fraction(p[1]) for p, q in zip(pts, pts[1:] + pts[:1]))
    if area == 0:
        return []
    if area < 0:
        pts.reverse()
    rim = [True] * len(pts)  # whether the side after this vertex lies on the ring
    left = list(range(len(pts)))
    out: list[tuple] = []
    start = 0
    while len(left) > 3:
        n, clipped = len(left), False
        bent = {k for j, k in enumerate(left) if _turn(pts[left[j - 1]], pts[k], pts[left[(j + 1) % n]]) < 0}
        for step in range(n):
            j = (start + step) % n
            i, k, m = left[j - 1], left[j], left[(j + 1) % n]
            a, b, c = pts[i], pts[k], pts[m]
            turn = _turn(a, b, c)
            if turn == 0:
                rim[i] = rim[i] and rim[k]
            elif turn > 0 and not ((others := [pts[o] for o in bent if pts[o] not in (a, b, c)]) and _holds(a, b, c, others)):
                out.append((a, b, c, rim[i], rim[k], False))
                rim[i] = False
            else:
                continue
            left.pop(j)
            start, clipped = j, True
            break
        if not clipped:
            return []
    a, b, c = (pts[k] for k in left)
    if _turn(a, b, c) > 0:
        out.append((a, b, c, *(rim[k] for k in left)))
    return out


def triangulate(regions: DataFrame, region_id: str, lats: str, lons: str) -> DataFrame:
    """One row per triangle: ``region_id``, corners ax..cy, box x0..y1, and rim_ab/rim_bc/rim_ca.

    A ring with an unknown vertex, lists of unequal length, a latitude beyond 90, fewer than three different vertices,
    a crossing of itself, or a turn around a pole has no known inside and gives no triangle.
    """
    key = regions.schema[region_id].dataType
    corner = [f"{p}{q}" for p in "abc" for q in "xy"]
    schema = T.StructType(
        [T.StructField(region_id, key)]
        + [T.StructField(c, T.DoubleType()) for c in (*corner, "x0", "x1", "y0", "y1")]
        + [T.StructField(c, T.BooleanType()) for c in ("rim_ab", "rim_bc", "rim_ca")]
    )
    names = schema.fieldNames()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for rid, la, lo in zip(frame["r"], frame["la"], frame["lo"]):
                la, lo = np.asarray(la, dtype=float), np.asarray(lo, dtype=float)
                if len(la) != len(lo) or len(la) < 3 or not (np.isfinite(la).all() and np.isfinite(lo).all()) or (abs(la) > 90).any():
                    continue
                for a, b, c, ab, bc, ca in ear_clip(unwrap_ring(la, lo) or []):
                    xs, ys = (a[0], b[0], c[0]), (a[1], b[1], c[1])
                    rows.append((rid, *a, *b, *c, min(xs), max(xs), min(ys), max(ys), ab, bc, ca))
            yield pd.DataFrame(rows, columns=names)

    doubles = "array<double>"
    given = regions.select(F.col(region_id).alias("r"), F.col(lats).cast(doubles).alias("la"), F.col(lons).cast(doubles).alias("lo"))
    return given.where("r is not null and la is not null and lo is not null").mapInPandas(run, schema)
