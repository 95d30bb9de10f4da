"""Points near points, and the region that holds a point.

Both go through a bounding-volume hierarchy whose leaves are packed along a Morton curve: triangles of regions, made by ear
clipping, in the plane of longitude and latitude; points on the unit sphere in space, where no date line and no pole is in the way. What is
looked for (a point, or the cube around a ball) descends by equi-joins on node ids, one level per join, so neither side has to fit in
memory, and the few candidates left are tested exactly.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, haversine_km, unit_xyz, usable_position, wrap_lon
from ..plans.positions import with_position
from ..session import materialize
from .skew import block_join, sent_whole
from .triangulate import triangulate

#: Triangles and points per leaf, nodes per inner node, root nodes at most (they become literals of the plan).
LEAF, POINT_LEAF, FANOUT, TOP = 8, 16, 32, 64


def _spread_bits(x: Column) -> Column:
    """The 16 bits of x moved to the even places of 32."""
    x = x.cast("bigint")
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(x: Column, y: Column) -> Column:
    """Place along a Morton curve over lon [-180, 540) x lat [-90, 90]."""
    cell = lambda v, low, width: F.least(F.lit(65535), F.greatest(F.lit(0), F.floor((v - low) / width * 65536)))
    return _spread_bits(cell(x, -180, 720)).bitwiseOR(F.shiftleft(_spread_bits(cell(y, -90, 180)), 1))


def morton3(x: Column, y: Column, z: Column) -> Column:
    """Place along a Morton curve through the cube [-1, 1]^3, 2^20 steps along each axis."""

    def spread(v: Column) -> Column:
        """The 20 bits of v moved to every third place."""
        out = F.least(F.lit((1 << 20) - 1), F.greatest(F.lit(0), F.floor((v + 1) * (1 << 19)))).cast("bigint")
        for shift in (32, 16, 8, 4, 2):  # blocks of bits move apart, in halves of halves
            keep = sum(1 << (bit + 2 * (bit - bit % max(1, shift // 2))) for bit in range(20))
            out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(keep))
        return out

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1)).bitwiseOR(F.shiftleft(spread(z), 2))


@dataclass
class Hierarchy:
    """A bounding-volume hierarchy: entries by leaf (``__node``), inner levels by parent (``__up``), and at most ``TOP`` root nodes as literals.

    A box has columns ``a0`` and ``a1`` for each axis ``a``.
    """

    axes: tuple[str, ...]
    entries: DataFrame
    levels: list[DataFrame] = field(default_factory=list)
    roots: list[tuple] = field(default_factory=list)

    @staticmethod
    def of(entries: DataFrame, axes: Sequence[str], order_by: Sequence[str], leaf: int) -> Hierarchy:
        """Bulk-loaded bottom-up: entries in order, ``leaf`` of them to a leaf, then ``FANOUT`` nodes to a node. Each level is written once."""
        placed = with_position(entries, order_by, "__pos")
        tree = Hierarchy(tuple(axes), placed.withColumn("__node", F.floor(F.col("__pos") / leaf)).drop("__pos", "__m"))
        box = [f(f"{a}{k}").alias(f"{a}{k}") for a in axes for k, f in ((0, F.min), (1, F.max))]
        nodes = materialize(tree.entries.groupBy("__node").agg(*box), "boxes")
        n = nodes.count()
        while n > TOP:
            up = nodes.withColumn("__up", F.floor(F.col("__node") / FANOUT))
            tree.levels.append(up)
            nodes = materialize(up.groupBy(F.col("__up").alias("__node")).agg(*box), "boxes")
            n = math.ceil(n / FANOUT)
        tree.roots = [tuple(r) for r in nodes.select("__node", *[f"{a}{k}" for a in axes for k in (0, 1)]).collect()]
        return tree

    def met_by(self, at: DataFrame, key: str, bounds: Mapping[str, tuple[Column, Column]]) -> DataFrame:
        """Rows of ``at`` (columns apart from the tree's, one of them ``key``), once for every entry whose box meets the one given by ``bounds`` per axis.

        A node that many rows visit is split: its few children go to each block of rows. A level that Spark sends to all executors by
        its own check of the size leaves the rows where they are.
        """
        meets = lambda box: reduce(Column.__and__, [(lo <= box(f"{a}1")) & (hi >= box(f"{a}0")) for a, (lo, hi) in bounds.items()])
        names = [f"{a}{k}" for a in self.axes for k in (0, 1)]
        roots = F.array(*[F.struct(F.lit(n).cast("bigint").alias("n"), *[F.lit(float(v)).alias(c) for c, v in zip(names, b)]) for n, *b in self.roots])
        shown = at.columns
        at = at.withColumn("__root", F.explode(roots)).where(meets(lambda c: F.col("__root")[c])).select(*shown, F.col("__root")["n"].alias("__node"))
        join = lambda nodes: nodes.join(at, "__node").drop("__node") if sent_whole(nodes) else block_join(nodes, at, ["__node"], key)
        for level in reversed(self.levels):
            down = level.select(F.col("__node").alias("__down"), F.col("__up").alias("__node"), *names)
            at = join(down).where(meets(F.col)).select(*shown, F.col("__down").alias("__node"))
        return join(self.entries).where(meets(F.col))


@dataclass
class RegionIndex:
    """The triangles of regions in a hierarchy."""

    region_id: str
    tree: Hierarchy


def build_region_index(regions: DataFrame, region_id: str, lats: str, lons: str) -> RegionIndex:
    """Triangulate ``regions`` and pack the triangles into a hierarchy along the Morton curve of their middles."""
    tris = triangulate(regions, region_id, lats, lons)
    tris = tris.withColumn("__m", morton((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2))
    return RegionIndex(region_id, Hierarchy.of(tris, ("x", "y"), ["__m", region_id, "ax", "ay", "bx", "by"], LEAF))


def _not_right(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Whether p may lie to the left of a-b or on it: false only where doubles can't err."""
    p, q = (bx - ax) * (py - ay), (by - ay) * (px - ax)
    return p - q >= -(1e-14 * (F.abs(p) + F.abs(q)) + 1e-18)


def _orient(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Sign of the turn a-b-p: by doubles where they can't err, else by decimals exact to 11 places of a degree."""
    p, q = (bx - ax) * (py - ay), (by - ay) * (px - ax)
    d = p - q
    dec = lambda c: c.cast("decimal(17,11)")
    exact = (dec(bx) - dec(ax)) * (dec(py) - dec(ay)) - (dec(by) - dec(ay)) * (dec(px) - dec(ax))
    return F.when(F.abs(d) > 1e-14 * (F.abs(p) + F.abs(q)) + 1e-18, F.signum(d)).otherwise(F.signum(exact.cast("double")))


def region_of(points: DataFrame, point_id: str, lat: str, lon: str, index: RegionIndex) -> DataFrame:
    """(``point_id``, region id): the regions that hold each point, each pair once.

    A point inside a region belongs to it, whichever triangle holds it. A point that lies on rings only belongs to
    the one of those regions with the smallest id, so a shared boundary assigns it once. Unusable positions
    (:func:`usable_position`) and NULL ids give no row; a repeated id counts once per region. Longitudes are equal modulo 360.
    """
    rid = index.region_id
    if point_id == rid:
        raise ValueError("point id and region id must have different names")
    la, lo = F.col(lat).cast("double"), F.col(lon).cast("double")
    at = points.where(usable_position(la, lo) & F.col(point_id).isNotNull()).select(F.col(point_id).alias("__p"), la.alias("__y"), wrap_lon(lo).alias("__x"))
    tree = index.tree
    if not tree.roots:
        return at.select(F.col("__p").alias(point_id)).limit(0).join(tree.entries.select(rid).limit(0), F.lit(False))
    if max(r[2] for r in tree.roots) >= 180:  # some ring crosses the date line
        at = at.withColumn("__x", F.explode(F.array(F.col("__x"), F.col("__x") + 360)))
    near = tree.met_by(at, "__p", {"x": (F.col("__x"), F.col("__x")), "y": (F.col("__y"), F.col("__y"))})
    c = F.col
    ends = [("a", "b"), ("b", "c"), ("c", "a")]
    # most triangles of a leaf are surely missed, which doubles tell; the exact test is one piece of code for all three sides, small enough to be compiled
    near = near.where(reduce(Column.__and__, [_not_right(c(f"{p}x"), c(f"{p}y"), c(f"{q}x"), c(f"{q}y"), c("__x"), c("__y")) for p, q in ends]))
    sides = F.array(*[F.struct(c(f"{p}x").alias("px"), c(f"{p}y").alias("py"), c(f"{q}x").alias("qx"), c(f"{q}y").alias("qy"), c(f"rim_{p}{q}").alias("rim")) for p, q in ends])
    turn = lambda s: F.struct(_orient(s["px"], s["py"], s["qx"], s["qy"], c("__x"), c("__y")).alias("turn"), s["rim"].alias("rim"))
    near = near.select("__p", rid, F.transform(sides, turn).alias("__s")).where(F.forall("__s", lambda s: s["turn"] >= 0))
    on_rim = F.exists("__s", lambda s: s["rim"] & (s["turn"] == 0))
    held = near.groupBy("__p", rid).agg(F.max(on_rim).alias("__rim"))
    per_point = held.groupBy("__p").agg(F.collect_list(F.when(~c("__rim"), c(rid))).alias("__in"), F.min(rid).alias("__low"))  # the few regions around a point
    return per_point.select(c("__p").alias(point_id), F.explode(F.when(F.size("__in") > 0, c("__in")).otherwise(F.array("__low"))).alias(rid))


def near_pairs(points: DataFrame, point_id: str, lat: str, lon: str, km: float) -> DataFrame:
    """(left_id, right_id, km): pairs of different ids at most ``km`` apart on the sphere, left_id < right_id, each once.

    The cube around each point whose half side is the chord of ``km`` descends the hierarchy of all points; a point of a leaf it reaches
    is tested exactly. Many points in one place fill many leaves of a few points each, so no task holds them together. Unusable
    positions and NULL ids give no row; of rows that repeat an id the smallest position counts.
    """
    la, lo = F.col(lat).cast("double"), F.col(lon).cast("double")
    x, y, z = unit_xyz(F.col("lat"), F.col("lon"))
    reach = 2 * math.sin(min(km / EARTH_KM, math.pi) / 2) * (1 + 1e-9) + 1e-12
    at = (
        points.where(usable_position(la, lo) & F.col(point_id).isNotNull())
        .groupBy(F.col(point_id).alias("id"))
        .agg(F.min(F.struct(la.alias("lat"), lo.alias("lon"))).alias("p"))
        .select("id", "p.lat", "p.lon")
        .select("id", "lat", "lon", x.alias("x0"), y.alias("y0"), z.alias("z0"))
        .select("*", F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("z0").alias("z1"), morton3(F.col("x0"), F.col("y0"), F.col("z0")).alias("__m"))
    )
    tree = Hierarchy.of(at, ("x", "y", "z"), ["__m", "id"], POINT_LEAF)
    look = tree.entries.select(F.col("id").alias("a_id"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), *[F.col(f"{a}0").alias(f"a_{a}") for a in tree.axes])
    if not tree.roots:
        return look.select(F.col("a_id").alias("left_id"), F.col("a_id").alias("right_id"), F.lit(0.0).alias("km")).limit(0)
    met = tree.met_by(look, "a_id", {a: (F.col(f"a_{a}") - reach, F.col(f"a_{a}") + reach) for a in tree.axes}).where("a_id < id")
    d = haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("lat"), F.col("lon"))
    return met.select(F.col("a_id").alias("left_id"), F.col("id").alias("right_id"), d.alias("km")).where(F.col("km") <= km)
