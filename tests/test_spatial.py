"""Triangles, regions and near points against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from knotwork.operators import skew, spatial
from knotwork.operators.spatial import build_region_index, near_pairs, region_of
from knotwork.operators.triangulate import ear_clip, triangulate, unwrap_ring


def area(ring):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1])) / 2


def star(rng, x, y, r, n):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    if any(b - a > 3 for a, b in zip(turns, turns[1:] + [turns[0] + 2 * math.pi])):
        return star(rng, x, y, r, n)
    far = [rng.uniform(0.3, 1) * r for _ in turns]
    return [(round(x + f * math.cos(t), 3), round(y + f * math.sin(t), 3)) for f, t in zip(far, turns)]


def crosses(ring, x, y):
    """Even-odd rule; None on the boundary."""
    odd = False
    for (xa, ya), (xb, yb) in zip(ring, ring[1:] + ring[:1]):
        if (ya > y) != (yb > y) and x < xa + (y - ya) / (yb - ya) * (xb - xa):
            odd = not odd
    return odd


def test_ear_clipping():
    rng = random.Random(1)
    for _ in range(60):
        ring = star(rng, rng.uniform(-100, 100), rng.uniform(-50, 50), 20, rng.randint(3, 40))
        if rng.random() < 0.5:
            ring.reverse()
        tris = ear_clip(ring + (ring[:1] if rng.random() < 0.5 else []))
        assert math.isclose(sum(area([a, b, c]) for a, b, c, *_ in tris), abs(area(ring)), rel_tol=1e-9)
        assert all(area([a, b, c]) > 0 for a, b, c, *_ in tris) and len(tris) <= len(ring) - 2
        assert sum(sum(t[3:]) for t in tris) >= 3


def test_rings_that_are_none():
    assert ear_clip([]) == [] and ear_clip([(0, 0), (1, 1)]) == [] and ear_clip([(0, 0), (1, 1), (2, 2), (0, 0)]) == []
    assert ear_clip([(0, 0), (1, 1), (1, 0), (0, 1)]) == []  # it crosses itself
    comb = [(0, 0), (4, 0), (4, 3), (3, 3), (3, 1), (2, 1), (2, 3), (1, 3), (1, 1), (0, 1)]
    assert sum(area([a, b, c]) for a, b, c, *_ in ear_clip(comb)) == abs(area(comb))
    square = ear_clip([(0, 0), (1, 0), (2, 0), (2, 2), (1, 2), (0, 2), (0, 1)])  # vertices on straight sides
    assert sum(area([a, b, c]) for a, b, c, *_ in square) == 4 and sum(sum(t[3:]) for t in square) >= 4


def test_unwrapping():
    ring = unwrap_ring([0, 0, 10, 10], [170, -170, -170, 170])
    assert sorted({x for x, _ in ring}) == [170, 190]
    assert unwrap_ring([80, 80, 80], [0, 120, -120]) is None
    assert min(x for x, _ in unwrap_ring([0, 1, 2], [370, 380, 375])) == 10


@pytest.fixture(scope="module")
def regions(spark):
    rng = random.Random(2)
    out, rings = [], {}
    for k in range(60):
        x, y = -180 + (k % 10) * 36, -60 + (k // 10) * 24
        ring = star(rng, x, y, 11, rng.randint(3, 14))
        rings[k] = ring
        lons = [(p[0] + 180) % 360 - 180 for p in ring]
        out.append((k, [p[1] for p in ring], lons))
    out += [(100, None, [1.0, 2.0, 3.0]), (101, [1.0], [1.0]), (102, [0.0, None, 1.0], [0.0, 1.0, 1.0]), (103, [1.0, 2.0], [1.0, 2.0, 3.0]), (104, [0.0, 0.0, 95.0], [0.0, 1.0, 1.0])]
    return spark.createDataFrame(out, "rid bigint, lats array<double>, lons array<double>").withColumn("x0", F.lit(1)), rings


@pytest.mark.parametrize("top", [64, 4])
def test_region_of(spark, regions, monkeypatch, top):
    monkeypatch.setattr(spatial, "TOP", top)  # a small root forces descents by joins
    monkeypatch.setattr(spatial, "FANOUT", 4)
    df, rings = regions
    rng = random.Random(3)
    points = [(k, round(rng.uniform(-75, 75), 4), round(rng.uniform(-180, 540), 4)) for k in range(2500)]
    odd = [(9001, None, 1.0), (9002, 0.0, 0.0), (9003, 95.0, 3.0), (9004, float("nan"), 3.0), (9005, 3.0, float("inf")), (None, 1.0, 1.0)]
    at = spark.createDataFrame(points + odd + points[:20], "pid bigint, lat double, lon double").withColumns({"ax": F.lit(1), "x0": F.lit(2)})
    index = build_region_index(df, "rid", "lats", "lons")
    assert (len(index.tree.levels) > 0) == (top == 4)
    got = [tuple(r) for r in region_of(at, "pid", "lat", "lon", index).collect()]
    want = {(k, r) for k, y, x in points for r, ring in rings.items() if any(crosses(ring, x + s, y) for s in (-720, -360, 0, 360))}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_shared_boundaries(spark):
    squares = [(k, [0.0, 0.0, 1.0, 1.0], [float(k), k + 1.0, k + 1.0, float(k)]) for k in range(1, 4)] + [(9, [0.0, 0.0, 1.0, 1.0], [10.0, 12.0, 12.0, 10.0])]
    index = build_region_index(spark.createDataFrame(squares, "rid bigint, lats array<double>, lons array<double>"), "rid", "lats", "lons")
    at = [(1, 0.5, 2.0), (2, 0.0, 3.0), (3, 0.5, 1.5), (4, 0.0, 1.0), (5, 0.5, 10.7), (6, 1.0, 4.0), (7, 0.1, 0.9999999), (8, 0.5, 11.0)]
    got = {tuple(r) for r in region_of(spark.createDataFrame(at, "pid bigint, lat double, lon double"), "pid", "lat", "lon", index).collect()}
    assert got == {(1, 1), (2, 2), (3, 1), (4, 1), (5, 9), (6, 3), (8, 9)}


def test_no_regions(spark, regions):
    df, _ = regions
    at = spark.createDataFrame([(1, 2.0, 3.0)], "pid bigint, lat double, lon double")
    index = build_region_index(df.limit(0), "rid", "lats", "lons")
    out = region_of(at, "pid", "lat", "lon", index)
    assert out.count() == 0 and out.columns == ["pid", "rid"]
    assert region_of(at.limit(0), "pid", "lat", "lon", build_region_index(df, "rid", "lats", "lons")).count() == 0
    assert triangulate(df.where("rid >= 100"), "rid", "lats", "lons").count() == 0


def km(a, b):
    la, lb = math.radians(a[1]), math.radians(b[1])
    h = math.sin((la - lb) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(a[2] - b[2]) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1, h)))


@pytest.fixture
def as_large(spark, monkeypatch):
    """Plan as for large tables: nothing sent to all executors, small roots, crowded nodes split early."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for name, value in (("TOP", 2), ("FANOUT", 4), ("POINT_LEAF", 3)):
        monkeypatch.setattr(spatial, name, value)
    monkeypatch.setattr(skew.block_join, "__defaults__", (20,))
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_morton_curve(spark):
    row = spark.range(1).select(*[spatial.morton3(*[F.lit(v) for v in p]) for p in ((-1.0, -1.0, -1.0), (1.0, 1.0, 1.0), (-1 + 2.0**-19 * 5, -1.0, -1.0), (0.0, -1.0, -1.0), (-1.0, -1.0, 0.0))]).first()
    assert tuple(row) == (0, (1 << 60) - 1, 0b1000001, 1 << 57, 1 << 59)


def test_many_points_in_one_place(spark, as_large, rows):
    """A third of the points share a position; points in a region all visit the same nodes."""
    at = spark.range(90).selectExpr("id", "if(id % 3 = 0, 10.0, 10.0 + id / 10.0) as lat", "20.0 as lon")
    got = near_pairs(at, "id", "lat", "lon", 1.0)
    assert "__part" in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got, "left_id", "right_id") == sorted([(a, b) for a in range(0, 90, 3) for b in range(a + 3, 90, 3)], key=repr)
    square = spark.createDataFrame([(1, [9.0, 9.0, 30.0, 30.0], [19.0, 21.0, 21.0, 19.0])], "rid bigint, lats array<double>, lons array<double>")
    held = region_of(at, "id", "lat", "lon", build_region_index(square, "rid", "lats", "lons"))
    assert "__part" in held._jdf.queryExecution().executedPlan().toString() and held.count() == 90


@pytest.mark.parametrize("large", [False, True])
@pytest.mark.parametrize("radius", [2.0, 900.0])
def test_near_pairs(spark, radius, large, request):
    if large:
        request.getfixturevalue("as_large")
    rng = random.Random(6)
    pts = []
    for k in range(250):
        if k % 2:
            base = pts[rng.randrange(len(pts))]
            pts.append((k, max(-90.0, min(90.0, base[1] + rng.uniform(-0.02, 0.02))), base[2] + rng.uniform(-0.02, 0.02) + rng.choice([0, 360])))
        else:
            pts.append((k, rng.choice([rng.uniform(-90, 90), 89.999, -90.0, 12.0]), rng.choice([rng.uniform(-180, 180), 180.0, -179.999, 5.0])))
    odd = [(900, None, 1.0), (901, 0.0, 0.0), (902, 0.0, 0.0), (903, 91.0, 1.0), (904, 91.0, 1.0), (None, 5.0, 5.0), (None, 5.0, 5.0)]
    df = spark.createDataFrame(pts + odd + pts[:30], "site bigint, lat double, lon double").withColumns({"id": F.lit(1), "cx": F.lit(1)})
    got = [tuple(r) for r in near_pairs(df, "site", "lat", "lon", radius).select("left_id", "right_id").collect()]
    want = {(a[0], b[0]) for i, a in enumerate(pts) for b in pts[i + 1 :] if km(a, b) <= radius}
    assert len(got) == len(set(got)) and set(got) == want
    assert near_pairs(df.limit(0), "site", "lat", "lon", radius).count() == 0
