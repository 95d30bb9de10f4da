"""Aggregates through joins against the joined rows; joins with hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from knotwork.operators.skew import block_join, eager_join_aggregate, hot_keys, known_rows, largest, mean, pairs, product_total, skew_join, smallest, total


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(4)
    key = lambda: rng.choice([1, 1, 1, rng.randint(2, 9), None])
    left = [(key(), rng.choice(["a", "b", None]), rng.choice([None, float("nan"), round(rng.uniform(-5, 5), 3)]), k) for k in range(300)]
    right = [(key(), rng.choice(["x", "y"]), rng.choice([None, rng.randint(-9, 9)]), k) for k in range(200)]
    return spark.createDataFrame(left, "k int, g string, x double, n int"), spark.createDataFrame(right, "k int, h string, y int, n int"), left, right


MEASURES = {"n": pairs(), "sx": total("left", "x", 3), "mx": mean("left", "x"), "cx": known_rows("left", "x"), "lo": smallest("right", "y"), "hi": largest("left", "x"), "sy": total("right", "y"), "xy": product_total("x", "y")}


@pytest.mark.parametrize(("lk", "rk", "by_key"), [([], [], False), (["g"], [], False), ([], ["h"], True), (["g"], ["h"], False)])
def test_equals_the_join(spark, sides, lk, rk, by_key):
    left, right, ls, rs = sides
    groups = {}
    for k, g, x, _ in ls:
        for q, h, y, _ in rs:
            if k is not None and k == q:
                key = tuple(([k] if by_key else []) + ([g] if lk else []) + ([h] if rk else []))
                groups.setdefault(key, []).append((x if x == x else None, y))
    out = eager_join_aggregate(left, right, "k", MEASURES, lk, rk, by_key)
    names = (["k"] if by_key else []) + lk + rk
    got = {tuple(r[c] for c in names): r for r in out.collect()}
    assert got.keys() == groups.keys()
    for key, rows in groups.items():
        r, xs, ys = got[key], [x for x, _ in rows if x is not None], [y for _, y in rows if y is not None]
        assert r["n"] == len(rows) and r["cx"] == len(xs) and r["lo"] == min(ys, default=None) and r["hi"] == max(xs, default=None)
        assert r["sy"] == (sum(ys) if ys else None) and (r["sx"] is None) == (r["mx"] is None) == (not xs)
        if xs:
            assert abs(r["sx"] - sum(xs)) < 1e-9 * len(rows) and abs(r["mx"] - sum(xs) / len(xs)) < 1e-9


def test_product(spark):
    left = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 5.0)], "k int, x double")
    right = spark.createDataFrame([(1, 10), (1, 1), (2, None)], "k int, y int")
    got = {r["k"]: r["xy"] for r in eager_join_aggregate(left, right, "k", {"xy": product_total("x", "y")}, by_key=True).collect()}
    assert got == {1: 55.0, 2: None}


def test_edge_cases(spark, sides):
    left, right, *_ = sides
    empty = eager_join_aggregate(left.limit(0), right, "k", {"n": pairs(), "s": total("right", "y")}).collect()
    assert [tuple(r) for r in empty] == [(0, None)]
    assert eager_join_aggregate(left.limit(0), right, "k", {"n": pairs()}, ["g"]).count() == 0
    with pytest.raises(ValueError):
        eager_join_aggregate(left, right, "k", {"n": pairs()}, ["n"], ["n"])
    with pytest.raises(ValueError):
        eager_join_aggregate(left, right, "k", {"g": pairs()}, ["g"])
    with pytest.raises(ValueError):
        total("middle", "x")


def test_no_joined_rows(spark):
    """Two hot keys that would join to 10^10 rows."""
    big = spark.range(100_000).select(F.lit(7).alias("k"))
    assert eager_join_aggregate(big, big, "k", {"n": pairs()}).first()["n"] == 10**10


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join(spark, rows, how):
    left = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 3 == 1, F.col("id")).alias("k"), "id")
    right = spark.range(0, 6000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w")).unionAll(spark.createDataFrame([(5, 50)], "k bigint, w bigint"))
    assert hot_keys(left, "k") == [5] and hot_keys(left.limit(0), "k") == []
    want, got = left.join(right, "k", how), skew_join(left, right, "k", how)
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(got, *want.columns) == rows(want, *want.columns)


def test_block_join(spark, rows):
    left = spark.range(40).select((F.col("id") % 4).alias("k"), F.col("id").alias("a"))
    right = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("b"))
    assert rows(block_join(left, right, ["k"], "b", 50), "a", "b") == rows(left.join(right, "k"), "a", "b")


@pytest.fixture
def no_broadcast(spark):
    """Plan as for large tables."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_block_join_splits_a_key_of_a_third(spark, rows, no_broadcast):
    """One pair of keys holds a third of the rows: it is met block by block, and looking up the blocks is salted."""
    right = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), F.lit("x").alias("g"), F.col("id").alias("b"))
    left = spark.createDataFrame([(1, "x", 10), (1, "y", 11), (4, "x", 12), (None, "x", 13)], "k bigint, g string, a bigint")
    got = block_join(left, right, ["k", "g"], "b", 500, keep_keys=True)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "__part" in text and "__salt" in text
    assert rows(got, "k", "g", "a", "b") == rows(left.join(right, ["k", "g"]), "k", "g", "a", "b")
    assert "__part" not in block_join(left, right.where("k <> 1"), ["k", "g"], "b", 500)._jdf.queryExecution().executedPlan().toString()
    assert block_join(left, right.limit(0), ["k", "g"], "b", 500).count() == 0


def test_skew_join_by_two_columns(spark, rows, no_broadcast):
    left = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), F.when(F.col("id") % 7 > 0, "x").alias("g"), "id", F.create_map(F.lit("m"), F.col("id")).alias("m"))
    right = left.select("k", "g").distinct().withColumn("w", F.xxhash64("k", "g")).where("k % 2 = 1")
    assert hot_keys(left, ["k", "g"]) == [(1, "x")]
    for how in ("inner", "left", "left_anti"):
        want, got = left.join(right, ["k", "g"], how), skew_join(left, right, ["k", "g"], how)
        assert "__salt" in got._jdf.queryExecution().executedPlan().toString()
        kept = [c for c in want.columns if c != "m"]
        assert rows(got, *kept) == rows(want, *kept)
