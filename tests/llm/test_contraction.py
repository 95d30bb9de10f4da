"""Groups from matches, against a union-find."""

import random

import pytest
from pyspark.sql import functions as F

from knotwork.llm.contraction import connected_groups


def groups(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            low, high = sorted((find(a), find(b)))
            up[high] = low
    return {x: find(x) for x in up}


def check(spark, pairs, kind="bigint"):
    df = spark.createDataFrame(pairs, f"s {kind}, t {kind}")
    got = connected_groups(df, "s", "t").collect()
    assert len(got) == len({r["node_id"] for r in got})
    assert {r["node_id"]: r["group_id"] for r in got} == groups(pairs)


def test_shapes(spark):
    chain = [(k, k + 1) for k in range(300)]
    star = [(1000, k) for k in range(1001, 1400)]
    clique = [(a, b) for a in range(2000, 2012) for b in range(2000, 2012)]
    check(spark, chain + [(b, a) for a, b in chain[:50]] + star + clique + [(3000, 3000), (None, 3), (4, None)] * 3)


@pytest.mark.parametrize("seed", range(2))
def test_random(spark, seed):
    rng = random.Random(seed)
    check(spark, [(rng.randrange(400), rng.randrange(400)) for _ in range(260)])


def test_strings(spark):
    check(spark, [("b", "a"), ("b", "c"), ("", "z"), ("z", "ü"), (None, "a")], "string")


def test_hub_is_spread(spark):
    """A hub beyond the salting limit: its edges go to many partitions, the result is the same."""
    n = 30_000
    df = spark.range(1, n).select(F.lit(0).cast("bigint").alias("s"), F.col("id").alias("t")).unionAll(spark.range(n, n + 2000, 2).select(F.col("id"), F.col("id") + 1))
    out = connected_groups(df, "s", "t").groupBy("group_id").count()
    top = out.orderBy(F.desc("count")).first()
    assert (top["group_id"], top["count"], out.count()) == (0, n, 1001)


def test_empty_and_types(spark):
    df = spark.createDataFrame([(1, 1), (None, 2)], "s bigint, t bigint")
    out = connected_groups(df, "s", "t", "node", "grp")
    assert out.count() == 0 and out.columns == ["node", "grp"]
    with pytest.raises(ValueError):
        connected_groups(df.withColumn("t", F.col("t").cast("string")), "s", "t")
