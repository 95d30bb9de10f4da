"""Percentiles: the error bound, and that sketches combine without loss."""

import math
import random

import pytest
from pyspark.sql import functions as F

from knotwork.llm.sketch import bucket_of, bucket_value, combine, percentiles, sketch

WANTED = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}


def exact(values, q):
    return sorted(values)[math.floor(q * (len(values) - 1))]


@pytest.mark.parametrize("accuracy", [0.01, 0.1])
def test_error_bound(spark, accuracy):
    rng = random.Random(1)
    groups = {
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-200, 200) for _ in range(999)],
        "hot": [rng.lognormvariate(0, 3) for _ in range(3000)],
        "signs": [float(x) for x in range(-50, 51)],
        "same": [7.25] * 40,
        "one": [-3.0],
    }
    data = [(g, v) for g, vs in groups.items() for v in vs] + [("hot", None), ("hot", float("nan")), ("none", None)]
    df = spark.createDataFrame(data, "g string, x double")
    got = {r["g"]: r for r in percentiles(sketch(df, ["g"], "x", accuracy), ["g"], WANTED, accuracy).collect()}
    assert got.keys() == groups.keys()
    for g, values in groups.items():
        assert got[g]["n_values"] == len(values)
        for name, q in WANTED.items():
            want = exact(values, q)
            assert abs(got[g][name] - want) <= accuracy * abs(want) * (1 + 1e-9), (g, name)


def test_combining_loses_nothing(spark, rows):
    df = spark.range(5000).select((F.col("id") % 7).alias("day"), (F.col("id") % 3).alias("part"), F.exp(F.rand(3) * 20 - 10).alias("x"))
    df = df.cache()
    whole = sketch(df, ["day"], "x")
    parts = [sketch(df.where(F.col("part") == k), ["day"], "x") for k in range(3)]
    assert rows(combine(parts, ["day"]), "day", "bucket", "n") == rows(whole, "day", "bucket", "n")
    assert rows(combine([whole], []), "bucket", "n") == rows(sketch(df, [], "x"), "bucket", "n")
    assert percentiles(sketch(df, [], "x"), [], {"m": 0.5}).count() == 1
    df.unpersist()


def test_extremes(spark):
    values = [float("-inf"), -1e308, -1.0, -1e-310, 0.0, 5e-324, 1e-300, 1.0, 1e308, 1.7976931348623157e308, float("inf")]
    df = spark.createDataFrame([(x,) for x in values], "x double").select("x", bucket_of(F.col("x")).alias("b")).withColumn("v", bucket_value(F.col("b")))
    got = df.orderBy("x").collect()
    assert [r["b"] for r in got] == sorted(r["b"] for r in got)
    assert got[0]["v"] == float("-inf") and got[-1]["v"] == float("inf") and got[4]["b"] == 0
    for r in got:
        if 1e-307 < abs(r["x"]) < 1e308:
            assert abs(r["v"] - r["x"]) <= 0.01 * abs(r["x"]) * (1 + 1e-9)


def test_empty_null_keys_and_clashes(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0)], "g string, x double")
    assert percentiles(sketch(df, ["g"], "x"), ["g"], {"m": 0.5}).first()["n_values"] == 2
    assert percentiles(sketch(df.limit(0), ["g"], "x"), ["g"], {"m": 0.5}).count() == 0
    with pytest.raises(ValueError):
        sketch(df.withColumn("n", F.lit(1)), ["n"], "x")
    with pytest.raises(ValueError):
        percentiles(sketch(df, ["g"], "x"), ["g"], {"m": 1.5})
    with pytest.raises(ValueError):
        sketch(df, ["g"], "x", accuracy=0)
