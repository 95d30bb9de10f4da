"""Mixing: shares, caps on repeats, times that follow the schedule."""

import pytest
from pyspark.sql import functions as F

from knotwork.llm import mixing
from knotwork.llm.mixing import mix_sources


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for k in range(3000):
        rows.append((k, ["Web", " web ", "WEB\t"][k % 3], 50 + k % 101))
    rows += [(10_000 + k, "notes", 40) for k in range(100)] + [(20_000 + k, "other", 10) for k in range(500)]
    rows += [(30_000, None, 5), (30_001, "web", None), (30_002, "web", 0), (30_003, "web", -4)]
    return spark.createDataFrame(rows, "doc bigint, src string, n bigint").withColumns({"time": F.lit(0), "source": F.lit("x"), "size": F.lit(1)})


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([("web", 0.6, 3), ("notes", 0.3, 2), ("nothing", 0.1, 5)], "source string, target_share double, max_repeats int")


@pytest.mark.parametrize("run_rows", [100_000, 100])
def test_shares_and_repeats(docs, targets, monkeypatch, run_rows):
    monkeypatch.setattr(mixing, "RUN_ROWS", run_rows)
    mix = mix_sources(docs, "doc", "src", "n", targets)
    total = docs.where("n > 0").agg(F.sum("n")).first()[0]
    r = {x["source"]: x for x in mix.report.collect()}
    assert not r["web"]["short"] and abs(r["web"]["given"] - 0.6 * total) <= 151
    assert r["notes"]["short"] and r["notes"]["given"] == 2 * 100 * 40
    assert r["nothing"]["short"] and r["nothing"]["given"] == 0 and r["nothing"]["actual_share"] == 0
    assert abs(sum(x["actual_share"] for x in r.values()) - 1) < 1e-12
    order = mix.order
    assert order.groupBy("source", "doc", "pass").count().where("count > 1").isEmpty()
    per = {x["source"]: x for x in order.groupBy("source").agg(F.max("pass").alias("p"), F.min("time").alias("lo"), F.max("time").alias("hi"), F.sum("size").alias("n")).collect()}
    assert per["notes"]["p"] == 1 and per["web"]["p"] == 0 and per["notes"]["n"] == 8000
    assert all(0 <= x["lo"] < 0.02 and 0.98 < x["hi"] <= 1 for x in per.values())
    assert order.where("doc >= 20000").isEmpty()


def test_times_follow_the_schedule(docs, targets):
    ramp = {"web": [(0.0, 0.0), (1.0, 2.0)], "notes": [(0.0, 1.0), (0.5, 1.0), (0.5, 0.0), (1.0, 0.0)]}
    order = mix_sources(docs, "doc", "src", "n", targets, ramp).order.cache()
    web = order.where("source = 'web'")
    whole = web.agg(F.sum("size")).first()[0]
    for t in (0.25, 0.5, 0.8):
        early = web.where(F.col("time") <= t).agg(F.sum("size")).first()[0]
        assert abs(early / whole - t * t) < 0.01
    assert order.where("source = 'notes'").agg(F.max("time")).first()[0] <= 0.5
    times = [r["time"] for r in order.collect()]
    assert times == sorted(times)
    order.unpersist()


def test_repeatable_and_whole_passes(docs, spark):
    targets = spark.createDataFrame([("notes", 1.0, 4)], "source string, target_share double, max_repeats int")
    mix = mix_sources(docs, "doc", "src", "n", targets, total=10_000)
    again = mix_sources(docs, "doc", "src", "n", targets, total=10_000)
    key = lambda m: [tuple(r) for r in m.order.collect()]
    assert key(mix) == key(again)
    counts = {r["pass"]: r["count"] for r in mix.order.groupBy("pass").count().collect()}
    assert counts == {0: 100, 1: 100, 2: 50}


def test_bad_settings_and_empty(docs, targets, spark):
    with pytest.raises(ValueError):
        mix_sources(docs, "doc", "src", "n", targets.unionAll(targets))
    with pytest.raises(ValueError):
        mix_sources(docs, "doc", "src", "n", targets, {"web": [(0.0, 1.0), (0.9, 1.0)]})
    with pytest.raises(ValueError):
        mix_sources(docs, "doc", "src", "n", targets, {"web": [(0.0, 0.0), (1.0, 0.0)]})
    empty = mix_sources(docs.limit(0), "doc", "src", "n", targets)
    assert empty.order.count() == 0 and empty.report.count() == 3


def test_order_does_not_depend_on_the_runs(docs, targets, monkeypatch, spark):
    """The same documents in the same order, however many rows a task accumulates."""
    got = []
    for run_rows in (100_000, 700, 50):
        monkeypatch.setattr(mixing, "RUN_ROWS", run_rows)
        got.append([tuple(r) for r in mix_sources(docs, "doc", "src", "n", targets).order.collect()])
    assert got[0] == got[1] == got[2] and len(got[0]) > 1000


def test_sizes_are_computed_once(spark, targets):
    """A size that comes from a function is written before it is filtered on."""
    from pyspark.sql.types import LongType

    runs = spark.sparkContext.accumulator(0)

    @F.udf(LongType())
    def length(x):
        runs.add(1)
        return len(x)

    texts = spark.createDataFrame([(k, "web", "x" * (k % 7)) for k in range(200)], "doc bigint, src string, text string")
    mix_sources(texts.select("doc", "src", length("text").alias("n")), "doc", "src", "n", targets).report.collect()
    assert runs.value == 200


def test_short_is_read_from_what_was_drawn(docs, targets):
    text = mix_sources(docs, "doc", "src", "n", targets).report.where("short")._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in text and "n_records" in text
