"""The plans that Spark makes: joins by key, pruned and filtered scans, partial aggregation, no global sort where none is needed."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from knotwork import Graph, connector, selector
from knotwork.operators.skew import eager_join_aggregate, pairs, total
from knotwork.session import discard, materialize, materialize_seen, shared_dir


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "v")
    spark.range(5000).select("id", (F.col("id") % 97).alias("k"), (F.col("id") * 0.5).alias("x"), F.lit("unused").alias("text"), F.timestamp_seconds("id").alias("ts")).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    """Plan as for large tables."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def looped(text):
    return "CartesianProduct" in text or "NestedLoop" in text


@connector(outputs=["gap"])
def gap(x_s, x_t):
    return x_t - x_s


@selector()
def small(gap):
    return F.abs(gap) < 1


@pytest.mark.parametrize("ft", [("x", 2.0), ("ts", 3, "s")])
def test_band_is_an_equi_join(stored, ft):
    text = plan(Graph(stored).create_edges_ft(ft, gap, small).e)
    assert not looped(text) and "SortMergeJoin" in text and "rangepartitioning" not in text and "text#" not in text.split("ReadSchema")[1][:80]


def test_keys_are_an_equi_join(stored):
    text = plan(Graph(stored).create_edges(gap, small, on="k").e)
    assert not looped(text) and "SortMergeJoin" in text and "rangepartitioning" not in text


def test_all_pairs_are_an_equi_join_of_blocks(stored):
    text = plan(Graph(stored).create_edges(gap, small).e)
    join = next(line for line in text.split("\n") if "ShuffledHashJoin" in line)
    assert not looped(text) and "abs(" in join  # the selector is part of the join


def test_filters_reach_the_scan(stored):
    text = plan(Graph(stored).filter_by_interval_v("k", (3, 5)).partition_nodes("k", {"x": "max"}))
    assert "GreaterThanOrEqual(k,3)" in text and "LessThanOrEqual(k,5)" in text
    read = text.split("ReadSchema: ")[1].split("\n")[0]
    assert "text" not in read and "id" not in read and "partial_max" in text


def test_eager_aggregation_joins_states(stored):
    df = stored.select("k", "x")
    text = plan(eager_join_aggregate(df, df.withColumnRenamed("x", "y"), "k", {"n": pairs(), "s": total("left", "x")}))
    head, tail = text.split("SortMergeJoin", 1)
    assert "partial_count(1)" in tail and tail.count("HashAggregate") >= 4 and "hashpartitioning(k" not in head


def test_written_tables(spark, stored):
    kept = materialize(stored.where("k = 1"), "test")
    assert kept.schema == stored.schema and "LogicalRDD" not in plan(kept) and kept._knotwork_path.startswith(shared_dir(spark))
    again, seen = materialize_seen(stored, "test", F.count(F.lit(1)).alias("n"), F.max("k").alias("top"))
    assert seen == {"n": 5000, "top": 96} and again.count() == 5000
    discard(kept)
    discard(stored)  # not ours: nothing happens
    with pytest.raises(Exception, match="exist"):
        spark.read.parquet(kept._knotwork_path).count()


def test_shared_folder_follows_the_session():
    session = lambda folder, master: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder), sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda key: None)))
    assert shared_dir(session("hdfs://x/shared/", "yarn")) == "hdfs://x/shared"
    assert shared_dir(session(None, "local[8]"))
    for master in ("yarn", "local-cluster[3,2,3000]", "spark://host:7077"):
        with pytest.raises(RuntimeError):
            shared_dir(session(None, master))


def test_nothing_is_left_over(tmp_path):
    """A program that is through leaves no intermediate table in the shared folder."""
    import os
    import subprocess
    import sys

    folder, root = tmp_path / "shared", os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder.mkdir()
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from knotwork import Graph, build_session
from knotwork.session import sweep
spark = build_session(master="local[2]", **{{"spark.checkpoint.dir": "file://{folder}", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
g = Graph(spark.range(50).select("id", (F.col("id") % 7).alias("k")), order_by="k").create_edges_ft(("id", 1)).append_cp()
assert g.v.count() == 50
import glob
assert glob.glob({str(folder)!r} + "/knotwork-*")
if "early" in sys.argv:
    sweep()
    assert not glob.glob({str(folder)!r} + "/knotwork-*")
"""
    for more in ([], ["early"]):
        subprocess.run([sys.executable, "-c", code, *more], check=True, timeout=300, capture_output=True)
        assert not list(folder.glob("knotwork-*"))  # Spark keeps a folder of its own there
