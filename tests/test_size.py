"""What is kept small on large tables, and that the rows stay the same."""

import time

import pytest
from pyspark.sql import functions as F

from knotwork import Graph, connector, selector
from knotwork.operators import band, overlap
from knotwork.queries import graphs
from knotwork.session import CLEANUP, materialize


def _nodes(spark, n=400):
    return spark.range(n).select("id", (F.col("id") * 7 % 97).alias("x"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("k"), (F.col("id") % 5).cast("string"))).alias("kind"))


def _joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_features_of_both_ends_come_from_the_joined_rows(spark, rows):
    @connector()
    def gap(x_s, x_t):
        gap = x_t - x_s
        return gap

    @selector()
    def odd(gap):
        return gap % 2 == 1

    g = Graph(_nodes(spark)).create_edges_ft(("x", 3), gap, odd)
    named = g.partition_graph("kind", relation_funcs={"gap": "sum"})[1]
    again = Graph(g.v, g.e).partition_graph("kind", relation_funcs={"gap": "sum"})[1]
    assert rows(named, *again.columns) == rows(again, *again.columns) and named.count() == 16
    assert _joins(named) == 1  # the edges aren't joined with their nodes once more
    changed = Graph(g.v.withColumn("kind", F.lit("one")), g.e)
    assert rows(g._with(v=changed.v).partition_graph("kind")[1], "n_edges") == rows(changed.partition_graph("kind")[1], "n_edges")
    kept = g.filter_by_interval_e("gap", (1, 1))
    assert rows(kept.partition_graph("kind")[1], "kind_s", "kind_t", "n_edges") == rows(Graph(kept.v, kept.e).partition_graph("kind")[1], "kind_s", "kind_t", "n_edges")


def test_pairs_of_sets_by_blocks(spark, rows, monkeypatch):
    sets = {k: {x * x * k % 61 for x in range(k % 9)} for k in range(-3, 40)} | {1 << 40: {1, 2, -5}, 77: set()}
    items = spark.createDataFrame([(k, x) for k, xs in sets.items() for x in xs or {None}] * 2 + [(None, 3), (1 << 40, None)], "name bigint, x int")
    names = sorted(sets)
    want = [(s, t, len(sets[s]), len(sets[t]), len(sets[s] & sets[t])) for a, s in enumerate(names) for t in names[a + 1 :]]
    for elements, strip in ((6_000_000, 1 << 19), (20, 7)):
        monkeypatch.setattr(overlap, "BLOCK_ELEMENTS", elements)
        monkeypatch.setattr(overlap, "STRIP", strip)
        pairs = overlap.set_pairs(items, "name", "x")
        assert rows(pairs, *pairs.columns) == sorted(want, key=repr)
        assert _joins(pairs) == 0  # no pair is moved to meet its count
        assert rows(overlap.set_pairs(items, "name", "x", met_only=True), *pairs.columns) == sorted((w for w in want if w[4]), key=repr)
    wide = items.withColumn("x", F.col("x") + (1 << 40))
    assert rows(overlap.set_pairs(wide, "name", "x"), *pairs.columns) == sorted(want, key=repr)
    with pytest.raises(TypeError):
        overlap.set_pairs(items.withColumn("x", F.col("x").cast("string")), "name", "x")
    assert overlap.set_pairs(items.where("false"), "name", "x").isEmpty()


def test_written_tables_leave_no_shuffle_files(spark):
    def files():
        every = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(every.size()) if (name := every.apply(k).getName()).startswith("shuffle_")}

    before = files()
    table = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "count"))
    until = time.time() + 20
    while (left := files() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and table.count() == 7
    assert spark.conf.get(CLEANUP) == "false"  # what others run is as before


def test_linkage_of_suppliers_reads_the_pairs_that_met(spark, tmp_path, rows):
    lines = [(s, p) for s in range(40) for p in {s % 4 * 10 + s * k % 7 for k in range(5)}]
    spark.createDataFrame(lines, "l_suppkey bigint, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(42).select(F.col("id").alias("s_suppkey"), F.lit("n").alias("s_name")).write.parquet(f"{tmp_path}/supplier.parquet")
    every = graphs.set_overlap(spark, str(tmp_path)).select("s", "t", "intsec_strength")
    want = Graph(graphs.suppliers(spark, str(tmp_path)).v, every, node_id="s_suppkey").append_linkage("intsec_strength", at_most=10).v
    assert rows(graphs.linkage_clusters(spark, str(tmp_path)), "s_suppkey", "cluster") == rows(want, "s_suppkey", "cluster")


@pytest.mark.parametrize("even", [True, False])
def test_band_rows_travel_once(spark, rows, monkeypatch, even):
    monkeypatch.setattr(band, "MOST_ROWS", 100_000 if even else 3)
    values = [None, float("nan"), -7.5, -1e13, -1e13 + 1, 1e13, 1e13 + 2, float("inf"), *[k * 0.75 for k in range(-40, 60)], *[3.0] * 9]
    v = spark.createDataFrame([(k, x, k % 2) for k, x in enumerate(values)], "id bigint, x double, kind int")
    known = sorted((x, k) for k, x in enumerate(values) if x is not None and x == x)
    want = [(s, t) for a, (x, s) in enumerate(known) for y, t in known[a + 1 :] if y - x <= 2]
    g = Graph(v).create_edges_ft(("x", 2))
    assert rows(g.e, "s", "t") == sorted(want, key=repr)
    assert rows(Graph(v).create_edges_ft(("x", 2), on="kind").e, "s", "t") == sorted(((s, t) for s, t in want if s % 2 == t % 2), key=repr)
    big = spark.createDataFrame([(k, x) for k, x in enumerate([-(1 << 63), -(1 << 63) + 3, (1 << 63) - 4, (1 << 63) - 1, -1, 0, 4])], "id bigint, x bigint")
    assert rows(Graph(big).create_edges_ft(("x", 4)).e, "s", "t") == [(0, 1), (2, 3), (4, 5), (5, 6)]
    if even:
        plan = g.e._jdf.queryExecution().executedPlan()
        plan.execute().count()
        assert "ReusedExchange" in plan.toString()  # both sides read the same rows


def test_sorted_by_its_first_column_needs_no_positions(spark, rows):
    v = spark.range(60).select("id", (F.col("id") * 7 % 23).alias("x"), (-F.col("id")).alias("y"))
    g = Graph(v, order_by="x")
    e = g.create_edges_ft(("x", 2), require_sorted=True)
    assert not g._positioned  # nothing was sorted and written
    assert rows(e.e, "s", "t", "ft_r") == rows(g.create_edges_ft(("x", 2)).e, "s", "t", "ft_r")
    with pytest.raises(AssertionError):
        g.create_edges_ft(("y", 2), require_sorted=True)
    assert rows(Graph(v).create_edges_ft(("x", 2), from_pos=3, to_pos=9).e, "s", "t") == rows(g.create_edges_ft(("x", 2), require_sorted=True, from_pos=3, to_pos=9).e, "s", "t")
