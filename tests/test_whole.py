"""The queries over whole tables, on small ones with blocks, types and layers of all kinds."""

import itertools

import pytest

import __spark_entry__ as contract


@pytest.fixture
def made(spark, tmp_path):
    def make(**tables):
        """A folder of tables, each given as (rows, schema)."""
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


def test_set_overlap_meets_suppliers_of_all_blocks(spark, made, rows):
    parts = {1: {1, 2, 3}, 9: {4}, 10: {2, 3}, 25: {1, 2, 3}, 340: {9}}
    folder = made(lineitem=([(s, p) for s, ps in parts.items() for p in ps] * 2, "l_suppkey bigint, l_partkey bigint"))
    want = [(s, t, len(a & b), len(a & b) / min(len(a), len(b)), a == b) for (s, a), (t, b) in itertools.combinations(parts.items(), 2)]
    assert rows(contract.queries()["set_overlap"](spark, folder), "s", "t", "intsec_card", "intsec_strength", "same") == sorted(want, key=repr)


EDGES = "s bigint, t bigint, type string, weight double"


def test_dominant_type_counts_every_type(spark, made, rows):
    pairs = {(1, 2): ["co_sighting", "co_sighting", "kin"], (1, 3): ["Signal", " signal", "trade"], (2, 3): ["other"], (2, 4): [None, None, "kin"], (3, 4): [None], (4, 5): ["trade", "kin"]}
    folder = made(layer_edges=([(s, t, k, 1.0) for (s, t), kinds in pairs.items() for k in kinds] + [(1, None, "kin", 1.0)], EDGES), layer_nodes=([(k,) for k in range(1, 6)], "v_n bigint"))
    want = [(1, 2, "co_sighting"), (1, 3, "signal"), (2, 3, "other"), (2, 4, "kin"), (3, 4, None), (4, 5, "kin")]
    assert rows(contract.queries()["dominant_type"](spark, folder), "s", "t", "dominant") == sorted(want, key=repr)


def test_multigraph_cells_of_every_type(spark, made, rows):
    edges = [(1, 2, "kin", 1.0), (1, 2, "signal", 2.0), (1, 2, "Signal", 3.0), (1, 3, "other", 4.0), (2, 3, None, 5.0), (2, 3, "trade", float("nan")), (2, 4, "trade", None), (3, None, "kin", 1.0)]
    folder = made(layer_edges=(edges, EDGES), layer_nodes=([(k,) for k in range(1, 5)], "v_n bigint"))
    want = [(1, 2, "kin", 1.0), (1, 2, "signal", 3.0), (1, 3, "other", 4.0), (2, 3, "unknown", 5.0)]
    assert rows(contract.queries()["multigraph_cells"](spark, folder), "s", "t", "relation", "value") == sorted(want, key=repr)


def test_components_of_all_layers(spark, made, rows):
    edges = [(1, 2), (2, 3), (6, 5), (5, 5), (4, None), (3, 99), (99, 4)]
    folder = made(layer_edges=([(s, t, "kin", 1.0) for s, t in edges], EDGES), layer_nodes=([(k,) for k in (1, 1, 2, 3, 4, 5, 6)], "v_n bigint"))
    known = contract.queries()
    assert rows(known["components"](spark, folder), "v_n", "cp") == [(1, 0), (2, 0), (3, 0), (4, 2), (5, 1), (6, 1)]
    assert rows(known["components_singles"](spark, folder), "v_n", "cp") == [(1, 1), (2, 1), (3, 1), (4, 0), (5, 2), (6, 2)]
    assert rows(known["components_top"](spark, folder), "cp", "n_nodes") == [(0, 3), (1, 2), (2, 1)]
    assert rows(known["strong_components"](spark, folder), "v_n", "cp") == [(k, k - 1) for k in range(1, 7)]


def test_lists_of_every_layer(spark, made, rows):
    nodes = [(2, "cell", 7, "g", 1), (1, "cell", 9, "g", 2), (1, "surge", 4, "g", 3), (1, "surge", 4, "g", 3), (3, "drift", 5, "b", 4), (4, "plume", 6, None, 5)]
    folder = made(layer_nodes=([(v, layer, 0.0, 0.0, at, color, size) for v, layer, at, color, size in nodes], "v_n bigint, layer string, x double, y double, time bigint, color string, size bigint"))
    out = contract.queries()["partition_nodes_lists"](spark, folder)
    assert rows(out, "layer", "color", "n_nodes", "size_sum", "time_list") == [("cell", "g", 2, 3, [9, 7]), ("drift", "b", 1, 4, [5]), ("surge", "g", 1, 3, [4])]
