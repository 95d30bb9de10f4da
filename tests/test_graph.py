"""Partitions, filters, labels, components and exports on small tables."""

import datetime as dt
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork import Graph, connector
from knotwork.functions.geo import great_circle_dist
from knotwork.functions.numeric import ieee_div
from knotwork.functions.sets import cp_intersection_strength, cp_node_intersection, hypergeometric_p_value, jaccard
from knotwork.operators.components import strong_components, weak_components
from knotwork.operators.labels import bin_edges, digitize, histogram
from knotwork.operators.partition import group_quantiles
from knotwork.operators.recipes import reversed_edges


#: Five nodes (id, x, time, color, size).
NODES = [(0, -3.4, 0, "g", 1), (1, 2.1, 1, "g", 3), (2, -1.1, 2, "b", 2), (3, 0.9, 5, "g", 3), (4, 2.3, 9, "r", 1)]


@pytest.fixture(scope="module")
def five(spark):
    @connector(outputs=["mid", "growth", "all_g"])
    def relate(x_s, x_t, size_s, size_t, color_s, color_t):
        return F.round((x_s + x_t) / 2, 6), size_t - size_s, (color_s == "g") & (color_t == "g")

    v = spark.createDataFrame(NODES, "id bigint, x double, time bigint, color string, size bigint")
    g = Graph(v).create_edges_ft(("time", 5), relate)
    return g._with(e=g.e.withColumnRenamed("ft_r", "dt"))


def related():
    """The edges of the five nodes, by a loop: s, t, dt, mid, growth, all_g."""
    out = []
    for a, b in itertools.combinations(NODES, 2):
        if b[2] - a[2] <= 5:
            out.append((a[0], b[0], b[2] - a[2], round((a[1] + b[1]) / 2, 6), b[4] - a[4], a[3] == b[3] == "g"))
    return out


def grouped(keys):
    """How many edges share each key."""
    return sorted(((*k, n) for k, n in Counter(map(keys, related())).items()), key=repr)


def test_edges_of_five(five, rows):
    assert rows(five.e, "s", "t", "dt", "mid", "growth", "all_g") == sorted(related(), key=repr)
    assert (five.n, five.m) == (5, 7) and "growth" in repr(five)


def test_partition_nodes(five, rows):
    assert rows(five.partition_nodes("color"), "color", "n_nodes") == [("b", 1), ("g", 3), ("r", 1)]
    out = five.partition_nodes(["color", "size"], {"time": "max"})
    assert rows(out, "color", "size", "n_nodes", "time") == [("b", 2, 1, 2), ("g", 1, 1, 0), ("g", 3, 2, 5), ("r", 1, 1, 9)]
    lists = five.partition_nodes("color", {"time": list.__name__}, n_nodes=False)
    assert rows(lists, "color", "time") == [("b", [2]), ("g", [0, 1, 5]), ("r", [9])]
    named = five.partition_nodes("color", {"x": ["mean", "std"], "time": "sum", "size": lambda c: F.max(c) * 10})
    assert named.columns == ["color", "n_nodes", "x_mean", "x_std", "time_sum", "size_<lambda>"]


def test_partition_rules(spark, five, rows):
    v = spark.createDataFrame([(0, None, 1.0), (1, "a", float("nan")), (2, "a", None), (3, "b", 2.0), (4, "b", 4.0)], "id bigint, k string, x double")
    out = Graph(v).partition_nodes("k", {"x": ["sum", "mean", "std", "count", "list"]})
    assert rows(out, "k", "n_nodes", "x_sum", "x_mean", "x_count", "x_list") == [("a", 2, 0.0, None, 0, [None, None]), ("b", 2, 6.0, 3.0, 2, [2.0, 4.0])]
    with pytest.raises(ValueError):
        five.partition_nodes("color", n_nodes=False)
    with pytest.raises(ValueError):
        Graph(v.withColumnRenamed("x", "n_nodes")).partition_nodes("k", {"n_nodes": "sum"})
    with pytest.raises(ValueError):
        five.partition_edges()
    assert five.partition_nodes("color", return_gv=True)[1].count().count() == 3


def test_partition_edges(five, rows):
    assert rows(five.partition_edges("all_g"), "all_g", "n_edges") == grouped(lambda e: (e[5],))
    assert rows(five.partition_edges(["all_g", "growth"]), "all_g", "growth", "n_edges") == grouped(lambda e: (e[5], e[4]))
    sums = {r["all_g"]: (r["growth"], r["mid"]) for r in five.partition_edges("all_g", relation_funcs={"growth": "sum", "mid": "min"}).collect()}
    assert sums == {k: (sum(e[4] for e in related() if e[5] == k), min(e[3] for e in related() if e[5] == k)) for k in (True, False)}
    mixed = five.partition_edges("growth", "color", "size")
    assert rows(mixed, "growth", "color_s", "size_t", "n_edges") == grouped(lambda e: (e[4], NODES[e[0]][3], NODES[e[1]][4]))
    for r in five.partition_edges("all_g", relation_funcs={"mid": ["mean", "std", "median", "q0.9"]}).collect():
        x = [e[3] for e in related() if e[5] == r["all_g"]]
        assert np.allclose([r["mid_mean"], r["mid_std"], r["mid_median"], r["mid_q0.9"]], [np.mean(x), np.std(x, ddof=1), np.median(x), np.quantile(x, 0.9)])
    assert [r["growth"] for r in five.partition_edges("growth", sort=True).collect()] == [-2, -1, 0, 1, 2]


def test_ends_that_are_no_nodes(spark, five, rows):
    lost = five._with(e=five.e.select("s", "t").unionByName(spark.createDataFrame([(0, 77)], "s bigint, t bigint")))
    assert rows(lost.partition_edges(target_features="color"), "color_t", "n_edges") == rows(five.partition_edges(target_features="color"), "color_t", "n_edges")
    assert lost.partition_edges(source_features="color", validate=True).count() > 0
    with pytest.raises(KeyError, match="77"):
        lost.partition_edges(target_features="color", validate=True)
    with pytest.raises(KeyError, match="None"):
        five._with(e=spark.createDataFrame([(None, 1)], "s bigint, t bigint")).partition_edges(None, "color", validate=True)


def test_hubs_are_salted(spark, rows):
    """One node starts a third of all edges: features, filters, indices and codes join it salted, with the same result."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        v = spark.range(300).selectExpr("id", "id % 5 as k")
        e = spark.range(9000).selectExpr("if(id % 3 = 0, 7, id % 310) as s", "(id * 7) % 300 as t")
        g = Graph(v, e)
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        for df in (g.update_edges().e, g.partition_edges(source_features="k"), g.return_cs_graph(), Graph(e, node_id="t", supernode_labels_by={"c": "s"}).v):
            assert "__salt" in plan(df)
        starts = [7 if k % 3 == 0 else k % 310 for k in range(9000)]
        assert g.update_edges().m == sum(x < 300 for x in starts) == g.return_cs_graph().count()
        assert rows(g.partition_edges(source_features="k"), "k_s", "n_edges") == sorted(Counter(x % 5 for x in starts if x < 300).items())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("q", [0, 0.25, 0.5, 0.9, 1])
def test_group_quantiles(spark, q):
    rng = random.Random(9)
    data = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([1, 2]), rng.choice([None, float("nan"), rng.uniform(-9, 9), 3.0])) for _ in range(400)] + [("c", 1, None)]
    got = {(r["k"], r["j"]): r["p"] for r in group_quantiles(spark.createDataFrame(data, "k string, j int, x double"), ["k", "j"], "x", {"p": q}).collect()}
    groups = {}
    for k, j, x in data:
        if k and x is not None and x == x:
            groups.setdefault((k, j), []).append(x)
    assert got.keys() == groups.keys() and all(np.isclose(got[k], np.quantile(x, q)) for k, x in groups.items())


def test_partition_graph(five, rows):
    sv, se = five.partition_graph("color")
    assert rows(sv, "color", "n_nodes") == [("b", 1), ("g", 3), ("r", 1)]
    assert rows(se, "color_s", "color_t", "n_edges") == [("b", "g", 1), ("g", "b", 2), ("g", "g", 3), ("g", "r", 1)]
    _, se = five.partition_graph(["color", "size"], relation_funcs={"dt": "mean"})
    assert rows(se, "color_s", "size_s", "color_t", "size_t", "n_edges", "dt") == [
        ("b", 2, "g", 3, 1, 3.0), ("g", 1, "b", 2, 1, 2.0), ("g", 1, "g", 3, 2, 3.0), ("g", 3, "b", 2, 1, 1.0), ("g", 3, "g", 3, 1, 4.0), ("g", 3, "r", 1, 1, 4.0)
    ]
    sg = five.super_graph("color")
    assert (sg.n, sg.m) == (3, 4) and sg.degrees().where("id.color = 'g'").first()["degree"] == 5  # both ends of the loop count
    roll = five.partition_rollup(["color", "size"], {"time": "max"})
    assert rows(roll.where("level < 2"), "color", "n_nodes", "time") == [("b", 1, 2), ("g", 3, 5), ("r", 1, 9), (None, 5, 9)]


def test_filters(spark, five, rows):
    assert rows(five.filter_by_interval_v("time", (1, 5)).e, "s", "t") == [(1, 2), (1, 3), (2, 3)]
    assert five.filter_by_interval_v("time", (1, 5), endpoint=False).n == 2
    assert five.filter_by_interval_e("dt", (1, 2)).m == 3 and five.filter_by_interval_e("dt", (1, 2), endpoint=False).m == 2
    assert five.filter_by_values_v("color", "g").m == 3 and five.filter_by_values_v("size", [1, 2]).n == 3
    assert five.filter_by_values_e("all_g", True).m == 3
    v = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, None)], "id bigint, x double")
    g = Graph(v)
    assert g.filter_by_values_v("x", [float("nan")]).n == 2 and g.filter_by_values_v("x", [1.0, None]).n == 3 and g.filter_by_values_v("x", 1.0).n == 1
    assert g.filter_by_interval_v("x", (0, 9)).n == 1
    e = spark.createDataFrame([(0, 1), (0, 7), (8, 1), (None, 0)], "s bigint, t bigint")
    assert rows(Graph(v, e).update_edges().e, "s", "t") == [(0, 1)]
    assert five.filter_by_group_quantile_v("color", "x", 0.5).n == 4


def test_bins(spark, rows):
    v = spark.createDataFrame([(0, 1), (1, 2), (2, 12), (3, 105), (4, 899), (5, None)], "id bigint, time bigint")
    g = Graph(v)
    take = lambda *a, **k: [r[1] for r in rows(g.append_binning_labels_v("time", "b", *a, **k).v, "id", "b")]
    assert take() == [1, 1, 1, 2, 10, 10]
    assert take(log_bins=5) == [1, 2, 6, 10, 15, 15]
    assert take(log_bins=5, floor=True) == [1, 2, 5, 9, 14, 14]
    assert take([0, 2, 100]) == [1, 2, 2, 3, 3, 3]
    edges = [100.0, 10.0, 1.5]
    known = v.where("time is not null")
    got = [r[1] for r in rows(known.select("id", digitize(F.col("time"), edges).alias("b")), "id", "b")]
    assert got == list(np.digitize([1, 2, 12, 105, 899], edges))
    with pytest.raises(ValueError):
        bin_edges(spark.createDataFrame([(0.0,), (3.0,)], "x double"), "x", log_bins=3)
    h = {r["bin"]: r["count"] for r in histogram(v, "time", [1, 2, 12, 50, 899]).collect()}
    assert h == {1: 1, 2: 1, 3: 1, 4: 2}
    assert {r["bin"]: r["count"] for r in histogram(v, "time", [0, 0.5, 12]).collect()} == {1: None, 2: 3}
    dens = histogram(v, "time", 4, density=True).collect()
    assert abs(sum((r["count"] or 0) * (r["right"] - r["left"]) for r in dens) - 1) < 1e-9


def test_datetime_categories(spark):
    v = spark.createDataFrame([(h, dt.datetime(2020, h + 1, 3, 2 * h)) for h in range(12)], "id bigint, time timestamp")
    got = Graph(v).append_datetime_categories_v(timeofday=True, met_season=True).v.orderBy("id").collect()
    assert Graph(v).append_datetime_categories_v().v.columns == ["id", "time"]
    assert [r["time_timeofday"] for r in got] == [2 * h // 6 for h in range(12)]
    assert [r["time_season"] for r in got] == [(h + 1) % 12 // 3 for h in range(12)]
    assert Graph(v).append_datetime_categories_v("time", timeofday="tod").v.columns == ["id", "time", "tod"]


def test_codes(spark, rows):
    v = spark.createDataFrame([(0, "b", 1), (1, "a", 2), (2, None, 1), (3, "b", 1), (4, "b", 0)], "id bigint, k string, n bigint")
    g = Graph(v, supernode_labels_by={"one": "k", "two": ["k", "n"]})
    assert rows(g.v, "id", "one", "two") == [(0, 1, 2), (1, 0, 0), (2, -1, -1), (3, 1, 2), (4, 1, 1)]


def test_components_of_five(spark, five, rows):
    e = spark.createDataFrame([(0, 1), (1, 2)], "s bigint, t bigint")
    g = five._with(e=e)
    assert [r[1] for r in rows(g.append_cp().v, "id", "cp")] == [0, 0, 0, 1, 2]
    assert [r[1] for r in rows(g.append_cp(consolidate_singles=True).v, "id", "cp")] == [1, 1, 1, 0, 0]
    assert [r[1] for r in rows(five._with(e=e.limit(0)).append_cp().v, "id", "cp")] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("seed", range(2))
def test_components_at_random(spark, seed):
    rng = random.Random(seed)
    arcs = [(rng.randrange(120), rng.randrange(120)) for _ in range(130)] + [(None, 1), (5, None), (7, 7)]
    e = spark.createDataFrame(arcs, "s bigint, t bigint")
    known = [(a, b) for a, b in arcs if None not in (a, b) and a != b]
    up = {}
    find = lambda x: x if up.get(x, x) == x else find(up[x])
    for a, b in known:
        up[max(find(a), find(b))] = min(find(a), find(b))
    assert {r["node"]: r["root"] for r in weak_components(e, "s", "t").collect()} == {x: find(x) for ab in known for x in ab}
    reach = {x: {x} for x in range(120)}
    for _ in range(120):
        for a, b in known:
            reach[a] |= reach[b]
    strong = {x: min(y for y in reach[x] if x in reach[y]) for x in range(120)}
    size = {r: sum(1 for v in strong.values() if v == r) for r in strong.values()}
    assert {r["node"]: r["root"] for r in strong_components(e, "s", "t").collect()} == {x: r for x, r in strong.items() if size[r] > 1}


def test_labels_jump_along_long_paths(spark, monkeypatch):
    """Around a cycle of 2,000 nodes with numbers in random order: far fewer rounds than steps."""
    from knotwork.operators import components

    rounds = []
    inner = components._spread
    monkeypatch.setattr(components, "_spread", lambda *a: rounds.append(1) or inner(*a))
    n = 2000
    number = random.Random(1).sample(range(n), n)
    arcs = spark.createDataFrame([(number[k], number[(k + 1) % n]) for k in range(n)], "u bigint, v bigint")
    labels = components._fixpoint(arcs, spark.range(n).selectExpr("id as node", "id as label"))
    assert labels.where("label <> 0").isEmpty() and labels.count() == n and len(rounds) < 60


@pytest.fixture(scope="module")
def holes(spark):
    # fixed values: which cells are unknown (column, row)
    unknown = {("dx", 0), ("dx", 1), ("dx", 2), ("dx", 3), ("dx", 4), ("dt", 1), ("up", 2), ("g", 3), ("w", 4)}
    full = [(s, t, {"dx": [9.0, 8.0, 7.0, 6.0, 5.0, 2.0, 1.4][k], "dt": float(d), "up": w > 0, "g": g, "w": m}) for k, (s, t, d, m, w, g) in enumerate(related())]
    e = [(s, t, *[None if (c, k) in unknown else x for c, x in row.items()]) for k, (s, t, row) in enumerate(full)]
    v = spark.createDataFrame([(k, float(k)) for k in range(5)], "id bigint, x double")
    return Graph(v, spark.createDataFrame(e, "s bigint, t bigint, dx double, dt double, up boolean, g boolean, w double"))


def test_exports(spark, holes, rows):
    assert holes.return_cs_graph().count() == 7
    assert holes.return_cs_graph("dt").count() == 6 and holes.return_cs_graph("dt", dropna=False).count() == 7 and holes.return_cs_graph("dx").count() == 2
    both = holes.return_cs_graph(["dt", "dx"], dropna=[False, True])
    assert {k: t.count() for k, t in both.items()} == {"dt": 7, "dx": 2}
    with pytest.raises(AssertionError):
        holes.return_cs_graph(["dt", "dx"], dropna=[True])
    assert {h: holes.return_nx_graph(relations=["dx", "dt"], dropna=h)[1].count() for h in ("none", "all", "any")} == {"none": 7, "all": 7 - 1, "any": 2}
    assert holes.return_nx_multigraph(relations=["dx", "dt"], dropna=False)[1].count() == 14
    assert holes.return_nx_multigraph(relations=["dx", "dt"])[1].count() == 8
    assert holes.return_nx_multigraph()[1].columns == ["s", "t", "relation"]
    shifted = Graph(holes.v.withColumn("id", F.col("id") + 2), holes.e.withColumns({"s": F.col("s") + 2, "t": F.col("t") + 2}))
    assert rows(shifted.return_cs_graph("dx"), "i", "j", "value") == [(2, 3, 2.0), (3, 4, 1.4)]
    vertices, arcs, kinds = shifted.return_gt_graph(features=True, relations=["dt"], node_indices=True, edge_indices=True)
    assert vertices.columns == ["i", "id", "x"] and shifted.return_gt_graph(relations=["dt"])[1].columns == ["i", "j", "dt"] and shifted.return_gt_graph()[0].columns == ["i"]
    assert vertices.count() == 5 and arcs.columns == ["i", "j", "s", "t", "dt"] and kinds["dt"] == "double" and kinds["i"] == "int64_t"
    twice = Graph(holes.v, holes.e.unionByName(holes.e))
    with pytest.raises(ValueError):
        twice.return_nx_graph(relations="dt", check=True)
    assert twice.return_nx_graph(relations="dt")[1].count() == 14
    assert twice.return_nx_multigraph(relations=["dt"])[1].count() == 12
    assert {r["column"]: r["n"] for r in holes.r.collect()} == {"dx": 2, "dt": 6, "up": 6, "g": 6, "w": 6}
    assert {r["column"]: r["n"] for r in holes.f.collect()} == {"x": 5}


def test_plot_tables(five, rows):
    shown = five.plot_2d("x", "time", edges=True, C="dt", C_split_0=True)
    r = shown["arrows"].where("s = 0 and t = 1").first()
    assert (r["xs"], r["ys"], round(r["dx"], 6), r["dy"], r["color"], r["zero"]) == (-3.4, 0, 5.5, 1, 1, False)
    assert {k: round(v, 3) for k, v in rows(shown["limits"].withColumn("low", F.col("low")), "axis", "low")} == {"x": -3.4 - 0.285, "time": -0.45, "color": 1.0}
    frames = list(five.plot_2d_generator("x", "time", "color"))
    assert [(f, p.count(), a.count()) for f, p, a in frames] == [("b", 1, 0), ("g", 3, 3), ("r", 1, 0)]
    z = five.plot_3d("x", "time", "size", edges=True)["arrows"].where("s = 0 and t = 1").first()
    assert z["dz"] == 2
    assert rows(five.plot_raster("color"), "row", "label", "time") == sorted([(0, "b", 2), (1, "g", 0), (1, "g", 1), (1, "g", 5), (2, "r", 9)], key=repr)
    assert five.plot_rects_numeric_numeric("x", "time", "x", "size").count() == 5


def test_functions(spark):
    df = spark.createDataFrame([([1, 2, 2, 3], [2, 3, 4]), ([1, 2], [2, 1, 1]), ([], [1]), (None, [1])], "a array<bigint>, b array<bigint>")
    common, card, same = cp_node_intersection(F.col("a"), F.col("b"))
    out = df.select(common.alias("c"), card.alias("n"), same.alias("same"), cp_intersection_strength(card, F.size("a"), F.size("b")).alias("w"), jaccard(F.col("a"), F.col("b")).alias("j")).collect()
    assert out[0]["c"] == [2, 3] and out[0]["n"] == 2 and not out[0]["same"] and out[1]["same"] and out[1]["w"] == 1.0
    assert out[2]["w"] is None and out[2]["j"] == 0.0 and out[0]["j"] == 0.5
    km = spark.sql("select 0D a, 0D b, 0D c, 90D d, double('nan') e").select(great_circle_dist(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("q"), great_circle_dist(F.col("a"), F.col("e"), F.col("c"), F.col("d")).alias("u")).first()
    assert abs(km["q"] - 6371 * np.pi / 2) < 1e-6 and km["u"] == 0.0
    q = spark.sql("select 1D a, 0D z, -2D m").select(ieee_div(F.col("a"), F.col("z")).alias("x"), ieee_div(F.col("m"), F.col("z")).alias("y"), ieee_div(F.col("z"), F.col("z")).alias("u")).first()
    assert q["x"] == float("inf") and q["y"] == float("-inf") and q["u"] is None


def test_hypergeometric(spark):
    from math import comb

    data = [(k, a, b) for k, a, b in itertools.product(range(4), (3, 10, 25), (4, 12))] + [(None, 3, 4)]
    df = spark.createDataFrame(data, "k int, a int, b int")
    for r in df.select("*", hypergeometric_p_value(F.col("k"), F.col("a"), F.col("b"), 40).alias("p")).collect():
        if r["k"] is None:
            assert r["p"] is None or np.isnan(r["p"])
            continue
        big, small = max(r["a"], r["b"]), min(r["a"], r["b"])
        want = sum(comb(big, j) * comb(40 - big, small - j) for j in range(r["k"] + 1, small + 1)) / comb(40, small)
        assert abs(r["p"] - want) < 1e-9


def test_directions_and_kinds(spark, rows):
    e = spark.createDataFrame([(1, 2, 1.0, "a"), (2, 1, 0.5, "b"), (1, 2, 2.0, "a"), (3, 3, 1.0, None), (1, 3, None, "c"), (None, 1, 4.0, "a"), (2, 1, 1.0, "a")], "s bigint, t bigint, w double, kind string")
    g = Graph(spark.range(1, 4), e)
    assert rows(g.undirected("w").e, "s", "t", "w") == [(1, 2, 4.5), (1, 3, 0.0), (2, 1, 4.5), (3, 1, 0.0), (3, 3, 2.0)]
    assert rows(g.dominant("kind").e, "s", "t", "dominant") == [(1, 2, "a"), (1, 3, "c"), (2, 1, "a"), (3, 3, None)]
    assert rows(reversed_edges(e, "s", "t").where("w = 0.5"), "s", "t", "kind") == [(1, 2, "b")] and g._with(e=e.limit(0)).undirected(["w"]).m == 0
