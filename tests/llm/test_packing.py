"""Packing: nothing lost, nothing cut without need, capacity kept, little space unused."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from knotwork.llm import packing
from knotwork.llm.packing import combinations, containers, nnls, pack, plan_containers


def check_plan(histogram, capacity):
    plan = plan_containers(histogram, capacity)
    used = Counter()
    for b in plan:
        assert b.count > 0 and b.size == sum(s * m for s, m in b.holds.items()) <= capacity
        for s, m in b.holds.items():
            used[s] += m * b.count
    assert used == Counter({s: n for s, n in histogram.items() if n})
    n = sum(b.count for b in plan)
    total = sum(s * c for s, c in histogram.items())
    return n, -(-total // capacity)


def test_nnls_against_grid():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.integers(0, 4, (6, 9)).astype(float), rng.integers(0, 50, 6).astype(float)
        x = nnls(a, b)
        assert (x >= 0).all()
        slope = a.T @ (b - a @ x)  # optimality: no useful direction is left
        assert (slope <= 1e-6 * max(1, abs(a.T @ b).max())).all() and abs(slope @ x) < 1e-5 * max(1, b @ b)


def test_combinations_fill_the_window():
    out = combinations([64, 32, 20, 16, 12, 1], 64)
    assert (64,) in out and (32, 32) in out and (20, 20, 12, 12) in out and (16, 16, 16, 16) in out and (32, 20, 12) in out
    assert all(63 <= sum(c) <= 64 and len(c) <= 4 for c in out) and len(out) == len(set(out))


@pytest.mark.parametrize("scale", [1, 50])
def test_text_like_lengths(scale):
    rng = np.random.default_rng(2)
    lengths = np.clip(rng.lognormal(5.5, 1.0, 20_000).astype(int), 1, 8192)
    n, fewest = check_plan({int(s): int(c) * scale for s, c in zip(*np.unique(lengths, return_counts=True))}, 8192)
    assert n <= fewest * 1.01 + 1


@pytest.mark.parametrize(("histogram", "capacity", "most"), [({}, 10, 0), ({1: 1}, 1, 1), ({8192: 5}, 8192, 5), ({3: 1000}, 10, 334), ({5000: 40, 3000: 40, 192: 40}, 8192, 40), ({7: 3, 5: 3, 3: 3, 2: 3}, 10, 6), ({4097: 9}, 8192, 9)])
def test_edge_plans(histogram, capacity, most):
    assert check_plan(histogram, capacity)[0] <= most
    with pytest.raises(ValueError):
        plan_containers({0: 1}, 5)


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 100)
    rng = random.Random(3)
    data = [(k, rng.choice([7, rng.randint(1, 60), rng.randint(1, 300)])) for k in range(900)] + [(900, None), (901, 0), (902, -5), (903, 100), (904, 201), (905, 7), (905, 7), (905, 7)]
    df = spark.createDataFrame(data, "id bigint, size bigint").selectExpr("id", "size as n", "1 as container", "2 as piece")
    got = pack(df, "id", "n", 100).collect()
    held, cut = defaultdict(int), defaultdict(list)
    for r in got:
        if r["size"]:
            held[r["container"]] += r["size"]
            cut[r["id"]].append((r["start"], r["size"], r["n_pieces"]))
        else:
            assert r["container"] is None and r["n_pieces"] == 1
    assert max(held.values()) <= 100 and sorted(held) == list(range(len(held)))
    sizes = defaultdict(int)
    for k, n in data:
        sizes[k] += max(n or 0, 0)
    assert {k: sum(p[1] for p in v) for k, v in cut.items()} == {k: n for k, n in sizes.items() if n}
    assert sorted(cut[904]) == [(0, 100, 3), (100, 100, 3), (200, 1, 3)] and all(len(cut[k]) == 1 for k, n in data if n and 0 < n <= 100 and k != 905)
    assert len(cut[905]) == 3
    total = sum(sizes.values())
    assert len(held) <= -(-total // 100) * 1.03 + 1
    per = containers(pack(df, "id", "n", 100), 100)
    assert per.count() == len(held) and per.selectExpr("sum(filled)").first()[0] == total


def test_pack_empty(spark):
    df = spark.createDataFrame([], "id string, n int")
    assert pack(df, "id", "n", 8).count() == 0
    with pytest.raises(ValueError):
        pack(df, "id", "n", 0)


def test_containers_do_not_depend_on_the_parts(spark, monkeypatch):
    rng = random.Random(4)
    df = spark.createDataFrame([(k, rng.choice([3, 5, rng.randint(1, 90)])) for k in range(2000)], "id bigint, n bigint")
    got = []
    for rank_rows in (200_000, 100, 7):
        monkeypatch.setattr(packing, "RANK_ROWS", rank_rows)
        got.append(sorted(tuple(r) for r in pack(df, "id", "n", 64).collect()))
    assert got[0] == got[1] == got[2]


def test_found_documents_are_read_from_the_containers(spark):
    """The rows of p6_found need the assignment: the function that gives the container is in the plan."""
    from knotwork.llm.queries import p6_found

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    text = p6_found(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "container(" in text and "row_number" in text


def test_empty_items_are_not_ranked(spark):
    """A third of all items are empty: they have no container, and no task gathers them to number them."""
    df = spark.range(900).selectExpr("id", "if(id % 3 = 0, 0, id % 50 + 1) as n")
    out = pack(df, "id", "n", 64)
    assert out.where("container is null").count() == 300 == out.where("size = 0").count() and out.count() == 900
    window = out._jdf.queryExecution().optimizedPlan().toString().split("row_number")[1]
    assert "(size" in window and "> 0)" in window
