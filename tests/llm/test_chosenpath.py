"""Similar sets, against all pairs compared one by one."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from knotwork.llm.chosenpath import similar_sets, trees_for


def brute(left, right, threshold, min_size=1):
    clean = lambda rows: {k: {t for t in v if t is not None} for k, v in rows if k is not None and v is not None and len({t for t in v if t is not None}) >= max(1, min_size)}
    a, b = clean(left), clean(right if right is not None else left)
    both = itertools.product(a, b) if right is not None else itertools.combinations(sorted(a), 2)
    return {(x, y) for x, y in both if len(a[x] & b[y]) / len(a[x] | b[y]) >= threshold}


def records(rng, n, universe, hot=0):
    out = []
    for k in range(n):
        if k and rng.random() < 0.4:
            base = list(out[rng.randrange(len(out))][1] or [])
            for _ in range(rng.randint(0, max(1, len(base) // 4))):
                if base:
                    base[rng.randrange(len(base))] = rng.randrange(universe)
        else:
            base = [rng.randrange(universe) for _ in range(rng.randint(5, 40))]
        out.append((k, base + ([universe + 1] if k % 3 == 0 and hot else []) + base[:2]))
    return out


@pytest.mark.parametrize(("threshold", "seed"), [(0.6, 0), (0.8, 1), (0.35, 2)])
def test_within(spark, threshold, seed):
    rng = random.Random(seed)
    data = records(rng, 700, 3000, hot=1) + [(900, None), (901, []), (902, [None, None]), (903, [None, 5, 5]), (904, [5]), (None, [5])]
    df = spark.createDataFrame(data, "cp bigint, ids array<bigint>").withColumns({"rid": F.lit("x"), "path": F.lit(1), "toks": F.lit(2)})
    found = similar_sets(df, "cp", "ids", threshold, recall=0.99999)
    got = [tuple(r) for r in found.pairs().select("id_a", "id_b").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data, None, threshold)
    assert found.members.where("id = 904").first()["rep"] == 903


def test_small_nodes_and_depth(spark):
    """Nodes far too large for the depth allowed: compared block by block, nothing is lost."""
    rng = random.Random(5)
    core = list(range(20))
    data = [(k, core[: rng.randint(14, 20)] + [100 + rng.randrange(4)]) for k in range(250)]
    df = spark.createDataFrame(data, "cp bigint, ids array<bigint>")
    got = {tuple(r) for r in similar_sets(df, "cp", "ids", 0.7, node_rows=16, depth=2, recall=0.99999).pairs().collect()}
    assert got == brute(data, None, 0.7)


def test_two_tables(spark):
    rng = random.Random(7)
    left = [(k, [f"t{t}" for t in v]) for k, v in records(rng, 200, 500)]
    right = [(k, v) for k, v in ((j, left[rng.randrange(200)][1][:-1] + ["y"]) for j in range(100))] + [(500, None)]
    schema = "id bigint, ids array<string>"
    found = similar_sets(spark.createDataFrame(left, schema), "id", "ids", 0.6, spark.createDataFrame(right, schema), recall=0.99999)
    assert {tuple(r) for r in found.pairs().select("id_a", "id_b").collect()} == brute(left, right, 0.6)


def test_copies_are_joined_once(spark):
    data = [(k, [1, 2, 3, 4, 5, 6]) for k in range(3000)] + [(5000, [1, 2, 3, 4, 5, 7])]
    found = similar_sets(spark.createDataFrame(data, "id bigint, ids array<bigint>"), "id", "ids", 0.6)
    assert [(r["a"], r["b"], r["common"]) for r in found.links.collect()] == [(0, 5000, 5)]
    assert found.members.groupBy("rep").count().orderBy("rep").collect()[0]["count"] == 3000


def test_copies_are_met_in_blocks(spark, monkeypatch):
    """One set is held by most records: its pairs with each other and with a like set are spelled out block by block."""
    from knotwork.operators import skew

    monkeypatch.setattr(skew.Crowded.of, "__defaults__", (20,))
    data = [(k, [1, 2, 3, 4, 5, 6]) for k in range(90)] + [(500 + k, [1, 2, 3, 4, 5, 7]) for k in range(3)] + [(700, [9, 8])]
    got = similar_sets(spark.createDataFrame(data, "id bigint, ids array<bigint>"), "id", "ids", 0.6).pairs()
    assert "__part" in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in got.collect()} == {(a, b) for a in [*range(90), 500, 501, 502] for b in [*range(90), 500, 501, 502] if a < b}


def test_min_size_and_empty(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [1, 2]), (3, [1, 2, 3]), (4, [1, 2, 3])], "id bigint, ids array<bigint>")
    assert {tuple(r) for r in similar_sets(df, "id", "ids", 0.9, min_size=3).pairs().collect()} == {(3, 4)}
    assert similar_sets(df.limit(0), "id", "ids", 0.9).pairs().count() == 0
    with pytest.raises(ValueError):
        similar_sets(df, "id", "ids", 0)


def test_trees():
    assert trees_for(0.6, 0.9999) > trees_for(0.6, 0.9) >= trees_for(0.9, 0.9) >= 1


def test_recall_at_the_default(spark):
    """Subsets of 0.6 of a larger set, the pairs that are easiest to miss, on tokens that a third of all records share."""
    rng = random.Random(11)
    data = []
    for k in range(600):
        big = [1, 2, *rng.sample(range(10, 20000), 18)]
        data += [(2 * k, big), (2 * k + 1, rng.sample(big, 12))]
    found = similar_sets(spark.createDataFrame(data, "id bigint, ids array<bigint>"), "id", "ids", 0.6, node_rows=100)
    want = brute(data, None, 0.6)
    got = {tuple(r) for r in found.pairs().collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) >= 600


def test_large_sets(spark):
    """Sets beyond the wide bits' limit, alike and not, among small ones."""
    rng = random.Random(12)
    data = [(k, rng.sample(range(3000), rng.randint(100, 400))) for k in range(120)]
    data += [(200 + k, v[: int(len(v) * rng.uniform(0.55, 1))]) for k, v in data[:60]] + [(400 + k, rng.sample(range(3000), rng.randint(40, 70))) for k in range(100)]
    found = similar_sets(spark.createDataFrame(data, "id bigint, ids array<bigint>"), "id", "ids", 0.6, node_rows=50, recall=0.99999)
    assert {tuple(r) for r in found.pairs().collect()} == brute(data, None, 0.6)
