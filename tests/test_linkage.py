"""Average linkage against merging one pair at a time."""

import random

import pytest

from knotwork.operators.linkage import average_linkage, cut


def one_by_one(weights):
    """The merges (least members, similarity, size) by the plain algorithm."""
    nodes = {x for p in weights for x in p}
    clusters = {x: [x] for x in nodes}
    out = []
    while True:
        best = None
        for u in clusters:
            for v in clusters:
                if u < v:
                    s = sum(weights.get((min(p, q), max(p, q)), 0) for p in clusters[u] for q in clusters[v]) / len(clusters[u]) / len(clusters[v])
                    if s > 0 and (best is None or (s, -u, -v) > best[0]):
                        best = ((s, -u, -v), u, v)
        if best is None:
            return out
        (s, *_), u, v = best
        clusters[u] += clusters.pop(v)
        out.append((u, v, round(s, 7), len(clusters[u])))


@pytest.mark.parametrize(("seed", "n", "share"), [(0, 14, 1.0), (1, 25, 0.2)])
def test_equals_one_merge_at_a_time(spark, seed, n, share):
    rng = random.Random(seed)
    weights = {(a, b): round(rng.uniform(0.01, 1), 6) for a in range(n) for b in range(a + 1, n) if rng.random() < share}
    rows = [(b, a, w) if rng.random() < 0.5 else (a, b, w) for (a, b), w in weights.items()]
    rows += [(a, b, w / 2) for a, b, w in rows[:5]] + [(3, 3, 9.0), (None, 1, 1.0), (2, None, 1.0), (90, 91, None), (92, 93, float("nan")), (94, 95, 0.0)]
    merges = average_linkage(spark.createDataFrame(rows, "a bigint, b bigint, w double").selectExpr("*", "1 as u", "2 as sum"), "a", "b", "w")
    got = {(r["left"], r["right"], round(r["similarity"], 7), r["size"]) for r in merges.collect()}
    want = one_by_one(weights)
    assert got == set(want)
    for k in (1, 3):
        up = {x: x for p in weights for x in p}
        for u, v, *_ in want[: len(want) - (k - 1)]:
            for x in up:
                up[x] = u if up[x] == v else up[x]
        clusters = {r["node"]: r["root"] for r in cut(merges, at_most=k).collect()}
        assert {x: clusters.get(x, x) for x in up} == up


def test_edges_of_clustering(spark):
    names = spark.createDataFrame([("b", "a", 0.5), ("c", "d", 0.4), ("a", "c", 0.1)], "a string, b string, w double")
    merges = average_linkage(names, "a", "b", "w")
    assert sorted((r["left"], r["right"], round(r["similarity"], 6), r["size"]) for r in merges.collect()) == [("a", "b", 0.5, 2), ("a", "c", 0.025, 4), ("c", "d", 0.4, 2)]
    assert sorted((r["node"], r["root"]) for r in cut(merges, similarity=0.3).collect()) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")]
    assert average_linkage(names.limit(0), "a", "b", "w").count() == 0
    with pytest.raises(ValueError):
        cut(merges)
