"""Connected components of a graph: weak ones by alternating star contraction, strong ones by colouring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.positions import with_position
from ..session import discard, materialize, materialize_seen
from .skew import hot_keys, sent_whole, skew_join

MAX_ROUNDS = 500


def _noted(edges: DataFrame, label: str, *columns: str) -> tuple[DataFrame, tuple]:
    """The rows written, with their number and a sum over their content, noted on the way: whether a round changed them.

    A task repeated after the loss of an executor may be noted twice, which costs one more round at most.
    """
    out, seen = materialize_seen(edges, label, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("sum"))
    return out, (seen["n"], seen["sum"])


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: every node's larger (or smaller) neighbours are linked to its least neighbour."""
    ends = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = skew_join(ends, least, "u")
    if large:
        return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    up = linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return up.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def weak_components(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node, root): every node with an edge to another one, and the least node of its component (Kiveris et al., 2014).

    Large-star and small-star steps alternate until the edges form stars; each round is written to the shared folder. Hubs
    are spread by :func:`skew_join`. NULL ends and loops are ignored.
    """
    s, t = F.col(source), F.col(target)
    now, mark = _noted(edges.where(s != t).select(F.greatest(s, t).alias("u"), F.least(s, t).alias("v")).distinct(), "stars", "u", "v")
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        large = materialize(_stars(now, True), "stars")
        before = mark
        after, mark = _noted(_stars(large, False), "stars", "u", "v")
        discard(now)
        discard(large)
        now = after
        if mark == before:
            roots = now.select("v").distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
    raise RuntimeError("the components don't settle")


def _spread(edges: DataFrame, labels: DataFrame, hot: list) -> DataFrame:
    """Labels after every node took the least among its own, its predecessors', and the label of the node it then points to.

    A label is the number of a node from which this one is reached, so what reaches that node reaches this one: the last step lets
    labels jump. With numbers in random order a label comes from anywhere in what has been seen, and what is seen grows by a
    constant factor a round, however long the paths are.
    """
    sent = skew_join(edges, labels.select(F.col("node").alias("u"), F.col("label").alias("l")), "u", hot=hot).groupBy(F.col("v").alias("node")).agg(F.min("l").alias("l"))
    near = labels.join(sent, "node", "left").select("node", F.least("label", "l").alias("label"))
    far = labels.select(F.col("node").alias("label"), F.col("label").alias("l"))
    return skew_join(near, far, "label", "left").select("node", F.least("label", "l").alias("label"))


def _fixpoint(edges: DataFrame, labels: DataFrame) -> DataFrame:
    labels, mark = _noted(labels, "labels", "node", "label")
    hot = [] if sent_whole(labels) else hot_keys(edges, "u")
    for _ in range(MAX_ROUNDS):
        before = mark
        after, mark = _noted(_spread(edges, labels, hot), "labels", "node", "label")
        discard(labels)
        labels = after
        if mark == before:
            return labels
    raise RuntimeError("the labels don't settle")


def strong_components(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node, root): nodes on a directed cycle and the least node of their strong component; all other nodes are their own root and left out.

    Nodes get numbers in random order. The least number that reaches a node colours it; within a colour the nodes that reach its root, found
    the same way against the edges, form its component. What remains is coloured again, within its old colour: in expectation a
    logarithmic number of times (Blelloch, Gu, Shun and Sun, 2016). Nodes without an edge in or out are taken off first, as long as
    that makes the graph markedly smaller. NULL ends and loops are ignored.
    """
    s, t = F.col(source), F.col(target)
    arcs = materialize(edges.where(s != t).select(s.alias("u"), t.alias("v")).distinct(), "arcs")
    ends = arcs.select(F.col("u").alias("node")).unionAll(arcs.select(F.col("v").alias("node"))).distinct()
    number = with_position(ends, [F.xxhash64("node"), "node"], "k")
    left = skew_join(skew_join(arcs, number.select(F.col("node").alias("u"), F.col("k").alias("a")), "u"), number.select(F.col("node").alias("v"), F.col("k").alias("b")), "v")
    n = F.count(F.lit(1)).alias("n")
    left, seen = materialize_seen(left.select(F.col("a").alias("u"), F.col("b").alias("v")), "arcs", n)
    discard(arcs)
    done: list[DataFrame] = []
    for _ in range(MAX_ROUNDS):
        while seen["n"]:  # trim
            before = seen["n"]
            ins, outs = left.select(F.col("v").alias("u")).distinct(), left.select(F.col("u").alias("v")).distinct()
            kept, seen = materialize_seen(skew_join(skew_join(left, ins, "u", "left_semi"), outs, "v", "left_semi").select("u", "v"), "arcs", n)
            discard(left)
            left = kept
            if seen["n"] > before * 0.9:
                break
        if not seen["n"]:
            break
        nodes = left.select(F.col("u").alias("node")).unionAll(left.select(F.col("v").alias("node"))).distinct()
        colour = _fixpoint(left, nodes.select("node", F.col("node").alias("label")))
        inside = skew_join(skew_join(left, colour.select(F.col("node").alias("u"), F.col("label").alias("c")), "u"), colour.select(F.col("node").alias("v"), F.col("label").alias("d")), "v")
        inside = materialize(inside.where("c = d").select("u", "v"), "arcs")
        # the root is the least of its colour: it is the least that a node reaches within it, if the node reaches it at all
        back = _fixpoint(inside.select(F.col("v").alias("u"), F.col("u").alias("v")), nodes.select("node", F.col("node").alias("label")))
        same = colour.join(back.select("node", F.col("label").alias("low")), "node").where("label = low")
        found = materialize(same.select("node", F.col("label").alias("root")), "strong")
        done.append(found)
        gone = found.select(F.col("node").alias("u"))
        rest = skew_join(skew_join(inside, gone, "u", "left_anti"), gone.withColumnRenamed("u", "v"), "v", "left_anti")
        rest, seen = materialize_seen(rest.select("u", "v"), "arcs", n)
        for table in (left, inside, colour, back):
            discard(table)
        left = rest
    if not done:
        return number.select("node", F.col("node").alias("root")).limit(0)
    out = reduce(DataFrame.unionAll, done)
    several = out.groupBy("root").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("root")
    named = skew_join(out, several, "root", "left_semi").join(number.select(F.col("k").alias("node"), F.col("node").alias("name")), "node")
    least = named.groupBy("root").agg(F.min("name").alias("least"))
    return skew_join(named, least, "root").select(F.col("name").alias("node"), F.col("least").alias("root"))


def label_components(v: DataFrame, roots: DataFrame, node_id: str, name: str, label_by_size: bool = True, consolidate_singles: bool = False) -> DataFrame:
    """The node table with a component label: 0 for the largest, ties by the component's first node in row order (``__pos``).

    Without ``label_by_size`` components are numbered by their first node. ``consolidate_singles``: all components of one
    node share label 0, the others are numbered from 1 by size.
    """
    at = v.join(roots.select(F.col("node").alias(node_id), F.col("root").alias("__root")), node_id, "left").withColumn("__root", F.coalesce("__root", node_id))
    sizes = at.groupBy("__root").agg(F.count(F.lit(1)).alias("__n"), F.min("__pos").alias("__first"))
    order = [F.desc("__n"), F.asc("__first")] if label_by_size or consolidate_singles else [F.asc("__first")]
    if consolidate_singles:
        big = with_position(sizes.where("__n > 1"), order, "__l").select("__root", (F.col("__l") + 1).alias(name))
        labels = sizes.select("__root").join(big, "__root", "left").na.fill(0, [name])
    else:
        labels = with_position(sizes, order, name).select("__root", name)
    return skew_join(at, labels, "__root").drop("__root")


def degrees(v: DataFrame, e: DataFrame, node_id: str, source: str, target: str) -> DataFrame:
    """(node id, degree, in_degree, out_degree) of every node, 0 where it has no edge."""
    ends = e.select(F.col(source).alias(node_id), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(e.select(F.col(target).alias(node_id), F.lit(0), F.lit(1)))
    per = ends.groupBy(node_id).agg(F.count(F.lit(1)).alias("degree"), F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return v.select(node_id).join(per, node_id, "left").na.fill(0, ["degree", "in_degree", "out_degree"])
