"""Groups of records from pairwise matches, by random contraction (Bögeholz, Brand and Todor, 2019).

In each round every vertex hooks to the neighbour, or itself, that comes first in a fresh hash order. Edges are
relabelled by the hooks, loops and repeats fall away, and the next round works on what is left; the number of vertices
falls by a constant factor per round whatever the shape of the graph. At the end the hooks are followed from the last
round back to the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import HOT_SHARE, WARM_ROWS, hot_keys, skew_join
from ..session import discard, materialize_seen

MAX_ROUNDS = 200


def _order(v: Column, turn: int) -> Column:
    """A fresh hash order. The turn is a text: unlike a number it doesn't go into generated code, which so is compiled once for all rounds."""
    return F.xxhash64(v, F.lit(f"turn {turn}"))


def _relabel(edges: DataFrame, hooks: DataFrame, end: str, hot: list) -> DataFrame:
    to = hooks.select(F.col("v").alias(end), F.col("r").alias(f"r{end}"))
    other = [c for c in edges.columns if c != end]
    return skew_join(edges, to, end, "inner", hot).select(*other, F.col(f"r{end}").alias(end))


def connected_groups(links: DataFrame, a: str, b: str, node: str = "node_id", group: str = "group_id") -> DataFrame:
    """(``node``, ``group``): every id that has a link to another id, with the smallest id of its group.

    Rows with a NULL end and links of an id to itself are ignored; repeats and either orientation count once; an empty
    input gives an empty result. Both ends must have one type. Hubs are spread over many tasks in every join, and
    the tables of each round lie in the shared folder, so the loss of an executor repeats one round's step at most.
    """
    kind = links.schema[a].dataType
    if links.schema[b].dataType != kind:
        raise ValueError("both ends of a link must have the same type")
    x, y = F.col(a), F.col(b)
    count = F.count(F.lit(1)).alias("n")
    canonical = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, seen = materialize_seen(canonical(links.where(x != y).select(x.alias("a"), y.alias("b"))), "links", count)
    rounds: list[DataFrame] = []
    sizes: list[int] = []
    while seen["n"]:
        if len(rounds) >= MAX_ROUNDS:
            raise RuntimeError("the contraction doesn't end")
        turn, limit = len(rounds), max(WARM_ROWS, int(seen["n"] * HOT_SHARE))
        ends = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionAll(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
        first = ends.groupBy("v").agg(F.min_by("w", _order(F.col("w"), turn)).alias("w"), F.count(F.lit(1)).alias("deg"))
        to = F.when(_order(F.col("w"), turn) < _order(F.col("v"), turn), F.col("w")).otherwise(F.col("v"))
        hooks, of = materialize_seen(first.select("v", to.alias("r"), "deg"), "hooks", count, F.max("deg").alias("deg"))
        hubs = [r["v"] for r in hooks.where(F.col("deg") > limit).select("v").collect()] if of["deg"] > limit else []  # under 2 / HOT_SHARE of them
        moved = _relabel(_relabel(edges, hooks, "a", hubs), hooks, "b", hubs).where("a <> b")
        after, seen = materialize_seen(canonical(moved), "links", count)
        rounds.append(hooks)
        sizes.append(of["n"])
        discard(edges)
        edges = after
    if not rounds:
        return edges.select(F.col("a").alias(node), F.col("b").alias(group))
    label = rounds[-1].select("v", F.col("r").alias("g"))
    for hooks, n in zip(rounds[-2::-1], sizes[-2::-1]):
        up = label.select(F.col("v").alias("r"), "g")
        label = skew_join(hooks, up, "r", "left", hot_keys(hooks, "r", rows=n)).select("v", F.coalesce("g", "r").alias("g"))
    label, of = materialize_seen(label, "groups", count)
    for table in [*rounds, edges]:
        discard(table)
    lowest = label.groupBy("g").agg(F.min("v").alias("low"))
    return skew_join(label, lowest, "g", hot=hot_keys(label, "g", rows=of["n"])).select(F.col("v").alias(node), F.col("low").alias(group))
