"""Hierarchical clustering of a pair table by average linkage, many merges at a time (Sumengen et al., 2021).

Two clusters that are each other's nearest are merged in the end by one-at-a-time clustering as well, as average linkage never
brings a merged cluster nearer to a third than its parts were. So each round merges all such pairs at once: by joins and
aggregates over the table of pairs, none of which needs all pairs in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.positions import with_position
from ..session import discard, materialize, materialize_seen
from .components import weak_components
from .skew import skew_join

MAX_ROUNDS = 2000
#: Similarities are added in units of 10**-SCALE as whole numbers, so their order doesn't matter.
SCALE = 9


def average_linkage(pairs: DataFrame, a: str, b: str, similarity: str) -> DataFrame:
    """(left, right, similarity, size): the merges, clusters being named by their least member and ``size`` the members of the merged one.

    Similarities are at least 0, higher is nearer; a pair that isn't in the table has similarity 0, and clusters never merge at 0. Either
    orientation of a pair counts, the highest of repeated rows; loops, unknown ends and unknown similarities don't. Of equally near
    pairs the one with the least members comes first. Similarities are rounded to ``SCALE`` decimals.
    """
    x, y, w = F.col(a), F.col(b), F.col(similarity).cast("double")
    known = pairs.where(x.isNotNull() & y.isNotNull() & (x != y) & ~F.isnan(w) & (w > 0)).select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"), w.alias("w"))
    known = materialize(known.groupBy("x", "y").agg(F.max("w").alias("w")), "alike")
    number = with_position(known.select(F.col("x").alias("id")).unionAll(known.select(F.col("y").alias("id"))).distinct(), ["id"], "k")
    coded = skew_join(skew_join(known, number.select(F.col("id").alias("x"), F.col("k").alias("u")), "x"), number.select(F.col("id").alias("y"), F.col("k").alias("v")), "y")
    n = F.count(F.lit(1)).alias("n")
    # u < v; the summed similarity of their members, and how many members each has
    now, seen = materialize_seen(coded.select("u", "v", F.round(F.col("w") * 10**SCALE).cast("bigint").alias("sum"), F.lit(1).cast("bigint").alias("nu"), F.lit(1).cast("bigint").alias("nv")), "linked", n)
    discard(known)
    done = []
    for _ in range(MAX_ROUNDS):
        if not seen["n"]:
            break
        near = (F.col("sum") / F.col("nu") / F.col("nv")).alias("near")
        ends = now.select(F.col("u").alias("c"), "u", "v", "nu", "nv", near).unionAll(now.select(F.col("v").alias("c"), "u", "v", "nu", "nv", near))
        best = ends.groupBy("c").agg(F.max(F.struct("near", (-F.col("u")).alias("lo"), (-F.col("v")).alias("hi"), (F.col("nu") + F.col("nv")).alias("size"))).alias("p")).select("p.*")
        mutual = best.groupBy("near", "lo", "hi", "size").agg(n).where("n = 2")  # chosen from both sides
        merged = materialize(mutual.select((-F.col("lo")).alias("left"), (-F.col("hi")).alias("right"), (F.col("near") / 10**SCALE).alias("similarity"), "size"), "merged")
        done.append(merged)
        into = merged.select(F.col("left").alias("c"), F.col("left").alias("to"), "size").unionAll(merged.select(F.col("right").alias("c"), F.col("left").alias("to"), "size"))
        moved = now
        for end, size in (("u", "nu"), ("v", "nv")):
            moved = skew_join(moved, into.select(F.col("c").alias(end), F.col("to").alias(f"{end}2"), F.col("size").alias(f"{size}2")), end, "left")
            moved = moved.withColumns({end: F.coalesce(f"{end}2", end), size: F.coalesce(f"{size}2", size)}).drop(f"{end}2", f"{size}2")
        moved = moved.where("u <> v")
        ordered = F.col("u") < F.col("v")
        moved = moved.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "sum", F.when(ordered, F.col("nu")).otherwise(F.col("nv")).alias("nu"), F.when(ordered, F.col("nv")).otherwise(F.col("nu")).alias("nv"))
        after, seen = materialize_seen(moved.groupBy("u", "v", "nu", "nv").agg(F.sum("sum").alias("sum")).select("u", "v", "sum", "nu", "nv"), "linked", n)
        discard(now)
        now = after
    else:
        raise RuntimeError("the clusters don't settle")
    every = reduce(DataFrame.unionAll, done) if done else now.select(F.col("u").alias("left"), F.col("v").alias("right"), F.lit(0.0).alias("similarity"), F.lit(0).cast("bigint").alias("size"))
    names = number.select(F.col("k").alias("left"), F.col("id").alias("l"))
    out = skew_join(skew_join(every, names, "left"), names.toDF("right", "r"), "right")
    return out.select(F.col("l").alias("left"), F.col("r").alias("right"), "similarity", "size")


def cut(merges: DataFrame, at_most: int | None = None, similarity: float | None = None) -> DataFrame:
    """(node, root): the clusters that are left if only merges at ``similarity`` or nearer are made, or all but the ``at_most`` - 1 farthest ones.

    ``root`` is the least member. Nodes that take part in no merge that is made have no row: they are clusters of their own. With ``at_most``,
    groups that are not linked at all stay apart, so there may be more clusters than that.
    """
    if (at_most is None) == (similarity is None):
        raise ValueError("cut by a number of clusters or by a similarity")
    if similarity is not None:
        kept = merges.where(F.col("similarity") >= similarity)
    else:
        ranked = with_position(merges, [F.asc("similarity"), F.desc("size"), "left", "right"], "__far")
        kept = ranked.where(F.col("__far") >= at_most - 1)
    return weak_components(kept, "left", "right")
