"""Edge tables made from edge tables: directions added up, the prevailing kind of each pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reversed_edges(e: DataFrame, source: str, target: str) -> DataFrame:
    """Every edge the other way round."""
    return e.select(*[F.col(f"`{ {source: target, target: source}.get(c, c)}`").alias(c) for c in e.columns])


def undirected(e: DataFrame, source: str, target: str, weights: Sequence[str]) -> DataFrame:
    """(source, target, weights): for each ordered pair linked either way the sums over both directions, so both of its rows are equal.

    An unknown weight, or a direction that isn't there, counts 0; edges with an unknown end are left out. A loop is there once in each
    direction and so counts twice. Repeated rows add up.
    """
    known = e.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(source, target, *weights)
    both = known.unionByName(reversed_edges(known, source, target))
    return both.groupBy(source, target).agg(*[F.coalesce(F.sum(f"`{w}`"), F.lit(0)).alias(w) for w in weights])


def dominant(e: DataFrame, source: str, target: str, kind: Column, name: str = "dominant") -> DataFrame:
    """(source, target, ``name``): the most frequent known kind of each pair, the first in order of equals; NULL if none is known.

    Counted per pair and kind first, so a pair with very many edges is one row per kind after its tasks have added up.
    """
    per = e.where(F.col(source).isNotNull() & F.col(target).isNotNull()).groupBy(source, target, kind.alias("__kind")).agg(F.count(F.lit(1)).alias("__n"))
    rank = F.when(F.col("__kind").isNotNull(), F.struct(-F.col("__n"), "__kind"))
    return per.groupBy(source, target).agg(F.min_by("__kind", rank).alias(name))
