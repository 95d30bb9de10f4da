"""Mixing sources to target shares along a time-varying curriculum.

Each source has a weight over training time; its integral is the demand for its tokens up to a time. A record whose
tokens come after c others of its source is placed at the time at which the demand reaches c: the integral, inverted.
A range sort by that time gives the training order.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import discard, materialize

#: Rows of one source and pass that one task accumulates, roughly. The order within a pass is the same whatever its value.
RUN_ROWS = 100_000
_FLIP = -(1 << 63)


def source_name(col: Column | str) -> Column:
    """Source names compare without surrounding white space and case."""
    return F.lower(F.regexp_replace(col, r"^\s+|\s+$", ""))


def _segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """(t0, width, weight at both ends, integral before) of a piecewise linear weight, scaled to an integral of 1."""
    knots = sorted(knots, key=lambda k: k[0])  # two knots at one time make a step
    if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1 or any(w < 0 for _, w in knots):
        raise ValueError("a schedule runs from time 0 to 1 with weights of at least 0")
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    if area <= 0:
        raise ValueError("a schedule needs some weight")
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        if t1 > t0:
            out.append((t0, t1 - t0, w0 / area, w1 / area, done))
            done += (t1 - t0) * (w0 + w1) / 2 / area
    return out


def time_of(share: Column, segments: Column) -> Column:
    """The time at which a source's integrated weight reaches ``share`` (0 to 1) of its whole."""
    s = F.element_at(F.filter(segments, lambda g: (g["done"] <= share) & ((g["w0"] > 0) | (g["w1"] > 0))), -1)
    rest, bend = share - s["done"], (s["w1"] - s["w0"]) / s["width"]
    root = s["w0"] + F.sqrt(F.greatest(F.lit(0.0), s["w0"] * s["w0"] + bend * rest * 2))
    return s["t0"] + F.least(s["width"], F.when(root > 0, rest * 2 / F.nullif(root, F.lit(0.0))).otherwise(F.lit(0.0)))


@dataclass
class Mix:
    """``order``: (source, id, pass, size, time), range-sorted by time; ``report``: a row per source of the targets."""

    order: DataFrame
    report: DataFrame


def mix_sources(
    docs: DataFrame,
    id_col: str,
    source_col: str,
    size_col: str,
    targets: DataFrame,
    schedules: Mapping[str, Sequence[tuple[float, float]]] | None = None,
    total: int | None = None,
    seed: int = 1,
) -> Mix:
    """Draw records so that each source of ``targets`` (source, target_share, max_repeats) gives its share of ``total``.

    ``total`` defaults to the size of all records, those of sources without a target included. A source is passed over
    as often as it takes, at most max_repeats times, each pass in its own random order; the last pass ends with the
    record that brings the source nearest to its share. A source that can't reach its share gives all its passes, spread over
    the whole time, and is reported as short; the others don't make up for it. ``schedules``: weight over time as
    (time, weight) knots per source, linear between them; without one the weight is constant. Only its shape counts.
    Records of unknown size, or of size 0 and less, and of sources without a target take no part. Names are compared by
    :func:`source_name`; repeated names in ``targets`` and NULLs there are errors of the caller and raise.

    The report is read from the positions assigned: a source is short if every record of all its allowed passes has one
    and their sizes stay below what was wanted.
    """
    name = source_name(F.col(source_col))
    sized = docs.select(name.alias("source"), F.col(id_col).alias("id"), F.col(size_col).cast("bigint").alias("size"))
    sized = materialize(sized, "sized")  # before the filter, which would have sizes computed once for itself
    kept = sized.where("size > 0")
    wanted = targets.select(source_name("source").alias("source"), "target_share", "max_repeats").collect()  # a setting: a row per source
    if len({r[0] for r in wanted}) < len(wanted) or any(v is None for r in wanted for v in r):
        raise ValueError("targets name each source once, with a share and a number of repeats")
    ours = F.when(F.col("source").isin([r["source"] for r in wanted]), F.col("source"))  # NULL: all others
    own = {r["source"]: r for r in kept.groupBy(ours.alias("source")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}
    if total is None:
        total = sum(r["n"] for r in own.values())
    spark, rows = docs.sparkSession, []
    for r in wanted:
        have, want = (own[r["source"]]["n"] if r["source"] in own else 0), r["target_share"] * total
        give = min(want, float(have * r["max_repeats"]))
        knots = (schedules or {}).get(r["source"]) or [(0.0, 1.0), (1.0, 1.0)]
        n = own[r["source"]]["rows"] if r["source"] in own else 0
        rows.append((r["source"], float(r["target_share"]), int(r["max_repeats"]), have, n, want, give, math.ceil(give / have) if have else 0, _segments(knots)))
    plan = spark.createDataFrame(
        rows,
        "source string, target_share double, max_repeats int, own_size bigint, own_records bigint, wanted double, planned double, passes int,"
        " segments array<struct<t0: double, width: double, w0: double, w1: double, done: double>>",
    )
    few = F.broadcast(plan)  # one row per target
    bits = max(0, math.ceil(math.log2(max([r["rows"] for r in own.values()], default=1) / RUN_ROWS)))
    drawn = kept.join(few.where("passes > 0").select("source", "passes"), "source").withColumn("pass", F.explode(F.expr("sequence(0, passes - 1)"))).drop("passes")
    # each pass in the order of the hash as an unsigned number, whose top bits give the run
    h = F.xxhash64("id", "pass", F.lit(seed))
    drawn = drawn.withColumn("__h", h.bitwiseXOR(F.lit(_FLIP))).withColumn("__run", F.shiftrightunsigned(F.col("__h").bitwiseXOR(F.lit(_FLIP)), 64 - bits) if bits else F.lit(0).cast("bigint"))
    runs = drawn.groupBy("source", "pass", "__run").agg(F.sum("size").alias("__n"))
    runs = runs.select("source", "pass", "__run", (F.sum("__n").over(W.partitionBy("source", "pass").orderBy("__run")) - F.col("__n")).alias("__before"))
    inside = F.sum("size").over(W.partitionBy("source", "pass", "__run").orderBy("__h", "id", "size").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    drawn = drawn.withColumn("__in", inside).join(runs, ["source", "pass", "__run"]).join(few.select("source", "own_size", "planned", "segments"), "source")
    middle = F.col("pass") * F.col("own_size") + F.col("__before") + F.col("__in") + F.col("size") / 2
    drawn = drawn.withColumn("__c", middle).where(F.col("__c") <= F.col("planned"))
    drawn = drawn.select("source", "id", "pass", "size", time_of(F.col("__c") / F.col("planned"), F.col("segments")).alias("time"))
    drawn = materialize(drawn, "drawn")
    discard(sized)
    given = drawn.groupBy("source").agg(F.sum("size").alias("given"), F.count(F.lit(1)).alias("n_records"))
    whole = F.sum("given").over(W.partitionBy(F.lit(0)))  # a row per target
    report = plan.drop("segments", "passes").join(given, "source", "left").na.fill(0, ["given", "n_records"])
    report = report.withColumn("actual_share", F.coalesce(F.try_divide(F.col("given").cast("double"), whole), F.lit(0.0)))
    spent = F.col("n_records") >= F.col("own_records") * F.col("max_repeats")
    report = report.withColumn("short", spent & (F.col("given") < F.col("wanted")))
    order = drawn.repartitionByRange("time", "source", "id", "pass").sortWithinPartitions("time", "source", "id", "pass")
    return Mix(order.withColumnRenamed("id", id_col), report)
