"""The band self-join: pairs of nodes whose distance along one sorted feature is at most a threshold.

The feature is cut into buckets as wide as the threshold. A source looks into its own bucket and the next, a target
lies in one, so the pairs come from an equi-join on the bucket and each candidate pair meets once. Crowded buckets are split.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.pairfunctions import BAND_OUTPUT, PairFunction, as_functions, check_outputs, schedule
from .pairs import _names, apply_functions, finish, needed_features
from .skew import WARM_ROWS, Crowded, block_join

#: Microseconds in each unit of time.
UNIT_US = {"D": 86_400_000_000, "h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1_000, "us": 1, "ns": 0.001}


def is_time(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


def micros(col: Column) -> Column:
    """Microseconds since 1970 of a date or timestamp, with or without zone (the session's zone is UTC)."""
    return F.unix_micros(col.cast("timestamp"))


def band_spec(v: DataFrame, ft_feature: Sequence) -> tuple[str, Column, float | int, float | None]:
    """(column, comparable value, threshold in its units, microseconds per unit or None) of a band."""
    column, threshold = ft_feature[0], ft_feature[1]
    if column not in v.columns:
        raise KeyError(f"no such feature: {column}")
    kind = v.schema[column].dataType
    if is_time(kind):
        assert len(ft_feature) == 3, "a time feature needs (column, threshold, unit)"
        assert ft_feature[2] in UNIT_US, f"the unit is one of {', '.join(UNIT_US)}"
        unit = UNIT_US[ft_feature[2]]
        return column, micros(F.col(column)), int(threshold * unit), unit
    assert len(ft_feature) == 2, "only a time feature has a unit"
    return column, F.col(column), threshold, None


def bucket_of(x: Column, width: float, whole: bool) -> Column:
    """The bucket of a value, bigint: whole numbers are divided as such, so none is too large for it."""
    if not whole:
        return F.floor(x / (width * (1 + 1e-9)))
    x, w = x.cast("bigint"), F.lit(int(width)).cast("bigint")
    return F.call_function("div", x, w) - F.when(x % w < 0, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def buckets_ahead(b: Column, whole: bool) -> Column:
    """Where partners of a source in bucket ``b`` may lie: in it or the next; or one further, where doubles are too coarse to tell. None lies beyond the last."""
    ahead = lambda k: F.try_add(b, F.lit(k).cast("bigint"))
    near = F.array(b, ahead(1))
    return near if whole else F.when(F.abs(F.greatest(b, F.lit(-(1 << 62)))) > 1 << 40, F.array(b, ahead(1), ahead(2))).otherwise(near)


#: Buckets of at most MOST_ROWS rows are joined whole if none has more than 1 / LEAST_TASKS of the work; else the crowded ones are split. Steers the plan, never the result.
MOST_ROWS, LEAST_TASKS = 100_000, 24


def evenly_spread(at: DataFrame, keys: Sequence[str]) -> bool:
    """Whether no bucket is so crowded that it has to be split."""
    rows = at.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"))
    seen = rows.agg(F.max("n").alias("most"), F.sum(F.col("n") * F.col("n")).alias("work")).first()
    most = seen["most"] or 0
    return most <= MOST_ROWS and (most <= WARM_ROWS or most * most * LEAST_TASKS <= seen["work"])


def buckets_behind(b: Column, whole: bool) -> Column:
    """The buckets of the sources that may look at a target in bucket ``b``, at least; see :func:`buckets_ahead`."""
    behind = lambda k: F.try_add(b, F.lit(-k).cast("bigint"))
    near = F.array(b, behind(1))
    return near if whole else F.when(F.abs(F.greatest(b, F.lit(-(1 << 62)))) > (1 << 40) - 4, F.array(b, behind(1), behind(2))).otherwise(near)


def band_maker(
    v: DataFrame,
    node_id: str,
    source: str,
    target: str,
    ft_feature: Sequence,
    connectors: object = None,
    selectors: object = None,
    transfer_features: str | Sequence[str] | None = None,
    r_dtype_dic: Mapping[str, object] | None = None,
    no_transfer_rs: str | Sequence[str] | None = None,
    from_pos: int = 0,
    to_pos: int | None = None,
    on: str | Sequence[str] | None = None,
    order_by: Sequence[str] = (),
    seen: Observation | None = None,
) -> Callable[..., DataFrame]:
    """What makes the edges of ``create_edges_ft``; called with names of features, it adds those of both ends as ``__f_s`` and ``__f_t``. ``seen`` notes the pairs within the band, before any selector.

    Each pair i < j, in the order of the band feature, then of ``order_by``, with value_j - value_i <= threshold; its distance
    is ``ft_r``. Nodes with an unknown value have no edges. ``on`` adds keys that must be equal. ``from_pos`` and ``to_pos``
    limit the source nodes and need a table with dense ``__pos``; without them rows are compared by value, and no
    global sort is needed.
    """
    _, value, threshold, unit = band_spec(v, ft_feature)
    con = [f for f in as_functions(connectors, "connector") if isinstance(f, PairFunction)]
    sel = [f for f in as_functions(selectors, "selector") if isinstance(f, PairFunction)]  # 'ft_selector' only ranks; the band comes first
    dtypes, transfer, drop = dict(r_dtype_dic or {}), _names(transfer_features), _names(no_transfer_rs)
    check_outputs([*con, *sel], dtypes, [BAND_OUTPUT])
    order = schedule(sel, con, [BAND_OUTPUT])
    columns = [c for c in v.columns if c != "__pos"]
    features = needed_features(order, transfer, columns)
    keys = _names(on)
    whole = unit is not None or isinstance(v.schema[ft_feature[0]].dataType, T.IntegralType)
    if whole:
        threshold = math.floor(threshold)  # distances are whole numbers
    bucket = bucket_of(F.col("__x"), threshold, whole) if threshold > 0 else F.col("__x")
    x = F.when(F.isnan(value), None).otherwise(value) if isinstance(v.schema[ft_feature[0]].dataType, (T.DoubleType, T.FloatType)) else value
    renamed = {f"__k{i}": F.col(k) for i, k in enumerate(keys)}
    rank_of = ["__pos"] if "__pos" in v.columns else [*order_by, node_id]
    rank = F.col("__pos") if "__pos" in v.columns else F.struct(*rank_of)
    cols = lambda end, of: [F.col(node_id).alias(f"__id_{end}"), rank.alias(f"__rank_{end}"), F.col("__x").alias(f"__x_{end}"), *[F.col(f).alias(f"{f}_{end}") for f in of], *[c.alias(n) for n, c in renamed.items()]]
    within = lambda df: df.where((F.col("__pos") >= from_pos) & (F.col("__pos") < to_pos)) if to_pos is not None else df.where(F.col("__pos") >= from_pos) if from_pos else df
    placed = lambda df: df.withColumn("__x", x).where("__x is not null").withColumn("__b", bucket)
    looks = F.explode(buckets_ahead(F.col("__b"), whole)) if threshold > 0 else F.col("__b")
    even = threshold > 0 and evenly_spread(placed(v), ["__b", *keys])
    crowded = None if even else Crowded.of(placed(v).select("__b", *[c.alias(n) for n, c in renamed.items()]), ["__b", *renamed])

    def met(of: Sequence[str]) -> DataFrame:
        """Sources with the targets of their bucket and of those ahead."""
        if crowded is not None:
            at = placed(v)
            return block_join(within(at).select(*cols("s", of), looks.alias("__b")), at.select(*cols("t", of), "__b"), ["__b", *renamed], "__id_t", crowded=crowded)
        # each row travels with its bare columns to its bucket, and to those behind as a target only; all else is made where it arrives
        narrow = [c for c in v.columns if c in {node_id, ft_feature[0], *rank_of, *of, *keys}]
        sent = placed(v).select(*narrow, F.explode(buckets_behind(F.col("__b"), whole)).alias("__c")).repartition("__c", *keys)
        if not sel:  # no side has rows to be spared: both read the same shuffle files, so no filter may slip below them
            sent = sent.where(F.spark_partition_id() >= 0)
        at = placed(sent)
        left = within(at).where(F.col("__c") == F.col("__b")).select(*cols("s", of), "__c")
        return left.join(at.select(*cols("t", of), "__c"), ["__c", *renamed]).drop("__c", *renamed)

    def make(more: Sequence[str] = ()) -> DataFrame:
        of = [c for c in columns if c in features or c in more]
        gap = F.try_subtract("__x_t", "__x_s")  # beyond all numbers is beyond the threshold
        xs, xt = F.col("__x_s"), F.col("__x_t")
        ahead = (xs < xt) | ((xs == xt) & (F.col("__rank_s") < F.col("__rank_t")))
        pairs = met(of).where(ahead & (gap <= threshold)).drop("__rank_s", "__rank_t")
        if seen is not None:
            pairs = pairs.observe(seen, F.count(F.lit(1)).alias("pairs"))
        ends = {f"__{f}_{end}": F.when(F.col(f"__id_{end}").isNotNull(), F.col(f"`{f}_{end}`")) for f in more for end in "st"}  # no id, no node
        pairs = pairs.withColumns(ends)
        # both sides as named inputs, the distance in the unit the caller chose
        pairs = pairs.withColumn(BAND_OUTPUT, gap.cast("double") / unit if unit else gap)
        ft = {"ft_feature_s": F.col("__x_s"), "ft_feature_t": F.col("__x_t"), "ftt": F.lit(threshold)}
        pairs = apply_functions(pairs, order, ft, threshold)
        return finish(pairs, source, target, [BAND_OUTPUT, *[o for f in order for o in f.outputs]], transfer, dtypes, drop, list(ends))

    return make
