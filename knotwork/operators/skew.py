"""Joins and aggregates that stay balanced when a few keys hold most rows.

``eager_join_aggregate`` never builds the joined rows: both inputs shrink to one compact state per join key (with
map-side combine, so a key holding a third of all rows leaves each task as one row), the states are joined, counts
are multiplied and sums scaled, and the products are rolled up to the wanted grouping.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import known
from ..session import discard, materialize

HOT_SHARE = 1 / 256


@dataclass(frozen=True)
class Measure:
    """An aggregate over joined rows that two compact states can give. Use the constructors below."""

    kind: str
    left: Column | str | None = None
    right: Column | str | None = None
    scale: int | None = None


def pairs() -> Measure:
    """Number of joined rows (bigint; an overflow raises)."""
    return Measure("pairs")


def _sided(kind: str, side: str, expr: Column | str, scale: int | None = None) -> Measure:
    if side not in ("left", "right"):
        raise ValueError("side is 'left' or 'right'")
    return Measure(kind, **{side: expr}, scale=scale)


def total(side: str, expr: Column | str, scale: int | None = None) -> Measure:
    """Sum of one side's expression over the joined rows; NULL if it is never known.

    ``scale``: add in units of 10**-scale held as bigint, so the sum does not depend on the order of addition.
    """
    return _sided("total", side, expr, scale)


def mean(side: str, expr: Column | str, scale: int | None = None) -> Measure:
    """Mean over the joined rows in which the expression is known; see :func:`total` for ``scale``."""
    return _sided("mean", side, expr, scale)


def known_rows(side: str, expr: Column | str) -> Measure:
    """Number of joined rows in which the expression is neither NULL nor NaN."""
    return _sided("known_rows", side, expr)


def smallest(side: str, expr: Column | str) -> Measure:
    return _sided("smallest", side, expr)


def largest(side: str, expr: Column | str) -> Measure:
    return _sided("largest", side, expr)


def product_total(left: Column | str, right: Column | str) -> Measure:
    """Sum of left expression times right expression over the joined rows (double)."""
    return Measure("product_total", left, right)


def _expr(x: Column | str) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def _states(df: DataFrame, on: Sequence[str], keys: Sequence[str], measures: Mapping[str, Measure], side: str) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias(f"__n_{side}")]
    for k, m in enumerate(measures.values()):
        x = getattr(m, side)
        if x is None:
            continue
        x = known(_expr(x), df)
        if m.kind in ("total", "mean"):
            if m.scale is not None:
                x = F.round(x.cast("double") * F.lit(10.0**m.scale)).cast("bigint")
            aggs.append(F.sum(x).alias(f"__v{k}_{side}"))
        elif m.kind == "product_total":
            aggs.append(F.sum(x.cast("double")).alias(f"__v{k}_{side}"))
        elif m.kind == "smallest":
            aggs.append(F.min(x).alias(f"__v{k}_{side}"))
        elif m.kind == "largest":
            aggs.append(F.max(x).alias(f"__v{k}_{side}"))
        if m.kind in ("mean", "known_rows"):
            aggs.append(F.count(x).alias(f"__c{k}_{side}"))
    for c in on:
        df = df.where(F.col(c).isNotNull())
    return df.groupBy(*on, *keys).agg(*aggs)


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    measures: Mapping[str, Measure],
    left_keys: Sequence[str] = (),
    right_keys: Sequence[str] = (),
    by_key: bool = False,
) -> DataFrame:
    """Aggregate ``left JOIN right USING (on)`` without joining rows.

    The result has a row per ``left_keys`` + ``right_keys`` (plus ``on`` if ``by_key``); with no grouping at all, one row.
    A NULL in ``on`` joins nothing; a NULL group key is a group; NaN counts as unknown in every measure. Repeated rows
    count as often as they occur. Empty inputs give no row (one row with 0 pairs if there is no grouping). Columns of
    the inputs that are not named here play no part, so equal names on both sides don't clash.
    """
    on = [on] if isinstance(on, str) else list(on)
    both = [*on, *left_keys, *right_keys]
    if len(set(both)) < len(both):
        raise ValueError("join keys and group keys must have different names; rename one side")
    if clash := set(measures) & set(both):
        raise ValueError(f"measures named like keys: {sorted(clash)}")
    ls = _states(left, on, left_keys, measures, "left")
    rs = _states(right, on, right_keys, measures, "right")
    joined = ls.join(rs, on)
    nl, nr = F.col("__n_left"), F.col("__n_right")
    times = {"left": nr, "right": nl}
    out = []
    for k, (name, m) in enumerate(measures.items()):
        side = "left" if m.left is not None else "right"
        v, c = F.col(f"__v{k}_{side}") if m.kind not in ("pairs", "known_rows") else None, F.col(f"__c{k}_{side}")
        if m.kind == "pairs":
            out.append(F.coalesce(F.sum(nl * nr), F.lit(0)).cast("bigint").alias(name))
        elif m.kind == "known_rows":
            out.append(F.coalesce(F.sum(c * times[side]), F.lit(0)).cast("bigint").alias(name))
        elif m.kind == "total":
            s = F.sum(v * times[side])
            out.append((s / F.lit(10.0**m.scale) if m.scale is not None else s).alias(name))
        elif m.kind == "mean":
            unit = F.lit(10.0**m.scale if m.scale is not None else 1.0)
            n = F.sum(c * times[side])
            out.append(F.when(n > 0, F.sum(v * times[side]).cast("double") / unit / F.nullif(n, F.lit(0))).alias(name))
        elif m.kind == "product_total":
            out.append(F.sum(F.col(f"__v{k}_left") * F.col(f"__v{k}_right")).alias(name))
        else:
            out.append((F.min if m.kind == "smallest" else F.max)(v).alias(name))
    groups = [*(on if by_key else []), *left_keys, *right_keys]
    return joined.groupBy(*groups).agg(*out) if groups else joined.agg(*out)


#: A key with no more rows than this is never hot, as a task takes so many in no time. Steers the plan, never the result.
WARM_ROWS = 1000


def _named(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def hot_keys(df: DataFrame, key: str | Sequence[str], share: float = HOT_SHARE, rows: int | None = None) -> list:
    """The keys (tuples, if ``key`` names several columns) that hold at least ``share`` of the rows with a key: at most 1/share of them.

    ``rows``: the number of rows if known; a table too small to have a hot key isn't looked at.
    """
    if rows is not None and rows <= WARM_ROWS:
        return []
    keys = _named(key)
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__count"))
    most = counts.orderBy(F.desc("__count"), *keys).limit(int(1 / share)).collect()
    if not most:
        return []
    n = counts.agg(F.sum("__count")).first()[0] if len(most) == int(1 / share) else sum(r["__count"] for r in most)
    hot = [r[:-1] for r in most if r["__count"] >= share * n and r["__count"] > WARM_ROWS]
    return hot if not isinstance(key, str) else [r[0] for r in hot]


def sent_whole(df: DataFrame) -> bool:
    """Whether Spark, by its own check of the size, would send ``df`` to all executors rather than shuffle the other side of a join."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return limit > 0 and int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= limit


def _is_hot(keys: Sequence[str], hot: Sequence) -> Column:
    """Whether a row's key is among the hot ones; several columns are compared by hash, as one salt more does no harm."""
    if len(keys) == 1:
        return F.col(keys[0]).isin([h[0] if isinstance(h, tuple) else h for h in hot])
    spark_hash = F.xxhash64(*[F.col(k) for k in keys])
    return reduce(Column.__or__, [spark_hash == F.xxhash64(*[F.lit(v) for v in h]) for h in hot])


def skew_join(left: DataFrame, right: DataFrame, key: str | Sequence[str], how: str = "inner", hot: Sequence | None = None, salts: int = 64) -> DataFrame:
    """Join ``left`` with ``right`` (one row per key) when few keys may hold most of ``left``.

    Rows of a hot key are spread over ``salts`` partitions by a hash of the whole row, and only that key's right row is
    repeated for them. ``hot``: the hot keys if known, else they are counted first, unless Spark sends ``right`` to all executors
    anyway (:func:`sent_whole`), where no row of ``left`` moves. ``how``: inner, left, left_semi or left_anti.
    The salt is a function of the row, so a re-run task sends each row to the same place.
    """
    keys = _named(key)
    if hot is None:
        hot = [] if sent_whole(right) else hot_keys(left, keys)
    if not hot:
        return left.join(right, keys, how)
    is_hot = _is_hot(keys, list(hot))
    fields = [F.to_json(f"`{f.name}`") if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in left.schema.fields if not isinstance(f.dataType, T.VariantType)]
    spread = F.when(is_hot, F.pmod(F.xxhash64(*fields), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return left.withColumn("__salt", spread).join(right.withColumn("__salt", F.explode(every)), [*keys, "__salt"], how).drop("__salt")


#: A key with more rows on the right side of :func:`block_join` is split into blocks of about this size.
BLOCK_ROWS = 4000


@dataclass(frozen=True)
class Crowded:
    """Keys with more than ``rows`` rows and the number of blocks of each (``blocks``, None if there is none), and the hot ones among them."""

    rows: int
    blocks: DataFrame | None = None
    hot: tuple = ()

    @staticmethod
    def of(right: DataFrame, keys: Sequence[str], rows: int = BLOCK_ROWS) -> Crowded:
        """Count the rows of each key, with what tasks have added up themselves. At most 1/``rows`` as many keys as rows are kept."""
        seen = Observation()
        counts = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__count"))
        many = materialize(counts.observe(seen, F.sum("__count").alias("rows"), F.max("__count").alias("most")).where(F.col("__count") > rows), "crowded")
        if (seen.get["most"] or 0) <= rows:
            discard(many)
            return Crowded(rows)
        limit = max(WARM_ROWS, int(seen.get["rows"] * HOT_SHARE))
        hot = [tuple(r[:-1]) for r in many.where(F.col("__count") >= limit).collect()]  # at most 1 / HOT_SHARE of them
        return Crowded(rows, many.select(*keys, F.ceil(F.col("__count") / rows).alias("__parts")), tuple(hot))

    def renamed(self, keys: Sequence[str]) -> Crowded:
        """The same for keys of other names."""
        return self if self.blocks is None else Crowded(self.rows, self.blocks.toDF(*keys, "__parts"), self.hot)


def block_join(left: DataFrame, right: DataFrame, keys: Sequence[str], spread_by: str, rows: int = BLOCK_ROWS, *, keep_keys: bool = False, crowded: Crowded | None = None) -> DataFrame:
    """Inner equi-join in which a crowded key is split: its right rows fall into blocks, its left rows visit each block.

    So no task meets more than ``rows`` right rows of a key at a time, however many there are. Crowded keys are counted first, unless
    ``crowded`` tells them. Without any the plain join is all there is; else rows learn their number of blocks by a join whose hot keys are
    salted. ``keep_keys``: the keys stay in the result.
    """
    keys = list(keys)
    crowded = crowded or Crowded.of(right, keys, rows)
    if crowded.blocks is None:
        joined = left.join(right, keys)
        return joined if keep_keys else joined.drop(*keys)
    parts = F.coalesce(F.col("__parts"), F.lit(1).cast("bigint"))
    visits = skew_join(left, crowded.blocks, keys, "left", crowded.hot).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("__parts")
    spread = skew_join(right, crowded.blocks, keys, "left", crowded.hot).withColumn("__part", F.pmod(F.xxhash64(spread_by), parts)).drop("__parts")
    joined = visits.join(spread, [*keys, "__part"]).drop("__part")
    return joined if keep_keys else joined.drop(*keys)
