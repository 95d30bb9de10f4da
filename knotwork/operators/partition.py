"""Partitioning nodes, edges or both by features and relations into aggregated super tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.group import GroupedData

from ..plans.positions import with_position
from .skew import skew_join


def _number(c: Column, kind: T.DataType) -> Column:
    return c.cast("int") if isinstance(kind, T.BooleanType) else c


def _in_order(c: Column, order: Sequence[str]) -> Column:
    """The values of a group in row order, unknown ones included."""
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(o) for o in order], c.alias("__x"))))
    return F.transform(rows, lambda r: r["__x"])


def aggregate(name: str, c: Column, kind: T.DataType, order: Sequence[str]) -> Column:
    """The aggregate called ``name``: unknown cells are skipped, a sum of none is 0, the deviation of one value is NULL."""
    x = _number(c, kind)
    text = isinstance(kind, T.StringType)
    if name in ("sum",):
        if text:
            return F.array_join(_in_order(c, order), "")
        return F.coalesce(F.sum(x), F.lit(0))
    simple: dict[str, Callable[[], Column]] = {
        "mean": lambda: F.avg(x),
        "avg": lambda: F.avg(x),
        "std": lambda: F.stddev_samp(x),
        "var": lambda: F.var_samp(x),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
        "count": lambda: F.count(c),
        "nunique": lambda: F.count_distinct(c),
        "list": lambda: _in_order(c, order),
        "tuple": lambda: _in_order(c, order),
        "set": lambda: F.array_sort(F.collect_set(c)),
        "first": lambda: F.min_by(c, F.struct(*order)),
        "last": lambda: F.max_by(c, F.struct(*order)),
        "any": lambda: F.bool_or(c),
        "all": lambda: F.bool_and(c),
        "prod": lambda: F.product(x),
        "size": lambda: F.count(F.lit(1)),
    }
    if (share := quantile_share(name)) is not None:  # inside a group of its own size only; see group_quantiles
        return F.percentile(x, F.lit(share))
    if name not in simple:
        raise ValueError(f"unknown aggregate {name!r}; one of {', '.join(['sum', 'median', *simple])}, q<share>, or a function of a Column")
    return simple[name]()


def quantile_share(name: object) -> float | None:
    """The share of a quantile's name: 0.5 for 'median', 0.9 for 'q0.9', None for any other aggregate."""
    if name == "median":
        return 0.5
    if isinstance(name, str) and name.startswith("q") and name[1:].replace(".", "", 1).isdigit():
        return float(name[1:])
    return None


def group_quantiles(df: DataFrame, keys: Sequence[str], column: str, shares: Mapping[str, float], interpolate: bool = True) -> DataFrame:
    """(keys, a column per quantile) of the known values of each group of known keys: by linear interpolation, or the value below.

    The values are sorted by a distributed sort; a group starts at its lowest position, and its quantiles lie at most one place around
    the wanted one. No task holds a group, however large. Groups without a known value have no row.
    """
    if bad := [q for q in shares.values() if not 0 <= q <= 1]:
        raise ValueError(f"not between 0 and 1: {bad}")
    kind = df.schema[column].dataType
    x = _number(F.col(f"`{column}`"), kind).cast("double")
    names = [f"__k{i}" for i in range(len(keys))]
    some = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], x.alias("__x")).where(F.col("__x").isNotNull() & ~F.isnan("__x"))
    for n in names:
        some = some.where(F.col(n).isNotNull())
    placed = with_position(some, [*names, "__x"], "__place")
    groups = placed.groupBy(*names).agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n"))
    off = lambda q: F.lit(float(q)) * (F.col("__n") - 1)
    wanted = groups.select(*names, F.explode(F.array(*[F.struct(F.lit(i).alias("q"), (off(q) - F.floor(off(q))).alias("rest"), (F.col("__first") + F.floor(off(q))).alias("lo"), (F.col("__first") + (F.ceil if interpolate else F.floor)(off(q))).alias("hi")) for i, q in enumerate(shares.values())])).alias("w")).select(*names, "w.*")
    sides = wanted.select(*names, "q", "rest", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("lo").alias("__place")), F.struct(F.lit(1).alias("side"), F.col("hi").alias("__place")))).alias("p")).select(*names, "q", "rest", "p.*")
    values = sides.join(placed.select("__place", "__x"), "__place")
    both = values.groupBy(*names, "q").agg(F.max("rest").alias("rest"), F.max(F.when(F.col("side") == 0, F.col("__x"))).alias("lo"), F.max(F.when(F.col("side") == 1, F.col("__x"))).alias("hi"))
    both = both.withColumn("v", F.when(F.col("rest") == 0, F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("rest")))
    out = both.groupBy(*names).agg(*[F.max(F.when(F.col("q") == i, F.col("v"))).alias(name) for i, name in enumerate(shares)])
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], *[F.col(f"`{name}`") for name in shares])


def _label(func: object) -> str:
    return func if isinstance(func, str) else getattr(func, "__name__", "agg")


def super_table(df: DataFrame, keys: Sequence[str], funcs: Mapping[str, object] | None, count: str | None, order: Sequence[str]) -> DataFrame:
    """Groups of equal, known keys with their size (``count``) and aggregates.

    ``funcs`` maps a column to an aggregate (a name or a function from Column to Column) or a list of them. If any value is a list, all results are named
    ``column_func``, else they keep the column's name. Without size and aggregates there is nothing to return: ValueError. Medians and quantiles
    come from :func:`group_quantiles`; 'list', 'tuple', 'set' and the sum of strings hold a group in one row, as their result does.
    """
    funcs = dict(funcs or {})
    if not funcs and not count:
        raise ValueError("ask for the size or for at least one aggregate")
    many = any(isinstance(f, (list, tuple)) for f in funcs.values())
    out = [F.count(F.lit(1)).alias(count)] if count else []
    names = list(keys) + ([count] if count else [])
    quantiles: dict[str, dict[str, float]] = {}
    for column, given in funcs.items():
        for func in given if isinstance(given, (list, tuple)) else [given]:
            name = f"{column}_{_label(func)}" if many else column
            if name in names:
                raise ValueError(f"two columns would be called {name!r}")
            names.append(name)
            if (share := quantile_share(func)) is not None:
                quantiles.setdefault(column, {})[name] = share
                continue
            c = F.col(f"`{column}`")
            agg = aggregate(func, c, df.schema[column].dataType, order) if isinstance(func, str) else func(c)
            out.append(agg.alias(name))
    groups = known_groups(df, keys)
    if not quantiles:
        return groups.agg(*out)
    table = groups.agg(*out) if out else groups.agg(F.count(F.lit(1)).alias("__n"))
    for column, shares in quantiles.items():
        table = table.join(group_quantiles(df, keys, column, shares), list(keys), "left")
    return table.select(*[F.col(f"`{n}`") for n in names])


def known_groups(df: DataFrame, keys: Sequence[str]) -> GroupedData:
    """``df`` grouped by keys, rows with an unknown key left out."""
    for k in keys:
        df = df.where(F.col(f"`{k}`").isNotNull())
    return df.groupBy(*[F.col(f"`{k}`") for k in keys])


def as_list(given: str | Sequence[str] | None) -> list[str]:
    return [] if given is None else [given] if isinstance(given, str) else list(given)


def with_end_features(
    e: DataFrame, v: DataFrame, node_id: str, source: str, target: str, source_features: Sequence[str], target_features: Sequence[str], reuse: bool = False, validate: bool = False
) -> DataFrame:
    """Edges with the features of their ends as ``f_s`` and ``f_t``, taken from the node table; ``reuse`` trusts columns that exist.

    An end that is in no node table has unknown features; ``validate`` makes it a KeyError, which takes a job of its own. Hubs are salted.
    """
    if validate:
        check_ends(e, v, node_id, [k for k, f in ((source, source_features), (target, target_features)) if f])
    for end, key, features in (("s", source, source_features), ("t", target, target_features)):
        wanted = [f for f in features if not (reuse and f"{f}_{end}" in e.columns)]
        if wanted:
            found = v.select(F.col(node_id).alias(key), *[F.col(f"`{f}`").alias(f"{f}_{end}") for f in wanted])
            e = skew_join(e.drop(*[f"{f}_{end}" for f in wanted]), found, key, "left")
    return e


def check_ends(e: DataFrame, v: DataFrame, node_id: str, ends: Sequence[str]) -> None:
    """KeyError if an edge has an end, known or not, that is in no node table."""
    for end in ends:
        ids = v.select(F.col(node_id).alias(end)).distinct()
        lost = skew_join(e.select(end), ids, end, "left_anti").select(end).limit(1).collect()
        if lost:
            raise KeyError(f"the edge table has {end} = {lost[0][0]!r}, which is no node")
