"""Edges from pairs of nodes: the theta self-join over the upper triangle of row positions.

Pairs come from an equi-join wherever one can be had. With declared keys (``on``) rows meet by key. Without, positions are
cut into blocks and every pair of blocks is one join key: the triangle is spread evenly over the tasks, each task holds two blocks
at most, and nothing has to be broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.pairfunctions import PairFunction, as_functions, check_outputs, schedule
from ..plans.positions import first_row_of, pair_index
from .skew import block_join

#: Pairs that one block pair should hold, roughly.
BLOCK_PAIRS = 4_000_000
#: Rows a task may hold in a hash table.
HASHED_ROWS = 1_000_000

#: Names of numpy types and what they become; unsigned ones take the next wider signed type.
_TYPES = {
    "bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int",
    "uint32": "bigint", "uint64": "decimal(20,0)", "float16": "float", "float32": "float", "float64": "double", "str": "string",
}


def sql_type(kind: object) -> str:
    """The SQL type of a numpy or Python type or its name; a SQL name stays as it is."""
    if isinstance(kind, T.DataType):
        return kind.simpleString()
    if isinstance(kind, type):
        kind = {bool: "bool", int: "int64", float: "float64", str: "str"}.get(kind) or np.dtype(kind).name
    elif isinstance(kind, np.dtype):
        kind = kind.name
    return _TYPES.get(str(kind), str(kind))


def _names(given: str | Sequence[str] | None) -> list[str]:
    return [] if given is None else [given] if isinstance(given, str) else list(given)


def _side(v: DataFrame, node_id: str, rank: Column, features: Sequence[str], end: str, extra: Mapping[str, Column] = {}) -> DataFrame:
    return v.select(F.col(node_id).alias(f"__id_{end}"), rank.alias(f"__pos_{end}"), *[F.col(f).alias(f"{f}_{end}") for f in features], *[c.alias(n) for n, c in extra.items()])


def keyed_pairs(v: DataFrame, node_id: str, features: Sequence[str], on: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """All pairs in row order with equal, known keys; a crowded key is split. Rows are compared by value, or by ``__pos`` if there is one."""
    keys = {f"__k{i}": F.col(k) for i, k in enumerate(on)}
    rank = F.col("__pos") if "__pos" in v.columns else F.struct(*order_by, node_id)
    for k in on:
        v = v.where(F.col(k).isNotNull())
    return block_join(_side(v, node_id, rank, features, "s", keys), _side(v, node_id, rank, features, "t", keys), list(keys), "__id_t").where("__pos_s < __pos_t")


def triangle(v: DataFrame, n: int, node_id: str, features: Sequence[str], first: int = 0, last: int | None = None, blocks: int | None = None) -> DataFrame:
    """All pairs with pos_s < pos_t of a table with dense ``__pos``; rows first..last only as sources.

    Columns ``__id_s``, ``__id_t``, ``__pos_s``, ``__pos_t`` and ``f_s``, ``f_t`` of each feature.
    """
    pos = F.col("__pos")
    sources = v.where((pos >= first) & (pos <= (n if last is None else last))) if first or last is not None else v
    g = blocks or max(1, math.ceil(math.sqrt(n * n / 2 / BLOCK_PAIRS)), min(8, math.ceil(n / 500)))
    block = F.floor(pos * g / max(n, 1)).cast("int")
    # block pair (i, j), i <= j, is key i * g + j; a source row of block i takes part in all j >= i, a target row of j in all i <= j
    left = _side(sources, node_id, pos, features, "s", {"__b": F.explode(F.transform(F.sequence(block, F.lit(g - 1)), lambda j: block * g + j))})
    right = _side(v, node_id, pos, features, "t", {"__b": F.explode(F.transform(F.sequence(F.lit(0), block), lambda i: i * g + block))})
    tasks = int(v.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fits = n * g / 2 / tasks <= HASHED_ROWS  # rows that a task would hold in a hash table; beyond that it sorts and may spill
    return left.join(right.hint("shuffle_hash" if fits else "merge"), "__b").where("__pos_s < __pos_t").drop("__b")


def _argument(name: str) -> str:
    return {"sources": "__id_s", "targets": "__id_t"}.get(name, name)


def _apply_column(pairs: DataFrame, fn: PairFunction, ft: Mapping[str, Column]) -> DataFrame:
    args = [ft[p] if p in ft else F.col(f"`{_argument(p)}`") for p in fn.inputs]
    out = fn.fn(*args)
    parts = list(out) if isinstance(out, (tuple, list)) else [out]
    keep = parts.pop(0) if fn.kind == "selector" else None
    if len(parts) != len(fn.outputs):
        raise AssertionError(f"{fn.name} returns {len(parts)} relations, {len(fn.outputs)} are declared")
    if fn.outputs:
        pairs = pairs.withColumns({n: c if isinstance(c, Column) else F.lit(c) for n, c in zip(fn.outputs, parts)})
    return pairs.where(keep) if keep is not None else pairs


def _apply_vectorized(pairs: DataFrame, fn: PairFunction, ftt: object) -> DataFrame:
    schema = T.StructType(list(pairs.schema.fields))
    for name in fn.outputs:
        schema = schema.add(name, T._parse_datatype_string(sql_type(fn.types.get(name, "double"))))
    outputs, inputs, is_selector, indexing, label = fn.outputs, fn.inputs, fn.kind == "selector", fn.indexing, fn.name
    run = fn.fn
    rename = {p: _argument(p) for p in inputs}

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            size = len(frame)
            if not size:
                continue
            at = np.arange(size)
            args = [ftt if p == "ftt" else at if indexing and p in ("sources", "targets") else frame[rename[p]].to_numpy() for p in inputs]
            got = run(*args)
            parts = list(got) if isinstance(got, tuple) else [got]
            keep = None
            if is_selector and indexing:
                keep, other = parts[0], parts[1]
                parts = parts[2:]
                if len(keep) != len(other):
                    raise AssertionError(f"{label} returns sources and targets of unequal length")
            elif is_selector:
                keep = np.asarray(parts.pop(0))
            for name, values in zip(outputs, parts, strict=True):
                if np.shape(values)[:1] != (size,):
                    raise AssertionError(f"{label} returns {name!r} with {np.shape(values)} values for {size} pairs")
                frame[name] = list(values) if np.ndim(values) > 1 else values
            yield frame if keep is None else frame.iloc[np.flatnonzero(keep) if keep.dtype == bool else keep]

    return pairs.mapInPandas(work, schema)


def apply_functions(pairs: DataFrame, order: Sequence[PairFunction], ft: Mapping[str, Column] | None = None, ftt: object = None) -> DataFrame:
    """Run the scheduled functions over the pairs. Vectorized ones become a barrier between the expressions around them."""
    for fn in order:
        pairs = _apply_vectorized(pairs, fn, ftt) if fn.vectorized else _apply_column(pairs, fn, ft or {})
    return pairs


def needed_features(functions: Sequence[PairFunction], transfer: Sequence[str], columns: Sequence[str]) -> list[str]:
    wanted = set(transfer).union(*[fn.features() for fn in functions])
    if missing := wanted - set(columns):
        raise KeyError(f"no such features: {sorted(missing)}")
    return [c for c in columns if c in wanted]


def finish(pairs: DataFrame, source: str, target: str, relations: Sequence[str], transfer: Sequence[str], dtypes: Mapping[str, object], drop: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """The edge table: ids, relations (cast, unless dropped), transferred features and the columns ``also`` as they are."""
    cast = lambda n: F.col(f"`{n}`").cast(sql_type(dtypes[n])).alias(n) if n in dtypes else F.col(f"`{n}`")
    kept = [cast(r) for r in relations if r not in drop]
    moved = [F.col(f"{f}_{end}") for f in transfer for end in "st"]
    return pairs.select(F.col("__id_s").alias(source), F.col("__id_t").alias(target), *kept, *moved, *[F.col(f"`{c}`") for c in also])


def all_pair_edges(
    v: DataFrame,
    n: int | None,
    node_id: str,
    source: str,
    target: str,
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
) -> DataFrame:
    """The edges of ``create_edges``. An empty selection gives a typed, empty table. ``seen`` notes the pairs, before any selector.

    The table has a dense ``__pos`` and ``n`` rows, unless pairs meet by key (``on``) and no range is asked for: then rows are
    compared by ``order_by`` and id.
    """
    con = [f for f in as_functions(connectors, "connector") if isinstance(f, PairFunction)]
    sel = [f for f in as_functions(selectors, "selector") if isinstance(f, PairFunction)]
    dtypes, transfer, drop = dict(r_dtype_dic or {}), _names(transfer_features), _names(no_transfer_rs)
    check_outputs([*con, *sel], dtypes)
    order = schedule(sel, con)
    features = needed_features(order, transfer, [c for c in v.columns if c != "__pos"])
    if n is None:
        pairs = keyed_pairs(v, node_id, features, _names(on), order_by)
    else:
        whole = n * (n - 1) // 2
        end = whole if to_pos is None else to_pos
        if whole and not 0 <= from_pos < end <= whole:
            raise AssertionError(f"0 <= from_pos < to_pos <= {whole} is required")
        limited = whole and (from_pos > 0 or end < whole)
        first, last = (first_row_of(n, from_pos), first_row_of(n, end - 1)) if limited else (0, None)
        pairs = keyed_pairs(v, node_id, features, _names(on)) if on else triangle(v, n, node_id, features, first, last)
        if limited:
            k = pair_index(F.lit(n), F.col("__pos_s"), F.col("__pos_t"))
            pairs = pairs.where((k >= from_pos) & (k < end))
    if seen is not None:
        pairs = pairs.observe(seen, F.count(F.lit(1)).alias("pairs"))
    pairs = apply_functions(pairs, order)
    return finish(pairs, source, target, [o for f in order for o in f.outputs], transfer, dtypes, drop)
