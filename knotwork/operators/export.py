"""Representations of a graph for other tools, as tables; converters to driver-side objects are optional and lazy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import skew_join


def _chosen(given: bool | str | Sequence[str], every: Sequence[str]) -> list[str]:
    if given is True:
        return list(every)
    if not given:
        return []
    names = [given] if isinstance(given, str) else list(given)
    if missing := set(names) - set(every):
        raise KeyError(f"no such columns: {sorted(missing)}")
    return names


def _indexed(e: DataFrame, v: DataFrame, node_id: str, source: str, target: str) -> DataFrame:
    at = v.select(F.col(node_id).alias("__n"), "__pos")
    e = skew_join(e, at.select(F.col("__n").alias(source), F.col("__pos").alias("i")), source)
    return skew_join(e, at.select(F.col("__n").alias(target), F.col("__pos").alias("j")), target)


def coo(v: DataFrame, e: DataFrame, node_id: str, source: str, target: str, relations: bool | str | Sequence[str] = False, dropna: bool | Sequence[bool] = True) -> DataFrame | Mapping[str, DataFrame]:
    """Adjacency as (i, j, value) rows, i and j being row positions of the nodes.

    ``relations=False``: value True for every edge. Otherwise one table per relation, or just the table if it is one;
    ``dropna``, one for all or one per relation, leaves out unknown values.
    """
    at = _indexed(e, v, node_id, source, target)
    if relations is False:
        return at.select("i", "j", F.lit(True).alias("value"))
    names = _chosen(relations, [c for c in e.columns if c not in (source, target)])
    drops = [dropna] * len(names) if isinstance(dropna, bool) else list(dropna)
    assert len(drops) == len(names), "dropna is one value or as many as there are relations"
    out = {}
    for name, drop in zip(names, drops):
        one = at.select("i", "j", F.col(f"`{name}`").alias("value"))
        out[name] = one.where("value is not null") if drop else one
    return next(iter(out.values())) if len(out) == 1 else out


def row_edges(v: DataFrame, e: DataFrame, node_id: str, source: str, target: str, features: bool | str | Sequence[str] = False, relations: bool | str | Sequence[str] = False, dropna: str = "none", check: bool = False) -> tuple[DataFrame, DataFrame]:
    """A directed graph with one edge per row: node table and edge table with the chosen columns.

    ``dropna``: 'none', or leave out edges of which 'any' or 'all' of the chosen relations are unknown. An edge given twice
    can't be one edge: ``check`` makes it a ValueError, at the price of a shuffle and a job.
    """
    if dropna not in ("none", "any", "all"):
        raise ValueError("dropna is 'none', 'any' or 'all'")
    rels = _chosen(relations, [c for c in e.columns if c not in (source, target)])
    nodes = v.select(node_id, *_chosen(features, [c for c in v.columns if c not in (node_id, "__pos")]))
    edges = e.select(source, target, *rels)
    if dropna != "none" and rels and relations is not True:
        edges = edges.na.drop(how=dropna, subset=rels)
    if check and not edges.groupBy(source, target).count().where("count > 1").isEmpty():
        raise ValueError("the edge table repeats a (source, target) pair; use cell_edges for multigraphs")
    return nodes, edges


def cell_edges(e: DataFrame, source: str, target: str, relations: bool | str | Sequence[str] = False, dropna: bool = True) -> DataFrame:
    """A multigraph with one edge per cell: (source, target, relation[, value]).

    ``relations=False`` gives an edge per cell without values. Values of different types are turned to strings. Repeated rows are edges of their own.
    """
    every = [c for c in e.columns if c not in (source, target)]
    names = _chosen(relations, every) or every
    kinds = {e.schema[n].dataType.simpleString() for n in names}
    cast = (lambda n: f"`{n}`") if len(kinds) == 1 else (lambda n: f"cast(`{n}` as string)")
    stack = ", ".join(f"'{n}', {cast(n)}" for n in names)
    out = e.selectExpr(f"`{source}`", f"`{target}`", f"stack({len(names)}, {stack}) as (relation, value)")
    if dropna:
        out = out.where("value is not null")
    return out if relations else out.drop("value")


#: Types of property maps by SQL type; anything else is an object.
PROPERTY_TYPES = {"boolean": "bool", "tinyint": "int16_t", "smallint": "int16_t", "int": "int32_t", "bigint": "int64_t", "float": "double", "double": "double", "string": "string"}


def property_tables(v: DataFrame, e: DataFrame, node_id: str, source: str, target: str, features: bool | str | Sequence[str] = False, relations: bool | str | Sequence[str] = False, dropna: str = "none", node_indices: bool = False, edge_indices: bool = False) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Vertices (i, features) and edges (i, j, relations) with dense indices, and the property type of each column.

    ``node_indices`` and ``edge_indices`` add the ids that the nodes, or the ends of the edges, had.
    """
    feats = _chosen(features, [c for c in v.columns if c not in (node_id, "__pos")])
    _, edges = row_edges(v, e, node_id, source, target, False, relations, dropna)
    vertices = v.select(F.col("__pos").alias("i"), *([node_id] if node_indices else []), *feats)
    arcs = _indexed(edges, v, node_id, source, target).select("i", "j", *([source, target] if edge_indices else []), *[c for c in edges.columns if c not in (source, target)])
    kinds = {f.name: PROPERTY_TYPES.get(f.dataType.simpleString(), "object") for t in (vertices, arcs) for f in t.schema}
    return vertices, arcs, kinds


def to_scipy(matrix: DataFrame, n: int) -> object:
    """A scipy COO matrix from a table of :func:`coo`; it must fit the driver."""
    try:
        from scipy.sparse import coo_matrix
    except ImportError as error:
        raise ImportError("to_scipy needs scipy") from error
    rows = matrix.toPandas()
    return coo_matrix((rows["value"], (rows["i"], rows["j"])), shape=(n, n))


def to_networkx(nodes: DataFrame, edges: DataFrame, node_id: str, source: str, target: str, multi: bool = False) -> object:
    """A networkx DiGraph (or MultiDiGraph keyed by relation) from the tables of an exporter; they must fit the driver."""
    try:
        import networkx as nx
    except ImportError as error:
        raise ImportError("to_networkx needs networkx") from error
    graph = nx.MultiDiGraph() if multi else nx.DiGraph()
    graph.add_nodes_from((r.pop(node_id), r) for r in nodes.toPandas().to_dict("records"))
    for r in edges.toPandas().to_dict("records"):
        s, t = r.pop(source), r.pop(target)
        graph.add_edge(s, t, key=r.pop("relation"), **r) if multi else graph.add_edge(s, t, **r)
    return graph
