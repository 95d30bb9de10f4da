"""A typed graph: a table of nodes with features and a table of edges with relations, both immutable."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

from .functions.numeric import nan_to_null, value_in
from .functions.vectors import ordinal_ranks, whiten
from .operators import components, export, labels, linkage, plotdata, recipes
from .operators.band import band_maker, band_spec
from .operators.matrix import dot_pairs
from .operators.pairs import all_pair_edges
from .operators.partition import as_list, group_quantiles, known_groups, super_table, with_end_features
from .operators.skew import skew_join
from .plans.metrics import log_step
from .plans.positions import with_position

POS = "__pos"


class Graph:
    """Nodes ``v`` (one row per ``node_id``) and edges ``e`` (``source``, ``target``, relations); ``e`` may be missing.

    ``order_by`` gives the row order that orients edges and numbers pairs; the node id breaks ties and is the order if
    nothing is said. NaN counts as unknown from the start. Methods that change the graph return a new one.
    """

    def __init__(
        self,
        v: DataFrame,
        e: DataFrame | None = None,
        node_id: str = "id",
        source: str = "s",
        target: str = "t",
        order_by: str | Sequence[str] | None = None,
        supernode_labels_by: Mapping[str, str | Sequence[str]] | None = None,
        superedge_labels_by: Mapping[str, str | Sequence[str]] | None = None,
    ) -> None:
        for column, table, name in ((node_id, v, "node"), *(((source, e, "edge"), (target, e, "edge")) if e is not None else ())):
            if column not in table.columns:
                raise KeyError(f"the {name} table has no column {column!r}")
        self.node_id, self.source, self.target = node_id, source, target
        self.order_by = as_list(order_by)
        v = nan_to_null(v)
        for name, by in (supernode_labels_by or {}).items():
            v = labels.with_codes(v, as_list(by), name)
        self._v = v
        self._positioned: dict[tuple, tuple[DataFrame, int]] = {}
        if e is not None:
            e = nan_to_null(e)
            for name, by in (superedge_labels_by or {}).items():
                e = labels.with_codes(e, as_list(by), name)
        self._e = e
        self._ends: Callable[..., DataFrame] | None = None  # makes the edges anew with features of their ends, if they were made from these nodes

    # --- tables and sizes ---

    @property
    def v(self) -> DataFrame:
        return self._v.drop(POS)

    @property
    def e(self) -> DataFrame:
        if self._e is None:
            raise AttributeError("the graph has no edges")
        return self._e

    @property
    def has_edges(self) -> bool:
        return self._e is not None

    @property
    def n(self) -> int:
        """Number of nodes."""
        return self._v.count()

    @property
    def m(self) -> int:
        """Number of edges, 0 without an edge table."""
        return self._e.count() if self._e is not None else 0

    @staticmethod
    def _counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
        if not names:
            return df.sparkSession.createDataFrame([], "column string, n bigint")
        one = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(names)])
        return one.selectExpr(f"stack({len(names)}, {', '.join(f'{c!r}, c{k}' for k, c in enumerate(names))}) as (column, n)")

    @property
    def f(self) -> DataFrame:
        """Known values of every feature."""
        return self._counts(self.v, [c for c in self.v.columns if c != self.node_id])

    @property
    def r(self) -> DataFrame:
        """Known values of every relation."""
        return self._counts(self.e, [c for c in self.e.columns if c not in (self.source, self.target)])

    def __repr__(self) -> str:
        edges = f"{', '.join(self.e.columns)}" if self.has_edges else "none"
        return f"Graph(v: {', '.join(self.v.columns)}; e: {edges})"

    def _with(self, v: DataFrame | None = None, e: DataFrame | None = None, keep_edges: bool = True) -> Graph:
        new = Graph.__new__(Graph)
        new.__dict__.update(self.__dict__)
        new._positioned = self._positioned if v is None else {}
        new._v = self._v if v is None else v
        new._e = e if e is not None else (self._e if keep_edges else None)
        new._ends = self._ends if v is None and e is None and keep_edges else None
        return new

    def positioned(self, *first: str) -> DataFrame:
        """The node table with its dense row position ``__pos``, sorted by ``first``, then by the graph's order."""
        return self._placed(first)[0]

    def _placed(self, first: Sequence[str] = ()) -> tuple[DataFrame, int]:
        order = tuple(dict.fromkeys([*first, *self.order_by, self.node_id]))
        if order not in self._positioned:
            at = with_position(self.v, list(order), POS)
            self._positioned[order] = (at, at._knotwork_rows)
        return self._positioned[order]

    # --- edges from pairs ---

    def create_edges(
        self,
        connectors: object = None,
        selectors: object = None,
        transfer_features: str | Sequence[str] | None = None,
        r_dtype_dic: Mapping[str, object] | None = None,
        no_transfer_rs: str | Sequence[str] | None = None,
        step_size: float = 1e7,
        from_pos: int = 0,
        to_pos: int | None = None,
        on: str | Sequence[str] | None = None,
        verbose: bool = False,
        logfile: str | None = None,
    ) -> Graph:
        """Edges between all pairs of nodes i < j in row order that the selectors keep, with the connectors' relations.

        ``on``: features that must be equal, for a join by key instead of all pairs. ``from_pos`` and ``to_pos`` limit the
        pairs by their number in the row-major triangle. ``step_size`` has no effect: Spark's partitions are the chunks.
        ``verbose`` and ``logfile`` make the edges at once and say how many pairs were met, how many edges were kept and how long it
        took, on the screen and as a row appended to the log (a folder in any file system, see :func:`read_log`).
        """
        del step_size
        noted = Observation() if verbose or logfile else None
        keyed = on and not from_pos and to_pos is None
        v, n = (self.v, None) if keyed else self._placed()
        e = all_pair_edges(v, n, self.node_id, self.source, self.target, connectors, selectors, transfer_features, r_dtype_dic, no_transfer_rs, from_pos, to_pos, on, self.order_by, noted)
        return self._with(e=log_step("create_edges", e, noted, verbose, logfile) if noted else e)

    def create_edges_ft(
        self,
        ft_feature: Sequence,
        connectors: object = None,
        selectors: object = None,
        transfer_features: str | Sequence[str] | None = None,
        r_dtype_dic: Mapping[str, object] | None = None,
        no_transfer_rs: str | Sequence[str] | None = None,
        min_chunk_size: int = 1000,
        max_pairs: float = 1e7,
        from_pos: int = 0,
        to_pos: int | None = None,
        on: str | Sequence[str] | None = None,
        require_sorted: bool = False,
        verbose: bool = False,
        logfile: str | None = None,
    ) -> Graph:
        """Edges between nodes at most a threshold apart along ``ft_feature``: (column, threshold) or (time column, threshold, unit).

        Nodes are sorted by that column first, then by the graph's order; ``require_sorted`` raises AssertionError instead if
        the graph's own order isn't sorted by it. ``from_pos``, ``to_pos``: the source nodes, by position.
        ``min_chunk_size`` and ``max_pairs`` have no effect; ``verbose`` and ``logfile`` are those of :meth:`create_edges`, the pairs being those within the band.
        """
        del min_chunk_size, max_pairs
        noted = Observation() if verbose or logfile else None
        column = band_spec(self.v, ft_feature)[0]
        ranged, own = from_pos or to_pos is not None, [*self.order_by, self.node_id]
        if require_sorted and own[0] != column:  # else it is sorted by that column to begin with
            at = self._placed()[0] if ranged else with_position(self.v.select(*dict.fromkeys([*own, column])), list(dict.fromkeys(own)), POS)
            at = at.select(POS, F.col(column).alias("x"))
            falls = at.join(at.select((F.col(POS) + 1).alias(POS), F.col("x").alias("before")), POS).where("x < before")
            assert falls.isEmpty(), f"the nodes aren't sorted by {column}"
        v = self.v if not ranged else self._placed()[0] if require_sorted else self._placed([column])[0]
        if to_pos is not None and not 0 <= from_pos < to_pos:
            raise AssertionError("0 <= from_pos < to_pos is required")
        make = band_maker(v, self.node_id, self.source, self.target, ft_feature, connectors, selectors, transfer_features, r_dtype_dic, no_transfer_rs, from_pos, to_pos, on, self.order_by, noted)
        if noted:
            return self._with(e=log_step("create_edges_ft", make(), noted, verbose, logfile))
        new = self._with(e=make())
        new._ends = make
        return new

    def create_correlation_edges(self, vector: str, threshold: float, relation: str = "corr", method: str = "pearson") -> Graph:
        """Edges between nodes whose vectors correlate by at least ``threshold`` in size, by blocks of matrix products.

        ``method``: pearson, spearman (ordinal ranks, ties in order of place) or dot (the vectors as they are).
        """
        if method not in ("pearson", "spearman", "dot"):
            raise ValueError("method is 'pearson', 'spearman' or 'dot'")
        v, n = self._placed()
        z = F.col(vector)
        z = z if method == "dot" else whiten(ordinal_ranks(z) if method == "spearman" else z)
        v = v.select(self.node_id, POS, z.alias("__z")).withColumn("__len", F.size("__z"))
        length = v.agg(F.max("__len")).first()[0] or 1
        v = v.where(F.col("__len") == length)
        scale = 1.0 if method == "dot" else 1.0 / length
        return self._with(e=dot_pairs(v, n, self.node_id, "__z", self.source, self.target, relation, threshold, length, scale))

    # --- partitions ---

    def partition_nodes(self, features: str | Sequence[str], feature_funcs: Mapping[str, object] | None = None, n_nodes: bool = True, return_gv: bool = False, sort: bool = False) -> DataFrame | tuple[DataFrame, GroupedData]:
        """Super nodes: nodes grouped by features, their number ``n_nodes`` and aggregates of features; ``sort`` puts them in the order of their keys."""
        keys = as_list(features)
        sv = super_table(self.v, keys, feature_funcs, "n_nodes" if n_nodes else None, [*self.order_by, self.node_id])
        sv = sv.orderBy(*keys) if sort else sv
        return (sv, known_groups(self.v, keys)) if return_gv else sv

    def partition_edges(
        self,
        relations: str | Sequence[str] | None = None,
        source_features: str | Sequence[str] | None = None,
        target_features: str | Sequence[str] | None = None,
        relation_funcs: Mapping[str, object] | None = None,
        n_edges: bool = True,
        return_ge: bool = False,
        reuse: bool = False,
        validate: bool = False,
        sort: bool = False,
    ) -> DataFrame | tuple[DataFrame, GroupedData]:
        """Super edges: edges grouped by relations, features of their sources and features of their targets.

        An edge with an end that is no node has unknown features there and is in no group; ``validate`` raises KeyError for it, at the price
        of a job. ``sort`` puts the groups in the order of their keys.
        """
        sf, tf = as_list(source_features), as_list(target_features)
        wanted = list(dict.fromkeys([*sf, *tf]))
        if self._ends and wanted and not (reuse or validate) and set(wanted) <= set(self._v.columns):  # the rows that are joined have the features at hand
            given = [*[f"{f}_s" for f in sf], *[f"{f}_t" for f in tf]]
            e = self._ends(wanted).select(*[F.col(f"`{c}`") for c in self.e.columns if c not in given], *[F.col(f"`__{c}`").alias(c) for c in given])
        else:
            e = with_end_features(self.e, self.v, self.node_id, self.source, self.target, sf, tf, reuse, validate)
        keys = [*as_list(relations), *[f"{f}_s" for f in sf], *[f"{f}_t" for f in tf]]
        if not keys:
            raise ValueError("group by a relation, or by a feature of an end")
        se = super_table(e, keys, relation_funcs, "n_edges" if n_edges else None, [self.source, self.target])
        se = se.orderBy(*keys) if sort else se
        return (se, known_groups(e, keys)) if return_ge else se

    def partition_graph(
        self,
        features: str | Sequence[str],
        feature_funcs: Mapping[str, object] | None = None,
        relation_funcs: Mapping[str, object] | None = None,
        n_nodes: bool = True,
        n_edges: bool = True,
        return_gve: bool = False,
    ) -> tuple:
        """Super nodes and the super edges between them, by the same features."""
        keys = as_list(features)
        sv, gv = self.partition_nodes(keys, feature_funcs, n_nodes, True)
        se, ge = self.partition_edges(None, keys, keys, relation_funcs, n_edges, True)
        return (sv, se, gv, ge) if return_gve else (sv, se)

    def super_graph(self, features: str | Sequence[str], feature_funcs: Mapping[str, object] | None = None, relation_funcs: Mapping[str, object] | None = None) -> Graph:
        """The partition as a graph of its own; a super node's id is the struct of its keys."""
        keys = as_list(features)
        sv, se = self.partition_graph(keys, feature_funcs, relation_funcs)
        sv = sv.withColumn("id", F.struct(*keys))
        ends = {end: F.struct(*[F.col(f"{k}_{end}").alias(k) for k in keys]) for end in "st"}
        return Graph(sv, se.withColumns({"s": ends["s"], "t": ends["t"]}), "id", "s", "t")

    def partition_rollup(self, features: Sequence[str], feature_funcs: Mapping[str, object] | None = None) -> DataFrame:
        """The chain of ever coarser partitions by the first k features, k = all .. 0, in one pass; ``level`` is k."""
        df = self.v
        for k in features:
            df = df.where(F.col(k).isNotNull())
        from .operators.partition import aggregate

        aggs = [aggregate(f, F.col(c), df.schema[c].dataType, [self.node_id]).alias(c) for c, f in (feature_funcs or {}).items()]
        level = (F.lit(len(features)) - sum((F.grouping(k).cast("int") for k in features), F.lit(0))).alias("level")
        return df.rollup(*features).agg(level, F.count(F.lit(1)).alias("n_nodes"), *aggs)

    # --- filters ---

    def update_edges(self) -> Graph:
        """Keep the edges whose ends are both in the node table."""
        ids = self._v.select(F.col(self.node_id).alias(self.source))
        e = skew_join(self.e, ids, self.source, "left_semi")
        e = skew_join(e, ids.withColumnRenamed(self.source, self.target), self.target, "left_semi")
        return self._with(e=e.select(*self.e.columns))

    def _filtered(self, keep: object) -> Graph:
        new = self._with(v=self._v.where(keep))
        return new.update_edges() if self.has_edges else new

    @staticmethod
    def _within(col: str, interval: tuple, endpoint: bool) -> object:
        lo, hi = (F.lit(x) for x in interval)
        return (F.col(col) >= lo) & ((F.col(col) <= hi) if endpoint else (F.col(col) < hi))

    def filter_by_interval_v(self, col: str, interval: tuple, endpoint: bool = True) -> Graph:
        """Keep nodes with a feature in an interval, closed unless ``endpoint`` is False; edges follow."""
        return self._filtered(self._within(col, interval, endpoint))

    def filter_by_interval_e(self, col: str, interval: tuple, endpoint: bool = True) -> Graph:
        return self._with(e=self.e.where(self._within(col, interval, endpoint)))

    def filter_by_values_v(self, col: str, values: object) -> Graph:
        """Keep nodes with a feature among the values (a string is one value; None stands for unknown); edges follow."""
        return self._filtered(value_in(F.col(col), values))

    def filter_by_values_e(self, col: str, values: object) -> Graph:
        return self._with(e=self.e.where(value_in(F.col(col), values)))

    def filter_by_group_quantile_v(self, by: str, col: str, q: float) -> Graph:
        """Keep nodes whose feature is at least the q-quantile (linear interpolation) within their group; edges follow."""
        limits = group_quantiles(self._v, [by], col, {"__limit": q})
        new = self._with(v=skew_join(self._v, limits, by).where(F.col(col) >= F.col("__limit")).select(*self._v.columns))
        return new.update_edges() if self.has_edges else new

    # --- labels ---

    def append_binning_labels_v(self, col: str, col_name: str, bins: object = 10, log_bins: object = False, floor: bool = False, return_bin_edges: bool = False) -> Graph | tuple[Graph, list[float]]:
        """Number the nodes by the bin of a feature, see :func:`labels.digitize`."""
        edges = labels.bin_edges(self._v, col, bins, log_bins, floor)
        new = self._with(v=self._v.withColumn(col_name, labels.digitize(F.col(col), edges)))
        return (new, edges) if return_bin_edges else new

    def append_datetime_categories_v(self, col: str = "time", timeofday: str | bool | None = None, met_season: str | bool | None = None) -> Graph:
        return self._with(v=labels.with_datetime_categories(self._v, col, timeofday, met_season))

    def append_supernode_labels(self, name: str, by: str | Sequence[str]) -> Graph:
        return self._with(v=labels.with_codes(self._v, as_list(by), name))

    def append_cp(self, directed: bool = False, connection: str = "weak", col_name: str = "cp", label_by_size: bool = True, consolidate_singles: bool = False) -> Graph:
        """Label every node with its component, 0 the largest. Strong components need ``directed`` and ``connection='strong'``."""
        if connection not in ("weak", "strong"):
            raise ValueError("connection is 'weak' or 'strong'")
        find = components.strong_components if directed and connection == "strong" else components.weak_components
        roots = find(self.e, self.source, self.target)
        at = self.positioned() if self.order_by else self.v.withColumn(POS, F.col(self.node_id))
        v = components.label_components(at, roots, self.node_id, col_name, label_by_size, consolidate_singles)
        return self._with(v=v.drop(POS))

    def undirected(self, weights: str | Sequence[str]) -> Graph:
        """The graph whose weights are summed over both directions, see :func:`recipes.undirected`."""
        return self._with(e=recipes.undirected(self.e, self.source, self.target, as_list(weights)))

    def dominant(self, kind: str | Column, name: str = "dominant") -> Graph:
        """The graph with one edge per pair and its most frequent kind, see :func:`recipes.dominant`."""
        return self._with(e=recipes.dominant(self.e, self.source, self.target, F.col(kind) if isinstance(kind, str) else kind, name))

    def append_linkage(self, relation: str, col_name: str = "cluster", at_most: int | None = None, similarity: float | None = None, merges: DataFrame | None = None) -> Graph:
        """Label every node with its cluster by average linkage over a similarity of the edges, 0 the largest: cut into ``at_most`` clusters, or at a ``similarity``.

        ``merges``: the table of :func:`linkage.average_linkage` if it is there already, to cut it more than once.
        """
        merges = linkage.average_linkage(self.e, self.source, self.target, relation) if merges is None else merges
        roots = linkage.cut(merges, at_most, similarity)
        at = self.positioned() if self.order_by else self.v.withColumn(POS, F.col(self.node_id))
        return self._with(v=components.label_components(at, roots, self.node_id, col_name).drop(POS))

    def degrees(self) -> DataFrame:
        return components.degrees(self.v, self.e, self.node_id, self.source, self.target)

    # --- exporters ---

    def return_cs_graph(self, relations: bool | str | Sequence[str] = False, dropna: bool | Sequence[bool] = True) -> DataFrame | Mapping[str, DataFrame]:
        return export.coo(self.positioned(), self.e, self.node_id, self.source, self.target, relations, dropna)

    def return_nx_graph(self, features: bool | str | Sequence[str] = False, relations: bool | str | Sequence[str] = False, dropna: str = "none", check: bool = False) -> tuple[DataFrame, DataFrame]:
        return export.row_edges(self.v, self.e, self.node_id, self.source, self.target, features, relations, dropna, check)

    def return_nx_multigraph(self, features: bool | str | Sequence[str] = False, relations: bool | str | Sequence[str] = False, dropna: bool = True) -> tuple[DataFrame, DataFrame]:
        nodes = self.v.select(self.node_id, *export._chosen(features, [c for c in self.v.columns if c != self.node_id]))
        return nodes, export.cell_edges(self.e, self.source, self.target, relations, dropna)

    def return_gt_graph(
        self, features: bool | str | Sequence[str] = False, relations: bool | str | Sequence[str] = False, dropna: str = "none", node_indices: bool = False, edge_indices: bool = False
    ) -> tuple[DataFrame, DataFrame, dict[str, str]]:
        return export.property_tables(self.positioned(), self.e, self.node_id, self.source, self.target, features, relations, dropna, node_indices, edge_indices)

    # --- what plots show ---

    def plot_2d(self, x: str, y: str, edges: bool = False, C: str | None = None, C_split_0: bool = False) -> dict[str, DataFrame]:
        """Points, axis limits and, with ``edges``, arrows; with a color ``C`` the limits have a row of its own, over all edges."""
        out = {"points": plotdata.points(self.v, self.node_id, x, y), "limits": self.plot_limits(x, y, C=C)}
        if edges:
            out["arrows"] = plotdata.arrows(self.v, self.e, self.node_id, self.source, self.target, x, y, color=C, split_zero=C_split_0)
        return out

    def plot_limits(self, *axes: str, C: str | None = None) -> DataFrame:
        """(axis, low, high) for a series of pictures: the range of each axis over all nodes and, with ``C``, that of the color over all edges."""
        limits = plotdata.axis_limits(self.v, list(axes))
        return limits.unionByName(plotdata.color_limits(self.e, C)) if C else limits

    def plot_map(self, lon: str, lat: str, edges: bool = False, C: str | None = None, C_split_0: bool = False) -> dict[str, DataFrame]:
        return self.plot_2d(lon, lat, edges, C, C_split_0)

    def plot_2d_generator(self, x: str, y: str, by: str, C: str | None = None) -> Iterator[tuple[object, DataFrame, DataFrame]]:
        return plotdata.frame_generator(self.v, self.e, self.node_id, self.source, self.target, by, x, y, C)

    def plot_map_generator(self, lon: str, lat: str, by: str, C: str | None = None) -> Iterator[tuple[object, DataFrame, DataFrame]]:
        return self.plot_2d_generator(lon, lat, by, C)

    def plot_3d(self, x: str, y: str, z: str, edges: bool = False) -> dict[str, DataFrame]:
        out = {"points": plotdata.points(self.v, self.node_id, x, y, z)}
        if edges:
            out["arrows"] = plotdata.arrows(self.v, self.e, self.node_id, self.source, self.target, x, y, z)
        return out

    def plot_rects_label_numeric(self, label: str, left: str, right: str) -> DataFrame:
        return plotdata.rects_label_numeric(self.v, self.node_id, label, left, right)

    def plot_rects_numeric_numeric(self, left: str, right: str, bottom: str, top: str) -> DataFrame:
        return plotdata.rects_numeric_numeric(self.v, self.node_id, left, right, bottom, top)

    def plot_raster(self, label: str, time: str = "time") -> DataFrame:
        return plotdata.raster(self.v, label, time)

    @staticmethod
    def plot_hist(df: DataFrame, col: str, bins: object = 10, log_bins: object = False, density: bool = False, floor: bool = False) -> DataFrame:
        return labels.histogram(df, col, bins, log_bins, density, floor)
