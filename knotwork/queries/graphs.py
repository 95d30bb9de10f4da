"""Queries of the graph operators: pairs, bands, partitions, filters, labels, components, exports, plot tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import great_circle_dist
from ..functions.numeric import known_cells
from ..functions.sets import cp_intersection_strength, cp_node_intersection, hypergeometric_p_value
from ..functions.vectors import dot, whiten
from ..graph import Graph
from ..operators import plotdata
from ..operators.linkage import average_linkage
from ..operators.overlap import set_pairs
from ..plans.metrics import read_log
from ..plans.pairfunctions import connector, selector
from ..session import scratch_path
from ..sources import TableStore, read_pajek, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Suppliers follow the customers in the common id space of the trade graph.
SUPPLIER_BASE = 1_000_000_000


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def suppliers(spark: SparkSession, sf: str) -> Graph:
    return Graph(_table(spark, sf, "supplier").drop("s_name"), node_id="s_suppkey")


def events(spark: SparkSession, sf: str) -> Graph:
    return Graph(_table(spark, sf, "events"), node_id="event_id", order_by="ts")


def trade(spark: SparkSession, sf: str) -> Graph:
    """Customers and suppliers, with an edge per pair that trades: number of items, value, and whether any was returned."""
    c = _table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = _table(spark, sf, "supplier").select((F.col("s_suppkey") + SUPPLIER_BASE).alias("id"), F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), F.lit(None).cast("string").alias("segment"))
    lines = _table(spark, sf, "lineitem").join(_table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    e = lines.groupBy(F.col("o_custkey").alias("s"), (F.col("l_suppkey") + SUPPLIER_BASE).alias("t")).agg(
        F.count(F.lit(1)).alias("n_items"), F.round(F.sum("l_extendedprice"), 2).alias("value"), F.bool_or(F.col("l_returnflag") == "R").alias("returned")
    )
    return Graph(c.unionByName(s), e)


_V = f"""v AS (SELECT c_custkey AS id, 'customer' AS kind, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer
  UNION ALL SELECT s_suppkey + {SUPPLIER_BASE}, 'supplier', s_nationkey, s_acctbal, NULL FROM supplier)"""
_E = f"""e AS (SELECT o_custkey AS s, l_suppkey + {SUPPLIER_BASE} AS t, count(*) AS n_items, round(sum(l_extendedprice), 2) AS value, bool_or(l_returnflag = 'R') AS returned
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
_VE = f"WITH {_V}, {_E}"
_SUPPLIERS = "SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos, count(*) OVER () AS n FROM supplier"
_TRIANGLE = "FROM (%s) a JOIN (%s) b ON a.pos < b.pos" % (_SUPPLIERS, _SUPPLIERS)


# --- all pairs ---


def gap(s_acctbal_s, s_acctbal_t):
    gap = F.round(s_acctbal_t - s_acctbal_s, 2)
    return gap


def double_gap(gap):
    double_gap = F.round(gap * 2, 2)
    return double_gap


@selector()
def close(gap):
    return F.abs(gap) <= 500


@selector(outputs=["same_nation"])
def same_nation(s_nationkey_s, s_nationkey_t, double_gap):
    same = s_nationkey_s == s_nationkey_t
    return double_gap >= 0, same


@query(f"SELECT a.s_suppkey AS s, b.s_suppkey AS t, round(b.s_acctbal - a.s_acctbal, 2) AS gap {_TRIANGLE}")
def pairs_all(spark: SparkSession, sf: str) -> DataFrame:
    return suppliers(spark, sf).create_edges(gap).e


@query(f"""SELECT a.s_suppkey AS s, b.s_suppkey AS t, round(b.s_acctbal - a.s_acctbal, 2) AS gap {_TRIANGLE}
  WHERE a.pos * (2 * a.n - a.pos - 1) // 2 + b.pos - a.pos - 1 >= a.n * (a.n - 1) // 20 AND a.pos * (2 * a.n - a.pos - 1) // 2 + b.pos - a.pos - 1 < a.n * (a.n - 1) // 4""")
def pairs_range(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs from a tenth to a half of the triangle."""
    g = suppliers(spark, sf)
    n = g.n
    return g.create_edges(gap, from_pos=n * (n - 1) // 20, to_pos=n * (n - 1) // 4).e


@query(f"SELECT a.s_suppkey AS s, b.s_suppkey AS t, round(b.s_acctbal - a.s_acctbal, 2) AS gap {_TRIANGLE} WHERE abs(round(b.s_acctbal - a.s_acctbal, 2)) <= 500")
def pairs_selector(spark: SparkSession, sf: str) -> DataFrame:
    return suppliers(spark, sf).create_edges(gap, close).e


@query(f"""SELECT a.s_suppkey AS s, b.s_suppkey AS t, round(b.s_acctbal - a.s_acctbal, 2) AS gap, round(round(b.s_acctbal - a.s_acctbal, 2) * 2, 2) AS double_gap,
  a.s_nationkey = b.s_nationkey AS same_nation {_TRIANGLE} WHERE round(b.s_acctbal - a.s_acctbal, 2) BETWEEN 0 AND 500""")
def pairs_two_selectors(spark: SparkSession, sf: str) -> DataFrame:
    return suppliers(spark, sf).create_edges([gap, double_gap], [close, same_nation]).e


@query(f"""SELECT a.s_suppkey AS s, b.s_suppkey AS t, a.s_nationkey AS s_nationkey_s, b.s_nationkey AS s_nationkey_t, a.s_acctbal AS s_acctbal_s,
  b.s_acctbal AS s_acctbal_t {_TRIANGLE} WHERE abs(round(b.s_acctbal - a.s_acctbal, 2)) <= 500""")
def pairs_transfer(spark: SparkSession, sf: str) -> DataFrame:
    return suppliers(spark, sf).create_edges(gap, close, transfer_features=["s_nationkey", "s_acctbal"], no_transfer_rs="gap").e


@query(f"SELECT a.s_suppkey AS s, b.s_suppkey AS t, CAST(trunc(round(b.s_acctbal - a.s_acctbal, 2)) AS INT) AS gap {_TRIANGLE}")
def pairs_cast(spark: SparkSession, sf: str) -> DataFrame:
    return suppliers(spark, sf).create_edges(gap, r_dtype_dic={"gap": "int32"}).e


@query(f"SELECT a.s_suppkey AS s, b.s_suppkey AS t, round(b.s_acctbal - a.s_acctbal, 2) AS gap {_TRIANGLE} AND a.s_nationkey = b.s_nationkey")
def pairs_on_key(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that meet by an equal feature: a hash join instead of all pairs."""
    return suppliers(spark, sf).create_edges(gap, on="s_nationkey").e


@query(f"SELECT a.s_suppkey AS s, b.s_suppkey AS t, b.s_acctbal - a.s_acctbal AS span {_TRIANGLE} WHERE abs(b.s_acctbal - a.s_acctbal) <= 500")
def pairs_vectorized(spark: SparkSession, sf: str) -> DataFrame:
    """Connector and selector over numpy arrays, the selector keeping sources and targets by indexing."""

    @connector(outputs=["span"], vectorized=True)
    def span(s_acctbal_s, s_acctbal_t):
        return s_acctbal_t - s_acctbal_s

    def near(span, sources, targets):
        keep = abs(span) <= 500
        sources, targets = sources[keep], targets[keep]
        return sources, targets

    return suppliers(spark, sf).create_edges(span, near).e


@query(SQL["pairs_selector"])
def pairs_chunked(spark: SparkSession, sf: str) -> DataFrame:
    """The same pairs with a chunk size asked for: Spark's partitions are the chunks, so it changes nothing."""
    return suppliers(spark, sf).create_edges(gap, close, step_size=1000).e


# --- bands ---

_EVENTS = "SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events"


@query(f"""SELECT a.event_id AS s, b.event_id AS t, (epoch_us(b.ts) - epoch_us(a.ts)) / 60000000.0 AS ft_r FROM ({_EVENTS}) a JOIN ({_EVENTS}) b
  ON a.pos < b.pos AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 10 MINUTE""")
def band_ts(spark: SparkSession, sf: str) -> DataFrame:
    """Events at most ten minutes apart."""
    return events(spark, sf).create_edges_ft(("ts", 10, "m")).e


@query(f"""SELECT a.event_id AS s, b.event_id AS t, (epoch_us(b.ts) - epoch_us(a.ts)) / 86400000000.0 AS ft_r, round(b.value - a.value, 2) AS rise FROM ({_EVENTS}) a JOIN ({_EVENTS}) b
  ON a.user_id = b.user_id AND a.pos < b.pos AND b.ts <= a.ts + INTERVAL 1 DAY""")
def band_ts_same_user(spark: SparkSession, sf: str) -> DataFrame:
    @connector(outputs=["rise"])
    def rise(value_s, value_t):
        return F.round(value_t - value_s, 2)

    return events(spark, sf).create_edges_ft(("ts", 1, "D"), rise, on="user_id").e


@query(SQL["band_ts"])
def band_ts_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """The same, with a check that the row order is that of the times, and with chunk sizes, which change nothing."""
    return events(spark, sf).create_edges_ft(("ts", 10, "m"), require_sorted=True, max_pairs=100, min_chunk_size=10).e


@query(f"""SELECT a.event_id AS s, b.event_id AS t, (epoch_us(b.ts) - epoch_us(a.ts)) * 1000 AS ft_r FROM ({_EVENTS}) a JOIN ({_EVENTS}) b
  ON a.pos < b.pos AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 10 MINUTE""")
def band_bigint(spark: SparkSession, sf: str) -> DataFrame:
    """The same in nanoseconds as whole numbers, which doubles can't tell apart."""
    v = _table(spark, sf, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ns"))
    return Graph(v, node_id="event_id", order_by="ns").create_edges_ft(("ns", 600_000_000_000)).e


@query(f"""SELECT 'create_edges_ft' AS step, count(*) AS pairs, count(*) FILTER (a.event_type = b.event_type) AS edges FROM ({_EVENTS}) a JOIN ({_EVENTS}) b
  ON a.pos < b.pos AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 10 MINUTE
  UNION ALL SELECT 'create_edges', count(*), count(*) FILTER (abs(round(b.s_acctbal - a.s_acctbal, 2)) <= 500) FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey""")
def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """What two runs wrote to their log: pairs met and edges kept."""

    @selector()
    def same_type(event_type_s, event_type_t):
        return event_type_s == event_type_t

    at = scratch_path(spark, "log")
    suppliers(spark, sf).create_edges(gap, close, logfile=at)
    events(spark, sf).create_edges_ft(("ts", 10, "m"), selectors=same_type, logfile=at)
    return read_log(spark, at).select("step", "pairs", "edges")


_PARTS = "SELECT *, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS pos FROM part"


@query(f"SELECT a.p_partkey AS s, b.p_partkey AS t, b.p_retailprice - a.p_retailprice AS ft_r FROM ({_PARTS}) a JOIN ({_PARTS}) b ON a.pos < b.pos AND b.p_retailprice <= a.p_retailprice + 1 AND b.p_retailprice - a.p_retailprice <= 0.5")
def band_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return Graph(_table(spark, sf, "part"), node_id="p_partkey").create_edges_ft(("p_retailprice", 0.5)).e


@query(f"""SELECT a.p_partkey AS s, b.p_partkey AS t, b.p_retailprice - a.p_retailprice AS ft_r FROM ({_PARTS}) a JOIN ({_PARTS}) b ON a.pos < b.pos
  AND b.p_retailprice <= a.p_retailprice + 1 AND b.p_retailprice - a.p_retailprice <= 0.5 WHERE a.pos >= 50 AND a.pos < 150""")
def band_range(spark: SparkSession, sf: str) -> DataFrame:
    """The same for source nodes 50 to 149."""
    return Graph(_table(spark, sf, "part"), node_id="p_partkey").create_edges_ft(("p_retailprice", 0.5), from_pos=50, to_pos=150).e


@query(f"""SELECT a.event_id AS s, b.event_id AS t, (epoch_us(b.ts) - epoch_us(a.ts)) / 3600000000.0 AS ft_r,
  CASE WHEN epoch_us(b.ts) > epoch_us(a.ts) THEN (b.value - a.value) / ((epoch_us(b.ts) - epoch_us(a.ts)) / 3600000000.0) END AS slope, a.event_type AS event_type_s, b.event_type AS event_type_t
  FROM ({_EVENTS}) a JOIN ({_EVENTS}) b ON a.pos < b.pos AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR AND a.event_type = 'purchase' AND b.event_type = 'error'""")
def band_selector(spark: SparkSession, sf: str) -> DataFrame:
    """Errors within two hours after a purchase, with a relation that needs the distance in time."""

    @connector(outputs=["slope"])
    def slope(value_s, value_t, ft_r):
        return F.try_divide(value_t - value_s, ft_r)

    @selector()
    def error_after_purchase(event_type_s, event_type_t):
        return (event_type_s == "purchase") & (event_type_t == "error")

    return events(spark, sf).create_edges_ft(("ts", 2, "h"), slope, [error_after_purchase, "ft_selector"], transfer_features="event_type").e


_RAIN = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY arrived) AS k FROM rain_nodes) WHERE k = 1)"""


@query(f"""SELECT a.node_id AS s, b.node_id AS t, b.time - a.time AS ft_r FROM {_RAIN} a JOIN {_RAIN} b ON a.g_id = b.g_id AND b.time - a.time BETWEEN 0 AND 1
  AND (a.time, a.node_id) < (b.time, b.node_id)""")
def rain_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive readings of one cell: the band join with an equal key, on data where one cell holds a tenth of the rows."""
    return rain(spark, sf).create_edges_ft(("time", 1), on="g_id").e


def rain(spark: SparkSession, sf: str) -> Graph:
    """Rain nodes, of redelivered rows the one that arrived first."""
    nodes = _table(spark, sf, "rain_nodes")
    first = nodes.groupBy("node_id").agg(F.min(F.struct("arrived", *[c for c in nodes.columns if c not in ("node_id", "arrived")])).alias("x"))
    return Graph(first.select("node_id", "x.*"), node_id="node_id", order_by="time")


# --- partitions ---


@query("SELECT c_mktsegment, count(*) AS n_nodes FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1")
def partition_nodes_1(spark: SparkSession, sf: str) -> DataFrame:
    return Graph(_table(spark, sf, "customer"), node_id="c_custkey").partition_nodes("c_mktsegment")


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n_nodes, max(c_acctbal) AS c_acctbal FROM customer WHERE c_mktsegment IS NOT NULL AND c_nationkey IS NOT NULL GROUP BY 1, 2")
def partition_nodes_2keys(spark: SparkSession, sf: str) -> DataFrame:
    return Graph(_table(spark, sf, "customer"), node_id="c_custkey").partition_nodes(["c_mktsegment", "c_nationkey"], {"c_acctbal": "max"})


@query("""SELECT c_mktsegment, count(*) AS n_nodes, round(coalesce(sum(c_acctbal), 0), 2) AS c_acctbal_sum, round(avg(c_acctbal), 6) AS c_acctbal_mean, round(stddev_samp(c_acctbal), 6) AS c_acctbal_std,
  count(c_acctbal) AS c_acctbal_count, min(c_acctbal) AS c_acctbal_min, count(DISTINCT c_nationkey) AS c_nationkey_nunique, round(quantile_cont(c_acctbal, 0.5), 6) AS c_acctbal_median
  FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1""")
def partition_nodes_aggs(spark: SparkSession, sf: str) -> DataFrame:
    out = Graph(_table(spark, sf, "customer"), node_id="c_custkey").partition_nodes("c_mktsegment", {"c_acctbal": ["sum", "mean", "std", "count", "min", "median"], "c_nationkey": "nunique"})
    return out.withColumns({"c_acctbal_sum": F.round("c_acctbal_sum", 2), **{c: F.round(c, 6) for c in ("c_acctbal_mean", "c_acctbal_std", "c_acctbal_median")}})


@query("SELECT layer, color, count(*) AS n_nodes, CAST(coalesce(sum(size), 0) AS BIGINT) AS size_sum, list(time ORDER BY v_n, time) AS time_list FROM (SELECT DISTINCT v_n, layer, x, y, time, color, size FROM layer_nodes) WHERE color IS NOT NULL AND layer IS NOT NULL GROUP BY 1, 2")
def partition_nodes_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Values of a group as a list in row order: each list is as long as its group of layer and color."""
    nodes = _table(spark, sf, "layer_nodes").distinct()
    return Graph(nodes, node_id="v_n", order_by=["v_n", "layer", "time"]).partition_nodes(["layer", "color"], {"size": ["sum"], "time": ["list"]})


@query("""SELECT n_regionkey, count(*) AS n_nodes, string_agg(n_name, '' ORDER BY n_nationkey) AS n_name_sum, list_sort(list(DISTINCT n_name)) AS n_name_set, list(n_name ORDER BY n_nationkey) AS n_name_tuple,
  round(quantile_cont(n_nationkey, 0.9), 6) AS "n_nationkey_q0.9", max(n_nationkey) - min(n_nationkey) AS n_nationkey_reach FROM nation GROUP BY 1""")
def partition_nodes_collected(spark: SparkSession, sf: str) -> DataFrame:
    """Joined strings, sets, tuples, a quantile and an aggregate of the caller's own."""

    def reach(c: Column) -> Column:
        return F.max(c) - F.min(c)

    g = Graph(_table(spark, sf, "nation"), node_id="n_nationkey")
    out = g.partition_nodes("n_regionkey", {"n_name": ["sum", "set", "tuple"], "n_nationkey": ["q0.9", reach]})
    return out.withColumn("n_nationkey_q0.9", F.round("`n_nationkey_q0.9`", 6))


@query("""SELECT c_mktsegment, c_nationkey, count(*) AS n, round(max(c_acctbal) - min(c_acctbal), 2) AS reach FROM customer WHERE c_mktsegment IS NOT NULL AND c_nationkey IS NOT NULL GROUP BY 1, 2""")
def partition_apply(spark: SparkSession, sf: str) -> DataFrame:
    """A function of the caller's over each group, by the handle the partition returns: a group must fit a task there, unlike with aggregates."""

    def spread(frame):  # noqa: ANN001, ANN202
        x = frame["c_acctbal"]
        return frame.head(1)[["c_mktsegment", "c_nationkey"]].assign(n=len(x), reach=round(x.max() - x.min(), 2))

    g = Graph(_table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal"), node_id="c_custkey")
    _, groups = g.partition_nodes(["c_mktsegment", "c_nationkey"], return_gv=True)
    return groups.applyInPandas(spread, "c_mktsegment string, c_nationkey int, n bigint, reach double")


@query("SELECT p_brand, p_size, count(*) AS n_nodes FROM part WHERE p_brand IS NOT NULL AND p_size IS NOT NULL GROUP BY 1, 2 ORDER BY 1, 2")
def partition_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """Groups in the order of their keys."""
    return Graph(_table(spark, sf, "part"), node_id="p_partkey").partition_nodes(["p_brand", "p_size"], sort=True)


@query("""SELECT c_nationkey, c_mktsegment, count(*) AS n_nodes, round(coalesce(sum(c_acctbal), 0), 2) AS c_acctbal,
  2 - (grouping(c_nationkey) + grouping(c_mktsegment)) AS level FROM customer WHERE c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL GROUP BY ROLLUP (c_nationkey, c_mktsegment)""")
def partition_rollup(spark: SparkSession, sf: str) -> DataFrame:
    out = Graph(_table(spark, sf, "customer"), node_id="c_custkey").partition_rollup(["c_nationkey", "c_mktsegment"], {"c_acctbal": "sum"})
    return out.withColumns({"c_acctbal": F.round("c_acctbal", 2), "level": F.col("level").cast("bigint")})


@query(f"{_VE} SELECT returned, count(*) AS n_edges, round(sum(value), 2) AS value, CAST(sum(n_items) AS BIGINT) AS n_items FROM e GROUP BY 1")
def partition_edges_rel(spark: SparkSession, sf: str) -> DataFrame:
    return trade(spark, sf).partition_edges("returned", relation_funcs={"value": "sum", "n_items": "sum"}).withColumn("value", F.round("value", 2))


@query(f"{_VE} SELECT a.segment AS segment_s, count(*) AS n_edges, CAST(sum(CAST(returned AS INT)) AS BIGINT) AS returned FROM e JOIN v a ON a.id = s WHERE a.segment IS NOT NULL GROUP BY 1")
def partition_edges_src(spark: SparkSession, sf: str) -> DataFrame:
    return trade(spark, sf).partition_edges(source_features="segment", relation_funcs={"returned": "sum"})


@query(f"{_VE} SELECT b.nation AS nation_t, count(*) AS n_edges, max(n_items) AS n_items FROM e JOIN v b ON b.id = t GROUP BY 1")
def partition_edges_tgt(spark: SparkSession, sf: str) -> DataFrame:
    return trade(spark, sf).partition_edges(target_features="nation", relation_funcs={"n_items": "max"})


@query(f"""{_VE} SELECT returned, a.segment AS segment_s, b.nation AS nation_t, count(*) AS n_edges, round(avg(value), 4) AS value_mean, max(value) AS value_max
  FROM e JOIN v a ON a.id = s JOIN v b ON b.id = t WHERE a.segment IS NOT NULL GROUP BY 1, 2, 3""")
def partition_edges_mixed(spark: SparkSession, sf: str) -> DataFrame:
    out = trade(spark, sf).partition_edges("returned", "segment", "nation", {"value": ["mean", "max"]})
    return out.withColumn("value_mean", F.round("value_mean", 4))


@query(f"WITH {_V} SELECT kind, nation, count(*) AS n_nodes, round(coalesce(sum(balance), 0), 2) AS balance FROM v GROUP BY 1, 2")
def partition_graph_v(spark: SparkSession, sf: str) -> DataFrame:
    sv, _ = trade(spark, sf).partition_graph(["kind", "nation"], {"balance": "sum"}, {"value": "sum"})
    return sv.withColumn("balance", F.round("balance", 2))


@query(f"""{_VE} SELECT a.kind AS kind_s, a.nation AS nation_s, b.kind AS kind_t, b.nation AS nation_t, count(*) AS n_edges, round(sum(value), 2) AS value
  FROM e JOIN v a ON a.id = s JOIN v b ON b.id = t GROUP BY 1, 2, 3, 4""")
def partition_graph_e(spark: SparkSession, sf: str) -> DataFrame:
    _, se = trade(spark, sf).partition_graph(["kind", "nation"], {"balance": "sum"}, {"value": "sum"})
    return se.withColumn("value", F.round("value", 2))


@query(f"""{_VE}, se AS (SELECT a.nation AS ns, b.nation AS nt FROM e JOIN v a ON a.id = s JOIN v b ON b.id = t GROUP BY 1, 2)
  SELECT nation, count(*) AS n_out FROM (SELECT ns AS nation FROM se) GROUP BY 1""")
def super_graph_degree(spark: SparkSession, sf: str) -> DataFrame:
    """Super nodes and super edges as a graph of their own, and the out-degree in it."""
    deg = trade(spark, sf).super_graph("nation").degrees().where("out_degree > 0")
    return deg.select(F.col("id.nation").alias("nation"), F.col("out_degree").alias("n_out"))


# --- filters ---


@query(f"{_VE} SELECT e.s, e.t, n_items FROM e JOIN v a ON a.id = s JOIN v b ON b.id = t WHERE a.balance BETWEEN 0 AND 5000 AND b.balance BETWEEN 0 AND 5000")
def filter_interval_v(spark: SparkSession, sf: str) -> DataFrame:
    return trade(spark, sf).filter_by_interval_v("balance", (0, 5000)).e.select("s", "t", "n_items")


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 20")
def filter_interval_halfopen(spark: SparkSession, sf: str) -> DataFrame:
    return Graph(_table(spark, sf, "part"), node_id="p_partkey").filter_by_interval_v("p_size", (10, 20), endpoint=False).v.select("p_partkey", "p_size")


@query(f"{_VE} SELECT e.s, e.t FROM e JOIN v a ON a.id = s JOIN v b ON b.id = t WHERE a.nation IN (1, 5, 7) AND b.nation IN (1, 5, 7)")
def filter_values_v(spark: SparkSession, sf: str) -> DataFrame:
    return trade(spark, sf).filter_by_values_v("nation", [1, 5, 7]).e.select("s", "t")


@query("SELECT v_n, layer, color FROM layer_nodes WHERE color = 'r' OR color IS NULL")
def filter_values_null(spark: SparkSession, sf: str) -> DataFrame:
    """None among the values keeps unknown cells."""
    return Graph(_table(spark, sf, "layer_nodes"), node_id="v_n").filter_by_values_v("color", ["r", None]).v.select("v_n", "layer", "color")


@query(f"{_VE} SELECT s, t, value FROM e WHERE value BETWEEN 10000 AND 20000")
def filter_interval_e(spark: SparkSession, sf: str) -> DataFrame:
    return trade(spark, sf).filter_by_interval_e("value", (10000, 20000)).e.select("s", "t", "value")


@query(f"{_VE} SELECT s, t, n_items FROM e WHERE n_items IN (2, 3)")
def filter_values_e(spark: SparkSession, sf: str) -> DataFrame:
    return trade(spark, sf).filter_by_values_e("n_items", [2, 3]).e.select("s", "t", "n_items")


@query("SELECT s, t, type, weight FROM (SELECT s, t, type, CASE WHEN NOT isnan(weight) THEN weight END AS weight FROM layer_edges) WHERE s IN (SELECT v_n FROM layer_nodes) AND t IN (SELECT v_n FROM layer_nodes)")
def update_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges whose ends are both known nodes."""
    return Graph(_table(spark, sf, "layer_nodes"), _table(spark, sf, "layer_edges"), node_id="v_n").update_edges().e.select("s", "t", "type", "weight")


@query("""WITH q AS (SELECT p_brand, quantile_cont(p_retailprice, 0.9) AS lim FROM part GROUP BY 1)
  SELECT p_partkey, p_brand FROM part JOIN q USING (p_brand) WHERE p_retailprice >= lim""")
def filter_group_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return Graph(_table(spark, sf, "part"), node_id="p_partkey").filter_by_group_quantile_v("p_brand", "p_retailprice", 0.9).v.select("p_partkey", "p_brand")


# --- labels ---


@query("SELECT p_partkey, CAST(len(list_filter([900.0, 1000, 1200, 1500], lambda x: x <= p_retailprice)) AS BIGINT) AS price_bin FROM part")
def bin_edges_given(spark: SparkSession, sf: str) -> DataFrame:
    return Graph(_table(spark, sf, "part"), node_id="p_partkey").append_binning_labels_v("p_retailprice", "price_bin", [900, 1000, 1200, 1500]).v.select("p_partkey", "price_bin")


@query("""WITH m AS (SELECT min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi FROM part), g AS (SELECT list(CASE WHEN k = 9 THEN hi ELSE lo + k * ((hi - lo) / 9) END ORDER BY k) AS edges FROM m, range(10) t(k))
  SELECT p_partkey, CAST(len(list_filter(edges, lambda x: x <= p_size)) AS BIGINT) AS size_bin FROM part, g""")
def bin_linear(spark: SparkSession, sf: str) -> DataFrame:
    return Graph(_table(spark, sf, "part"), node_id="p_partkey").append_binning_labels_v("p_size", "size_bin", 10).v.select("p_partkey", "size_bin")


@query("""WITH m AS (SELECT log10(min(p_size)) AS lo, log10(max(p_size)) AS hi, max(p_size) AS top FROM part), c AS (SELECT *, CAST(ceil((hi - lo) * 5) AS INT) AS n FROM m),
  g AS (SELECT list(CASE WHEN k = n - 1 THEN top ELSE 10 ** (lo + k * ((hi - lo) / (n - 1))) END ORDER BY k) AS edges FROM c, range(20) t(k) WHERE k < n)
  SELECT p_partkey, CAST(len(list_filter(edges, lambda x: x <= p_size)) AS BIGINT) AS size_bin FROM part, g""")
def bin_log(spark: SparkSession, sf: str) -> DataFrame:
    """Logarithmic bins: 5 edges per factor of ten."""
    return Graph(_table(spark, sf, "part"), node_id="p_partkey").append_binning_labels_v("p_size", "size_bin", log_bins=5).v.select("p_partkey", "size_bin")


@query("""WITH m AS (SELECT min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi FROM part),
  g AS (SELECT list_concat(list_sort(list(DISTINCT floor(lo + k * ((hi - lo) / 6)))), []) AS edges FROM m, range(7) t(k))
  SELECT p_partkey, CAST(len(list_filter(edges, lambda x: x <= p_size)) AS BIGINT) AS size_bin FROM part, g""")
def bin_floor(spark: SparkSession, sf: str) -> DataFrame:
    return Graph(_table(spark, sf, "part"), node_id="p_partkey").append_binning_labels_v("p_size", "size_bin", 7, floor=True).v.select("p_partkey", "size_bin")


@query("""WITH g AS (SELECT unnest([1, 2, 3, 4]) AS bin, unnest([0.0, 10, 20, 30]) AS "left", unnest([10.0, 20, 30, 50]) AS "right")
  SELECT CAST(bin AS BIGINT) AS bin, CAST("left" AS DOUBLE) AS "left", CAST("right" AS DOUBLE) AS "right", CAST(("left" + "right") / 2 AS DOUBLE) AS center, nullif(count(l_quantity), 0) AS count
  FROM g LEFT JOIN lineitem ON l_quantity >= "left" AND (l_quantity < "right" OR ("right" = 50 AND l_quantity = 50)) GROUP BY ALL""")
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return Graph.plot_hist(_table(spark, sf, "lineitem"), "l_quantity", [0, 10, 20, 30, 50])


@query("""WITH g AS (SELECT unnest([1, 2, 3, 4]) AS bin, unnest([0.0, 10, 20, 30]) AS "left", unnest([10.0, 20, 30, 50]) AS "right"), n AS (SELECT count(l_quantity) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50)
  SELECT CAST(bin AS BIGINT) AS bin, CAST("left" AS DOUBLE) AS "left", CAST("right" AS DOUBLE) AS "right", round(CAST(nullif(count(l_quantity), 0) AS DOUBLE) / any_value(n) / ("right" - "left"), 9) AS count
  FROM g LEFT JOIN lineitem ON l_quantity >= "left" AND (l_quantity < "right" OR ("right" = 50 AND l_quantity = 50)), n GROUP BY 1, g."left", g."right" """)
def histogram_density(spark: SparkSession, sf: str) -> DataFrame:
    out = Graph.plot_hist(_table(spark, sf, "lineitem"), "l_quantity", [0, 10, 20, 30, 50], density=True)
    return out.select("bin", "left", "right", F.round("count", 9).alias("count"))


@query("""WITH m AS (SELECT log10(min(l_quantity)) AS lo, log10(max(l_quantity)) AS hi, max(l_quantity) AS top FROM lineitem), c AS (SELECT *, CAST(ceil((hi - lo) * 4) AS INT) AS n FROM m),
  e AS (SELECT k, CASE WHEN k = n - 1 THEN top ELSE 10 ** (lo + k * ((hi - lo) / (n - 1))) END AS x, n FROM c, range(20) t(k) WHERE k < n),
  b AS (SELECT a.k + 1 AS bin, a.x AS l, b.x AS r, a.k = a.n - 2 AS final FROM e a JOIN e b ON b.k = a.k + 1)
  SELECT bin, round(l, 9) AS "left", round(r, 9) AS "right", nullif(count(l_quantity), 0) AS count FROM b LEFT JOIN lineitem ON l_quantity >= l AND (l_quantity < r OR (final AND l_quantity <= r)) GROUP BY 1, 2, 3""")
def histogram_log(spark: SparkSession, sf: str) -> DataFrame:
    """Logarithmic bins, 4 edges per factor of ten."""
    out = Graph.plot_hist(_table(spark, sf, "lineitem"), "l_quantity", log_bins=4)
    return out.select("bin", F.round("left", 9).alias("left"), F.round("right", 9).alias("right"), "count")


@query("SELECT event_id, CAST(hour(ts) // 6 AS TINYINT) AS part_of_day FROM events")
def time_of_day(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).append_datetime_categories_v("ts", timeofday="part_of_day").v.select("event_id", "part_of_day")


@query("SELECT o_orderkey, CAST((month(o_orderdate) % 12) // 3 AS TINYINT) AS season FROM orders")
def met_season(spark: SparkSession, sf: str) -> DataFrame:
    return Graph(_table(spark, sf, "orders"), node_id="o_orderkey").append_datetime_categories_v("o_orderdate", met_season="season").v.select("o_orderkey", "season")


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand, p_size) - 1 AS label FROM part")
def super_labels(spark: SparkSession, sf: str) -> DataFrame:
    return Graph(_table(spark, sf, "part"), node_id="p_partkey", supernode_labels_by={"label": ["p_brand", "p_size"]}).v.select("p_partkey", "label")


# --- components ---

_CLOSE = "SELECT a.s_suppkey AS s, b.s_suppkey AS t FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND abs(round(b.s_acctbal - a.s_acctbal, 2)) <= 4"
_LINKED = "SELECT s, t FROM layer_edges WHERE s IN (SELECT v_n FROM layer_nodes) AND t IN (SELECT v_n FROM layer_nodes)"


def _reach(links: str, nodes: str) -> str:
    """Components in SQL: g (id, root), the root being the least node reached, and z (root, n)."""
    return f"""WITH RECURSIVE l AS ({links}), d AS (SELECT s, t FROM l UNION SELECT t, s FROM l), r(id, seen) AS (SELECT id, id FROM ({nodes}) UNION SELECT r.id, d.t FROM r JOIN d ON d.s = r.seen),
      g AS (SELECT id, min(seen) AS root FROM r GROUP BY id), z AS (SELECT root, count(*) AS n FROM g GROUP BY root)"""


_LAYERED = _reach(_LINKED, "SELECT DISTINCT v_n AS id FROM layer_nodes")


@query(f"{_reach(_CLOSE, 'SELECT s_suppkey AS id FROM supplier')} SELECT id AS s_suppkey, dense_rank() OVER (ORDER BY n DESC, root) - 1 AS cp FROM g JOIN z USING (root)")
def components_of_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers whose balances are within four of each other, in a chain: components of selected pairs."""

    @selector()
    def within_four(gap):
        return F.abs(gap) <= 4

    return suppliers(spark, sf).create_edges(gap, within_four).append_cp().v.select("s_suppkey", "cp")


def layers(spark: SparkSession, sf: str) -> Graph:
    """All nodes of the layers, each once, and the layer edges between them."""
    return Graph(_table(spark, sf, "layer_nodes").select("v_n").distinct(), _table(spark, sf, "layer_edges").select("s", "t"), node_id="v_n").update_edges()


@query(f"{_LAYERED} SELECT id AS v_n, dense_rank() OVER (ORDER BY n DESC, root) - 1 AS cp FROM g JOIN z USING (root)")
def components(spark: SparkSession, sf: str) -> DataFrame:
    return layers(spark, sf).append_cp().v.select("v_n", "cp")


@query(f"{_LAYERED} SELECT id AS v_n, CASE WHEN n = 1 THEN 0 ELSE dense_rank() OVER (ORDER BY CASE WHEN n > 1 THEN n ELSE 0 END DESC, CASE WHEN n > 1 THEN root END) END AS cp FROM g JOIN z USING (root)")
def components_singles(spark: SparkSession, sf: str) -> DataFrame:
    return layers(spark, sf).append_cp(consolidate_singles=True).v.select("v_n", "cp")


@query(f"{_LAYERED} SELECT dense_rank() OVER (ORDER BY n DESC, root) - 1 AS cp, n AS n_nodes FROM z ORDER BY n DESC, root LIMIT 5")
def components_top(spark: SparkSession, sf: str) -> DataFrame:
    """The five largest components: labels are ranks, so the top is an interval of them."""
    return layers(spark, sf).append_cp().filter_by_interval_v("cp", (0, 5), endpoint=False).partition_nodes("cp")


@query(f"""WITH RECURSIVE d AS (SELECT DISTINCT s, t FROM ({_LINKED}) WHERE s <> t), n AS (SELECT DISTINCT v_n AS id FROM layer_nodes), r(a, b) AS (SELECT id, id FROM n UNION SELECT r.a, d.t FROM r JOIN d ON d.s = r.b),
  g AS (SELECT x.a AS id, min(x.b) AS root FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1), z AS (SELECT root, count(*) AS n FROM g GROUP BY root)
  SELECT id AS v_n, dense_rank() OVER (ORDER BY n DESC, root) - 1 AS cp FROM g JOIN z USING (root)""")
def strong_components(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes that reach each other along the direction of the layer edges."""
    return layers(spark, sf).append_cp(directed=True, connection="strong").v.select("v_n", "cp")


@query(f"{_VE} SELECT v.id, count(e.s) AS degree FROM v LEFT JOIN (SELECT s, s AS id FROM e UNION ALL SELECT s, t FROM e) e USING (id) GROUP BY 1")
def degree(spark: SparkSession, sf: str) -> DataFrame:
    return trade(spark, sf).degrees().select("id", "degree")


# --- functions of pairs ---

MIN_CORR = 0.45


@query("""WITH w AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: (x - list_avg(CAST(embedding AS DOUBLE[]))) / list_stddev_pop(CAST(embedding AS DOUBLE[]))) AS z FROM embeddings)
  SELECT a.vec_id AS s, b.vec_id AS t, round(list_dot_product(a.z, b.z) / 64, 6) AS corr FROM w a JOIN w b ON a.vec_id < b.vec_id WHERE abs(list_dot_product(a.z, b.z) / 64) >= 0.45""")
def pearson_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of vectors correlated by at least 0.45 in size."""
    v = _table(spark, sf, "embeddings").select("vec_id", whiten(F.col("embedding")).alias("z"))

    @connector(outputs=["corr"])
    def corr(z_s, z_t):
        return dot(z_s, z_t) / F.size(z_s)

    @selector()
    def strong(corr):
        return F.abs(corr) >= MIN_CORR

    return Graph(v, node_id="vec_id").create_edges(corr, strong).e.withColumn("corr", F.round("corr", 6))


@query(SQL["pearson_pairs"])
def pearson_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The same pairs by blocks of matrix products."""
    v = Graph(_table(spark, sf, "embeddings").select("vec_id", "embedding"), node_id="vec_id")
    return v.create_correlation_edges("embedding", MIN_CORR).e.withColumn("corr", F.round("corr", 6))


@query("""WITH x AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
  k AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY x, i) - 1.0 AS k FROM x),
  w AS (SELECT vec_id, list((k - 31.5) / sqrt((64 * 64 - 1) / 12.0) ORDER BY i) AS z FROM k GROUP BY vec_id)
  SELECT a.vec_id AS s, b.vec_id AS t, round(list_dot_product(a.z, b.z) / 64, 6) AS corr FROM w a JOIN w b ON a.vec_id < b.vec_id WHERE abs(list_dot_product(a.z, b.z) / 64) >= 0.45""")
def spearman_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The same for ranks, ties in order of place."""
    v = Graph(_table(spark, sf, "embeddings").select("vec_id", "embedding"), node_id="vec_id")
    return v.create_correlation_edges("embedding", MIN_CORR, method="spearman").e.withColumn("corr", F.round("corr", 6))


_KM = """6371 * acos(greatest(-1, least(1, sin(radians(lat_s::DOUBLE)) * sin(radians(lat_t::DOUBLE))
  + cos(radians(lat_s::DOUBLE)) * cos(radians(lat_t::DOUBLE)) * cos(radians(lon_s::DOUBLE) - radians(lon_t::DOUBLE)))))"""


@query(f"""SELECT layer, count(*) AS n, round(sum(km), 3) AS km FROM (SELECT DISTINCT edge_id, layer,
  CASE WHEN isnan(lat_s) OR isnan(lat_t) OR isnan(lon_s) OR isnan(lon_t) THEN 0 ELSE coalesce(round({_KM}, 3), 0) END AS km FROM flow_edges) GROUP BY layer""")
def great_circle(spark: SparkSession, sf: str) -> DataFrame:
    """Summed length of the flow edges of each layer, each edge once; unknown places count 0."""
    km = F.round(great_circle_dist(F.col("lat_s"), F.col("lat_t"), F.col("lon_s"), F.col("lon_t")), 3)
    e = _table(spark, sf, "flow_edges").select("edge_id", "layer", km.alias("km")).distinct()
    return e.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("km"), 3).alias("km"))


@query("""WITH i AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_suppkey IS NOT NULL), n AS (SELECT s, count(p) AS n FROM i GROUP BY s),
  k AS (SELECT a.s, b.s AS t, count(*) AS k FROM i a JOIN i b ON a.p = b.p AND a.s < b.s GROUP BY 1, 2)
  SELECT a.s, b.s AS t, CAST(coalesce(k, 0) AS INT) AS intsec_card, CASE WHEN least(a.n, b.n) > 0 THEN CAST(coalesce(k, 0) AS DOUBLE) / least(a.n, b.n) END AS intsec_strength,
  coalesce(k, 0) = a.n AND a.n = b.n AS same FROM n a JOIN n b ON a.s < b.s LEFT JOIN k ON k.s = a.s AND k.t = b.s""")
def set_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap of the part sets of every pair of suppliers, those with no common part included."""
    return _overlaps(spark, sf)


def _overlaps(spark: SparkSession, sf: str, met_only: bool = False) -> DataFrame:
    pairs = set_pairs(_table(spark, sf, "lineitem"), "l_suppkey", "l_partkey", met_only)
    strength = cp_intersection_strength(F.col("k"), F.col("n_s"), F.col("n_t"))
    same = (F.col("k") == F.col("n_s")) & (F.col("k") == F.col("n_t"))
    return pairs.select("s", "t", F.col("k").alias("intsec_card"), strength.alias("intsec_strength"), same.alias("same"))


@query()
def linkage_merges(spark: SparkSession, sf: str) -> DataFrame:
    """Nations merged by average linkage over the items they trade: the merges."""
    e = _nation_trade(spark, sf)
    return average_linkage(e, "s", "t", "weight")


@query()
def linkage_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers in ten clusters by average linkage over the overlap of their parts, the largest first."""
    v = suppliers(spark, sf).v.select("s_suppkey")
    g = Graph(v, _overlaps(spark, sf, met_only=True).select("s", "t", "intsec_strength"), node_id="s_suppkey")  # the others share 0, which links nothing
    return g.append_linkage("intsec_strength", at_most=10).v


@query("""WITH c AS (SELECT cp, list_sort(list_distinct(any_value(supernode_ids))) AS cells FROM clusters WHERE supernode_ids IS NOT NULL GROUP BY cp),
  e AS (SELECT DISTINCT least(s, t) AS s, greatest(s, t) AS t FROM superedges WHERE s <> t),
  x AS (SELECT s, t, CAST(len(list_intersect(a.cells, b.cells)) AS INT) AS k, greatest(len(a.cells), len(b.cells)) AS big, least(len(a.cells), len(b.cells)) AS small FROM e JOIN c a ON a.cp = s JOIN c b ON b.cp = t),
  y AS (SELECT *, unnest(range(k + 1, small + 1)) AS j FROM x),
  z AS (SELECT s, t, sum(exp(lgamma(big + 1) - lgamma(j + 1) - lgamma(big - j + 1) + lgamma(12100 - big + 1) - lgamma(small - j + 1) - lgamma(12100 - big - small + j + 1)
    - lgamma(12101) + lgamma(small + 1) + lgamma(12100 - small + 1))) AS p FROM y GROUP BY s, t)
  SELECT x.s, x.t, k AS intsec_card, round(coalesce(p, 0), 7) AS p_value FROM x LEFT JOIN z USING (s, t)""")
def overlap_p_value(spark: SparkSession, sf: str) -> DataFrame:
    """Chance of sharing more cells than two clusters do, for the links on record."""
    c = _table(spark, sf, "clusters").where("supernode_ids is not null").groupBy("cp").agg(F.min(F.array_sort(F.array_distinct(F.filter("supernode_ids", lambda x: x.isNotNull())))).alias("cells"))
    e = _table(spark, sf, "superedges").select(F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t")).where("s <> t").distinct()
    at = e.join(c.select(F.col("cp").alias("s"), F.col("cells").alias("a")), "s").join(c.select(F.col("cp").alias("t"), F.col("cells").alias("b")), "t")
    card = F.size(F.array_intersect("a", "b"))
    return at.select("s", "t", card.alias("intsec_card"), F.round(hypergeometric_p_value(card, F.size("a"), F.size("b"), 110 * 110), 7).alias("p_value"))


# --- exports ---

_POS = f"{_VE}, p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM v)"


@query(f"{_POS} SELECT a.pos AS i, b.pos AS j, TRUE AS value FROM e JOIN p a ON a.id = s JOIN p b ON b.id = t")
def coo(spark: SparkSession, sf: str) -> DataFrame:
    return trade(spark, sf).return_cs_graph()


@query(f"{_POS} SELECT a.pos AS i, b.pos AS j, value FROM e JOIN p a ON a.id = s JOIN p b ON b.id = t WHERE value IS NOT NULL")
def coo_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return trade(spark, sf).return_cs_graph("value")


def _kind(col: str) -> Column:
    """A type without its variants in case and blanks."""
    return F.lower(F.trim(col))


_CELLS = """c AS (SELECT s, t, coalesce(lower(trim(type)), 'unknown') AS relation, max(CASE WHEN NOT isnan(weight) THEN weight END) AS value FROM layer_edges WHERE t IS NOT NULL AND s IS NOT NULL GROUP BY 1, 2, 3)"""
_WIDE = f"{_CELLS}, e AS (SELECT s, t, max(value) FILTER (relation = 'kin') AS kin, max(value) FILTER (relation = 'trade') AS trade FROM c GROUP BY s, t)"


def wide_edges(spark: SparkSession, sf: str) -> Graph:
    """Layer edges with a column for every type that occurs, its variants as one ('unknown' for none): the largest known weight."""
    w = F.col("weight")
    e = _table(spark, sf, "layer_edges").where("s is not null and t is not null").select("s", "t", F.coalesce(_kind("type"), F.lit("unknown")).alias("type"), F.when(~F.isnan(w), w).alias("weight"))
    e = e.groupBy("s", "t").pivot("type").agg(F.max("weight"))
    return Graph(_table(spark, sf, "layer_nodes").select("v_n").distinct(), e, node_id="v_n")


@query(f"WITH {_CELLS} SELECT s, t, relation, value FROM c WHERE value IS NOT NULL")
def multigraph_cells(spark: SparkSession, sf: str) -> DataFrame:
    """An edge for every known cell of every type."""
    return wide_edges(spark, sf).return_nx_multigraph(relations=True)[1]


@query(f"WITH {_WIDE} SELECT s, t, kin, trade FROM e WHERE kin IS NOT NULL AND trade IS NOT NULL")
def row_edges_dropna(spark: SparkSession, sf: str) -> DataFrame:
    return wide_edges(spark, sf).return_nx_graph(relations=["kin", "trade"], dropna="any")[1]


@query(f"WITH {_WIDE} SELECT s, t, kin, trade FROM e WHERE kin IS NOT NULL OR trade IS NOT NULL")
def row_edges_all(spark: SparkSession, sf: str) -> DataFrame:
    return wide_edges(spark, sf).return_nx_graph(relations=["kin", "trade"], dropna="all")[1]


@query(f"{_POS} SELECT a.pos AS i, b.pos AS j, e.s, e.t, value, returned FROM e JOIN p a ON a.id = s JOIN p b ON b.id = t")
def property_edges(spark: SparkSession, sf: str) -> DataFrame:
    return trade(spark, sf).return_gt_graph(relations=["value", "returned"], edge_indices=True)[1]


@query(f"{_POS} SELECT pos AS i, v.id, kind, balance FROM v JOIN p USING (id)")
def property_vertices(spark: SparkSession, sf: str) -> DataFrame:
    return trade(spark, sf).return_gt_graph(features=["kind", "balance"], node_indices=True)[0]


@query("""SELECT unnest(['i', 'id', 'kind', 'balance', 'j', 's', 't', 'value', 'returned']) AS "column", unnest(['int64_t', 'int64_t', 'string', 'double', 'int64_t', 'int64_t', 'int64_t', 'double', 'bool']) AS type""")
def property_types(spark: SparkSession, sf: str) -> DataFrame:
    """The property type of each column of the vertex and the edge table."""
    kinds = trade(spark, sf).return_gt_graph(features=["kind", "balance"], relations=["value", "returned"], node_indices=True, edge_indices=True)[2]
    return spark.createDataFrame(list(kinds.items()), "column string, type string")


@query(f"WITH {_V} SELECT unnest(['kind', 'nation', 'balance', 'segment']) AS \"column\", unnest([count(kind), count(nation), count(balance), count(segment)]) AS n FROM v")
def f_counts(spark: SparkSession, sf: str) -> DataFrame:
    return trade(spark, sf).f


@query("""SELECT unnest(['type', 'weight', 'arrived']) AS "column", unnest([count(type), count(CASE WHEN NOT isnan(weight) THEN 1 END), count(arrived)]) AS n FROM layer_edges""")
def r_counts(spark: SparkSession, sf: str) -> DataFrame:
    return Graph(_table(spark, sf, "layer_nodes"), _table(spark, sf, "layer_edges"), node_id="v_n").r


@query("""SELECT s, t, arrived, CAST(type IS NOT NULL AS INT) + CAST(weight IS NOT NULL AND NOT isnan(weight) AS INT) AS n_known FROM layer_edges""")
def row_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many relations of each edge are known."""
    e = _table(spark, sf, "layer_edges")
    return e.select("s", "t", "arrived", known_cells(e, ["type", "weight"]).alias("n_known"))


# --- tables behind plots ---


@query(f"{_VE} SELECT s, t, a.nation AS xs, a.balance AS ys, b.nation - a.nation AS dx, round(b.balance - a.balance, 2) AS dy, value AS color FROM e JOIN v a ON a.id = s JOIN v b ON b.id = t")
def arrow_frame(spark: SparkSession, sf: str) -> DataFrame:
    return trade(spark, sf).plot_2d("nation", "balance", edges=True, C="value")["arrows"].withColumn("dy", F.round("dy", 2))


@query("""SELECT 'x' AS axis, min(x) - (max(x) - min(x)) * 0.05 AS low, max(x) + (max(x) - min(x)) * 0.05 AS high FROM layer_nodes
  UNION ALL SELECT 'y', min(y) - (max(y) - min(y)) * 0.05, max(y) + (max(y) - min(y)) * 0.05 FROM layer_nodes""")
def plot_limits(spark: SparkSession, sf: str) -> DataFrame:
    return plotdata.axis_limits(_table(spark, sf, "layer_nodes"), ["x", "y"])


@query(f"{_VE} SELECT e.s, e.t, a.balance AS xs, a.nation AS ys, round(b.balance - a.balance, 2) AS dx, b.nation - a.nation AS dy, a.nation AS frame FROM e JOIN v a ON a.id = s JOIN v b ON b.id = t WHERE a.nation = b.nation")
def frame_arrows(spark: SparkSession, sf: str) -> DataFrame:
    """Arrows of every frame of an animation over nations: both ends lie in the frame."""
    g = trade(spark, sf)
    return plotdata.frames(g.v, g.e, "id", "s", "t", "nation", "balance", "nation")[1].withColumn("dx", F.round("dx", 2))


@query(f"""{_VE} SELECT s, t, a.nation AS xs, a.balance AS ys, a.id AS zs, b.nation - a.nation AS dx, round(b.balance - a.balance, 2) AS dy, b.id - a.id AS dz FROM e JOIN v a ON a.id = s JOIN v b ON b.id = t""")
def arrows_3d(spark: SparkSession, sf: str) -> DataFrame:
    g = trade(spark, sf)
    g = g._with(v=g.v.withColumn("height", F.col("id")))
    return g.plot_3d("nation", "balance", "height", edges=True)["arrows"].withColumn("dy", F.round("dy", 2))


@query(f"""{_VE} SELECT 'nation' AS axis, min(nation) - (max(nation) - min(nation)) * 0.05::DOUBLE AS low, max(nation) + (max(nation) - min(nation)) * 0.05::DOUBLE AS high FROM v
  UNION ALL SELECT 'color', min(value), max(value) FROM e""")
def frame_limits(spark: SparkSession, sf: str) -> DataFrame:
    """What all pictures of a series share: the range of the axis and that of the color."""
    return trade(spark, sf).plot_limits("nation", C="value")


@query("SELECT g_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(area AS DOUBLE) - x AS width, CAST(area AS DOUBLE) - y AS height FROM grid_cells")
def rects_numeric(spark: SparkSession, sf: str) -> DataFrame:
    cells = _table(spark, sf, "grid_cells").select("g_id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "area")])
    return Graph(cells, node_id="g_id").plot_rects_numeric_numeric("x", "area", "y", "area")


@query("SELECT dense_rank() OVER (ORDER BY event_type) - 1 AS row, event_type AS label, ts AS time FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL")
def raster_frame(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).plot_raster("event_type", "ts")


@query("SELECT g_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) - 0.6::DOUBLE AS y, CAST(area AS DOUBLE) - x AS width, 1.2::DOUBLE AS height FROM grid_cells")
def rects_frame(spark: SparkSession, sf: str) -> DataFrame:
    cells = _table(spark, sf, "grid_cells").select("g_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("area").cast("double").alias("area"))
    return Graph(cells, node_id="g_id").plot_rects_label_numeric("y", "x", "area").select("g_id", "x", F.col("y"), "width", "height")


# --- stored tables and files ---


def _store(spark: SparkSession, **tables: DataFrame) -> TableStore:
    """A store in the shared folder with the given tables."""
    store = TableStore(spark, scratch_path(spark, "store"))
    for name, df in tables.items():
        store.write(name, df)
    return store


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 5000")
def store_read(spark: SparkSession, sf: str) -> DataFrame:
    """Columns and a filter of a stored table, the only one and so without a name."""
    return _store(spark, nodes=_table(spark, sf, "customer")).read(columns=["c_custkey", "c_mktsegment"], where="c_acctbal > 5000")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 1000 AND 30000")
def store_range(spark: SparkSession, sf: str) -> DataFrame:
    """A range of a table that was sorted as it was stored: few row groups are read."""
    store = _store(spark)
    store.write_sorted("orders", _table(spark, sf, "orders"), ["o_orderkey"], 8)
    return store.read_range("o_orderkey", 1000, 30000, "orders", ["o_orderkey", "o_custkey"])


@query("SELECT 'edges' AS key, count(*) AS n FROM lineitem UNION ALL SELECT 'nodes', 2 * count(*) FROM customer")
def store_append(spark: SparkSession, sf: str) -> DataFrame:
    """Tables by their keys, one of them appended to."""
    store = _store(spark, nodes=_table(spark, sf, "customer"), edges=_table(spark, sf, "lineitem"))
    store.append("nodes", _table(spark, sf, "customer"))
    counts = [store.read(key).agg(F.lit(key).alias("key"), F.count(F.lit(1)).alias("n")) for key in store.keys()]
    return counts[0].unionByName(counts[1])


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier WHERE s_nationkey < 10")
def csv_read(spark: SparkSession, sf: str) -> DataFrame:
    """A text table by its schema, with columns and a filter."""
    path = scratch_path(spark, "supplier") + ".csv"
    _table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal").write.csv(path, header=True)
    return read_table(spark, path, ["s_suppkey", "s_nationkey", "s_acctbal"], "s_nationkey < 10", schema="s_suppkey bigint, s_nationkey int, s_acctbal double")


_NATIONS = """SELECT c_nationkey + 1 AS s, s_nationkey + 1 AS t, CAST(count(*) AS DOUBLE) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"""


def _nation_trade(spark: SparkSession, sf: str) -> DataFrame:
    """(s, t, weight): items sold between nations, numbered from 1 as in Pajek files."""
    g = trade(spark, sf)
    e = g.partition_edges(None, "nation", "nation", {"n_items": "sum"})
    return e.select((F.col("nation_s") + 1).cast("bigint").alias("s"), (F.col("nation_t") + 1).cast("bigint").alias("t"), F.col("n_items").alias("weight"))


def _text(lines: DataFrame) -> str:
    """Lines (k, line) written as one file in order of k."""
    path = scratch_path(lines.sparkSession, "pajek")
    lines.repartition(1).sortWithinPartitions("k").select("line").write.text(path)
    return path


@query(_NATIONS)
def pajek_arcs(spark: SparkSession, sf: str) -> DataFrame:
    """A network written as arcs, read back."""
    body = _nation_trade(spark, sf).select((F.col("s") * 100 + F.col("t")).alias("k"), F.concat_ws(" ", "s", "t", "weight").alias("line"))
    head = spark.createDataFrame([(-3, "*Vertices 25"), (-2, "% items"), (-1, "*Arcs")], "k bigint, line string")
    return read_pajek(spark, _text(head.unionByName(body)))[1].select("s", "t", "weight")


@query(_NATIONS)
def pajek_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The same network written as a matrix, with blank lines and comments between its rows, read back."""
    rows = spark.range(1, 26).withColumnRenamed("id", "s").join(_nation_trade(spark, sf), "s", "left").groupBy("s").agg(F.collect_list(F.struct("t", "weight")).alias("r"))  # at most 25 cells
    at = lambda t: F.coalesce(F.get(F.filter("r", lambda x: x["t"] == t), F.lit(0))["weight"], F.lit(0))
    body = rows.select((F.col("s") * 3).alias("k"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(25)), lambda t: at(t).cast("string")), " ").alias("line"))
    notes = spark.range(1, 26).select((F.col("id") * 3 + 1).alias("k"), F.when(F.col("id") % 2 == 0, "").otherwise("% a note").alias("line"))
    head = spark.createDataFrame([(-2, "*Vertices 25"), (-1, "*Matrix")], "k bigint, line string")
    return read_pajek(spark, _text(head.unionByName(body).unionByName(notes)))[1].select("s", "t", "weight")


# --- recipes that combine them ---


@query("SELECT type, count(*) AS n FROM layer_edges GROUP BY 1")
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "layer_edges").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT s, t, weight FROM layer_edges WHERE weight >= 0 AND NOT isnan(weight) AND t IS NOT NULL AND s IS NOT NULL), a AS (SELECT s, t, sum(weight) AS w FROM d GROUP BY 1, 2)
  SELECT coalesce(x.s, y.t) AS s, coalesce(x.t, y.s) AS t, round(coalesce(x.w, 0) + coalesce(y.w, 0), 6) AS weight FROM a x FULL JOIN a y ON x.s = y.t AND x.t = y.s""")
def undirected_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of both directions added, a missing one counting 0."""
    e = _table(spark, sf, "layer_edges").where("weight >= 0 and not isnan(weight)").select("s", "t", "weight")
    return Graph(_table(spark, sf, "layer_nodes"), e, node_id="v_n").undirected("weight").e.withColumn("weight", F.round("weight", 6))


@query("""WITH c AS (SELECT s, t, lower(trim(type)) AS type, count(*) AS n FROM layer_edges WHERE t IS NOT NULL AND s IS NOT NULL GROUP BY 1, 2, 3)
  SELECT s, t, first(type ORDER BY n DESC, type) FILTER (type IS NOT NULL) AS dominant FROM c GROUP BY 1, 2""")
def dominant_type(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent of all types of each pair, variants as one, the first by name of equals; NULL where no type is known."""
    return Graph(_table(spark, sf, "layer_nodes"), _table(spark, sf, "layer_edges"), node_id="v_n").dominant(_kind("type")).e


@query("""SELECT cp, CAST(sum(area) AS BIGINT) AS area FROM (SELECT DISTINCT cp, g_id FROM (SELECT cp, unnest(supernode_ids) AS g_id FROM clusters) WHERE g_id IS NOT NULL) JOIN (SELECT g_id, area FROM grid_cells) USING (g_id) GROUP BY cp""")
def cluster_area(spark: SparkSession, sf: str) -> DataFrame:
    """Area a cluster covers, each cell once: distinct, then sum."""
    members = _table(spark, sf, "clusters").select("cp", F.explode(F.array_distinct("supernode_ids")).alias("g_id")).where("g_id is not null").distinct()
    return members.join(_table(spark, sf, "grid_cells").select("g_id", "area"), "g_id").groupBy("cp").agg(F.sum("area").alias("area"))


@query("""WITH x AS (SELECT a.event_type AS event_type_s, b.event_type AS event_type_t FROM events a JOIN events b
  ON (a.ts, a.event_id) < (b.ts, b.event_id) AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 10 MINUTE) SELECT event_type_s, event_type_t, count(*) AS n_edges FROM x GROUP BY 1, 2""")
def event_type_flows(spark: SparkSession, sf: str) -> DataFrame:
    """The whole way: nodes, band join, partition by the type of both ends."""
    return events(spark, sf).create_edges_ft(("ts", 10, "m")).partition_graph("event_type")[1]
