"""Queries of the core operators for large, uneven data: hot keys (p1) and places (p2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import eager_join_aggregate, known_rows, mean, pairs, total
from ..operators.spatial import build_region_index, near_pairs, region_of
from ..session import materialize

FT_SCALE = 6  # ft_r is added in millionths


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def edges_once(spark: SparkSession, sf: str) -> DataFrame:
    """edge_id, s, layer, ft_r (NULL unless known and not negative), each edge_id once.

    Rows of one edge_id are equal but for ``arrived``, so any of them will do; the grouping combines them on the map side.
    """
    ft = F.col("ft_r")
    edges = _table(spark, sf, "flow_edges").select("edge_id", "s", "layer", F.when(~F.isnan(ft) & (ft >= 0), ft).alias("ft_r"))
    return edges.distinct()


def cluster_cells(spark: SparkSession, sf: str) -> DataFrame:
    """cp, g_id: the cells of each cluster, each once. Redelivered clusters repeat their set, so distinct rows suffice."""
    members = _table(spark, sf, "clusters").select("cp", F.explode(F.array_distinct("supernode_ids")).alias("g_id"))
    return members.where(F.col("g_id").isNotNull() & F.col("cp").isNotNull()).distinct()


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Cells that hold at least 1 % of the edges or are in at least 5 % of the clusters."""
    cells = _table(spark, sf, "grid_cells").select(F.col("g_id").alias("cell"))
    edges = edges_once(spark, sf).select(F.col("s").alias("cell"))
    by_s = materialize(eager_join_aggregate(edges, cells, "cell", {"n": pairs()}, by_key=True), "p1s")
    of_edges = by_s.agg(F.sum("n").alias("all"))
    found_s = by_s.join(F.broadcast(of_edges)).where(F.col("n") * 100 >= F.col("all")).select(F.lit("s").alias("field"), F.col("cell").alias("g_id"))
    listed = _table(spark, sf, "clusters").where("cp is not null and supernode_ids is not null").select("cp").distinct()
    of_clusters = listed.agg(F.count(F.lit(1)).alias("all"))
    members = cluster_cells(spark, sf).select(F.col("g_id").alias("cell"))
    by_cell = eager_join_aggregate(members, cells, "cell", {"n": pairs()}, by_key=True)
    found_c = by_cell.join(F.broadcast(of_clusters)).where(F.col("n") * 20 >= F.col("all")).select(F.lit("supernode_ids").alias("field"), F.col("cell").alias("g_id"))
    return found_s.unionByName(found_c)


def p1_cell_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Per cell and zone: edges that start there, how many have a known ft_r, and its mean."""
    cells = _table(spark, sf, "grid_cells").select(F.col("g_id").alias("cell"), "zone")
    edges = edges_once(spark, sf).select(F.col("s").alias("cell"), "ft_r")
    measures = {"n_edges": pairs(), "n_known": known_rows("left", "ft_r"), "mean_ft_r": mean("left", "ft_r", FT_SCALE)}
    return eager_join_aggregate(edges, cells, "cell", measures, right_keys=["zone"], by_key=True)


def p1_cell_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Per cell: the clusters that cover it."""
    cells = _table(spark, sf, "grid_cells").select("g_id", "zone")
    return eager_join_aggregate(cluster_cells(spark, sf), cells, "g_id", {"n_clusters": pairs()}, right_keys=["zone"], by_key=True)


def p1_layer_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Per layer: pairs of an edge and a cluster that covers the cell it starts in, and their summed ft_r.

    Joined row by row this is the product of two hot keys; here it is one multiplication per cell and layer.
    """
    edges = edges_once(spark, sf).select(F.col("s").alias("g_id"), "layer", "ft_r")
    measures = {"n_pairs": pairs(), "sum_ft_r": total("left", "ft_r", FT_SCALE)}
    return eager_join_aggregate(edges, cluster_cells(spark, sf).select("g_id"), "g_id", measures, left_keys=["layer"])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sites at most 2 km apart, and the basin that holds a site."""
    sites = _table(spark, sf, "sites").select("site_id", "lat", "lon").dropDuplicates(["site_id"])
    near = near_pairs(sites, "site_id", "lat", "lon", 2.0).select(F.lit("near").alias("kind"), "left_id", "right_id")
    index = build_region_index(_table(spark, sf, "basins"), "basin_id", "lats", "lons")
    inside = region_of(sites, "site_id", "lat", "lon", index).select(F.lit("inside").alias("kind"), F.col("site_id").alias("left_id"), F.col("basin_id").alias("right_id"))
    return near.unionByName(inside)


def p2_basin_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Per basin: its sites and their mean height."""
    sites = _table(spark, sf, "sites").dropDuplicates(["site_id"])
    index = build_region_index(_table(spark, sf, "basins"), "basin_id", "lats", "lons")
    held = region_of(sites, "site_id", "lat", "lon", index).join(sites.select("site_id", "elev"), "site_id")
    return held.groupBy("basin_id").agg(F.count(F.lit(1)).alias("n_sites"), F.round(F.avg("elev"), 9).alias("mean_elev"))


QUERIES = {
    "p1_found": p1_found,
    "p1_cell_edges": p1_cell_edges,
    "p1_cell_clusters": p1_cell_clusters,
    "p1_layer_clusters": p1_layer_clusters,
    "p2_found": p2_found,
    "p2_basin_sites": p2_basin_sites,
}

_EDGES = "SELECT DISTINCT edge_id, s, layer, CASE WHEN NOT isnan(ft_r) AND ft_r >= 0 THEN ft_r END AS ft_r FROM flow_edges"
_UNITS = "CAST(sum(CAST(round(ft_r * 1e6) AS BIGINT)) AS DOUBLE)"
_MEMBERS = "SELECT DISTINCT cp, g_id FROM (SELECT cp, unnest(supernode_ids) AS g_id FROM clusters) WHERE g_id IS NOT NULL AND cp IS NOT NULL"
_SITES = """SELECT DISTINCT site_id, lat, lon - floor((lon + 180) / 360) * 360 AS lon, elev
  FROM sites WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon) AND abs(lat) <= 90 AND NOT (lat = 0 AND lon = 0)"""
_INSIDE = """v AS (SELECT basin_id, unnest(range(1, len(lats) + 1)) AS k, unnest(lats) AS y, unnest(lons) AS lon FROM basins),
  d AS (SELECT *, coalesce((lon - lag(lon) OVER w + 540) % 360 - 180, lon) AS step FROM v WINDOW w AS (PARTITION BY basin_id ORDER BY k)),
  u AS (SELECT basin_id, k, y, sum(step) OVER (PARTITION BY basin_id ORDER BY k) AS x FROM d),
  sides AS (SELECT basin_id, x AS xa, y AS ya, coalesce(lead(x) OVER w, first(x) OVER w) AS xb, coalesce(lead(y) OVER w, first(y) OVER w) AS yb
    FROM u WINDOW w AS (PARTITION BY basin_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  held AS (SELECT DISTINCT site_id, basin_id FROM (SELECT site_id, basin_id, shift
    FROM once JOIN sides ON (ya > lat) <> (yb > lat), (VALUES (-360), (0), (360)) AS m(shift)
    WHERE lon + shift < xa + (lat - ya) / (yb - ya) * (xb - xa) GROUP BY ALL HAVING count(*) % 2 = 1))"""

SQL = {
    "p1_found": f"""WITH e AS ({_EDGES}), j AS (SELECT s FROM e JOIN grid_cells ON s = g_id), m AS ({_MEMBERS})
      SELECT 's' AS field, s AS g_id FROM j GROUP BY s HAVING count(*) * 100 >= (SELECT count(*) FROM j)
      UNION ALL SELECT 'supernode_ids', g_id FROM m JOIN grid_cells USING (g_id) GROUP BY g_id
      HAVING count(*) * 20 >= (SELECT count(DISTINCT cp) FROM clusters WHERE supernode_ids IS NOT NULL)""",
    "p1_cell_edges": f"""WITH e AS ({_EDGES}) SELECT g_id AS cell, zone, count(*) AS n_edges, count(ft_r) AS n_known, {_UNITS} / 1e6 / nullif(count(ft_r), 0) AS mean_ft_r
      FROM e JOIN grid_cells ON s = g_id GROUP BY g_id, zone""",
    "p1_cell_clusters": f"WITH m AS ({_MEMBERS}) SELECT g_id, zone, count(*) AS n_clusters FROM m JOIN grid_cells USING (g_id) GROUP BY g_id, zone",
    "p1_layer_clusters": f"""WITH e AS ({_EDGES}), m AS ({_MEMBERS}) SELECT layer, count(*) AS n_pairs, {_UNITS} / 1e6 AS sum_ft_r
      FROM e JOIN m ON s = g_id GROUP BY layer""",
    "p2_found": f"""WITH once AS ({_SITES}), {_INSIDE}
      SELECT 'near' AS kind, a.site_id AS left_id, b.site_id AS right_id FROM once a JOIN once b ON a.site_id < b.site_id AND abs(a.lat - b.lat) <= 0.02
      WHERE 2 * 6371 * asin(sqrt(least(1, sin(radians(a.lat - b.lat) / 2) ** 2
        + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(a.lon - b.lon) / 2) ** 2))) <= 2
      UNION ALL SELECT 'inside', site_id, basin_id FROM held""",
    "p2_basin_sites": f"""WITH once AS ({_SITES}), {_INSIDE}
      SELECT basin_id, count(*) AS n_sites, round(avg(elev), 9) AS mean_elev FROM held JOIN once USING (site_id) GROUP BY basin_id""",
}
