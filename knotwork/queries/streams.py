"""Streaming operators, run over a stored table until its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import stream_band_edges, stream_clusters, stream_once, stream_partition


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream. Its files may lie in a folder or be a single file, which the pattern covers."""
    path = f"{sf}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_dir = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(folder).isDirectory()
    return spark.readStream.schema(schema).parquet(path if is_dir else f"{sf}/{name}.parque[t]")


def _finished(stream: DataFrame) -> DataFrame:
    """Run to the end of what is there, in append mode, and read what came out."""
    base = scratch_path(stream.sparkSession, "stream")
    run = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Events per type and day whose window has closed by the end of the stream."""
    out = stream_partition(_stream(spark, sf, "events"), ["event_type"], "ts", "1 day", "1 hour", aggs={"value": F.round(F.sum("value"), 2)})
    return _finished(out).select(F.to_date("window_start").alias("day"), "event_type", "n_nodes", "value")


def stream_band(spark: SparkSession, sf: str) -> DataFrame:
    """Events of one user at most an hour apart, joined as they come."""
    return _finished(stream_band_edges(_stream(spark, sf, "events"), "event_id", "ts", 3600, "2 hours", on=["user_id"]))


def stream_deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    """Flow edges of each layer, redelivered ones dropped as they come."""
    once = stream_once(_stream(spark, sf, "flow_edges").select("edge_id", "layer", "arrived"), ["edge_id"], "arrived", "400 days")
    return _finished(once.select("edge_id", "layer")).groupBy("layer").agg(F.count(F.lit(1)).alias("n_edges"))


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of events of a user with gaps of at most an hour, as far as they have closed by the end of the stream."""
    return _finished(stream_clusters(_stream(spark, sf, "events").select("user_id", "ts"), "user_id", "ts", 3600, "1 hour"))


QUERIES = {"stream_sessions": stream_sessions, "stream_windows": stream_windows, "stream_band": stream_band, "stream_deduplicated": stream_deduplicated}

SQL = {
    "stream_sessions": """WITH x AS (SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000, true) AS opens FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      y AS (SELECT user_id, ts, sum(CAST(opens AS INT)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x)
      SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n_nodes FROM y GROUP BY user_id, k
      HAVING epoch_us(max(ts)) + 3600000000 < (SELECT epoch_ms(max(ts)) * 1000 - 3600000000 FROM events)""",
    "stream_windows": """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n_nodes, round(sum(value), 2) AS value FROM events WHERE event_type IS NOT NULL
      AND date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""",
    "stream_band": """SELECT a.event_id AS s, b.event_id AS t, (epoch_us(b.ts) - epoch_us(a.ts)) / 1e6 AS ft_r FROM events a JOIN events b
      ON a.user_id = b.user_id AND (a.ts, a.event_id) < (b.ts, b.event_id) AND b.ts <= a.ts + INTERVAL 1 HOUR""",
    "stream_deduplicated": "SELECT layer, count(DISTINCT edge_id) AS n_edges FROM flow_edges GROUP BY layer",
}
