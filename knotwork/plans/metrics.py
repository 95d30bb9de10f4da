"""What a run did: pairs met, edges kept and seconds, said on the screen and kept as a log."""

from __future__ import annotations

import logging
import sys
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import materialize_seen

log = logging.getLogger("knotwork")
SCHEMA = "step string, pairs bigint, edges bigint, secs double"


def log_step(step: str, edges: DataFrame, noted: Observation, verbose: bool = False, logfile: str | None = None) -> DataFrame:
    """Make ``edges`` now, once, and report: the number of pairs ``noted`` on the way, of edges, and the seconds.

    The rows of a log have the same columns whatever the step did. A task repeated after the loss of an executor may be
    noted twice: the numbers tell of the run, not of the result.
    """
    began = time.monotonic()
    made, seen = materialize_seen(edges, "edges", F.count(F.lit(1)).alias("edges"))
    row = (step, noted.get["pairs"], seen["edges"], time.monotonic() - began)
    log.info("%s: %s pairs, %s edges, %.3f s", *row)
    if verbose:
        print("{}: {} pairs, {} edges, {:.3f} s".format(*row), file=sys.stderr)
    if logfile:
        run = RunLog([row])
        run.write(edges.sparkSession, logfile)
    return made


@dataclass
class RunLog:
    """Collects a row per step."""

    rows: list[tuple] = field(default_factory=list)

    def run(self, step: str, pairs: DataFrame | None, edges: DataFrame, path: str) -> DataFrame:
        """Write ``edges`` to ``path`` and note how many there are and how long it took; candidates are counted if given."""
        began = time.monotonic()
        seen = Observation()
        edges.observe(seen, F.count(F.lit(1)).alias("edges")).write.mode("overwrite").parquet(path)
        n = pairs.count() if pairs is not None else None
        self.rows.append((step, n, seen.get["edges"], time.monotonic() - began))
        log.info("%s: %s pairs, %s edges, %.3f s", *self.rows[-1])
        return edges.sparkSession.read.parquet(path)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, SCHEMA)

    def write(self, spark: SparkSession, path: str) -> None:
        """Append the rows as tab-separated text with a header."""
        self.table(spark).coalesce(1).write.mode("append").csv(path, sep="\t", header=True)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log rows with the rate of pairs and of edges per second, for plotting."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=SCHEMA)
    return rows.withColumns({f"{c}_per_sec": F.try_divide(F.col(c).cast("double"), F.col("secs")) for c in ("pairs", "edges")})
