"""Session-level helpers: engine settings, the shared scratch folder, cutting lineage.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which every executor can reach, so a lost
executor costs a re-read and never a recomputation of earlier rounds.
"""

from __future__ import annotations

import atexit
import logging
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, Observation, SparkSession

log = logging.getLogger("knotwork")

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_local_root: list[str] = []
_written: list[str] = []
_shipped: set[str] = set()


def build_session(app: str = "knotwork", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the engine's settings; ``extra`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    ship(session)
    return session


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they can import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):
        folder = tempfile.mkdtemp(prefix="knotwork-ship-")
        path = os.path.join(folder, "knotwork.zip")
        with zipfile.ZipFile(path, "w") as bundle:
            for at, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        bundle.write(os.path.join(at, name), os.path.join("knotwork", os.path.relpath(os.path.join(at, name), root)))
        spark.sparkContext.addPyFile(path)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only in local mode, where one machine is the whole cluster, a folder of our own stands in for an unset value.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="knotwork-"))
    return _local_root[0]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there is removed when the program ends."""
    path = f"{shared_dir(spark)}/knotwork-{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


#: Spark's setting under which the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _own_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files: all that may be read again lies in the shared folder."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and the scan keeps column pruning."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _own_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._knotwork_path = path
    return out


def materialize_seen(df: DataFrame, label: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """:func:`materialize`, and aggregates of the rows noted while they were written, without another job.

    Repeated work after the loss of an executor may be noted twice: fit for sizes that steer, not for results.
    """
    seen = Observation()
    return materialize(df.observe(seen, *metrics), label), seen.get


def discard(df: DataFrame | None) -> None:
    """Delete the files of a frame made by :func:`materialize`; nothing may read it afterwards."""
    path = getattr(df, "_knotwork_path", None)
    if path is not None:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    """Remove a path of ours, whatever file system it lies in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if path in _written:
        _written.remove(path)


def sweep(spark: SparkSession | None = None) -> None:
    """Delete all intermediate tables of this program that are still there; what was made from them can't be read any longer.

    Runs by itself when the program ends. Call it before stopping a session whose shared folder isn't a local one.
    """
    spark = spark or SparkSession.getActiveSession()
    for path in list(_written):
        url = urlparse(path)
        try:
            if url.scheme in ("", "file"):
                shutil.rmtree(url.path, ignore_errors=True)
                _written.remove(path)
            elif spark is not None:
                _delete(spark, path)
        except Exception as error:  # the session may be gone: what is left is named, not hidden
            log.warning("%s is left over: %s", path, error)


@atexit.register
def _at_exit() -> None:
    sweep()
    for root in _local_root:
        shutil.rmtree(root, ignore_errors=True)
