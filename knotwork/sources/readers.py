"""Readers: columnar and text tables, Pajek networks, stored numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.positions import with_position

FORMATS = ("parquet", "orc", "json", "csv", "text")


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: str | None = None, fmt: str | None = None, schema: str | T.StructType | None = None, **options: object) -> DataFrame:
    """A table by path; the format follows the ending unless ``fmt`` says it. Columns and filters reach the scan of columnar formats.

    CSV files have a header unless ``header`` says otherwise, and need a ``schema`` or ``inferSchema=True``.
    """
    kind = fmt or next((f for f in FORMATS if path.rstrip("/").split("/")[-1].split(".")[-1] == f), "parquet")
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    if kind == "csv":
        options.setdefault("header", True)
    reader = spark.read.options(**options)
    df = (reader.schema(schema) if schema is not None else reader).format(kind).load(path)
    if where:
        df = df.where(where)
    return df.select(*columns) if columns is not None else df


def read_pajek(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label) and edges (s, t, weight, directed) of a Pajek file with *Vertices, *Arcs, *Edges or *Matrix sections.

    Lines are parsed where they lie; only the few section headers reach the driver. Vertices without a line get their number
    as label; a missing weight is 1. *Arcs are directed, *Edges are not; in a *Matrix every entry but 0 is an arc.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.trim("value").alias("line")).where("line <> '' and not line like '\\\\%%'")
    heads = lines.where("line like '*%'").orderBy("at").collect()
    parts = [(h["at"], heads[k + 1]["at"] if k + 1 < len(heads) else (1 << 62), h["line"].lower()) for k, h in enumerate(heads)]

    def section(*names: str) -> DataFrame | None:
        found = [(lo, hi) for lo, hi, line in parts if line.split()[0].lstrip("*") in names]
        if not found:
            return None
        cond = F.lit(False)
        for lo, hi in found:
            cond = cond | ((F.col("at") > lo) & (F.col("at") < hi))
        return lines.where(cond)

    sizes = [int(line.split()[1]) for _, _, line in parts if line.startswith("*vertices")]
    n = max(sizes, default=0)
    words = F.split("line", r"\s+")
    number = lambda k, kind: F.try_element_at(words, F.lit(k)).try_cast(kind)
    nodes = spark.range(1, n + 1)
    listed = section("vertices")
    label = F.regexp_extract("line", r'^\s*\d+\s+(?:"([^"]*)"|(\S+))', 1)
    bare = F.regexp_extract("line", r'^\s*\d+\s+(?:"([^"]*)"|(\S+))', 2)
    if listed is not None:
        named = listed.select(number(1, "bigint").alias("id"), F.when(label != "", label).otherwise(bare).alias("label"))
        nodes = nodes.join(named.groupBy("id").agg(F.min("label").alias("label")), "id", "left")
    else:
        nodes = nodes.withColumn("label", F.lit(None).cast("string"))
    nodes = nodes.select("id", F.coalesce(F.when(F.col("label") != "", F.col("label")), F.col("id").cast("string")).alias("label"))
    edges = spark.createDataFrame([], "s bigint, t bigint, weight double, directed boolean")
    for name, directed in (("arcs", True), ("edges", False)):
        if (part := section(name)) is not None:
            edges = edges.unionByName(part.select(number(1, "bigint").alias("s"), number(2, "bigint").alias("t"), F.coalesce(number(3, "double"), F.lit(1.0)).alias("weight"), F.lit(directed).alias("directed")))
    if (part := section("matrix")) is not None:
        numbered = with_position(part, ["at"], "row")  # the n-th line that is no blank and no comment is row n, wherever the file was split
        rows = numbered.select((F.col("row") + 1).alias("s"), F.posexplode(words).alias("k", "w"))
        cells = rows.select("s", (F.col("k") + 1).cast("bigint").alias("t"), F.col("w").try_cast("double").alias("weight"), F.lit(True).alias("directed"))
        edges = edges.unionByName(cells.where("weight <> 0"))
    return nodes, edges.where("s is not null and t is not null")


def read_npy(spark: SparkSession, path: str, rows_per_task: int = 10_000, column: str = "x") -> DataFrame:
    """(pos, ``column``): a stored numpy array, row by row; tasks map the file and read their own slice.

    A one-dimensional array gives doubles, a two-dimensional one arrays of doubles. The path must be readable by all executors.
    """
    whole = np.load(path, mmap_mode="r")
    if whole.ndim not in (1, 2):
        raise ValueError("only arrays of one or two dimensions are tables")
    n, flat = len(whole), whole.ndim == 1
    schema = T.StructType([T.StructField("pos", T.LongType()), T.StructField(column, T.DoubleType() if flat else T.ArrayType(T.DoubleType()))])

    def slices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = np.load(path, mmap_mode="r")
        for frame in frames:
            for k in frame["id"]:
                part = np.asarray(data[k * rows_per_task : (k + 1) * rows_per_task], dtype=float)
                yield pd.DataFrame({"pos": np.arange(len(part)) + k * rows_per_task, column: part if flat else list(part)})

    tasks = -(-n // rows_per_task)
    return spark.range(0, tasks, 1, max(1, tasks)).mapInPandas(slices, schema)


#: Number types of classic netCDF files by their code.
_CLASSIC_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


def classic_variables(path: str) -> dict[str, tuple[tuple[str, ...], np.ndarray]]:
    """Name -> (dimensions, values) of a netCDF file in classic form (or with 64-bit offsets); the values stay in the file, mapped."""
    with open(path, "rb") as file:
        magic = file.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2):
            raise ValueError("no netCDF file in classic form")
        wide = magic[3] == 2

        def number(size: int = 4) -> int:
            return int.from_bytes(file.read(size), "big", signed=True)

        def name() -> str:
            n = number()
            text = file.read(n).decode()
            file.read(-n % 4)
            return text

        def skip_attributes() -> None:
            _, n = number(), number()
            for _ in range(n):
                name()
                kind, values = number(), number()
                size = np.dtype(_CLASSIC_TYPES[kind]).itemsize * values
                file.read(size + -size % 4)

        records = number()
        _, n = number(), number()
        dims = [(name(), number()) for _ in range(n)]
        skip_attributes()
        _, n = number(), number()
        heads = []
        for _ in range(n):
            label = name()
            at = [number() for _ in range(number())]
            skip_attributes()
            heads.append((label, at, number(), number(), number(8 if wide else 4)))
    moving = lambda at: bool(at) and dims[at[0]][1] == 0
    sizes = [size for _, at, _, size, _ in heads if moving(at)]
    stride = sum(sizes)
    out = {}
    for label, at, kind, _, begin in heads:
        dtype = np.dtype(_CLASSIC_TYPES[kind])
        shape = tuple(records if dims[d][1] == 0 else dims[d][1] for d in at)
        if not moving(at):
            values = np.memmap(path, dtype, "r", begin, shape) if all(shape) else np.empty(shape, dtype)
        elif not records:
            values = np.empty(shape, dtype)
        else:  # one record of every moving variable after the other; a single one isn't padded
            step = stride if len(sizes) > 1 else int(np.prod(shape[1:], dtype=int)) * dtype.itemsize
            raw = np.memmap(path, np.uint8, "r", begin)
            strides = (step, *(int(np.prod(shape[k + 1 :], dtype=int)) * dtype.itemsize for k in range(1, len(shape))))
            values = np.ndarray(shape, dtype, raw, 0, strides)
        out[label] = (tuple(dims[d][0] for d in at), values)
    return out


def _netcdf(path: str) -> dict[str, tuple[tuple[str, ...], object]]:
    with open(path, "rb") as file:
        classic = file.read(3) == b"CDF"
    if classic:
        return classic_variables(path)
    try:
        import netCDF4
    except ImportError as error:
        raise ImportError("netCDF files that aren't in classic form need the netCDF4 package") from error
    return {k: (v.dimensions, v) for k, v in netCDF4.Dataset(path).variables.items()}


def read_netcdf(spark: SparkSession, path: str, variables: Sequence[str], rows_per_task: int = 100_000) -> DataFrame:
    """Variables over the same dimensions as columns, one row per grid point, with the coordinates of each dimension (its index, if it has none).

    Tasks read their own slabs of the first dimension; the driver reads the header only. All columns are doubles, masked values NULL.
    The path must be readable by all executors.
    """
    found = _netcdf(path)
    if missing := [v for v in variables if v not in found]:
        raise KeyError(f"no such variables: {missing}")
    dims = found[variables[0]][0]
    if not dims or any(found[v][0] != dims for v in variables):
        raise ValueError("the variables must have the same dimensions, one at least")
    shape = tuple(found[variables[0]][1].shape)
    step = max(1, rows_per_task // max(1, int(np.prod(shape[1:], dtype=int))))
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in [*dims, *variables]])

    def slabs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = _netcdf(path)
        axis = [np.array(data[d][1][:]).astype(float) if d in data else np.arange(n, dtype=float) for d, n in zip(dims, shape)]
        for frame in frames:
            for k in frame["id"]:
                part = slice(k * step, min((k + 1) * step, shape[0]))
                grid = np.meshgrid(axis[0][part], *axis[1:], indexing="ij")
                plain = lambda v: np.ma.filled(np.ma.asarray(data[v][1][part]).astype(float), np.nan).ravel()  # noqa: B023, E731
                yield pd.DataFrame({d: a.ravel() for d, a in zip(dims, grid)} | {v: plain(v) for v in variables})

    tasks = -(-shape[0] // step)
    return spark.range(0, tasks, 1, max(1, tasks)).mapInPandas(slabs, schema)
