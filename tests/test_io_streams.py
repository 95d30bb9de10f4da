"""Sources, stores, logs and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork import Graph
from knotwork.plans.metrics import RunLog, read_log
from knotwork.sources import TableStore, read_netcdf, read_npy, read_pajek, read_table
from knotwork.streaming import stream_band_edges, stream_once, stream_partition
from knotwork.streaming.sessions import stream_clusters

PAJEK = """% a network
*Vertices 5
1 "Anna B" 0.1 0.2
2 Bob
4 "D"
*Arcs
1 2 3.5
2 1
*Edges
4 5 2
"""


def test_pajek(spark, tmp_path, rows):
    (tmp_path / "net.net").write_text(PAJEK)
    v, e = read_pajek(spark, str(tmp_path / "net.net"))
    assert rows(v, "id", "label") == [(1, "Anna B"), (2, "Bob"), (3, "3"), (4, "D"), (5, "5")]
    assert rows(e, "s", "t", "weight", "directed") == [(1, 2, 3.5, True), (2, 1, 1.0, True), (4, 5, 2.0, False)]
    (tmp_path / "m.net").write_text("*Vertices 3\n*Matrix\n0 1 0\n0 0 2.5\n1 0 0\n")
    assert rows(read_pajek(spark, str(tmp_path / "m.net"))[1], "s", "t", "weight") == [(1, 2, 1.0), (2, 3, 2.5), (3, 1, 1.0)]


def test_pajek_matrix_with_gaps(spark, tmp_path, rows):
    """Rows of a matrix are counted without blank lines and comments, also where the file is read in parts."""
    (tmp_path / "gaps.net").write_text("*Vertices 3\n*Matrix\n0 1 0\n\n% note\n0 0 2.5\n1 0 0\n")
    assert rows(read_pajek(spark, str(tmp_path / "gaps.net"))[1], "s", "t", "weight") == [(1, 2, 1.0), (2, 3, 2.5), (3, 1, 1.0)]
    n = 200
    lines = "\n".join(("% remark\n" if k % 7 == 0 else "") + " ".join("1" if j == (k + 1) % n else "0" for j in range(n)) for k in range(n))
    (tmp_path / "wide.net").write_text(f"*Vertices {n}\n*Matrix\n{lines}\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert rows(read_pajek(spark, str(tmp_path / "wide.net"))[1], "s", "t") == sorted([(k + 1, (k + 1) % n + 1) for k in range(n)], key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_npy(spark, tmp_path):
    a = np.arange(70.0).reshape(35, 2)
    np.save(tmp_path / "a.npy", a)
    got = read_npy(spark, str(tmp_path / "a.npy"), rows_per_task=8).orderBy("pos").collect()
    assert [r["x"] for r in got] == a.tolist()
    np.save(tmp_path / "b.npy", np.arange(5))
    assert [r["x"] for r in read_npy(spark, str(tmp_path / "b.npy")).orderBy("pos").collect()] == [0, 1, 2, 3, 4]


def classic(dims, variables, records, wide=False):
    """The bytes of a netCDF file in classic form: dims (name, size; 0 for records), variables (name, dims, code, format, values)."""
    number = lambda x: int(x).to_bytes(4, "big", signed=True)
    name = lambda t: number(len(t)) + t.encode() + bytes(-len(t) % 4)
    attribute = number(12) + number(1) + name("units") + number(2) + number(3) + b"mm " + bytes(1)

    def head(begins):
        out = b"CDF" + bytes([2 if wide else 1]) + number(records) + number(10) + number(len(dims)) + b"".join(name(n) + number(k) for n, k in dims) + attribute + number(11) + number(len(variables))
        for (label, at, code, form, values), begin in zip(variables, begins):
            size = values.astype(form).nbytes // (records if dims[at[0]][1] == 0 else 1)
            out += name(label) + number(len(at)) + b"".join(map(number, at)) + number(0) + number(0) + number(code) + number(size + -size % 4) + begin.to_bytes(8 if wide else 4, "big")
        return out

    at = len(head([0] * len(variables)))
    begins, fixed = {}, b""
    for label, dim, _, form, values in variables:
        if dims[dim[0]][1]:
            begins[label] = at + len(fixed)
            fixed += values.astype(form).tobytes()
            fixed += bytes(-len(fixed) % 4)
    moving = [v for v in variables if dims[v[1][0]][1] == 0]
    rows = []
    for k in range(records):
        for label, _, _, form, values in moving:
            if k == 0:
                begins[label] = at + len(fixed) + sum(map(len, rows))
            part = np.asarray(values[k : k + 1]).astype(form).tobytes()
            rows.append(part + (bytes(-len(part) % 4) if len(moving) > 1 else b""))
    return head([begins[v[0]] for v in variables]) + fixed + b"".join(rows)


@pytest.mark.parametrize("wide", [False, True])
def test_netcdf(spark, tmp_path, wide):
    t, lat, lon = np.arange(5) * 6.0, np.array([10.5, 11.5]), np.array([1, 2, 3])
    rain, code = np.arange(30.0).reshape(5, 2, 3) / 4, np.arange(30).reshape(5, 2, 3) - 7
    dims = [("time", 0), ("lat", 2), ("lon", 3)]
    variables = [("lat", [1], 5, ">f4", lat), ("lon", [2], 4, ">i4", lon), ("time", [0], 6, ">f8", t), ("rain", [0, 1, 2], 6, ">f8", rain), ("code", [0, 1, 2], 3, ">i2", code), ("mask", [1, 2], 1, ">i1", np.arange(6).reshape(2, 3))]
    path = str(tmp_path / "grid.nc")
    (tmp_path / "grid.nc").write_bytes(classic(dims, variables, 5, wide))
    got = read_netcdf(spark, path, ["rain", "code"], rows_per_task=12)
    assert got.columns == ["time", "lat", "lon", "rain", "code"] and got.rdd.getNumPartitions() == 3
    want = sorted((t[i], lat[j], lon[k], rain[i, j, k], code[i, j, k]) for i in range(5) for j in range(2) for k in range(3))
    assert sorted(map(tuple, got.collect())) == want
    assert [r["mask"] for r in read_netcdf(spark, path, ["mask"]).orderBy("lat", "lon").collect()] == list(range(6))
    with pytest.raises(KeyError):
        read_netcdf(spark, path, ["snow"])
    with pytest.raises(ValueError):
        read_netcdf(spark, path, ["rain", "mask"])
    (tmp_path / "one.nc").write_bytes(classic([("n", 0)], [("x", [0], 3, ">i2", np.arange(7))], 7))
    assert [r["x"] for r in read_netcdf(spark, str(tmp_path / "one.nc"), ["x"]).orderBy("n").collect()] == list(range(7))


def test_tables_and_store(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "id % 7 as k", "string(id) as name")
    df.write.csv(str(tmp_path / "t.csv"), header=True)
    assert read_table(spark, str(tmp_path / "t.csv"), ["id"], "k = 3", schema="id bigint, k int, name string").count() == 143
    with pytest.raises(ValueError):
        read_table(spark, "x", fmt="xls")
    store = TableStore(spark, str(tmp_path / "store"))
    assert store.keys() == []
    store.write("v", df)
    assert store.read(columns=["id"]).count() == 1000
    store.append("v", df.limit(10))
    assert store.read("v").count() == 1010
    store.write_sorted("sorted", df.orderBy(F.rand(1)), ["id"], 4)
    part = store.read_range("id", 10, 20, "sorted", ["id", "k"])
    assert part.count() == 11 and "PushedFilters: [IsNotNull(id), GreaterThanOrEqual(id,10), LessThanOrEqual(id,20)]" in part._jdf.queryExecution().toString()
    with pytest.raises(AssertionError):
        store.read()
    assert Graph(store.read_range("id", None, 50, "sorted")).create_edges_ft(("id", 1)).m == 50


def test_log(spark, tmp_path):
    log = RunLog()
    e = Graph(spark.range(50)).create_edges_ft(("id", 2)).e
    out = log.run("band", None, e, str(tmp_path / "e"))
    log.run("again", e, e, str(tmp_path / "e2"))
    assert out.count() == 97 and [r[:3] for r in log.rows] == [("band", None, 97), ("again", 97, 97)]
    log.write(spark, str(tmp_path / "log"))
    got = {r["step"]: r for r in read_log(spark, str(tmp_path / "log")).collect()}
    assert got["again"]["edges"] == 97 and got["again"]["edges_per_sec"] > 0 and got["band"]["pairs_per_sec"] is None


def _batches(spark, tmp_path, batches, schema):
    """A stream that delivers one file per micro-batch, in order."""
    folder = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder / f"{k:03d}"))
    read_schema = spark.createDataFrame([], schema).schema
    return spark.readStream.schema(read_schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(folder))


def _run(stream, tmp_path, name):
    out = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    return stream.sparkSession.table(name)


def test_stream_band_and_once(spark, tmp_path, rows):
    first = [(1, "2024-01-01T00:00:00Z", "a"), (2, "2024-01-01T00:05:00Z", "a"), (2, "2024-01-01T00:05:00Z", "a"), (5, None, "a")]
    later = [(3, "2024-01-01T00:14:00Z", "a"), (4, "2024-01-01T00:15:00Z", "b"), (1, "2024-01-01T00:00:00Z", "a")]
    stream = _batches(spark, tmp_path, [first, later], "id bigint, ts string, k string").withColumn("ts", F.to_timestamp("ts"))
    once = _run(stream_once(stream.where("ts is not null"), ["id"], "ts", "1 hour"), tmp_path, "once_rows")
    assert rows(once, "id") == [(1,), (2,), (3,), (4,)]
    edges = _run(stream_band_edges(stream, "id", "ts", 600, "1 hour", features=["k"]), tmp_path, "band_rows").distinct()
    assert rows(edges, "s", "t", "ft_r", "k_s", "k_t") == [(1, 2, 300.0, "a", "a"), (2, 3, 540.0, "a", "a"), (2, 4, 600.0, "a", "b"), (3, 4, 60.0, "a", "b")]


def test_stream_partition_and_clusters(spark, tmp_path, rows):
    minute = lambda m: f"2024-01-01T{m // 60:02d}:{m % 60:02d}:00Z"
    data = [[("a", minute(0)), ("a", minute(4)), ("b", minute(3)), (None, minute(1))], [("a", minute(30)), ("a", minute(2))], [("b", minute(300))], [("b", minute(600))]]
    stream = _batches(spark, tmp_path, data, "k string, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = _run(stream_partition(stream, ["k"], "ts", "10 minutes", "5 minutes"), tmp_path, "windows")
    assert rows(got.where("window_start < '2024-01-01 01:00:00'"), "k", "n_nodes")[:1] == [("a", 1)] and got.agg(F.sum("n_nodes")).first()[0] >= 4
    got = _run(stream_clusters(stream, "k", "ts", 300, "5 minutes"), tmp_path, "clusters_seen")
    seen = {(r["k"], r["started"].minute + 60 * r["started"].hour, r["n_nodes"]) for r in got.collect()}
    assert {("a", 30, 1), ("b", 3, 1), ("b", 300, 1)} <= seen and any(k == "a" and s == 0 for k, s, _ in seen)
