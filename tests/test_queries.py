"""Every core query against its SQL, on the smallest tables, where they are at hand."""

import glob
import importlib
import math
import os

import pytest

import __spark_entry__ as contract

FOLDER = os.environ.get("KNOTWORK_TABLES", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
SQL = {name: sql for module in contract.MODULES if "llm" not in module.__name__ for name, sql in module.SQL.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    result = duck.execute(SQL[name])
    columns = sorted(d[0] for d in result.description)
    assert sorted(df.columns) == columns
    order = [[d[0] for d in result.description].index(c) for c in columns]
    want = sorted((tuple(plain(r[k]) for k in order) for r in result.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_the_core_stands_alone():
    """Nothing outside the llm folder imports it, but for the guarded line of the contract."""
    import pathlib

    root = pathlib.Path(contract.__file__).parent / "knotwork"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text(), path
    importlib.import_module("knotwork")
