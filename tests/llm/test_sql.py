"""The queries p3 to p8 against their SQL, on the smallest tables, where they are at hand."""

import glob
import math
import os

import pytest

import __spark_entry__ as contract
from knotwork.llm import queries

FOLDER = os.environ.get("KNOTWORK_TABLES", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else float(f"{v:.10g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    result = duck.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(plain(v) for v in r) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(v) for v in r) for r in df.select(*names).collect()), key=repr) == want


def test_contraction_runs_at_any_size(spark, monkeypatch):
    """The smallest input goes through the same rounds as a large one."""
    from knotwork.llm import contraction

    rounds = []
    inner = contraction._relabel
    monkeypatch.setattr(contraction, "_relabel", lambda *a: rounds.append(1) or inner(*a))
    assert queries.p4_found(spark, FOLDER).count() > 0 and len(rounds) >= 2
