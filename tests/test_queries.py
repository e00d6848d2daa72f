"""Every query that SQL can express against DuckDB, over whole tables; plans of pure Catalyst queries without Python."""

import glob
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry


def key(v):
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v))
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(key(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {f.split('/')[-1][:-8]} as select * from '{f}'")
    return con


SQL = {k: q for k, q in entry.oracle_sql().items() if not k.startswith(tuple(f"p{i}_" for i in range(1, 10)))}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_duckdb(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    got = rows(df.columns, df.collect())
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert got == want


PYTHON = {"dense_topk", "dense_search", "rrf_fusion", "hybrid_rrf", "global_rrf", "bootstrap_ci", "bootstrap_patients"}


@pytest.mark.parametrize("name", sorted(set(SQL) - PYTHON))
def test_no_python_in_plan(spark, data, name):
    plan = entry.queries()[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() == 7
