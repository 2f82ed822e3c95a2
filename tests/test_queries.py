"""Every registered query with SQL against DuckDB on the smallest tables; the others run and keep their columns."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        path = f"{SF}/{f}"
        c.execute(f"create view {f.split('.')[0]} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{float(v):.8g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(columns, names, data):
    order = [columns.index(n) for n in names]
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, db, name):
    got = catalogue.queries()[name](spark, SF)
    want = db.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, sorted(columns), [tuple(r) for r in got.collect()]) == rows(columns, sorted(columns), want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    got = catalogue.queries()[name](spark, SF)
    assert got.columns and got.count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
