import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def normal(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_query_equals_sql(spark, tables, name):
    df = entry.queries()[name](spark, DATA)
    want = tables.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    got = sorted((tuple(normal(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(normal(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    if os.path.isdir(DATA):
        assert entry.entry(spark).count() > 0
