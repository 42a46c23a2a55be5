"""Every query with an oracle against DuckDB on the whole tables, and goldens of the others."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from synframe.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(cols, data):
    fix = lambda v: round(v, 6) if isinstance(v, float) else v
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted([tuple(fix(r[i]) for i in order) for r in data], key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_against_sql(spark, con, name):
    df = registry.QUERIES[name](spark, DATA)
    want = con.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_entry_has_all_queries(spark):
    q = entry.queries()
    assert set(registry.QUERIES) <= set(q) and set(entry.oracle_sql()) <= set(q)
