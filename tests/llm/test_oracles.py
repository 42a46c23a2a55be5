"""Queries whose results SQL can express, held against that SQL on whole tables."""

import duckdb
import pytest

from synframe.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    rel = con.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(rel.columns)
    want = sorted((tuple(r) for r in rel.select(*[duckdb.ColumnExpression(c) for c in df.columns]).fetchall()), key=str)
    assert sorted((tuple(r) for r in df.collect()), key=str) == want and want
