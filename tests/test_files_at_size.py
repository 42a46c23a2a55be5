"""Texts are written as several files in order, and readers take them as one."""

import glob
import os

import duckdb
import pytest

from synframe.plans import registry

from tests.test_operators import DATA, rows

READERS = ["read_fasta", "read_fasta_unchecked", "read_blocks_coords", "read_maf", "read_gff", "read_overlap_dot", "read_nucmer", "read_paf", "read_pairwise_maf", "read_order", "read_permutations"]


@pytest.mark.parametrize("name", READERS)
def test_readers_over_several_files(spark, monkeypatch, name):
    con, paths, write = duckdb.connect(), [], registry._file
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    monkeypatch.setattr(registry, "_file", lambda *a, **b: paths.append(write(*a, **b)) or paths[-1])
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        df = registry.QUERIES[name](spark, DATA)
        got = rows(df.columns, [tuple(r) for r in df.collect()])
    finally:
        spark.conf.set(key, old)
    want = con.sql(registry.ORACLE_SQL[name])
    assert got == rows(want.columns, want.fetchall())
    sizes = [os.path.getsize(f) for p in paths for f in glob.glob(f"{p.removeprefix('file:')}/part-*")]
    assert len(sizes) > 2 and max(sizes) < 0.6 * sum(sizes)
