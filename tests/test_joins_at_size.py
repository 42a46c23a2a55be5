"""Tables too large to broadcast: every join is a sort-merge join, as it is over large inputs."""

import pytest

from synframe.operators.filters import filter_intersecting
from synframe.plans import registry
from synframe.sources.blocks_view import _COPIES, _COPIES_SPARK, BLOCKS_SQL, from_files

DATA = "/root/testdata/sf0.01"


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, old)


@pytest.mark.parametrize("name", ["clean_blocks_strict", "clean_blocks_loose", "adjacency_edges", "bifurcations", "genome_distance"])
def test_view_of_blocks_joins_with_itself(spark, no_broadcast, name):
    got = sorted(map(tuple, registry.QUERIES[name](spark, DATA).collect()), key=str)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    assert got and got == sorted(map(tuple, registry.QUERIES[name](spark, DATA).collect()), key=str)


def test_copies_without_a_union_are_the_same_rows(spark):
    assert _COPIES in BLOCKS_SQL
    union = spark.sql(BLOCKS_SQL.replace("from lineitem", f"from parquet.`{DATA}/lineitem.parquet`"))
    view = spark.sql(from_files(BLOCKS_SQL, DATA))
    assert view.schema == union.schema and sorted(view.collect()) == sorted(union.collect())


def test_intersecting_rows_go_by_row_not_by_id(spark):
    """An id that stands in two sequences goes where it intersects, and stays elsewhere; equal rows share their fate."""
    rows = [(1, "x", 0, 10), (2, "x", 5, 20), (1, "y", 0, 10), (2, "y", 30, 40), (3, "y", 50, 60), (3, "y", 50, 60), (1, "z", 0, 10), (2, "z", 2, 4)]
    got = filter_intersecting(spark.createDataFrame(rows, "id long, seq string, s long, e long"), 7)
    assert got.columns == ["id", "seq", "s", "e"]
    assert sorted(map(tuple, got.collect())) == [(1, "y", 0, 10), (1, "z", 0, 10), (2, "y", 30, 40), (3, "y", 50, 60), (3, "y", 50, 60)]


def test_graph_and_contig_ends_read_written_blocks(spark, monkeypatch):
    """Clean blocks are derived once: what the graph and the contigs' ends are made of is a table, not a plan of joins."""
    plans = []
    for name in ("breakpoint_graph", "contig_ends"):
        old = getattr(registry.ad, name)
        monkeypatch.setattr(registry.ad, name, lambda b, *a, old=old: plans.append(b._jdf.queryExecution().optimizedPlan().toString()) or old(b, *a))
    assert registry.chains(spark, "/root/testdata/sf0.001").count() and len(plans) == 2
    assert not any("Join" in p or "Aggregate" in p for p in plans)
