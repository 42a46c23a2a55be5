"""Plans stay what they should be: pruned scans, pushed filters, no cartesian products, no Python in relational operators."""

import re

import pytest

from synframe.plans import registry

DATA = "/root/testdata/sf0.001"
RELATIONAL = ["block_coverage", "clean_blocks_strict", "edge_support", "trimmed_graph", "interval_containment", "agp_rows", "name_votes", "overlap_join", "range_complement", "intersect_filter", "path_compress", "bulge_removal"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", RELATIONAL)
def test_relational_operators_stay_in_the_jvm(spark, name):
    p = plan(registry.QUERIES[name](spark, DATA))
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", p)


def test_scan_is_pruned(spark):
    p = plan(registry.QUERIES["block_coverage"](spark, DATA))
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint>" in p


def test_two_text_columns_only_read_what_they_need(spark):
    p = plan(registry.QUERIES["reverse_complement"](spark, DATA))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p
