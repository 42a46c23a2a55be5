"""Overlaps of many short sequences: sizes are counted from words, pairs are neither grouped nor broadcast."""

import random

import pytest
from pyspark.sql import functions as F

from synframe.operators import overlap as ov
from synframe.plans import registry

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def by_hand(seqs, least, most):
    out = {}
    for a, x in seqs:
        for b, y in seqs:
            for k in range(least, min(len(x), len(y), most) + 1):
                if a != b and x[-k:].upper() == y[:k].upper() and "N" not in x[-k:].upper():
                    out[a, b] = max(out.get((a, b), 0), k)
    return {(*k, v) for k, v in out.items()}


def drawn(seed, letters, n=60, most=14, names=lambda i: f"s{i}"):
    rnd = random.Random(seed)
    return [(names(i), "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, most)))) for i in range(n)]


@pytest.mark.parametrize("seqs", [drawn(1, "AC"), drawn(2, "AAAAACN"), drawn(3, "A"), drawn(4, "aCGT"), drawn(5, "ACN", names=lambda i: f"s{i % 40}"), drawn(6, "AC", most=2)])
def test_overlaps_sizes_and_pairs(spark, seqs):
    want = by_hand(seqs, 2, 9)
    f = spark.createDataFrame(seqs, "name string, seq string").repartition(3)
    assert sorted(map(tuple, ov.overlaps(f, 2, 9).collect())) == sorted(want)
    sizes = {}
    for *_, k in want:
        sizes[k] = sizes.get(k, 0) + 1
    assert sorted(map(tuple, ov.overlap_sizes(f, 2, 9).collect())) == sorted(sizes.items())
    for k in (2, 5):
        assert sorted(map(tuple, ov.overlaps(f, 2, 9, only=k).collect())) == sorted(w for w in want if w[2] == k)
    pairs = spark.createDataFrame([(a, b) for a, _ in seqs[:20] for b, _ in seqs], "src string, dst string")
    asked = {a for a, _ in seqs[:20]}
    assert sorted(map(tuple, ov.overlaps_of(pairs, f, 2, 9).collect())) == sorted(w for w in want if w[0] in asked)


@pytest.mark.parametrize("name", ["overlap_join", "overlap_histogram", "overlap_rate", "overlap_mode", "direct_distances", "overlap_dot"])
def test_words_are_not_broadcast(spark, name):
    """A table of words is made from a column far smaller than itself, so Spark's estimate would have it broadcast."""
    p = plan(registry.QUERIES[name](spark, DATA))
    assert "BroadcastHashJoin" not in p
    if name in ("overlap_join", "overlap_mode", "overlap_dot"):
        assert "SortMergeJoin" in p and "Aggregate" not in p  # pairs are not grouped
    if name in ("overlap_histogram", "overlap_rate"):
        assert "SortMergeJoin" not in p


def test_graph_of_no_overlaps(spark):
    f = spark.createDataFrame([("a", "ACGTACGG")], "name string, seq string").filter(F.lit(False))
    assert ov.overlap_graph(f, 3, 5).columns == ["src", "dst", "size"] and ov.overlap_graph(f, 3, 5).isEmpty()
    assert ov.overlap_rate(ov.overlap_sizes(f, 3, 5), f).first() == (0, 0, False)
