"""K-mers packed in longs, and longer ones as text, find the same paths."""

import random

import pytest
from pyspark.sql import functions as F

from synframe.operators import blockfinder as bf
from tests.test_blockfinder import brute, frame, turned


@pytest.mark.parametrize("k", [31, 33])
def test_longer_paths_against_brute_force(spark, k):
    rnd = random.Random(k)
    parts = ["".join(rnd.choice("ACGT") for _ in range(90)) for _ in range(4)]
    seqs = {(f"g{n % 3}", f"c{n}"): "N".join(x if rnd.random() < 0.6 else turned(x) for x in rnd.sample(parts, 3)) for n in range(6)}
    walk = bf.kmer_walk(frame(spark, seqs), k, 64)
    assert dict(walk.dtypes)["node"] == ("bigint" if k == 31 else "string") and walk.rdd.getNumPartitions() > 1
    got = bf.unitig_blocks(frame(spark, seqs), k, 64).select("genome", "chr", "bstart", "bend", "sign").collect()
    assert sorted(map(tuple, got)) == sorted((g, c, s, e, x) for g, c, _, x, s, e in brute(seqs, k)) and got
    assert bf.spelled(bf.sides(walk), k).filter(F.length("node") != k).isEmpty()


def test_letters_of_packed_and_spelled_kmers(spark):
    """A node's sides as twelve bits: the letters that follow, ends, and steps to the node itself; the same for packed k-mers and longer ones."""
    rnd = random.Random(3)
    s = "".join(rnd.choice("ACGT") for _ in range(70))
    seqs = {("g", "a"): s + "N" + turned(s[:50]) + "A" * 40, ("g", "b"): s[10:60] + s[5:55]}
    for k in (31, 33):
        named = frame(spark, seqs).withColumn("sid", F.when(F.col("chr") == "a", 1).otherwise(2).cast("long"))
        got = {(r.sid, r.pos): (r.sign, r.bits) for r in bf.kmer_steps(named, k, 16, ["sid", "pos", "sign", "bits"]).collect()}
        want = {}
        for (_, c), t in seqs.items():
            at = {i: t[i : i + k] for i in range(len(t) - k + 1) if set(t[i : i + k]) <= set("ACGT")}
            for i, x in at.items():
                own = x <= turned(x)
                side = lambda j, l: 16 if j not in at else (1 << "ACGT".index(l if own else turned(l))) + 32 * (min(at[j], turned(at[j])) == min(x, turned(x)))
                a, b = side(i + 1, t[i + k : i + k + 1]), side(i - 1, t[i - 1])
                want[1 if c == "a" else 2, i] = (1, a | b << 6) if own else (-1, b | a << 6)
        assert got == want and {b & 32 for _, b in got.values()} == {0, 32}


def test_no_table_of_all_kmers_is_written(spark, monkeypatch):
    written = []
    old = bf.Written.put
    monkeypatch.setattr(bf.Written, "put", lambda self, df: written.append(df.columns) or old(self, df))
    s = "ACGTTGCATTGACCAGT"
    assert bf.unitig_blocks(frame(spark, {("a", "1"): s, ("b", "1"): s}), 5).count()
    assert written and not any("pos" in c for c in written)


@pytest.mark.parametrize("k", [5, 31, 33])
def test_branching_sides_are_those_of_the_walk(spark, k):
    rnd = random.Random(k)
    s = "".join(rnd.choice("ACGT") for _ in range(150))
    seqs = {("g", "a"): s + "N" + turned(s[:90]) + "A" * 40, ("g", "b"): s[10:60] + s[5:75], ("h", "c"): "ACACACACAC" * 5}
    got = bf.branching(frame(spark, seqs), k, 16)
    want = bf.spelled(bf.sides(bf.kmer_walk(frame(spark, seqs), k, 16)).filter("open or low <> high"), k)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and not got.isEmpty()


def test_rows_of_kmers_that_move_are_narrow(spark, monkeypatch):
    """What is shuffled by node is a node and a place or its letters, and by piece a place; no sequence, sign or node goes with it."""
    seen = []
    old = bf.Written.put
    monkeypatch.setattr(bf.Written, "put", lambda self, df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or old(self, df))
    s = "ACGTTGCATTGACCAGT"
    bf.unitig_blocks(frame(spark, {("a", "1"): s, ("b", "1"): s}), 5)
    plan = next(p for p in seen if "MapInArrow" in p and "Union" in p)
    top = plan[: plan.index("Union")]
    assert "RepartitionByExpression" in top and "node" not in top[top.index("RepartitionByExpression") :]


@pytest.mark.parametrize("k", [5, 33])
def test_places_are_looked_up_in_rounds(spark, monkeypatch, k):
    monkeypatch.setattr(bf, "ROUND", 1)
    rnd = random.Random(k)
    parts = ["".join(rnd.choice("ACGT") for _ in range(90)) for _ in range(4)]
    seqs = {(f"g{n % 3}", f"c{n}"): "".join(x if rnd.random() < 0.6 else turned(x) for x in rnd.sample(parts, 3)) for n in range(6)}
    written, old = [], bf.Written.put
    monkeypatch.setattr(bf.Written, "put", lambda self, df: written.append(df.columns) or old(self, df))
    got = bf.unitig_blocks(frame(spark, seqs), k, 64).select("genome", "chr", "bstart", "bend", "sign").collect()
    assert sorted(map(tuple, got)) == sorted((g, c, s, e, x) for g, c, _, x, s, e in brute(seqs, k)) and got
    assert sum("edge" in c for c in written) == bf.PARTS
