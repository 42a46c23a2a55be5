"""Blocks found in sequences, against a plain de Bruijn graph."""

import random

import pytest

from synframe.operators import blockfinder as bf
from synframe.operators.kmers import canonical, kmer, pieces
from synframe.plans import registry
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def brute(seqs, k):
    """Stretches of k-mers in which every step is the only way on, on both sides, wherever its nodes occur; those that occur twice."""
    walk = {}
    for (g, c), s in seqs.items():
        row = []
        for i in range(len(s) - k + 1):
            f = s[i : i + k]
            ok = set(f) <= set("ACGT")
            row.append((min(f, turned(f)), 1 if f <= turned(f) else -1) if ok else None)
        walk[g, c] = row
    near, count = {}, {}
    for row in walk.values():
        for i, x in enumerate(row):
            if x:
                count[x[0]] = count.get(x[0], 0) + 1
                for j, d in ((i + 1, 1), (i - 1, -1)):
                    y = row[j] if 0 <= j < len(row) else None
                    near.setdefault((x[0], d * x[1]), set()).add(y and (y[0], -d * y[1]))
    joined = lambda x, y: near[x] == {y} and near[y] == {x} and x[0] != y[0]
    out = []
    for (g, c), row in walk.items():
        i = 0
        while i < len(row):
            if not row[i]:
                i += 1
                continue
            j = i
            while j + 1 < len(row) and row[j + 1] and joined((row[j][0], row[j][1]), (row[j + 1][0], -row[j + 1][1])):
                j += 1
            if count[row[i][0]] > 1:
                name, sign = min(row[i : j + 1])
                out.append((g, c, int(name.translate(str.maketrans("ACGT", "0123")), 16) + 1, sign, i, j + k))
            i = j + 1
    return sorted(out)


def frame(spark, seqs):
    return spark.createDataFrame([(g, c, s) for (g, c), s in seqs.items()], "genome string, chr string, seq string")


def test_pieces_cover_every_kmer(spark):
    s = "ACGTTGCAnACCAGTTGACC"
    p = pieces(frame(spark, {("g", "c"): s}), 1, 5, 4)
    got = p.select("at", "size", F.col("p").cast("string").alias("p")).collect()
    assert sorted((r["at"], r["size"], r["p"]) for r in got) == [(a, 20, s.upper()[max(0, a - 1) : a + 9]) for a in range(0, 20, 4)]
    k = p.filter("at = 8").select(kmer(F.col("p"), F.lit(0), 5).alias("a"), kmer(F.col("p"), F.lit(2), 5).alias("b"), canonical(F.lit("TTG"))[1].alias("c")).first()
    assert tuple(k) == (None, "ACCAG", -1)


@pytest.mark.parametrize("piece", [7, 64, 8192])
def test_paths_against_brute_force(spark, piece):
    rnd = random.Random(piece)
    parts = ["".join(rnd.choice("ACGT") for _ in range(rnd.choice([3, 20, 60]))) for _ in range(8)] + ["A" * 12, "ACACACACAC", "N"]
    seqs = {}
    for n in range(9):
        s = "".join(x if rnd.random() < 0.7 else turned(x).replace("N", "N") for x in rnd.sample(parts, 6))
        seqs[f"g{n % 3}", f"c{n}"] = s
    seqs["g0", "x"], seqs["g0", "y"], seqs["g1", "empty"] = parts[0] * 3, "ACG", ""
    got = sorted(tuple(r) for r in bf.unitig_blocks(frame(spark, seqs), 5, piece).collect())
    assert got == brute(seqs, 5) and got


def test_longer_kmers_and_refused_ones(spark):
    rnd = random.Random(1)
    s = "".join(rnd.choice("ACGT") for _ in range(200))
    seqs = {("a", "1"): s, ("b", "1"): "TTTT" + turned(s)}
    got = bf.unitig_blocks(frame(spark, seqs), 21).collect()
    assert sorted((r.genome, r.bstart, r.bend) for r in got) == [("a", 0, 200), ("b", 4, 204)] and len({r.block_id for r in got}) == 1 and {r.sign for r in got} == {1, -1}
    with pytest.raises(ValueError, match="odd"):
        bf.unitig_blocks(frame(spark, seqs), 4)
    assert bf.unitig_blocks(frame(spark, seqs).limit(0), 5).count() == 0


def test_passes_join_blocks_over_single_differences(spark):
    rnd = random.Random(2)
    base = ["".join(rnd.choice("ACGT") for _ in range(400)) for _ in range(3)]
    changed = [b[:200] + ("A" if b[200] != "A" else "C") + b[201:] for b in base]
    seqs = {("a", "1"): "".join(base), ("b", "1"): changed[0] + turned(changed[2]) + changed[1]}
    fine = bf.unitig_blocks(frame(spark, seqs), 15)
    assert fine.filter("genome = 'a'").count() == 6  # each stretch is cut where one letter differs
    found = bf.find_blocks(frame(spark, seqs), [100], 15)[100].collect()
    per = {}
    for r in found:
        per.setdefault(r.block_id, []).append((r.genome, r.sign, r.bend - r.bstart))
    assert len(per) == 3 and all(len(x) == 2 and min(n for *_, n in x) > 370 for x in per.values())
    assert sum(len({s for _, s, _ in x}) == 2 for x in per.values()) == 1


def test_found_blocks_of_the_fixture_feed_the_graph(spark):
    assert registry.QUERIES["sequence_scaffolds"](spark, DATA).count() > 0
