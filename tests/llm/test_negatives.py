import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from synframe.llm import negatives as N

DATA = "/root/testdata/sf0.001"


def brute(rows, anchor, positives=5, negatives=3, low=50, high=95):
    ok = [(i, lab, [math.floor(256 * float(x)) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for m, (a, lab, x) in enumerate(ok):
        if anchor(a):
            scored = [(sum(p * q for p, q in zip(x, y, strict=False)), i, other) for n, (i, other, y) in enumerate(ok) if n != m]
            scored.sort(key=lambda t: (-t[0], t[1]))
            for p, i, _ in [t for t in scored if t[2] == lab][:positives]:
                best = [t for t in scored if t[2] != lab and low * p <= 100 * t[0] <= high * p][:negatives]
                out += [(a, i, r + 1, t[1], p, t[0]) for r, t in enumerate(best)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, rows):
    return N.labelled_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), F.col("label"))


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = N.op11_hard_negatives(spark, DATA)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert rows_of(got) == brute(rows, lambda i: i % 50 == 0) and got.count()


@pytest.mark.parametrize("seed", [1, 2])
def test_small_blocks_leaves_and_clusters(spark, seed, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 4)
    monkeypatch.setattr(N, "BUCKETS", 2)
    monkeypatch.setattr(N, "BALLS", 5)
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, 8)) * 3
    rows = [(int(i), int(rnd.integers(4) if seed == 1 else i % 40), [float(x) for x in centres[i % 6] + rnd.normal(size=8) * 0.3]) for i in range(400)]
    rows += [(500 + i, 1, [0.5] * 8) for i in range(60)] + [(600, 2, [1.0]), (601, None, [1.0] * 8), (602, 1, None), (603, 1, [None] * 8), (None, 1, [1.0] * 8), (605, 1, [math.nan] * 8)]
    got = rows_of(N.hard_negatives(frame(spark, rows), "vec_id % 10 = 0", 4, 2, 30, 90, block=23, anchor_block=7))
    assert got == brute(rows, lambda i: i % 10 == 0, 4, 2, 30, 90) and got


def test_node_pairs_prune_groups():
    rnd = np.random.default_rng(4)
    v = np.concatenate([rnd.integers(-3, 4, (500, 6)) + c for c in np.array([[90, 0, 0, 0, 0, 0], [0, 90, 0, 0, 0, 0], [0, 0, -90, 0, 0, 0]])])
    ids, labels = np.arange(1500), np.repeat([0, 1, 1], 500)
    tree = N.Tree(ids, ids, labels, v)
    own = tree.rows
    assert sorted(own) == list(range(1500)) and (v[own] == tree.v).all()
    for (s, e, *_), ball in zip(tree.nodes, tree.balls, strict=True):
        assert (np.sqrt(((tree.f[s:e] - ball[:-1]) ** 2).sum(1)) <= ball[-1] + 1e-6).all()
    need, high = np.full((1500, 1), 7000), np.full((1500, 1), N.MOST)
    x, y, _ = N.leaf_pairs(tree, tree, False, need, high)
    assert not len(x)  # other labels score near zero: whole groups go without a score
    x, y, _ = N.leaf_pairs(tree, tree, True, need, high)
    leaves = (tree.nodes[:, 2] < 0).sum()
    assert 0 < len(x) < leaves * leaves / 2
    score = tree.v @ tree.v.T
    i, r, value, j = N.search(tree, tree, True, np.full((1500, 1), N.LEAST), high, np.full((1500, 1), N.LEAST), 3)
    for m in range(0, 1500, 97):
        want = sorted((-score[m, n], tree.ids[n]) for n in range(1500) if n != m and tree.labels[n] == tree.labels[m])[:3]
        assert sorted((-s, tree.ids[n]) for s, n in zip(value[i == m], j[i == m], strict=True)) == want


def test_intervals_hold():
    rnd = np.random.default_rng(5)
    for scale in (1, 1e9):
        a, c = rnd.normal(size=(2, 50, 7)) * scale
        ra, rc = rnd.random((2, 50)) * scale
        low, high = N.intervals(a, ra, c, rc)
        for _ in range(50):
            p, q = rnd.normal(size=(2, 50, 7))
            p *= (ra * rnd.random(50) / np.linalg.norm(p, axis=1))[:, None]
            q *= (rc * rnd.random(50) / np.linalg.norm(q, axis=1))[:, None]
            s = ((a + p) * (c + q)).sum(1)
            assert (low <= s).all() and (s <= high).all()


def test_scores_beyond_exact_doubles():
    a = np.array([[1 << 30, 3], [-(1 << 62), 5]])
    assert N.exact_scores(a[:1], a[:1], a[:1].astype(float), a[:1].astype(float)).tolist() == [[(1 << 60) + 9]]
    assert N.exact_scores(a, a, a.astype(float), a.astype(float)).tolist()[1] == [-N.MOST - 1, N.MOST]


def test_few_rows_ties_and_repeats(spark):
    rows = [(0, 1, [1.0]), (0, 1, [1.0]), (3, 1, [1.0]), (4, 2, [0.75]), (5, 2, [0.75]), (6, 2, [0.5]), (7, 3, [0.75]), (8, 2, [-1.0]), (50, 9, [1.0])]
    got = rows_of(N.hard_negatives(frame(spark, rows), "vec_id % 50 = 0"))
    assert got == brute(rows, lambda i: i % 50 == 0) and (0, 0, 1, 4, 65536, 49152) in got
    assert rows_of(N.hard_negatives(frame(spark, rows).limit(0), "vec_id % 50 = 0")) == []
    assert rows_of(N.hard_negatives(frame(spark, rows), "vec_id = 50")) == []
    assert rows_of(N.hard_negatives(frame(spark, rows), "vec_id = 1")) == []
