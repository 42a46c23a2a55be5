import math

import numpy as np

from synframe.llm.topk import block_bounds, exact_topk, inner_products, integer_vectors, op10_topk, quantise, scan

DATA = "/root/testdata/sf0.001"


def brute(rows, k=20):
    ok = [(i, np.array([math.floor(64 * float(x)) for x in v])) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 20 == 0:
            best = sorted((-int(a @ b), i) for i, b in ok if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def rows_of(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert rows_of(op10_topk(spark, DATA)) == brute(rows)


def test_ties_nulls_and_small_blocks(spark):
    rnd = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rnd.integers(-3, 4, 5) / 64]) for i in range(120)]
    rows += [(200, None), (220, [0.1, None, 0.0, 0.0, 0.0]), (240, [float("nan")] * 5), (260, [float("inf")] * 5), (None, [1.0] * 5), (280, [0.0] * 5)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    v = integer_vectors(df)
    got = rows_of(exact_topk(v, "vec_id % 20 = 0", k=7, block=16, query_block=3))
    assert got == brute(rows, 7)


def test_few_and_no_rows(spark):
    v = integer_vectors(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (20, [-1.0])], "vec_id long, embedding array<float>"))
    assert rows_of(exact_topk(v, "vec_id % 20 = 0")) == [(0, 1, 1, 8192), (0, 2, 20, -4096), (20, 1, 0, -4096), (20, 2, 1, -8192)]
    assert exact_topk(v.limit(0), "vec_id % 20 = 0").count() == 0


def test_bounds_hold_and_spare_exact_reads():
    rnd = np.random.default_rng(2)
    v = np.floor(64 * rnd.normal(size=(3000, 16))).astype(np.int64)
    v[7] *= 1 << 20
    rows = rnd.permutation(3000)
    exact = v[:9] @ v.T
    for bits in (8, 5, 2):
        cells, low, width = quantise(v, bits)
        base, down, up = block_bounds(v[:9], cells, low, width)
        assert (base + down[:, None] <= exact).all() and (exact <= base + up[:, None]).all()
        i, j, lower, upper = scan(rows[:9], v[:9], rows, rows, cells, low, width, 20)
        for x in range(9):
            want = sorted((-exact[x, y], rows[y], y) for y in range(3000) if y != x)[:20]
            assert {y for _, _, y in want} <= set(j[i == x].tolist())
    cells, low, width = quantise(np.delete(v, 7, 0), 8)
    i, j, _, _ = scan(rows[:5], v[:5], np.delete(rows, 7), np.delete(rows, 7), cells, low, width, 20)
    assert len(i) < 5 * 60


def test_every_width_of_cells(spark):
    rnd = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rnd.normal(size=6)]) for i in range(300)] + [(1000 + i, [0.5, 0.5, 0.0, 0.0, 0.0, 1.0]) for i in range(200)] + [(2000, [0.5, 0.25])]
    rows += [(2020, [1e7, -1e7, 0.0, 0.0, 3.0, 0.0])]
    v = integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4))
    want = brute([(i, x + [0.0] * (6 - len(x))) for i, x in rows], 5)
    for bits in (8, 4, 1):
        assert rows_of(exact_topk(v, "vec_id % 20 = 0", k=5, bits=bits, block=90, query_block=8)) == want


def test_scores_beyond_a_long():
    big = np.array([[1 << 62, 3]])
    assert inner_products(big, big).tolist() == [(1 << 63) - 1] and inner_products(big, -big).tolist() == [-(1 << 63)]
    assert inner_products(np.zeros((2, 0), np.int64), np.zeros((2, 0), np.int64)).tolist() == [0, 0]


def test_long_vectors_and_huge_components(spark):
    rows = [(i, [float(i % 7 - 3)] * 5000) for i in range(60)] + [(100, [3e30, -3e30]), (120, [1e300])]
    v = integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = rows_of(exact_topk(v, "vec_id % 20 = 0", k=3))
    assert len(got) == 5 * 3
    assert [r for r in got if r[0] == 0] == [(0, 1, 7, 5000 * 192 * 192), (0, 2, 14, 5000 * 192 * 192), (0, 3, 21, 5000 * 192 * 192)]


def test_repeated_rows(spark):
    v = integer_vectors(spark.createDataFrame([(20, [1.0]), (20, [1.0]), (3, [0.5])], "vec_id long, embedding array<float>"))
    assert rows_of(exact_topk(v, "vec_id % 20 = 0")) == [(20, 1, 20, 4096)] * 2 + [(20, 2, 3, 2048)] * 2
