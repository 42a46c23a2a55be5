import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from synframe.llm import periodic as P

DATA = "/root/testdata/sf0.001"


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if w[q:] == w[:-q] or q == len(w))


def brute(w, least=6, exponent=4):
    """By maximal stretches of each period, straight from the definition."""
    out = []
    for q in range(1, len(w) // exponent + 1):
        same = [w[i] == w[i + q] for i in range(len(w) - q)] + [False]
        i = 0
        while i < len(same):
            j = i
            while same[j]:
                j += 1
            n = j - i + q
            if j > i and n >= least and n >= exponent * q and smallest_period(w[i : i + n]) == q:
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def expected(doc_id, text):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    cols = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *cols, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(w, runs)))


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    df = P.op12_periodic_runs(spark, DATA)
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(expected(r.doc_id, r.text) for r in rows) and sum(r[1] > 0 for r in got) > 5


def found(texts, least=6, exponent=4):
    bounds = np.cumsum([0, *map(len, texts)])
    start, length, period = P.find_runs(np.array([x for t in texts for x in t], np.int64), bounds, least, exponent)
    of = np.searchsorted(bounds, start, "right") - 1
    return [[(int(s - bounds[t]), int(n), int(q)) for s, n, q, k in zip(start, length, period, of, strict=True) if k == t] for t in range(len(texts))]


def test_random_runs_against_brute_force():
    rnd = random.Random(1)
    for trial in range(300):
        texts = []
        for _ in range(rnd.randrange(1, 6)):
            t = []
            for _ in range(rnd.randrange(5)):
                piece = [rnd.randrange(rnd.choice([1, 2, 4])) for _ in range(rnd.randrange(1, 12))]
                t += piece * rnd.choice([1, 1, 2, 4, 5, 9]) + piece[: rnd.randrange(len(piece) + 1)]
            texts.append(t)
        assert found(texts) == [brute(t) for t in texts], trial
    assert found([[0, 1] * 20], exponent=5) == [[(0, 40, 2)]]
    with pytest.raises(ValueError, match="four"):
        found([[0]], exponent=3)


def test_wide_keys_and_sparse_levels(monkeypatch):
    rnd = random.Random(2)
    t = [rnd.randrange(10**6) for _ in range(3000)]
    t[500:500] = t[:70] * 6
    t[2000:2000] = [7] * 9
    want = [brute(t)]
    assert found([t]) == want and len(want[0]) == 2
    plain = P._grouped

    def wide(a, b, at, n):
        return plain(a, b, at, 1 << 40)

    monkeypatch.setattr(P, "_grouped", wide)
    assert found([t, [1] * 50]) == [want[0], [(0, 50, 1)]]


def test_one_long_periodic_text():
    period = [int(x) for x in np.random.default_rng(3).integers(0, 50, 1000)]
    t = period * 300
    assert found([t]) == [[(0, 300_000, smallest_period(t[:3000]))]]


def test_texts_nulls_and_names(spark):
    loop = "la li lu " * 5
    rows = [(1, loop + "end", 1), (2, None, 2), (3, "", 3), (4, " \t\n", 4), (None, "é é é é é é \u00a0x", 5), (1, loop + "end", 6), (7, "a  b\tc", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `runs.x``` int")
    got = {r.n_words: (r.runs, r.collapsed) for r in P.periodic_runs(df).collect()}
    assert [tuple(r) for r in got[16][0]] == [(0, 15, 3)] and got[16][1] == "la li lu end"
    assert [tuple(r) for r in got[7][0]] == [(0, 6, 1)] and got[7][1] == "é \u00a0x" and got[0] == ([], "")
    out = P.collapse_runs(df)
    assert out.columns == df.columns
    texts = {r[2]: r[1] for r in out.collect()}
    assert texts == {1: "la li lu end", 2: None, 3: "", 4: " \t\n", 5: "é \u00a0x", 6: "la li lu end", 7: "a  b\tc"}
    assert P.periodic_runs(df.limit(0)).count() == 0


def test_many_texts_of_one_batch():
    texts = pa.array(["x " * k for k in range(40)] + [None, "a b " * 30])
    n, runs, text = P._texts(texts, 6, 4)
    assert [len(r) for r in runs.to_pylist()] == [0] * 6 + [1] * 34 + [0, 1]
    assert text.to_pylist()[39] == "x" and text.to_pylist()[-1] == "a b" and text.to_pylist()[-2] == ""
