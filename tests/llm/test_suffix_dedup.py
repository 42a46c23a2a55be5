import hashlib
import random
from collections import Counter

from synframe.llm.suffix_dedup import op1_suffix_dedup, removed_spans

DATA = "/root/testdata/sf0.001"


def brute(texts, size):
    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, size=400, ids=None):
    ids = ids or list(range(len(texts)))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, texts)], "doc_id long, text string, start int, kept string").repartition(5)
    out = removed_spans(df, size).collect()
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out)
    assert got == Counter((i, *b) for i, b in zip(ids, brute([(t or "").encode() for t in texts], size)))


def test_edges_periods_and_repeats(spark):
    rnd = random.Random(1)
    word = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    passage = word(450)
    near = word(1500)
    texts = [None, "", "short", passage + word(300), word(200) + passage, word(399) + passage + word(5) + passage, near, near[:700] + "Z" + near[701:], near, near, "a" * 1200, "ab" * 700, word(900), word(350) + passage[:395] + word(10)]
    texts += [passage[:400] + word(20), word(20) + passage[-400:], word(30) + passage[10:409] + word(30)]
    texts += [word(40) + passage[:380] + word(100) for _ in range(20)]
    check(spark, texts)


def test_repeated_rows_null_ids_and_same_ids(spark):
    rnd = random.Random(2)
    a, b = ("".join(rnd.choice("xyz") for _ in range(800)) for _ in range(2))
    check(spark, [a, a, b, a[:500], b[100:600], b], ids=[5, 5, 5, None, None, 7])


def test_empty_table(spark):
    assert removed_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: b for r, b in zip(docs, brute([(r.text or "").encode() for r in docs], 400))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op1_suffix_dedup(spark, DATA).collect()}
    assert got == want
    assert any(v[1] for v in want.values())


def test_crowded_contexts(spark, monkeypatch):
    from synframe.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "CROWD", 3)
    rnd = random.Random(7)
    word = lambda n: "".join(rnd.choice("abc ") for _ in range(n))
    quote, tail = word(300), word(150)
    texts = [word(rnd.randrange(150, 500)) + quote + word(rnd.randrange(150, 500)) for _ in range(25)]
    texts += [word(200) + quote + tail + word(100) for _ in range(6)] + [word(90) + quote + tail[:110] for _ in range(4)]
    check(spark, texts + [None, texts[0]])


def test_segments_name_windows_alike(monkeypatch):
    from synframe.llm import suffix_dedup

    rnd = random.Random(9)
    text = "".join(rnd.choice("abcé ") for _ in range(5000)).encode()

    def windows():
        ctx, _, _, start, count, dist = suffix_dedup.parts(text, 400)
        return sorted((s + i, c, d - i) for c, s, n, d in zip(ctx.tolist(), start.tolist(), count.tolist(), dist.tolist()) for i in range(n))

    whole = windows()
    assert [w[0] for w in whole] == list(range(len(text) - 399))
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    assert windows() == whole


def test_digests_tell_apart_what_polynomials_do_not():
    import numpy as np

    from synframe.llm.suffix_dedup import PrefixHash, digests

    a = bytes(97 + i.bit_count() % 2 for i in range(2048))
    b = bytes(195 - x for x in a)
    x, y = (PrefixHash(np.frombuffer(t, np.uint8)).of(np.array([0]), 2048)[0] for t in (a, b))
    assert x == y and a != b
    one = np.array([0]), np.array([2048]), np.array([3])
    assert digests(a, *one).tolist() != digests(b, *one).tolist()


def test_text_of_the_query_is_what_is_left(spark, tmp_path):
    rnd = random.Random(10)
    passage = "é" * 3 + "".join(rnd.choice("abc ") for _ in range(420))
    spark.createDataFrame([(1, passage + "x" * 50), (2, "ÿ" + passage), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text for r in op1_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: "x" * 50, 2: "ÿ", 3: ""}
