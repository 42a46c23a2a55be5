import hashlib
import random
import re

import pyarrow as pa

from synframe.llm import decontaminate as D

DATA = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    """Covered words, and of each item the longest match as (length, document word, item word)."""
    w, covered, best = words(text), set(), {}
    for item, t in items:
        v = words(t)
        n = min(window, len(v))
        for j in range(len(v) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[j : j + n]:
                    covered |= set(range(p, p + n))
                    m = n
                    while p + m < len(w) and j + m < len(v) and w[p + m] == v[j + m]:
                        m += 1
                    key = (-m, p, j)
                    best[item or ""] = min(best.get(item or "", key), key)
    return len(w), covered, best


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    index = [(i, words(t)) for i, t in items]
    windows = {}
    for i, v in index:
        n = min(10, len(v))
        for j in range(len(v) - n + 1 if n else 0):
            windows.setdefault(tuple(v[j : j + n]), set()).add(i)
    want = []
    for r in docs:
        w, covered, held = words(r.text), set(), set()
        for n in {len(g) for g in windows}:
            for p in range(len(w) - n + 1):
                if (g := tuple(w[p : p + n])) in windows:
                    covered |= set(range(p, p + n))
                    held |= windows[g]
        want.append((r.doc_id, len(w), len(covered), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(covered)))
    got = sorted(tuple(r) for r in D.op13_decontaminate(spark, DATA).collect())
    assert got == sorted(want) and any(r[5] for r in got) and not all(r[5] for r in got)


def shard(texts, items, window=10, parts=1):
    hits = matches = None
    for k in range(parts):
        own = items[k::parts]
        n, hits, matches = D.search_shard(D.Items([i for i, _ in own], [t for _, t in own], window), pa.array(texts, pa.string()), hits, matches)
    return [(int(a), {x for h in b for x in range(h["start"], h["start"] + h["length"])}, {m["item_id"]: (-m["length"], m["doc_word"], m["item_word"]) for m in c}) for a, b, c in zip(n, hits.to_pylist(), matches.to_pylist(), strict=True)]


def test_random_texts_against_brute_force():
    rnd = random.Random(5)
    for trial in range(60):
        letters = "ab" if trial % 3 else "abcdefé"
        text = lambda most: rnd.choice([" ", ", ", "\n"]).join(rnd.choice(letters) for _ in range(rnd.randrange(most)))  # noqa: E731, B023
        items = [(str(k % 7), text(14)) for k in range(rnd.randrange(9))]
        texts = [None, "", "---", *[text(60) for _ in range(6)], *[items[k % len(items)][1] for k in range(2) if items]]
        window = rnd.choice([1, 3, 10])
        want = [brute(t, items, window) for t in texts]
        assert shard(texts, items, window) == want
        assert shard(texts, items, window, parts=3) == want


def test_matches_end_at_texts_and_short_items():
    texts = ["one two three", "four five six", "one two three four five six seven", "ONE, Two-three"]
    items = [("a", "three four"), ("b", "one two three four five six"), ("c", "x"), ("d", None), ("e", "..."), (None, "Two three")]
    got = shard(texts, items)
    assert got == [brute(t, items) for t in texts]
    assert got[0][2] == {"": (-2, 1, 0)} and got[1][2] == {} and set(got[2][2]) == {"a", "b", ""}


def test_portions_of_repeated_words(monkeypatch):
    monkeypatch.setattr(D, "GROWN", 50)
    items = [("a", "x " * 40), ("b", "x " * 12 + "y")]
    texts = ["x " * 100, "y " + "x " * 30 + "y", "x " * 9]
    assert shard(texts, items) == [brute(t, items) for t in texts]


def test_passes_over_blocks_and_extra_columns(spark):
    items = [(k, f"item number {k} has w{k} and nothing else but w{k} w{k + 1} at its end") for k in range(20)] + [(3, None), (None, "null item")]
    docs = [(k, f"start of it {items[k % 20][1]} rest" if k % 2 else "clean text", k, "z") for k in range(12)] + [(None, None, 0, None), (1, "a null item", 0, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, `n_words` int, `a.b``c` string")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, hits int")
    one = D.contamination(d, i)
    assert one.columns == ["doc_id", "n_words", "hits", "matches"]
    many = D.contamination(d, i, block_bytes=300)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(one) == rows(many)
    left = D.decontaminate(d, i, block_bytes=500)
    assert left.columns == d.columns and sorted(map(str, left.collect())) == sorted(str(r) for r in d.collect() if not brute(r.text, [(str(a) if a is not None else None, b) for a, b in items])[1])
    assert D.contamination(d.limit(0), i).count() == 0
    assert {len(r.hits) for r in D.contamination(d, i.limit(0)).collect()} == {0}
