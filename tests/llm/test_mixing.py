from collections import defaultdict

import pytest

import xxhash
from pyspark.sql import functions as F

from synframe.llm.mixing import Targets, mix, op5_mix_sources, probabilities, rake, tokens_and_topic, unit

DATA = "/root/testdata/sf0.001"


def plain_rake(cells, marginals, sweeps=400):
    w = {k: v for k, v in cells.items() if v > 0}
    s = sum(w.values())
    w = {k: v / s for k, v in w.items()}
    for _ in range(sweeps):
        for d, m in enumerate(marginals):
            have = defaultdict(float)
            for k, v in w.items():
                have[k[d]] += v
            t = sum(m.get(x, 0) for x in have)
            w = {k: v * m.get(k[d], 0) / t / have[k[d]] for k, v in w.items()}
    return w


def test_rake_against_plain_loops():
    cells = {(a, b, c): float((i * 7 + j * 3 + k * 5) % 11 + 1) for i, a in enumerate("xyz") for j, b in enumerate("pq") for k, c in enumerate("01")}
    cells["x", "p", "0"] = 0.0
    m = [{"x": 0.5, "y": 0.3, "z": 0.2}, {"p": 0.6, "q": 0.4}, {"0": 0.1, "1": 0.9}]
    got, want = rake(cells, m), plain_rake(cells, m)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-8)
    for d, t in enumerate(m):
        for name, x in t.items():
            assert sum(v for k, v in got.items() if k[d] == name) == pytest.approx(x, abs=1e-8)
    ratio, scale = probabilities(cells, got, 0.5)
    assert sum(v * min(1, scale * ratio[k]) for k, v in cells.items()) == pytest.approx(0.5 * sum(cells.values()))
    assert rake({}, m) == {}


def plain_topic(text):
    """Signs of three sums over the long words, each word adding or subtracting by a bit of its hash."""
    words = [w for w in text.encode().lower().split() if len(w) >= 6]
    return str(sum((sum(1 if xxhash.xxh64_intdigest(w) >> b & 1 else -1 for w in words) > 0) << b for b in range(3)))


def test_query_against_brute_force(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = df.withColumn("u", unit(F.col("doc_id"), F.col("text"))).collect()
    words, topic, by_source = {}, {}, defaultdict(float)
    for r in rows:
        words[r.doc_id], topic[r.doc_id] = len(r.text.split()), plain_topic(r.text)
        by_source[r.source] += words[r.doc_id]
    assert len(by_source) == 20  # all of them are named
    target = {s: n**0.5 / sum(x**0.5 for x in by_source.values()) for s, n in by_source.items()}
    t = Targets()
    cls = {r.doc_id: (r.source, r.lang if r.lang in t.lang else "*", topic[r.doc_id]) for r in rows}
    cells = defaultdict(float)
    for d, c in cls.items():
        cells[c] += words[d]
    ratio, scale = probabilities(dict(cells), plain_rake(cells, [target, t.lang, t.topic], 500), 0.8)
    want = {r.doc_id: (*cls[r.doc_id], words[r.doc_id]) for r in rows if r.u < min(1, scale * ratio[cls[r.doc_id]])}
    got = op5_mix_sources(spark, DATA).collect()
    assert {r.doc_id: (r.source, r.lang, r.topic, r.tokens) for r in got} == want and 0 < len(want) < len(rows)
    for r in got:
        q = scale * ratio[cls[r.doc_id]]
        assert r.probability == pytest.approx(min(1, q), rel=1e-6) and r.weight * r.probability == pytest.approx(q, rel=1e-6)


def test_topic_follows_the_words():
    assert tokens_and_topic(b"") == (0, "0") and tokens_and_topic(" a\x0bb\u00a0c ".encode())[0] == 2
    a = " ".join(f"painting{i % 40} museum gallery" for i in range(300))
    assert tokens_and_topic(a.encode())[1] == tokens_and_topic((a + " painting3 stranger").encode())[1] == plain_topic(a)


def test_targets_out_of_reach_are_told():
    with pytest.warns(UserWarning, match="cannot all be met"):
        rake({("x", "p"): 1.0, ("y", "q"): 1.0}, [{"x": 0.9, "y": 0.1}, {"p": 0.1, "q": 0.9}])


def test_sample_share_nulls_and_clashes(spark):
    rows = [(i, f"word{i} " * 10, "en" if i % 2 else None, "src0" if i % 3 == 0 else None, 1, 2.0) for i in range(3000)] + [(None, None, None, None, 0, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens int, weight double")
    got = mix(df, Targets({"src0": 0.5, "*": 0.5}, {"en": 0.5, "*": 0.5}, {"*": 1}), rate=0.5).collect()
    assert sum(r.tokens for r in got) == pytest.approx(0.5 * 30000, rel=0.1)
    assert sum(r.tokens for r in got if r.source == "src0") == pytest.approx(0.25 * 30000, rel=0.15)
    again = mix(df.repartition(7), Targets({"src0": 0.5, "*": 0.5}, {"en": 0.5, "*": 0.5}, {"*": 1}), rate=0.5).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in again)
    assert mix(df.limit(0)).count() == 0
