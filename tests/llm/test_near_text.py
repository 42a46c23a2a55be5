import random

import corpus_pipeline as cp
from synframe.llm import simhash
from synframe.llm.near_text import text_components

DATA = "/root/testdata/sf0.001"


def brute(rows):
    sets, fps = [], []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
        fps.append(simhash.fingerprint((t or "").encode()))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            near = (fps[i] ^ fps[j]).bit_count() <= 4 or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])
            if near and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    return sorted((d, min(r[0] for r, h in zip(rows, group) if h == g)) for (d, _), g in zip(rows, group))


def near_copies():
    rnd = random.Random(11)
    rows, d = [], 0
    hot = " ".join(f"hot{i}" for i in range(9))
    for size in (12, 60, 300, 1500, 4000):
        for _ in range(6):
            base = [rnd.choice("abcdefgh") + str(rnd.randrange(300)) for _ in range(size)]
            for edits in (0, size // 100, size // 60, size // 45, size // 40, size // 35, size // 20):
                t = list(base)
                for i in rnd.sample(range(size), edits):
                    t[i] = f"new{d}"
                rows.append((d, hot + " " + " ".join(t)))
                d += 1
    return rows


def test_wide_bitmaps_never_differ_more_than_sets():
    import numpy as np

    from synframe.llm.near_text import WIDE, _apart, _wide

    rnd = np.random.default_rng(4)
    pool = np.unique(rnd.integers(0, 1 << 63, 9000).astype(np.uint64))
    for n, m, both in ((1500, 1400, 1300), (2000, 2500, 1800), (4090, 4100, 4000), (3000, 3000, 0), (WIDE, WIDE + 1, WIDE)):
        one, two = pool[:n], np.concatenate((pool[:both], pool[-(m - both) :]))
        assert _apart(_wide(one), _wide(two)) <= n + m - 2 * both
    assert 9 * _apart(_wide(pool[:3000]), _wide(pool[3000:6000])) > 6000 and _wide(pool[: WIDE - 1]) is None


def test_components_against_all_pairs(spark):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert sorted((r.doc_id, r.component_id) for r in text_components(df).collect()) == want
    by_print = {(r.doc_id, r.component_id) for r in simhash.near_components(df).collect()}
    assert len({c for _, c in want}) < len({c for _, c in by_print})


def test_stage_drops_near_copies_beyond_four_bits(spark):
    rows = near_copies()
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    df = spark.createDataFrame([(d, t, "en", "src0", len(t)) for d, t in rows], schema)
    assert {r.doc_id for r in cp.dedup_near(spark, df, DATA).collect()} == {c for _, c in brute(rows)}
