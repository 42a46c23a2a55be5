import random

import xxhash

from synframe.llm.simhash import drop_near_duplicates, fingerprint, near_components, op8_simhash_neardup

DATA = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\x09\x0a\x0b\x0c\x0d":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute(rows, bits=4):
    fps = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        low[r] = min(x for x in (low.get(r), d) if x is not None) if (low.get(r), d) != (None, None) else None
    return sorted((d, f"{fps[i]:016x}", low[find(i)]) for i, (d, _) in enumerate(rows))


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in op8_simhash_neardup(spark, DATA).collect())
    assert got == brute(rows)
    assert len({g[2] for g in got}) < len(got)


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    h = spark.createDataFrame([("a b c é",)], "t string").select(F.xxhash64("t")).first()[0]
    assert h % (1 << 64) == xxhash.xxh64_intdigest("a b c é".encode(), 42)


def test_edge_rows(spark):
    rnd = random.Random(3)
    base = [rnd.choice(["alpha", "beta", "gam", "de", "É", "x"]) for _ in range(400)]
    rows = [(9, None), (8, ""), (7, " \t\n\x0b"), (6, "one"), (5, "ONE"), (4, "one two three four"), (4, "one two three four"), (3, "a b c d"), (2, " ".join(base)), (1, " ".join(base[:200] + ["new"] + base[200:])), (20, "w " * 20000)]
    rows += [(100 + i, " ".join(base[:i] + [f"u{i}"] + base[i + 1 :])) for i in range(0, 400, 5)]
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, fp string, component_id int").repartition(6)
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in near_components(df).collect())
    assert got == brute(rows)
    kept = {r.doc_id for r in drop_near_duplicates(df).collect()}
    assert kept == {c for _, _, c in got}


def test_fingerprint_counts_repeats_and_null_ids(spark):
    for t in ("a b c d a b c d a b c d", "A  b\rc", "é É", "x"):
        assert fingerprint(t.encode()) == plain_fingerprint(t)
    df = spark.createDataFrame([(None, "a b"), (None, "q r s"), (3, "a b")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in near_components(df).collect()), key=str)
    assert got == [(3, 3), (None, 3), (None, None)]
    assert near_components(df.limit(0)).count() == 0


def test_tally_counts_equal_positional_bytes():
    import numpy as np

    from synframe.llm.simhash import tally

    rnd = random.Random(12)
    pairs = [(rnd.randrange(1 << 64), rnd.randrange(1 << 64)) for _ in range(300)]
    pairs += [(a, a ^ sum(rnd.randrange(256) << 8 * p for p in range(8) if rnd.random() < 0.4)) for a, _ in pairs]
    want = [sum((a >> 8 * p) & 255 == (b >> 8 * p) & 255 for p in range(8)) for a, b in pairs]
    assert tally(np.array([a ^ b for a, b in pairs], np.uint64)).tolist() == want


def test_links_span_all_components_for_every_index_and_hot_lists(spark):
    from synframe.llm.simhash import links

    rnd = random.Random(13)
    fps = {rnd.randrange(1 << 64) for _ in range(60)}
    for base in list(fps)[:6]:
        for _ in range(40):
            x = base
            for p in rnd.sample(range(64), rnd.randrange(1, 7)):
                x ^= 1 << p
            fps.add(x)
    shared = rnd.randrange(1 << 32)  # one list of many that are no links
    fps |= {shared | rnd.randrange(1 << 32) << 32 for _ in range(150)}
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long").repartition(3)

    def groups(edges):
        g = {x: x for x in fps}

        def find(x):
            while g[x] != x:
                x = g[x]
            return x

        for a, b in edges:
            g[find(a)] = find(b)
        roots = {}
        for x in fps:
            roots.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, roots.values()))

    for bits in (0, 3, 4, 5):
        want = groups([(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= bits])
        for together, hot in ((1, 8192), (2, 30), (3, 8192), (3, 20), (4, 8192)):
            got = [(r.a % (1 << 64), r.b % (1 << 64)) for r in links(df, bits, together, hot).collect()]
            assert all((a ^ b).bit_count() <= bits for a, b in got)
            assert groups(got) == want
