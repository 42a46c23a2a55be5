import hashlib
import random
import zlib

from synframe.llm.line_dedup import drop_repeated_lines, op7_line_dedup, patience, runs

DATA = "/root/testdata/sf0.001"


def increasing(pairs):
    """A longest subsequence of (i, j), sorted by i, whose j increase, by plain dynamic programming; of several the one that, read
    from its end, always takes the latest pair."""
    best = []
    for n, (_, j) in enumerate(pairs):
        best.append(max(((best[m][0] + 1, m) for m in range(n) if pairs[m][1] < j), default=(1, None)))
    out, n = [], max(range(len(pairs)), key=lambda n: (best[n][0], n)) if pairs else None
    while n is not None:
        out.append(pairs[n])
        n = best[n][1]
    return out[::-1]


def align(a, b, a0=0, b0=0):
    """Patience diff of two lists of lines, recursive and by the book."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(a0 + i, b0 + i) for i in range(head)] + [(a0 + len(a) - 1 - i, b0 + len(b) - 1 - i) for i in range(tail)]
    a, b, a0, b0 = a[head : len(a) - tail], b[head : len(b) - tail], a0 + head, b0 + head
    anchors = increasing([(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1])
    i0 = j0 = 0
    for i, j in [*anchors, (len(a), len(b))] if anchors else []:
        out += align(a[i0:i], b[j0:j], a0 + i0, b0 + j0)
        if i < len(a):
            out.append((a0 + i, b0 + j))
        i0, j0 = i + 1, j + 1
    return sorted(out)


def blocks_of(early, late, least):
    """Lines of ``late`` in aligned blocks of ``least`` words or more."""
    out, run = set(), []
    for i, j in [*align(early, late), (None, None)]:
        if run and (i is None or (i, j) != (run[-1][0] + 1, run[-1][1] + 1)):
            if sum(len(late[y].split()) for _, y in run) >= least:
                out |= {y for _, y in run}
            run = []
        run.append((i, j))
    return out


def brute(rows, min_words=10):
    """rows: (doc_id, text); the text left of every row after alignment with every earlier document. Shares no code with the operator."""
    key = lambda d, t: (d is None, d or 0, zlib.crc32((t or "").encode()))
    docs = {}
    for d, t in rows:
        docs[key(d, t)] = [(i, l.rstrip("\r")) for i, l in enumerate((t or "").split("\n")) if l.strip()]
    gone = {k: set() for k in docs}
    owners, done = {}, {}
    for k in sorted(docs):
        lines = [l for _, l in docs[k]]
        for f in sorted({f for l in lines for f in owners.get(l, ())}):
            pair = (tuple(l for _, l in docs[f]), tuple(lines))
            if pair not in done:
                done[pair] = blocks_of(list(pair[0]), lines, min_words)
            gone[k] |= {docs[k][y][0] for y in done[pair]}
        for l in set(lines):
            owners.setdefault(l, []).append(k)
    return [(d, t if t is None else "\n".join(l for i, l in enumerate(t.split("\n")) if i not in gone[key(d, t)]), len(gone[key(d, t)])) for d, t in rows]


def test_query_against_brute_force(spark):
    for data in (DATA, "/root/testdata/sf0.01"):
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
        want = sorted((d, n, hashlib.sha256(t.encode()).hexdigest()) for d, t, n in brute(rows))
        got = sorted((r.doc_id, r.deleted_lines, r.kept_sha256) for r in op7_line_dedup(spark, data).collect())
        assert got == want and any(g[1] for g in got)


def test_block_of_lines_that_others_own(spark):
    rnd = random.Random(3)
    one, two = (" ".join(f"{c}{rnd.randrange(10**6)}" for _ in range(6)) for c in "ab")
    rows = [(1, one), (2, two), (3, f"{one}\n{two}"), (4, f"x y\n{one}\n{two}\nz")]
    got = {r.doc_id: r.text for r in drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: one, 2: two, 3: f"{one}\n{two}", 4: "x y\nz"}


def test_patience_is_an_increasing_match():
    rnd = random.Random(5)
    for _ in range(300):
        a, b = ([rnd.randrange(9) for _ in range(rnd.randrange(14))] for _ in range(2))
        m = patience(a, b)
        assert all(a[i] == b[j] for i, j in m)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:]))
    assert patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]


def test_edges(spark):
    rnd = random.Random(6)
    line = lambda n=12: " ".join(rnd.choice(["aa", "bb", "cc", "dé", "e"]) + str(rnd.randrange(999)) for _ in range(n))
    common, block = line(), [line() for _ in range(5)]
    rows = [(i, "\n".join([line(), common, line()])) for i in range(30)]
    rows += [(40, "\n".join(block)), (41, "\n".join([line(), *block, line()])), (42, "\n".join(block)), (42, "\n".join(block)), (43, "\n".join(block[::-1])), (44, "\n\n".join(block) + "\r\n")]
    rows += [(50, None), (51, ""), (52, "\n \n"), (53, "short line"), (54, "short line"), (None, "\n".join(block[:2])), (55, "\n".join([block[0]] * 2000)), (56, "w " * 30000), (57, "w " * 30000)]
    df = spark.createDataFrame([(d, t, 5, "q") for d, t in rows], "doc_id long, text string, deleted_lines int, k string").repartition(5)
    got = sorted(((r.doc_id, r.text, r.deleted_lines) for r in drop_repeated_lines(df).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    left = {r[0]: r for r in got}
    assert left[42][1] == "" and left[54][2] == 0 and left[7][2] == 1 and left[0][2] == 0
    assert drop_repeated_lines(df.limit(0)).count() == 0


def test_blocks_of_every_earlier_document(spark):
    rnd = random.Random(8)
    own = iter(range(10**6))
    line = lambda n: " ".join(f"w{next(own)}" for _ in range(n))
    short, p1, p2 = [line(6) for _ in range(4)], [line(6) for _ in range(2)], [line(6) for _ in range(3)]
    rows = [(i, "\n".join([line(9), short[i - 1], line(9)])) for i in (1, 2, 3, 4)]
    rows += [(5, "\n".join([line(8), *short])), (6, "\n".join([*short, line(7)]))]  # (a)
    rows += [(11, "\n".join([*p1, line(5), *p2])), (12, "\n".join(p1)), (13, "\n".join([*p2, line(4), *p1]))]  # (b)
    pool = [line(rnd.choice([1, 3, 6, 12])) for _ in range(14)]
    rows += [(100 + i, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 9)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.text, r.deleted_lines) for r in drop_repeated_lines(df).collect())
    assert got == sorted(brute(rows))
    lost = {r[0]: r[2] for r in got}
    assert lost[6] == 4 and lost[13] == 5


def test_runs_cover_every_block():
    rnd = random.Random(9)
    for _ in range(300):
        w = [rnd.choice([1, 2, 6, 12]) for _ in range(rnd.randrange(1, 9))]
        a = rnd.randrange(len(w))
        b = rnd.randrange(a, len(w))
        inside = {x for i, j in runs(w, 10) if a <= i and j <= b for x in range(i, j + 1)}
        assert inside == (set(range(a, b + 1)) if sum(w[a : b + 1]) >= 10 else set())
