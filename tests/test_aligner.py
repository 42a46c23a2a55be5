"""Minimisers, segments and chains of contigs against references, against plain loops."""

import random

import pytest
from synframe.operators import aligner as al
from synframe.operators.lists import rank_lists

K, W, GAP = 5, 3, 40


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def plain_sketch(s, k=K, w=W):
    def value(i):
        f = s[i : i + k]
        if set(f) - set("ACGT"):
            return None
        c = min(f, turned(f))
        return int(c.translate(str.maketrans("ACGT", "0123")), 16) % al.PRIME * al.MULTIPLIER % al.PRIME, i

    n = len(s) - k + 1
    v = [value(i) for i in range(max(0, n))]
    out = set()
    for i in range(max(1, n - w + 1) if n > 0 else 0):
        own = [x for x in v[i : i + w] if x]
        if own:
            p = min(own)[1]
            f = s[p : p + k]
            out.add((min(f, turned(f)), p, 1 if f <= turned(f) else -1))
    return out


def plain_align(queries, refs, k=K, w=W, gap=GAP, most=9):
    rs = [(m, n, p, g) for n, s in refs.items() for m, p, g in plain_sketch(s, k, w)]
    diagonals = {}
    for qn, s in queries.items():
        for m, q, g in plain_sketch(s, k, w):
            same = [x for x in rs if x[0] == m]
            if len(same) <= most:
                for _, rn, r, g2 in same:
                    diagonals.setdefault((qn, rn, g * g2, r - g * g2 * q), []).append((r, q))
    groups = {}
    for (qn, rn, st, _), a in diagonals.items():
        a.sort()
        run = [a[0]]
        for x in [*a[1:], None]:
            if x is None or x[0] - run[-1][0] > gap:
                qs = [q for _, q in run]
                groups.setdefault((qn, rn, st), []).append((run[0][0], run[-1][0] + k, min(qs), max(qs) + k, len(run)))
                run = []
            run.append(x)
    out = []
    for (qn, rn, st), seg in groups.items():
        pos = [(rs_, re, qs if st > 0 else -qe, qe if st > 0 else -qs) for rs_, re, qs, qe, _ in seg]
        pred = {}
        for j, b in enumerate(pos):
            best = None
            for i, a in enumerate(pos):
                dr, dq = b[0] - a[1], b[2] - a[3]
                if a[0] < b[0] and a[1] < b[1] and a[2] < b[2] and a[3] < b[3] and max(dr, dq) <= gap and min(dr, dq) > -k:
                    key = (max(dr, dq) + abs(dr - dq), a[0], a[2], a[1], a[3], i)
                    best = min(best, key) if best else key
            if best:
                pred[j] = best
        succ = {}
        for j, (cost, *_, i) in pred.items():
            b = pos[j]
            key = (cost, b[0], b[2], b[1], b[3], j)
            succ[i] = min(succ.get(i, key), key)
        follows = {key[-1]: i for i, key in succ.items()}
        heads = {}
        for j in range(len(pos)):
            h = j
            while h in follows:
                h = follows[h]
            heads.setdefault(h, []).append(seg[j])
        out += [(qn, rn, st, min(x[0] for x in c), max(x[1] for x in c), min(x[2] for x in c), max(x[3] for x in c), sum(x[4] for x in c)) for c in heads.values()]
    return sorted(out)


def frame(spark, seqs):
    return spark.createDataFrame(list(seqs.items()), "name string, seq string")


@pytest.mark.parametrize("piece", [4, 16, 1024])
def test_sketch_against_windows(spark, piece):
    rnd = random.Random(3)
    seqs = {f"s{n}": "".join(rnd.choice("ACGTN" if n % 4 == 0 else "ACGT") for _ in range(n)) for n in [*range(1, 14), 15, 31, 32, 33, 200]}
    got = {(r["name"], r.kmer, r.pos, r.sign) for r in al.minimisers(frame(spark, seqs), K, W, piece).collect()}
    assert got == {(n, *x) for n, s in seqs.items() for x in plain_sketch(s)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chains_against_quadratic_search(spark, seed):
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    parts = [word(rnd.randrange(10, 60)) for _ in range(12)] + ["ACGACGACGACG"]
    refs = {f"r{i}": "".join(rnd.choices(parts, k=8)) for i in range(3)}
    queries = {}
    for i in range(6):
        s = list("".join(rnd.choices(parts, k=4)))
        for _ in range(4):
            p = rnd.randrange(len(s))
            s[p : p + rnd.choice([0, 1, 3])] = list(word(rnd.choice([0, 1, 2])))
        s = "".join(s)
        queries[f"q{i}"] = turned(s) if i % 2 else s
    got = sorted(tuple(r[c] for c in ("qry", "ref", "strand", "ref_start", "ref_end", "qry_start", "qry_end", "anchors")) for r in al.align(frame(spark, queries), frame(spark, refs), K, W, GAP, 9).collect())
    assert got == plain_align(queries, refs) and len(got) > 10


def test_no_rows_and_refused_k(spark):
    none = frame(spark, {"a": "ACGTACGT"}).limit(0)
    assert al.align(none, none, K, W).count() == 0
    with pytest.raises(ValueError, match="odd"):
        al.minimisers(none, 4)


def test_lists_are_ranked(spark):
    n = 1000
    rnd = random.Random(4)
    ids = rnd.sample(range(10**6), n)
    rows, want = [], {}
    for s, e in ((0, 1), (1, 3), (3, 500), (500, n)):
        for k in range(s, e):
            rows.append((ids[k], ids[k - 1] if k > s else None))
            want[ids[k]] = (ids[s], k - s)
    rnd.shuffle(rows)
    got = {r.id: (r.head, r["rank"]) for r in rank_lists(spark.createDataFrame(rows, "id long, prev long")).collect()}
    assert got == want


def test_sketch_holds_codes_and_reads_only_the_genomes_that_are_aligned(spark):
    """Seeds meet by codes in longs, cut batch by batch; genomes that no side of an alignment reads are not spelled out."""
    from synframe.plans import registry

    seqs = frame(spark, {"a": "ACGTTGCATGCCATNACGGTACCATGAACGT" * 3})
    assert dict(al._sketch(seqs, 5, 3).dtypes)["code"] == "bigint"
    got = registry.genome_sequences(spark, "/root/testdata/sf0.001", ("g0", "g1"))
    every = registry.genome_sequences(spark, "/root/testdata/sf0.001")
    assert sorted(got.collect()) == sorted(every.filter("genome in ('g0', 'g1')").collect()) and every.count() > got.count()
