"""The order check in parts against one fold over each scaffold."""

import random

import pytest
from synframe.operators import verify as ve
from synframe.operators.intervals import counts_before


def agrees(increasing, a, b):
    if a["chr"] != b["chr"]:
        return False
    if (a["position"] < b["position"]) == increasing:
        return True
    lo, hi = 0.2 * a["chr_len"], 0.8 * a["chr_len"]
    return a["start"] > hi and b["start"] < lo if increasing else a["start"] < lo and b["start"] > hi


def plain(rows):
    prev = prev_strands = increasing = None
    bad = strand = gaps = n = 0
    for sign, own in rows:
        if own is None or len(own) == 0:
            continue
        n += 1
        strands = [sign * x["strand"] for x in own]
        if prev is not None:
            error = increasing is not None and not any(agrees(increasing, a, b) for a in prev for b in own)
            if error:
                bad += 1
                increasing = None
            elif increasing is None and len(prev) == 1 and len(own) == 1:
                increasing = bool(own[0]["position"] > prev[0]["position"])
            want = 1 if increasing else -1
            if not error and prev_strands and not any(a == b == want for a in prev_strands for b in strands):
                strand += 1
                increasing = None
            gaps += min(abs(a["position"] - b["position"]) for a in prev for b in own) > 1
        prev, prev_strands = own, strands
    return n, bad, strand, gaps


@pytest.mark.parametrize("span", [2, 5, 1024])
def test_parts_against_one_fold(spark, span, monkeypatch):
    monkeypatch.setattr(ve, "SPAN", span)
    rnd = random.Random(span)
    order, hits, want = [], [], {}
    for s in range(12):
        rows, at = [], 0
        for i in range(rnd.randrange(1, 40)):
            name = f"s{s}c{i}"
            sign = rnd.choice([1, 1, 1, -1])
            at += rnd.choice([1, 1, 1, 2, -3]) if s % 2 else rnd.choice([-1, -1, -2, 4])
            own = []
            for _ in range(rnd.choice([0, 1, 1, 1, 2])):
                own.append({"position": at + rnd.choice([0, 0, 7]), "chr": rnd.choice(["a", "a", "a", "b"]), "strand": rnd.choice([1, 1, -1]), "start": rnd.randrange(1000), "chr_len": 1000})
            order.append((f"s{s}", i * 3, name, sign))
            hits += [(name, x["chr"], x["position"], x["strand"], x["start"], x["chr_len"]) for x in own]
            rows.append((sign, sorted(own, key=lambda x: (x["position"], x["chr"], x["strand"], x["start"]))))
        want[f"s{s}"] = plain(rows)
    o = spark.createDataFrame(order, "scf string, idx long, contig string, sign int")
    h = spark.createDataFrame(hits, "contig string, chr string, position long, strand int, start long, chr_len long")
    got = {r.scf: (r.contigs, r.misordered, r.misstranded, r.gaps) for r in ve.verify_order(o, h).collect()}
    assert got == want and sum(x[1] for x in want.values()) and sum(x[2] for x in want.values())
    assert ve.verify_order(o.limit(0), h).count() == 0


def test_counts_before_over_ranges(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice("abc"), i, rnd.randrange(5)) for i in range(300)]
    got = {(r.g, r.c): r.before for r in counts_before(spark.createDataFrame(rows, "g string, c long, n long"), ["g", "c"], "n").collect()}
    total, want = 0, {}
    for g, c, n in sorted(rows):
        want[g, c], total = total, total + n
    assert got == want
