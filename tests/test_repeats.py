import random

import pytest
from pyspark.sql import functions as F

from synframe.operators import adjacency as ad
from synframe.operators import filters as fl
from synframe.operators.matching import best_matching
from synframe.operators.phylogeny import VOID, leaves_depth_first, parsimony, rate
from synframe.operators.repeats import GAP, KEY, MATCH, REPEAT_MATCH, context_scores, contig_copies, match_profiles, resolve_repeats, split_by_instance
from synframe.plans.scaffolding import run_scaffolding
from synframe.sources.recipe import parse_newick

BLOCKS = "genome string, chr string, block_id long, sign int, bstart long, bend long"
TREE = "((t:1,r1:1):1,r2:1);"


def rows_of(genome, chr_, ids):
    return [(genome, chr_, abs(x), 1 if x > 0 else -1, 100 * i, 100 * i + 80) for i, x in enumerate(ids)]


def matched(spark, rows):
    b = spark.createDataFrame(rows, BLOCKS)
    r = fl.repeat_blocks(b)
    pure = fl.sequence_uniqueness(b, r).filter("genome = 't' and all_repeats")
    return b, match_profiles(ad.repeat_contexts(b, r), r, TREE, "t", repetitive=pure)


def test_absent_draft_is_void(spark):
    rows = [("r1", "c", 5, 10, 2, 1, [1, 2], [3]), ("t", "x", 5, 10, 2, 1, [1, 2], [3])]
    contexts = spark.createDataFrame(rows, "genome string, chr string, block_id long, bstart long, pos long, sign int, left array<long>, right array<long>")
    repeats = spark.createDataFrame([(5,)], "block_id long")
    tree = "(t:1,(r1:2,r2:1):1);"
    assert match_profiles(contexts, repeats, tree, "t").count() == 0
    got = match_profiles(contexts, repeats, tree, "t", drafts=["r2"]).collect()
    assert sorted((r.genome, r.kind, r.score) for r in got if r.score is not None) == [("t", "unique", 6.0)] and len(got) == 2


def test_all_repeat_contig_is_copied_for_every_profile(spark):
    ref = [1, 2, 9, 3, 4, 5, 6, -9, 7, 8]
    rows = [x for g in ("r1", "r2") for x in rows_of(g, "chr", ref)]
    rows += rows_of("t", "a", [1, 2]) + rows_of("t", "b", [3, 4, 5, 6]) + rows_of("t", "c", [7, 8]) + rows_of("t", "rep", [9])
    b, m = matched(spark, rows)
    assert sorted((r.genome, r.profile, r.kind, r.pos) for r in m.collect()) == [("r1", 0, "reference", 2), ("r1", 1, "reference", 7), ("r2", 0, "reference", 2), ("r2", 1, "reference", 7), ("t", 0, "repeat", 0), ("t", 1, "repeat", 0)]
    out = resolve_repeats(b, m, "t").collect()
    copies = sorted((r.chr, r.block_id, r.sign, r.origin) for r in out if r.genome == "t" and r.origin == "rep")
    assert copies == [("rep@1", 10, 1, "rep"), ("rep@2", 11, 1, "rep")]
    for g in ("r1", "r2"):
        own = [(r.block_id, r.sign) for r in sorted((r for r in out if r.genome == g), key=lambda r: r.bstart)]
        assert own == [(1, 1), (2, 1), (10, 1), (3, 1), (4, 1), (5, 1), (6, 1), (11, -1), (7, 1), (8, 1)]
    # the run places the contig twice
    seqs = b.groupBy("genome", "chr").agg((F.max("bend") + 20).alias("seq_len"))
    done = run_scaffolding(spark, {50: b}, seqs, "t", ["r1", "r2"], [], TREE, resolve_repeats=True)["contigs"]
    got = [(r.chr, r.sign) for r in done.orderBy("scf", "idx").collect()]
    want = [("a", 1), ("rep", 1), ("b", 1), ("rep", -1), ("c", 1)]
    assert got in (want, [(c, -s) for c, s in reversed(want)])


def test_unique_contexts_are_matched_but_not_copied(spark):
    ref = [1, 2, 9, 3, 4, 5, 6, 9, 7, 8]
    rows = [x for g in ("r1", "r2") for x in rows_of(g, "chr", ref)] + rows_of("t", "a", [1, 2, 9, 3]) + rows_of("t", "c", [5, 6, 9, 7])
    b, m = matched(spark, rows)
    assert sorted((r.profile, r.chr) for r in m.filter("kind = 'unique'").collect()) == [(0, "a"), (1, "c")]
    assert contig_copies(b, m, "t").count() == 0
    assert sorted(map(tuple, resolve_repeats(b, m, "t").drop("origin").collect())) == sorted(rows)


def test_twin_contexts_take_no_part(spark):
    ref = [1, 2, 9, 3, 4, 5, 6, 9, 7, 8]
    rows = [x for g in ("r1", "r2") for x in rows_of(g, "chr", ref)] + rows_of("t", "x", [9]) + rows_of("t", "y", [9]) + rows_of("t", "a", [1, 2, 3])
    assert matched(spark, rows)[1].filter("genome = 't'").count() == 0


def test_copies_need_agreeing_profiles():
    def m(pos, refs, sign=1):
        return {"pos": pos, "sign": sign, "refs": refs}

    a0, a1, a2 = (m(i, {"r": ("c", 10 + i, 1)}) for i in range(3))
    b0, b1 = (m(i, {"r": ("c", 30 - i, -1)}) for i in range(2))
    far, other = m(1, {"r": ("c", 99, 1)}), m(1, {"q": ("c", 11, 1)})
    assert split_by_instance([a0, a1, a2, b0, b1], 3) == [[a0, a1, a2], [b0, b1]]
    assert split_by_instance([a0, far, other], 2) == []
    assert split_by_instance([a0, b0], 1) == [[a0], [b0]]

# ---- the same by plain loops: whole repeats, one pair of contexts at a time --------------------------------------------


def plain_align(one: list[int], two: list[int], repeats: set[int], same_length: bool) -> int:
    n, m = len(one), len(two)
    row = [0 if not same_length else GAP * j for j in range(m + 1)]
    for i in range(1, n + 1):
        new = [0 if not same_length else GAP * i]
        for j in range(1, m + 1):
            a, b = one[i - 1], two[j - 1]
            unit = REPEAT_MATCH if abs(a) in repeats or abs(b) in repeats else MATCH
            new.append(max(row[j - 1] + (unit if a == b else -unit), row[j] + GAP, new[j - 1] + GAP))
        row = new
    return row[m]


def plain_score(a: dict, b: dict, repeats: set[int], same_length: bool) -> int:
    if not b["left"] and not b["right"]:
        return 0
    return plain_align(a["left"], b["left"], repeats, same_length) + plain_align(a["right"][::-1], b["right"][::-1], repeats, same_length)


def plain_mean(profile: list[dict], b: dict, repeats: set[int], same_length: bool) -> float:
    return sum(plain_score(x, b, repeats, same_length) for x in profile) / len(profile)


def plain_profiles(contexts, repeats, tree, target, drafts=()):
    tree = parse_newick(tree)
    mu, order = rate(tree), [g for g in leaves_depth_first(tree) if g != target]
    families, out = {}, []
    for c in contexts:
        families.setdefault(c["block_id"], []).append(c)

    def pairs(left, right, value):
        w = {(i, len(left) + j): -v for i, p in enumerate(left) for j, c in enumerate(right) if (v := value(p, c)) is not None}
        return [(a, b - len(left)) for a, b in best_matching(w)]

    def above(x):
        return x if x > 0 else None

    for own, rows in families.items():
        reps = {own, *({abs(x) for c in rows for x in c["left"] + c["right"]} & repeats)}
        by = {}
        for c in sorted(rows, key=lambda c: (c["genome"], c["chr"], c["bstart"])):
            by.setdefault(c["genome"], []).append(c)
        have = [g for g in order if g in by]
        profiles = [[c] for c in by[have[0]]] if have else []
        grown = [list(p) for p in profiles]
        for g in have[1:]:
            for i, j in pairs(profiles if False else grown, by[g], lambda p, c: above(plain_mean(p, c, reps, True))):
                grown[i].append(by[g][j])
        kept = []
        for p in profiles if False else grown:
            states = {g: True if any(c["genome"] == g for c in p) else VOID if g in drafts else False for g in order}
            if parsimony(tree, states | {target: True}, mu) < parsimony(tree, states | {target: False}, mu):
                kept.append(p)
        out += [(own, i, *(c[k] for k in KEY), "reference", None) for i, p in enumerate(kept) for c in p]
        mine = by.get(target, [])
        unique = [c for c in mine if not c["free"]]
        sides = [(c["left"], c["right"]) for c in mine if c["free"]]
        lone = [c for c in mine if c["free"] and sides.count((c["left"], c["right"])) == 1]
        value = {(i, len(kept) + j): v for i, p in enumerate(kept) for j, c in enumerate(unique) if (v := above(plain_mean(p, c, reps, False))) is not None}
        # there is a copy of each context of an all-repeat contig for every profile, so that each has its own best one
        best = {}
        for i, p in enumerate(kept):
            v, j = max(((plain_mean(p, c, reps, False), -j) for j, c in enumerate(lone)), default=(-1, 0))
            if v >= 0:
                best[i] = lone[-j]
                value[i, len(kept) + len(unique) + i] = v
        for i, j in best_matching({e: -v for e, v in value.items()}):
            c, kind = (unique[j - len(kept)], "unique") if j < len(kept) + len(unique) else (best[i], "repeat")
            out.append((own, i, *(c[k] for k in KEY), kind, value[i, j]))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_profiles_against_plain_loops(spark, seed):
    rnd = random.Random(seed)
    rows = []
    base = [rnd.choice([1, -1]) * x for x in rnd.sample(range(1, 40), 24)]
    for x in (50, 51, 52):
        for _ in range(3):
            base.insert(rnd.randrange(len(base)), rnd.choice([1, -1]) * x)
    for g in ("r1", "r2", "r3"):
        own = [x for x in base if rnd.random() < 0.9]
        for k, at in enumerate(range(0, len(own), 12)):
            rows += rows_of(g, f"c{k}", own[at : at + 12])
    own = [x for x in base if rnd.random() < 0.95]
    at = k = 0
    while at < len(own):
        n = rnd.randrange(1, 7)
        rows += rows_of("t", f"t{k}", own[at : at + n])
        at, k = at + n, k + 1
    rows += rows_of("t", "p1", [50]) + rows_of("t", "p2", [51, 52]) + rows_of("t", "p3", [-52, 50, 51])
    b = spark.createDataFrame(rows, BLOCKS)
    r = fl.repeat_blocks(b)
    repeats = {x.block_id for x in r.collect()}
    pure = fl.sequence_uniqueness(b, r).filter("genome = 't' and all_repeats")
    free = {x["chr"] for x in pure.collect()}
    contexts = ad.repeat_contexts(b, r)
    tree = "(((t:1,r1:1):1,r2:1):1,r3:2);"
    own = [c.asDict() | {"left": list(c["left"]), "right": list(c["right"]), "free": c["genome"] == "t" and c["chr"] in free} for c in contexts.collect()]
    drafts = ["r3"] if seed % 2 else []
    got = match_profiles(contexts, r, tree, "t", drafts=drafts, repetitive=pure)
    got = sorted((tuple(x[c] for c in ("block_id", "profile", *KEY, "kind", "score")) for x in got.collect()), key=str)
    assert got == sorted(plain_profiles(own, repeats, tree, "t", drafts), key=str) and len({x[-2] for x in got}) > 1
    scored = {(x.block_id, x.genome, x["chr"], x.bstart, x.qry, x.qry_start): x.score for x in context_scores(contexts, r, "t").collect()}
    want = {}
    for x in own:
        for y in own:
            if x["block_id"] == y["block_id"] and x["genome"] != "t" and y["genome"] == "t" and (v := plain_score(x, y, repeats, False)) > 0:
                want[x["block_id"], x["genome"], x["chr"], x["bstart"], y["chr"], y["bstart"]] = v
    assert scored == want


def test_a_large_family_falls_apart(spark):
    rows = []
    for k in range(600):
        rows += [("r1", f"c{k}", 7, 100, 1, 1, [1000 + k], [5000 + k]), ("t", f"t{k}", 7, 100, 1, 1, [1000 + k], [])]
    contexts = spark.createDataFrame(rows, "genome string, chr string, block_id long, bstart long, pos long, sign int, left array<long>, right array<long>")
    got = match_profiles(contexts, spark.createDataFrame([(7,)], "block_id long"), "(t:1,r1:1);", "t").collect()
    pair = {}
    for r in got:
        pair.setdefault(r.profile, set()).add(r["chr"][1:])
    assert len(pair) == 600 and all(len(x) == 1 for x in pair.values()) and len(got) == 1200


def test_groups_are_scored_together_as_they_are_alone():
    """Scores of many small groups come from one dynamic program; they are those of every group by itself."""
    import random

    from synframe.operators import repeats as rp

    rng, place = random.Random(5), {"g1": 0, "g2": 1, "g3": 2}
    side = lambda: [rng.choice([-3, -2, -1, 1, 2, 3, 4]) for _ in range(rng.randrange(6))]
    groups = []
    for _ in range(40):
        contexts = [{"genome": rng.choice(["g0", "g1", "g2", "g3"]), "left": side(), "right": side(), "head": True} for _ in range(rng.randrange(1, 8))]
        groups.append((contexts, set(rng.sample([1, 2, 3, 4], 2))))
    for (contexts, reps), table in zip(groups, rp._score_tables(groups, place, "g0"), strict=True):
        for i, x in enumerate(contexts):
            for j, y in enumerate(contexts):
                if x["genome"] != "g0" and (y["genome"] == "g0" or place[x["genome"]] < place[y["genome"]]):
                    assert table[i, j] == rp.scores([x], [y], reps, y["genome"] != "g0")[0, 0]
