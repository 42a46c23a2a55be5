"""Repeat resolution (survey I9, I10, D7, J28, J33)."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synframe.operators.components import connected_components
from synframe.operators.matching import best_matching
from synframe.operators.phylogeny import VOID, leaves_depth_first, parsimony, rate
from synframe.runtime import Written, shuffle_partitions
from synframe.sources.recipe import Tree, parse_newick

# Scores of a context alignment.
GAP = -2
MATCH, REPEAT_MATCH = 2, 1
KEY = ("genome", "chr", "bstart", "pos", "sign")
MATCHED = "block_id long, profile int, genome string, chr string, bstart long, pos long, sign int, kind string, score double"


FOUND = pa.schema([("block_id", pa.int64()), ("profile", pa.int32()), ("p_chr", pa.string()), ("p_start", pa.int64()), ("genome", pa.string()), ("chr", pa.string()), ("bstart", pa.int64()), ("pos", pa.int64()), ("sign", pa.int32()), ("kind", pa.string()), ("score", pa.float64())])

#: Contexts of one side in one matrix of scores.
SIDE = 1024


def padded(lists: list, far_first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Lists as rows of a matrix, and their lengths; ``far_first``: turned round, so that the far end comes first."""
    size = np.array([len(x) for x in lists], np.int64)
    out = np.zeros((len(lists), max(1, size.max(initial=0))), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x[::-1] if far_first else x
    return out, size


def align(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, repeats: np.ndarray, same_length: bool) -> np.ndarray:
    """Global alignment scores of all rows of ``a`` (lengths n) with all rows of ``b``, one matrix a cell of the dynamic program:
    match 2, mismatch -2 (1 and -1 if either is a repeat), gap -2; gaps at the far (first) end are free unless ``same_length``."""
    shape = (len(a), len(b))
    ra, rb = np.isin(np.abs(a), repeats), np.isin(np.abs(b), repeats)
    edge = GAP if same_length else 0
    row = [np.full(shape, edge * j) for j in range(b.shape[1] + 1)]
    out = np.zeros(shape, np.int64)
    for i in range(a.shape[1] + 1):
        if i:
            new = [np.full(shape, edge * i)]
            for j in range(1, b.shape[1] + 1):
                unit = np.where(ra[:, i - 1, None] | rb[None, :, j - 1], REPEAT_MATCH, MATCH)
                step = np.where(a[:, i - 1, None] == b[None, :, j - 1], unit, -unit)
                new.append(np.maximum(np.maximum(row[j - 1] + step, row[j] + GAP), new[j - 1] + GAP))
            row = new
        at = np.flatnonzero(n == i)
        for j in range(b.shape[1] + 1):
            own = np.flatnonzero(m == j)
            out[np.ix_(at, own)] = row[j][np.ix_(at, own)]
    return out


def scores(one: list[dict], two: list[dict], repeats: set[int], same_length: bool) -> np.ndarray:
    """Of all pairs, the sum over both sides; the right context is read from its far end. A second context without neighbours
    scores 0."""
    reps = np.array(sorted(repeats), np.int64)
    out = np.zeros((len(one), len(two)), np.int64)
    for p in range(0, len(one), SIDE):
        for q in range(0, len(two), SIDE):
            x, y = one[p : p + SIDE], two[q : q + SIDE]
            own = align(*padded([c["left"] for c in x], False), *padded([c["left"] for c in y], False), reps, same_length)
            own += align(*padded([c["right"] for c in x], True), *padded([c["right"] for c in y], True), reps, same_length)
            own[:, [not c["left"] and not c["right"] for c in y]] = 0
            out[p : p + SIDE, q : q + SIDE] = own
    return out


def mean_scores(profiles: list[list[dict]], two: list[dict], repeats: set[int], same_length: bool) -> np.ndarray:
    """Of all pairs of a profile and a context, the mean over the profile's members."""
    of = np.repeat(np.arange(len(profiles)), [len(p) for p in profiles])
    out = np.zeros((len(profiles), len(two)))
    np.add.at(out, of, scores([c for p in profiles for c in p], two, repeats, same_length))
    return out / np.array([len(p) for p in profiles])[:, None] if profiles else out


def _hubs(contexts: DataFrame) -> DataFrame:
    """``(id, hub)``: an inverted index of contexts (id, block_id, left, right, free): contexts can only score above 0 with one another
    if they share a member of one side, and at least 0 if each side is empty in one of them. A hub stands for such a meeting."""
    member = lambda c, side: F.transform(c, lambda x: F.xxhash64("block_id", F.lit(side), x))
    bare = F.when((F.size("left") == 0) | (F.size("right") == 0), F.array(F.xxhash64("block_id", F.lit("bare")))).otherwise(F.array().cast("array<bigint>"))
    empty = Window.partitionBy("block_id")
    whole = F.max((F.size("left") + F.size("right") == 0).cast("int")).over(empty) * F.max(F.col("free").cast("int")).over(empty)
    rows = contexts.withColumn("whole", whole)
    family = F.when(F.col("whole") > 0, F.array(F.xxhash64("block_id", F.lit("whole")))).otherwise(F.array().cast("array<bigint>"))
    return rows.select("id", F.explode(F.array_distinct(F.concat(member("left", "l"), member("right", "r"), bare, family))).alias("hub"))


def context_scores(contexts: DataFrame, repeats: DataFrame, target: str) -> DataFrame:
    """``(block_id, genome, chr, bstart, qry, qry_start, score)``: every context of a reference with every context of the target (on
    ``qry``) of the same repeat that it scores above 0 with, gaps at the far end being free. Pairs meet by the members they share; a batch of
    pairs is aligned at once."""
    kept = Written(contexts.sparkSession, "scores")
    c = kept.cut(contexts.withColumn("id", F.monotonically_increasing_id()))
    m = lambda df, k: df.select("block_id", F.col("id").alias(k), F.explode(F.array_distinct(F.concat(F.transform("left", lambda x: F.struct(F.lit("l").alias("side"), x.alias("x"))), F.transform("right", lambda x: F.struct(F.lit("r").alias("side"), x.alias("x")))))).alias("m"))
    mine = F.col("genome") == target
    pair = m(c.filter(~mine), "x").join(m(c.filter(mine), "y"), ["block_id", "m"]).select("x", "y").distinct()
    reps = repeats.select(F.col("block_id").alias("r")).distinct().withColumn("is", F.lit(True))
    flat = c.select("id", F.explode(F.array_distinct(F.transform(F.concat("left", "right"), lambda x: F.abs(x)))).alias("r")).join(reps, "r").groupBy("id").agg(F.collect_set("r").alias("reps"))
    c = kept.cut(c.join(flat, "id", "left").withColumn("reps", F.array_distinct(F.concat(F.coalesce("reps", F.array().cast("array<bigint>")), F.array("block_id")))))
    side = lambda k: c.select(F.col("id").alias(k), *[F.col(n).alias(f"{k}_{n}") for n in ("block_id", "genome", "chr", "bstart", "left", "right", "reps")])
    both = pair.join(side("x"), "x").join(side("y"), "y")

    def run(frames):
        for f in frames:
            got = _paired([f[k] for k in ("x_left", "x_right", "x_reps", "y_left", "y_right", "y_reps")])
            out = f[["x_block_id", "x_genome", "x_chr", "x_bstart", "y_chr", "y_bstart"]].set_axis(["block_id", "genome", "chr", "bstart", "qry", "qry_start"], axis=1)
            out["score"] = got
            yield out[out["score"] > 0]

    return both.mapInPandas(run, "block_id long, genome string, chr string, bstart long, qry string, qry_start long, score long")


def align_rows(a: np.ndarray, n: np.ndarray, ra: np.ndarray, b: np.ndarray, m: np.ndarray, rb: np.ndarray, edge: np.ndarray | int = 0) -> np.ndarray:
    """The dynamic program of ``align`` row by row, over pairs instead of all combinations: row i of ``a`` (repeats: ``ra``) with row i of
    ``b``; ``edge``: the score of a gap at the far end."""
    row, side = [np.zeros(len(a), np.int64) + edge * j for j in range(b.shape[1] + 1)], np.zeros(len(a), np.int64)
    for i in range(a.shape[1] + 1):
        if i:
            new = [np.zeros(len(a), np.int64) + edge * i]
            for j in range(1, b.shape[1] + 1):
                unit = np.where(ra[:, i - 1] | rb[:, j - 1], REPEAT_MATCH, MATCH)
                new.append(np.maximum(np.maximum(row[j - 1] + np.where(a[:, i - 1] == b[:, j - 1], unit, -unit), row[j] + GAP), new[j - 1] + GAP))
            row = new
        for j in range(b.shape[1] + 1):
            side = np.where((n == i) & (m == j), row[j], side)
    return side


def _flags(lists: list, repeats: list, turn: bool) -> np.ndarray:
    """Which members are repeats, padded as the lists are; ``repeats``: a set for each list."""
    return padded([[abs(x) in r for x in row] for row, r in zip(lists, repeats, strict=True)], turn)[0] > 0


def _paired(cols: list) -> np.ndarray:
    """Scores of contexts row by row, far ends free."""
    xl, xr, xreps, yl, yr, yreps = ([list(v) for v in c] for c in cols)
    xreps, yreps = list(map(set, xreps)), list(map(set, yreps))
    total = np.zeros(len(xl), np.int64)
    for one, two, turn in ((xl, yl, False), (xr, yr, True)):
        (a, n), (b, m) = padded(one, turn), padded(two, turn)
        total += align_rows(a, n, _flags(one, xreps, turn), b, m, _flags(two, yreps, turn))
    return total


#: Contexts of a group up to which its scores are made together with those of other groups, and rows of such a batch of groups.
SMALL, TOGETHER = 64, 4096


def _score_tables(groups: list[tuple[list[dict], set[int]]], place: dict[str, int], target: str) -> list[np.ndarray]:
    """A matrix for each group (contexts, repeats): the scores of its contexts with those of later genomes, both sides whole, and with the
    target's, far ends free. All pairs of all groups are aligned at once."""
    tables, flat, reps, x, y, edge, at = [np.zeros((len(cs), len(cs)), np.int64) for cs, _ in groups], [], [], [], [], [], []
    for k, (cs, r) in enumerate(groups):
        if any(c["head"] for c in cs):  # else there is no profile to match
            where = [place.get(c["genome"]) for c in cs]
            for i, p in enumerate(where):
                for j, q in enumerate(where):
                    mine = cs[j]["genome"] == target
                    if p is not None and (mine or q is not None and p < q) and (cs[j]["left"] or cs[j]["right"]):
                        x.append(len(flat) + i)
                        y.append(len(flat) + j)
                        edge.append(0 if mine else GAP)
                        at.append((k, i, j))
        flat += cs
        reps += [r] * len(cs)
    if at:
        x, y, edge = np.array(x), np.array(y), np.array(edge, np.int64)
        total = np.zeros(len(x), np.int64)
        for side, turn in (("left", False), ("right", True)):
            lists = [c[side] for c in flat]
            (v, n), f = padded(lists, turn), _flags(lists, reps, turn)
            total += align_rows(v[x], n[x], f[x], v[y], n[y], f[y], edge)
        for (k, i, j), s in zip(at, total.tolist(), strict=True):
            tables[k][i, j] = s
    return tables


def match_profiles(contexts: DataFrame, repeats: DataFrame, tree: Tree | str, target: str, legacy_profiles: bool = False, drafts: list[str] | tuple = (), repetitive: DataFrame | None = None) -> DataFrame:
    """J28 (1)-(4). Reference contexts are matched genome by genome into profiles, those kept that parsimony wants in the target (an
    absent draft is VOID), and the target's contexts matched to them: a context of a contig with a unique block once, with a score
    above 0; contexts of all-repeat contigs (``repetitive``: chr) without an identical twin as often as there are profiles, with a
    score of 0 or more. Contexts of a repeat that cannot meet by an index of their members never share a task: a group is a component of
    that index, and scores are made for all pairs of it at once. Rows of kind ``reference`` are the members of the kept profiles, those of kind
    ``unique`` and ``repeat`` the target's contexts matched to them; profiles of a repeat are numbered by their first contexts."""
    tree = parse_newick(tree) if isinstance(tree, str) else tree
    mu, order = rate(tree), [g for g in leaves_depth_first(tree) if g != target]
    kept_ = Written(contexts.sparkSession, "profiles")
    # the repeats that occur in a block's own contexts travel with it
    near = contexts.withColumn("near", F.array_distinct(F.transform(F.concat("left", "right"), lambda x: F.abs(x))))
    named = near.select("block_id", F.explode("near").alias("r")).distinct().join(repeats.select(F.col("block_id").alias("r")).distinct(), "r").groupBy("block_id").agg(F.collect_list("r").alias("reps"))
    rows = contexts.join(named, "block_id", "left").withColumn("free", F.lit(False))
    if repetitive is not None:
        mark = repetitive.select("chr", F.lit(target).alias("genome"), F.lit(True).alias("_f")).distinct()
        rows = rows.join(mark, ["genome", "chr"], "left").withColumn("free", F.coalesce("_f", F.lit(False))).drop("_f")
    # the genome that starts a repeat's profiles, and twins, are those of the whole repeat
    family = Window.partitionBy("block_id")
    place = F.coalesce(*[F.when(F.col("genome") == g, i) for i, g in enumerate(order)], F.lit(len(order)))
    rows = rows.withColumn("head", F.min(place).over(family) == place).withColumn("head", F.col("head") & (place < len(order)))
    rows = rows.withColumn("lone", F.col("free") & (F.count("*").over(Window.partitionBy("block_id", "genome", "free", "left", "right")) == 1))
    rows = kept_.cut(rows.withColumn("id", F.monotonically_increasing_id()))
    hubs = _hubs(rows).select("id", F.col("hub").bitwiseOR(1 << 62).alias("hub"))
    comp = connected_components(hubs, "id", "hub").select(F.col("node").alias("id"), "component")
    rows = rows.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))

    def pairs(left, right, value):
        w = {(int(i), len(left) + int(j)): -float(value[i, j]) for i, j in zip(*np.nonzero(value > 0), strict=True)}
        return [(a, b - len(left)) for a, b in best_matching(w)]

    def matched(own: int, reps: set[int], contexts: list[dict], table: np.ndarray | None) -> list[tuple]:
        """The rows of one group; ``table``: its scores, or None if they are made here."""
        by: dict[str, list] = {}
        for i, c in enumerate(contexts):
            by.setdefault(c["genome"], []).append(c | {"at": i})

        def means(profiles, two, same_length):
            if table is None:
                return mean_scores(profiles, two, reps, same_length)
            to = [c["at"] for c in two]
            return np.array([table[[c["at"] for c in p]][:, to].sum(0) / len(p) for p in profiles])

        have = [g for g in order if g in by]
        profiles = [[c] for g in have for c in by[g] if c["head"]]
        grown = [list(p) for p in profiles]
        for g in have:
            if profiles and not by[g][0]["head"]:
                for i, j in pairs(profiles, by[g], means(profiles if legacy_profiles else grown, by[g], True)):
                    grown[i].append(by[g][j])
        kept = []
        for p in profiles if legacy_profiles else grown:
            states = {g: True if any(c["genome"] == g for c in p) else VOID if g in drafts else False for g in order}
            if parsimony(tree, states | {target: True}, mu) < parsimony(tree, states | {target: False}, mu):
                kept.append(p)
        out = [(own, i, kept[i][0]["chr"], kept[i][0]["bstart"], *(c[k] for k in KEY), "reference", None) for i, p in enumerate(kept) for c in p]
        mine = by.get(target, [])
        unique, lone = [c for c in mine if not c["free"]], [c for c in mine if c["lone"]]
        value = {}
        if kept and unique:
            v = means(kept, unique, False)
            value = {(int(i), len(kept) + int(j)): float(v[i, j]) for i, j in zip(*np.nonzero(v > 0), strict=True)}
        # there is a copy of each context of an all-repeat contig for every profile, so that each has its own best one
        best = {}
        if kept and lone:
            v = means(kept, lone, False)
            for i, j in enumerate(v.argmax(1)):
                if v[i, j] >= 0:
                    best[i] = lone[j]
                    value[i, len(kept) + len(unique) + i] = float(v[i, j])
        for i, j in best_matching({e: -v for e, v in value.items()}):
            c, kind = (unique[j - len(kept)], "unique") if j < len(kept) + len(unique) else (best[i], "repeat")
            out.append((own, i, kept[i][0]["chr"], kept[i][0]["bstart"], *(c[k] for k in KEY), kind, value[i, j]))
        return out

    def settled(rows: list[dict]):
        """Rows of whole groups -> their matches."""
        groups = []
        for (own, _), g in groupby(rows, key=lambda r: (r["block_id"], r["component"])):
            g = sorted(g, key=lambda r: (r["genome"], r["chr"], r["bstart"]))
            groups.append((own, {own, *(g[0]["reps"] or ())}, g))
        small = [len(g) <= SMALL for _, _, g in groups]
        tables = iter(_score_tables([(g, r) for (_, r, g), s in zip(groups, small, strict=True) if s], {g: i for i, g in enumerate(order)}, target))
        out = [row for (own, r, g), s in zip(groups, small, strict=True) for row in matched(own, r, g, next(tables) if s else None)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), FOUND, strict=True)], schema=FOUND)

    def run(batches):
        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if len(held) >= TOGETHER and (held[-1]["block_id"], held[-1]["component"]) != (r["block_id"], r["component"]):
                    yield from settled(held)
                    held = []
                held.append(r)
        yield from settled(held)

    names = ["block_id", "component", "reps", *KEY, "left", "right", "free", "head", "lone"]
    # by number: groups are small beside the work they make, and Spark would put them into few tasks
    dealt = rows.select(*names).repartition(shuffle_partitions(rows.sparkSession), "block_id", "component").sortWithinPartitions("block_id", "component")
    found = dealt.mapInArrow(run, MATCHED.replace("genome string", "p_chr string, p_start long, genome string", 1))
    number = F.dense_rank().over(Window.partitionBy("block_id").orderBy("p_chr", "p_start")) - 1
    return found.withColumn("profile", number.cast("int")).drop("p_chr", "p_start")


def split_by_instance(matches: list[dict], size: int) -> list[list[dict]]:
    """J28 (5): matches of one contig of ``size`` blocks as copies of it. By position, a match extends the first copy whose last match
    agrees with it in chromosome, relative sign and shift of every genome that their profiles share. Copies of more than half of
    the contig's blocks stay. A match: pos, sign and refs {genome: (chr, pos, sign)}."""
    if size == 1:
        return [[m] for m in matches]

    def agree(a, b):
        both = a["refs"].keys() & b["refs"].keys()
        for g in both:
            (c1, p1, s1), (c2, p2, s2) = a["refs"][g], b["refs"][g]
            if c1 != c2 or a["sign"] * s1 != b["sign"] * s2 or (p2 - p1) * a["sign"] * s1 != b["pos"] - a["pos"]:
                return False
        return bool(both)

    groups: list[list[dict]] = []
    for pos in sorted({m["pos"] for m in matches}):
        left = [m for m in matches if m["pos"] == pos]
        for g in groups:
            nxt = next((m for m in left if agree(g[-1], m)), None)
            if nxt is not None:
                left.remove(nxt)
                g.append(nxt)
        groups += [[m] for m in left]
    return [g for g in groups if len(g) > size // 2]


def contig_copies(blocks: DataFrame, matched: DataFrame, target: str) -> DataFrame:
    """J28 (5): ``(chr, copy, pos, block_id, profile)``: the copies of all-repeat contigs and their matched blocks. One contig at a time."""
    refs = matched.filter("kind = 'reference'").groupBy("block_id", "profile").agg(F.collect_list(F.struct("genome", "chr", "pos", F.col("sign").alias("s"))).alias("refs"))
    size = blocks.filter(F.col("genome") == target).groupBy("chr").agg(F.count("*").alias("size"))
    rows = matched.filter("kind = 'repeat'").select("chr", "block_id", "profile", "pos", "sign").join(refs, ["block_id", "profile"]).join(size, "chr")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        found = []
        for b, p, pos, sign, own in sorted(f[["block_id", "profile", "pos", "sign", "refs"]].itertuples(index=False, name=None), key=lambda x: (x[2], x[0], x[1])):
            found.append({"block_id": b, "profile": p, "pos": pos, "sign": sign, "refs": {r["genome"]: (r["chr"], r["pos"], r["s"]) for r in own}})
        name = f["chr"].iloc[0]
        out = [(name, i, m["pos"], m["block_id"], m["profile"]) for i, g in enumerate(split_by_instance(found, int(f["size"].iloc[0])), 1) for m in g]
        return pd.DataFrame(out, columns=["chr", "copy", "pos", "block_id", "profile"])

    return rows.groupBy("chr").applyInPandas(run, "chr string, copy int, pos long, block_id long, profile int")


def resolve_repeats(blocks: DataFrame, matched: DataFrame, target: str) -> DataFrame:
    """J28 (6): the blocks with every copied contig replaced by its copies, named ``chr@copy``; ``origin`` is the contig's own name. The
    matched blocks of a copy get fresh ids above the largest in use, their instances in the references the same ones."""
    kept = Written(blocks.sparkSession, "repeats")
    blocks, matched = kept.cut(blocks.select("genome", "chr", "block_id", "sign", "bstart", "bend")), kept.cut(matched)
    copies = kept.cut(contig_copies(blocks, matched, target))
    # fresh ids are dense: ranks within buckets of contigs, after the counts of the buckets before
    top = blocks.agg(F.max("block_id").alias("top"))
    c = copies.withColumn("bucket", F.pmod(F.xxhash64("chr"), F.lit(256)))
    base = c.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("chr", "copy", "pos"))
    c = c.withColumn("r", rank).join(base.select("bucket", "base"), "bucket").crossJoin(F.broadcast(top))  # one row
    fresh = kept.cut(c.select("chr", "copy", "pos", "block_id", "profile", (F.col("top") + F.col("base") + F.col("r")).alias("new_id")))

    ref = matched.filter("kind = 'reference'").join(fresh.select("block_id", "profile", "new_id"), ["block_id", "profile"])
    mine = F.col("genome") == target
    others = blocks.filter(~mine).join(ref.select("genome", "chr", "bstart", "block_id", "new_id"), ["genome", "chr", "bstart", "block_id"], "left")
    others = others.select("genome", "chr", F.coalesce("new_id", "block_id").alias("block_id"), "sign", "bstart", "bend", F.col("chr").alias("origin"))
    w = Window.partitionBy("chr").orderBy("bstart", "block_id")
    own = blocks.filter(mine).withColumn("pos", (F.row_number().over(w) - 1).cast("long"))
    names = fresh.select("chr", "copy").distinct()
    same = own.join(names.select("chr").distinct(), "chr", "left_anti").select("genome", "chr", "block_id", "sign", "bstart", "bend", F.col("chr").alias("origin"))
    new = own.join(names, "chr").join(fresh.select("chr", "copy", "pos", "new_id"), ["chr", "copy", "pos"], "left")
    new = new.select("genome", F.concat("chr", F.lit("@"), "copy").alias("chr"), F.coalesce("new_id", "block_id").alias("block_id"), "sign", "bstart", "bend", F.col("chr").alias("origin"))
    return others.unionByName(same).unionByName(new)
