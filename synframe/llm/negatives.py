"""Hard-negative mining by dual-tree search (operator 11).

An anchor's positives are the ``positives`` rows of its label that score highest with it (integer inner product; ties: smaller vec_id). For
each positive the hard negatives are the ``negatives`` highest rows of other labels that score between ``low`` and ``high``
percent of the positive's score.

1. *Blocks.* Planes fitted to a bounded sample (``SAMPLE`` rows) cut the space into leaves; a leaf and a bucket of labels are a cell, and a
   cell is dealt to blocks of bounded size by a hash. A poor sample costs time and no result. Anchors have blocks of their own.
2. *Trees.* A block is one row: its vectors in the order of a tree of balls (centre and radius), labels apart where they are frequent.
3. *Node pairs.* The inner products of a ball of anchors with a ball of candidates lie in an interval. A pair of nodes goes, with all its
   anchors at once, if the interval misses what each of the anchors still asks for: scores at or above its kth best so far, within its
   bands. Pairs of whole blocks are judged first, so that most blocks never travel; pairs of leaves that remain are scored exactly,
   the most promising first.
4. *Rounds.* The blocks of an anchor block's own cell come first and set the bar for all others; then the rest. Both for positives
   and, once those are certain, for negatives. Only the k best of a request leave a pair of blocks.

Intervals are widened by the rounding error; scores are exact integers, beyond a long set to its greatest or least value.

Rows with a null label, a null vector, a null or non-finite component or a null vec_id take no part. A shorter vector counts as
padded with zeros. Repeated vec_ids are separate rows: each is an anchor of its own and a candidate of the other. An anchor
without a positive, or a positive without a negative in its band, gives no row; so does an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from synframe.llm.topk import MOST, _matrix
from synframe.runtime import Written, bound_text_batches, lean, shuffle_partitions

SCALE = 256
#: Bytes of vectors in a block of candidates, anchors in a block, rows in a leaf of a tree.
BLOCK_BYTES, ANCHORS, LEAF = 1 << 21, 512, 64
#: Rows of the sample to which planes are fitted, most leaves they make, and buckets of labels.
SAMPLE, LEAVES, BUCKETS = 2048, 1024, 16
#: Candidate blocks whose balls are broadcast at once, and node pairs judged at once.
BALLS, PAIRS = 8192, 1 << 15
LEAST = -MOST - 1
BLOCK = "rows binary, ids binary, labels binary, v binary, nodes binary, balls binary"


def labelled_vectors(emb: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """``(vec_id, label, v)``: v = floor(scale x) of every usable vector."""
    x = F.transform(F.col("embedding"), lambda a: a.cast("double"))
    bad = F.exists(x, lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf")))
    ok = emb.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).filter(~bad)
    return ok.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(x, lambda a: F.floor(a * scale)).alias("v"))


def planes(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Median planes across the direction of greatest spread, as a heap: row i has its halves at 2i and 2i + 1."""
    w, t = np.zeros((1 << depth, sample.shape[1])), np.zeros(1 << depth)
    own = {1: sample.astype(float)}
    for i in range(1, 1 << depth):
        x = own.pop(i)
        if len(x) > 1:
            d = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][0]
            w[i], t[i] = d, np.median(x @ d)
        right = x @ w[i] > t[i]
        own[2 * i], own[2 * i + 1] = x[~right], x[right]
    return w, t


def leaf_of(v: np.ndarray, w: np.ndarray, t: np.ndarray) -> np.ndarray:
    at = np.ones(len(v), np.int64)
    while len(at) and at[0] < len(w):
        at = 2 * at + (np.einsum("ij,ij->i", v, w[at]) > t[at])
    return at - len(w)


class Tree:
    """Vectors of a block in tree order. Nodes: first row, end, left child, right child (-1: a leaf), 1 if all rows have one label."""

    def __init__(self, rows, ids, labels, v, nodes=None, balls=None):
        self.rows, self.ids, self.labels, self.v = rows, ids, labels, v
        self.nodes, self.balls = nodes, balls
        if nodes is None:
            self._grow()
        self.f = self.v.astype(float)
        self.centre, self.radius = self.balls[:, :-1], self.balls[:, -1]
        self.norm = np.sqrt((self.centre**2).sum(1))
        inner = self.nodes[:, 2:4]
        self.roots = np.setdiff1d(np.arange(len(self.nodes)), inner[inner >= 0])

    def _grow(self):
        names, number, size = np.unique(self.labels, return_inverse=True, return_counts=True)
        f = self.v.astype(float)
        groups = [np.flatnonzero(number == k) for k in np.flatnonzero(size >= LEAF)]
        rest = np.flatnonzero(size[number] < LEAF)
        order, nodes, balls = [], [], []

        def node(own: np.ndarray, first: int) -> int:
            me = len(nodes)
            x = f[own]
            centre = x.mean(0)
            radius = np.sqrt(((x - centre) ** 2).sum(1).max()) * (1 + 1e-9)
            nodes.append([first, first + len(own), -1, -1, int((self.labels[own] == self.labels[own[0]]).all())])
            balls.append(np.append(centre, radius))
            if len(own) <= LEAF or not radius:
                order.append(own)
            else:
                axis = x.var(0).argmax()
                own = own[np.argsort(x[:, axis], kind="stable")]
                half = len(own) // 2
                left = node(own[:half], first)
                nodes[me][2:4] = left, node(own[half:], first + half)
            return me

        first = 0
        for own in [*groups, *([rest] if len(rest) else [])]:
            node(own, first)
            first += len(own)
        order = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.rows, self.ids, self.labels, self.v = (x[order] for x in (self.rows, self.ids, self.labels, self.v))
        self.nodes, self.balls = np.array(nodes, np.int64).reshape(-1, 5), np.array(balls).reshape(len(nodes), -1)


def intervals(a: np.ndarray, ra: np.ndarray, c: np.ndarray, rc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner products between two balls, row by row."""
    na, nc = np.sqrt((a * a).sum(1)), np.sqrt((c * c).sum(1))
    spread = na * rc + nc * ra + ra * rc
    spread += (na + ra) * (nc + rc) * (a.shape[1] + 8) * 2.0**-50
    middle = np.einsum("ij,ij->i", a, c)
    return middle - spread, middle + spread


def exact_scores(a: np.ndarray, c: np.ndarray, fa: np.ndarray, fc: np.ndarray) -> np.ndarray:
    """All inner products, as longs."""
    most = float((np.abs(fa).max(0, initial=0) * np.abs(fc).max(0, initial=0)).sum())
    if most < 2.0**53:
        return (fa @ fc.T).astype(np.int64)
    if most < 2.0**62:
        return a @ c.T
    return np.clip(a.astype(object) @ c.T.astype(object), LEAST, MOST).astype(np.int64)


def leaf_pairs(a: Tree, c: Tree, same: bool, need: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor leaf, candidate leaf, upper bound)`` of the pairs that no node pair above them rules out."""
    low = np.array([need[s:e].min() for s, e in a.nodes[:, :2]], float)
    top = np.array([high[s:e].max() for s, e in a.nodes[:, :2]], float)
    label_a, label_c = a.labels[a.nodes[:, 0]], c.labels[c.nodes[:, 0]]
    x, y = (g.ravel() for g in np.meshgrid(a.roots, c.roots, indexing="ij"))
    todo, out = [(x[k : k + PAIRS], y[k : k + PAIRS]) for k in range(0, len(x), PAIRS)], []
    while todo:
        x, y = todo.pop()
        least, most = intervals(a.centre[x], a.radius[x], c.centre[y], c.radius[y])
        pure = (a.nodes[x, 4] & c.nodes[y, 4]).astype(bool)
        ok = (most >= low[x]) & (least <= top[x]) & ~(pure & ((label_a[x] != label_c[y]) if same else (label_a[x] == label_c[y])))
        x, y, most = x[ok], y[ok], most[ok]
        at_a, at_c = a.nodes[x, 2] < 0, c.nodes[y, 2] < 0
        leaf = at_a & at_c
        out.append((x[leaf], y[leaf], most[leaf]))
        split_c = ~leaf & ~at_c & (at_a | (c.radius[y] * a.norm[x] >= a.radius[x] * c.norm[y]))
        split_a = ~leaf & ~split_c
        u = np.concatenate((x[split_c], x[split_c], a.nodes[x[split_a], 2], a.nodes[x[split_a], 3]))
        w = np.concatenate((c.nodes[y[split_c], 2], c.nodes[y[split_c], 3], y[split_a], y[split_a]))
        todo += [(u[k : k + PAIRS], w[k : k + PAIRS]) for k in range(0, len(u), PAIRS)]
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, np.int64),) * 3


def _best(i: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the k best of their anchor."""
    order = np.lexsort((ids, -score.astype(float), i)) if len(score) and np.abs(score.astype(float)).max() < 2.0**53 else np.lexsort((ids, ~score, i))
    i = i[order]
    return order[np.arange(len(i)) - np.searchsorted(i, i) < k]


def search(a: Tree, c: Tree, same: bool, low: np.ndarray, high: np.ndarray, need: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """``(anchor, request, score, candidate)``: of each request (a column of ``low``, ``high`` and ``need``) of each anchor the k best
    candidates of the block, of the anchor's label or of others, that score from ``low`` to ``high`` and at least ``need``."""
    bar = np.maximum(low, need)
    x, y, most = leaf_pairs(a, c, same, bar, high)
    out: list[tuple[np.ndarray, ...]] = []
    for leaf in np.unique(x):
        s, e = a.nodes[leaf, :2]
        mine = np.flatnonzero(x == leaf)
        mine = mine[np.argsort(-most[mine], kind="stable")]
        found = [(np.zeros(0, np.int64),) * 3 for _ in range(low.shape[1])]
        done, size = 0, 2
        while done < len(mine):
            part = mine[done : done + size]
            done, size = done + size, size * 2
            part = part[most[part] >= bar[s:e].min()]
            if not len(part):
                break
            at = np.concatenate([np.arange(*c.nodes[j, :2]) for j in y[part]])
            score = exact_scores(a.v[s:e], c.v[at], a.f[s:e], c.f[at])
            able = (a.labels[s:e, None] == c.labels[at]) == same
            able &= a.rows[s:e, None] != c.rows[at]
            for r in range(low.shape[1]):
                ok = able & (score >= bar[s:e, r, None]) & (score <= high[s:e, r, None])
                if len(at) > k:
                    kth = np.partition(np.where(ok, score, LEAST), len(at) - k, axis=1)[:, len(at) - k]
                    ok &= score >= kth[:, None]
                i, j = np.nonzero(ok)
                i, value, j = (np.concatenate(z) for z in zip(found[r], (i, score[i, j], at[j]), strict=True))
                keep = _best(i, value, c.ids[j], k)
                found[r] = i, value, j = i[keep], value[keep], j[keep]
                full = np.flatnonzero(np.bincount(i, minlength=e - s) >= k)
                if len(full):
                    worst = np.full(e - s, MOST)
                    np.minimum.at(worst, i, value)
                    bar[s + full, r] = np.maximum(bar[s + full, r], worst[full])
        for r, (i, value, j) in enumerate(found):
            out.append((i + s, np.full(len(i), r), value, j))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, np.int64),) * 4


def _raw(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).astype(x.dtype.newbyteorder("<")).tobytes()


def _one_row(values: list, kinds: list, names: list[str]) -> pa.Table:
    return pa.table([pa.array([x], k) for x, k in zip(values, kinds, strict=True)], names=names)


def _grow(dims: int, key: str):
    """One block -> one row with its tree, and the ball around all of it."""

    def run(t: pa.Table) -> pa.Table:
        ints = lambda x: t[x].combine_chunks().to_numpy().astype(np.int64)
        tree = Tree(ints("row"), ints("vec_id"), ints("label"), _matrix(t["v"], dims))
        centre = tree.f.mean(0)
        radius = float(np.sqrt(((tree.f - centre) ** 2).sum(1).max())) * (1 + 1e-9)
        values = [t[key][0].as_py(), _raw(centre), radius, *[_raw(x) for x in (tree.rows, tree.ids, tree.labels, tree.v, tree.nodes, tree.balls)]]
        return _one_row(values, [pa.int64(), pa.binary(), pa.float64(), *[pa.binary()] * 6], [key, "centre", "radius", "rows", "ids", "labels", "v", "nodes", "balls"])

    return run


def _trees(dims: int, k: int, same: bool):
    """Rows (block of candidates, block of anchors, requests of its anchors by row) -> what the pair of blocks holds."""
    load = lambda c: Tree(*[np.frombuffer(x.as_py(), "<i8").reshape(*s) for x, s in zip(c[:5], ((-1,), (-1,), (-1,), (-1, dims), (-1, 5)), strict=True)], np.frombuffer(c[5].as_py(), "<f8").reshape(-1, dims + 1))

    def run(batches):
        for b in batches:
            for p in range(b.num_rows):
                row = [b.column(i)[p] for i in range(b.num_columns)]
                c, a = load(row[:6]), load(row[6:12])
                own, low, high, need = (np.frombuffer(x.as_py(), "<i8") for x in row[12:16])
                low, high, need = (x.reshape(len(own), -1) for x in (low, high, need))
                # anchors without a request ask for nothing
                order = np.argsort(own)
                at = np.minimum(np.searchsorted(own, a.rows, sorter=order), len(own) - 1)
                held = own[order[at]] == a.rows
                fill = lambda x, none: np.where(held[:, None], x[order[at]], none)  # noqa: B023, E731
                i, r, score, j = search(a, c, same, fill(low, MOST), fill(high, LEAST), fill(need, MOST), k)
                cols = (a.rows[i], r.astype(np.int32), c.ids[j], score)
                for s in range(0, len(i), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[s : s + 100_000]) for x in cols], names=["a_row", "r", "vec_id", "score"])

    return run


def _requests(t: pa.Table) -> pa.Table:
    """The requests of one anchor block: rows, and low, high and need of each, padded with requests for nothing."""
    lists = [t[x].combine_chunks() for x in ("low", "high", "need")]
    size = np.diff(lists[0].offsets.to_numpy())
    out = []
    for x, none in zip(lists, (MOST, LEAST, MOST), strict=True):
        full = np.full((len(size), size.max()), none)
        full[np.arange(size.max()) < size[:, None]] = x.flatten().to_numpy()
        out.append(full)
    least, most = float(np.maximum(out[0], out[2]).min()), float(out[1].max())
    values = [t["a"][0].as_py(), _raw(t["row"].combine_chunks().to_numpy().astype(np.int64)), *map(_raw, out), least, most]
    return _one_row(values, [pa.int64(), *[pa.binary()] * 4, *[pa.float64()] * 2], ["a", "own", "low", "high", "need", "least", "most"])


class _Search:
    """Blocks of anchors and candidates on the shared folder, and the rounds over them."""

    def __init__(self, vectors: DataFrame, anchors: str, block: int | None, anchor_block: int):
        self.spark = spark = vectors.sparkSession
        bound_text_batches(spark)
        self.kept = Written(spark, "negatives")
        numbered = vectors.withColumns({"row": F.monotonically_increasing_id(), "anchor": F.coalesce(F.expr(anchors), F.lit(False))})
        v = self.kept.cut(numbered)  # written, so the numbers stay
        self.dims = v.agg(F.max(F.size("v"))).first()[0] or 0
        self.empty = not self.dims
        if self.empty:
            return
        size = block or max(1, BLOCK_BYTES // (8 * self.dims))
        depth = min(int(np.log2(LEAVES)), max(0, int(np.ceil(np.log2(max(1, v.count() / (size * BUCKETS)))))))
        sample = v.orderBy(F.xxhash64("row", F.lit(3))).limit(SAMPLE).select("v").toArrow() if depth else None
        w, t = planes(_matrix(sample["v"], self.dims), depth) if depth else (np.zeros((1, self.dims)), np.zeros(1))
        v = self._placed(v, w, t)
        cells = v.groupBy("bucket", "leaf").agg(F.ceil(F.count("*") / size).alias("c_parts"), F.ceil(F.count_if("anchor") / anchor_block).alias("a_parts"))
        cells = F.broadcast(cells)  # BUCKETS * LEAVES rows at most
        v = v.join(cells, ["bucket", "leaf"])
        number = lambda parts, seed: (F.col("bucket") * LEAVES + F.col("leaf")) * (1 << 32) + F.pmod(F.xxhash64("row", F.lit(seed)), F.greatest(parts, F.lit(1)))
        v = self.kept.cut(v.withColumns({"c": number(F.col("c_parts"), 7), "a": F.when(F.col("anchor"), number(F.col("a_parts"), 11))}))
        self.anchors = v.filter("anchor").select("row", "vec_id", "a")
        cols = ["row", "vec_id", "label", "v"]
        kinds = f"long, centre binary, radius double, {BLOCK}"
        self.blocks = self.kept.cut(v.select("c", *cols).groupBy("c").applyInArrow(_grow(self.dims, "c"), f"c {kinds}"))
        self.groups = self.kept.cut(v.filter("anchor").select("a", *cols).groupBy("a").applyInArrow(_grow(self.dims, "a"), f"a {kinds}"))
        self.parts = shuffle_partitions(spark)

    def _placed(self, v: DataFrame, w: np.ndarray, t: np.ndarray) -> DataFrame:
        dims = self.dims

        def run(batches):
            for b in batches:
                leaf = leaf_of(_matrix(b.column(2), dims).astype(float), w, t)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], names=[*b.schema.names, "leaf"])

        placed = v.select("vec_id", "label", "v", "row", "anchor").mapInArrow(lean(run), "vec_id long, label long, v array<long>, row long, anchor boolean, leaf long")
        return placed.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(BUCKETS)))

    def asked(self, requests: DataFrame) -> DataFrame:
        """Requests ``(row, low, high, need)`` (arrays) of the anchors, one row for each block of anchors."""
        own = self.anchors.join(requests, "row").select("a", "row", "low", "high", "need")
        return self.kept.cut(own.groupBy("a").applyInArrow(_requests, "a long, own binary, low binary, high binary, need binary, least double, most double"))

    def pairs(self, asked: DataFrame, same: bool, home: bool) -> DataFrame:
        """``(a, c)``: the block pairs whose interval meets the requests; those of one leaf (and bucket, if ``same``) or the others."""
        groups = self.groups.select("a", "centre", "radius").join(asked.select("a", "least", "most"), "a")
        balls, out, dims, last = self.blocks.select("c", "centre", "radius"), None, self.dims, None
        while True:  # bounded portions of the balls, by number
            chunk = (balls if last is None else balls.filter(F.col("c") > last)).orderBy("c").limit(BALLS).toArrow()
            if not chunk.num_rows:
                break
            last = chunk["c"][-1].as_py()
            number = chunk["c"].to_numpy()
            centre = np.frombuffer(b"".join(chunk["centre"].to_pylist()), "<f8").reshape(-1, dims)
            held = self.spark.sparkContext.broadcast((number, centre, chunk["radius"].to_numpy()))

            def run(batches, held=held):
                number, centre, radius = held.value
                cell = number >> 32
                for b in batches:
                    for a, x, r, least, most in zip(*[c.to_pylist() for c in b.columns], strict=True):
                        x = np.broadcast_to(np.frombuffer(x, "<f8"), centre.shape)
                        low, high = intervals(x, np.full(len(radius), r), centre, radius)
                        near = cell % LEAVES == (a >> 32) % LEAVES
                        alike = cell // LEAVES == (a >> 32) // LEAVES
                        ok = (high >= least) & (low <= most) & ((alike & (near == home)) if same else (near == home))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(ok.sum(), a)), pa.array(number[ok])], names=["a", "c"])

            some = groups.repartition(self.parts, "a").mapInArrow(lean(run), "a long, c long")
            out = some if out is None else out.unionByName(some)
        return out

    def found(self, asked: DataFrame, pairs: DataFrame, same: bool, k: int) -> DataFrame:
        """``(a_row, r, vec_id, score)``: the k best of each pair of blocks."""
        side = lambda df, key, tag: df.select(key, *[F.col(x).alias(f"{tag}_{x}") for x in ("rows", "ids", "labels", "v", "nodes", "balls")])
        mine = side(self.groups, "a", "a").join(asked.drop("least", "most"), "a")
        both = pairs.repartition(self.parts, "a", "c").hint("shuffle_merge").join(side(self.blocks, "c", "c"), "c").join(mine, "a").drop("a", "c")
        return self.kept.cut(both.mapInArrow(lean(_trees(self.dims, k, same)), "a_row long, r int, vec_id long, score long"))

    def best(self, requests: DataFrame, same: bool, k: int) -> DataFrame:
        """The k best of each request, ``(a_row, r, rank, vec_id, score)``; requests: ``(row, r, low, high)``, r from 0 without gaps."""
        by = Window.partitionBy("a_row", "r")
        ranked = lambda df: df.withColumn("rank", F.row_number().over(by.orderBy(F.col("score").desc(), "vec_id"))).filter(F.col("rank") <= k)
        packed = lambda df: df.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("r", "low", "high", "need"))).alias("x")).select("row", "x.low", "x.high", "x.need")
        asked = self.asked(packed(requests.withColumn("need", F.lit(LEAST))))
        first = self.kept.cut(ranked(self.found(asked, self.pairs(asked, same, home=True), same, k)))
        bar = first.filter(F.col("rank") == k).select(F.col("a_row").alias("row"), "r", F.col("score").alias("need"))
        asked = self.asked(packed(requests.join(bar, ["row", "r"], "left").fillna({"need": LEAST})))
        rest = self.kept.cut(self.pairs(asked, same, home=False))
        if rest.isEmpty():
            return first
        return self.kept.cut(ranked(first.drop("rank").unionByName(self.found(asked, rest, same, k))))


def hard_negatives(
    vectors: DataFrame, anchors: str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int | None = None, anchor_block: int = ANCHORS
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the rows of ``vectors`` for which the SQL condition
    ``anchors`` holds. ``low`` and ``high`` are percentages: low * positive <= 100 * negative <= high * positive."""
    work = _Search(vectors, anchors, block, anchor_block)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if work.empty:
        return work.spark.createDataFrame([], schema)
    whole = work.anchors.select("row", F.lit(0).alias("r"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))
    chosen = work.best(whole, True, positives).select(F.col("a_row").alias("row"), (F.col("rank") - 1).alias("r"), F.col("vec_id").alias("positive_id"), F.col("score").alias("p"))
    part = lambda percent, f: f((F.col("p").cast("decimal(20,0)") * percent).cast("decimal(30,2)") / 100).cast("long")
    bands = work.kept.cut(chosen.withColumns({"low": part(low, F.ceil), "high": part(high, F.floor)}))
    # requests of an anchor are numbered without gaps over those that are not empty
    some = bands.filter("low <= high").withColumn("q", F.row_number().over(Window.partitionBy("row").orderBy("r")) - 1)
    some = work.kept.cut(some)
    mined = work.best(some.select("row", F.col("q").alias("r"), "low", "high"), False, negatives)
    out = mined.join(some.select(F.col("row").alias("a_row"), F.col("q").alias("r"), "positive_id", "p"), ["a_row", "r"])
    out = out.join(work.anchors.select(F.col("row").alias("a_row"), F.col("vec_id").alias("anchor_id")), "a_row")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("p").alias("positive_score"), F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production parameters: five positives, three negatives, 50 to 95 percent; anchors are the rows whose vec_id is divisible by 50, and every
    seventh vec_id has its label moved by one."""
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(labelled_vectors(emb, label), "vec_id % 50 = 0")


ORACLE_SQL = """
with v as (select row_number() over () as n, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                  list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
           where vec_id is not null and label is not null and embedding is not null
             and not coalesce(list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x))), false)),
     s as (select a.n, a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, cast(list_inner_product(a.v, c.v) as bigint) as score
           from v a join v c on a.vec_id % 50 = 0 and a.n <> c.n),
     p as (select n, anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by n order by score desc, vec_id) as k
           from s where same qualify k <= 5)
select anchor_id, positive_id, cast(row_number() over o as int) as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s using (n, anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
window o as (partition by n, k order by score desc, vec_id) qualify row_number() over o <= 3
"""
