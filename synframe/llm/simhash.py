"""SimHash near-dedup through an inverted index of positional bytes with count filtering (operator 8).

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most ``d`` bits
differ in at most ``d`` bytes, so they share at least ``8 - d`` positional bytes: the guaranteed minimum.

1. *Index.* A fingerprint is posted under every set of ``together`` byte positions with their bytes. With ``together=1`` that is a list
   for each positional byte; such a list holds 1/256 of all fingerprints, so the work grows with the square of the input. The default
   of three positions makes lists 65,536 times shorter; any pair that reaches the minimum of four still meets.
2. *Count filter.* In a list the shared positional bytes of a pair are tallied; pairs below the minimum go.
3. *Verification.* The rest are compared bit by bit.

Equal fingerprints collapse to one row before the index is built, so thousands of copies cost one row.
A list of more than ``SMALL`` members never emits all its pairs: it emits a spanning forest of its verified links (at most one row per
member), which leaves the components as they are. A list of more than ``HOT`` members is not searched in its task: its members are dealt
to blocks by a hash, and every pair of blocks is a task's unit of its own.

Nulls: a null text has no words (fingerprint 0); a null ``doc_id`` keeps its row, links like any other but
never names a component (component_id is null if it links to no row with an id). Repeated rows stay.
Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synframe.operators.components import connected_components
from synframe.runtime import Written, bound_text_batches, lean, shuffle_partitions

SEED = 42
#: Members of a list up to which its pairs are listed, and beyond which it is dealt to blocks.
SMALL, HOT = 8, 8192


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = SEED) -> int:
    """Majority fingerprint of the ``shingle``-word sequences of a UTF-8 text, as an unsigned integer."""
    words = text.lower().split() if text else []  # bytes: ASCII letters and the six ASCII white spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, seed)]
    else:
        ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
        starts = [0, *(e + 1 for e in ends[:-shingle])]
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=True)]
    ones = np.zeros(64, np.int64)
    h = np.array(hashes, "<u8")
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``(doc_id, fp)``: fp is the fingerprint's 64 bits as a long."""

    def run(batches):
        for b in batches:
            text = b.column(1).cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(t, shingle) for t in text], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, fp long")


def tally(x: np.ndarray) -> np.ndarray:
    """Shared positional bytes of pairs whose fingerprints differ in the bits of ``x``."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    return 8 - np.bitwise_count((((x & low) + low) | x) & ~low).astype(np.int64)


def _near(x: np.ndarray, bits: int) -> np.ndarray:
    """Which differences reach the minimum tally and are then verified."""
    out = tally(x) >= 8 - bits
    out[out] = np.bitwise_count(x[out]) <= bits
    return out


def _forest(f: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Spanning forest (index pairs) of the members of one posting list that differ in at most ``bits`` bits."""
    out, left = [], np.arange(len(f))
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            near = _near(f[left] ^ f[i], bits)
            if near.any():
                hit = left[near]
                out += [(int(i), int(j)) for j in hit]
                todo += hit.tolist()
                left = left[~near]
    return out


def list_links(f: np.ndarray, start: np.ndarray, end: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of the lists ``f[start:end]``: all of small lists, a spanning forest of others."""
    size = end - start
    a, b = [f[:0]], [f[:0]]
    small = start[(size > 1) & (size <= SMALL)]
    sizes = size[(size > 1) & (size <= SMALL)]
    for i in range(SMALL - 1):
        for j in range(i + 1, SMALL):
            at = small[sizes > j]
            if len(at):
                near = _near(f[at + i] ^ f[at + j], bits)
                a.append(f[at[near] + i])
                b.append(f[at[near] + j])
    for s, e in zip(start[size > SMALL], end[size > SMALL], strict=True):
        if found := _forest(f[s:e], bits):
            i, j = np.array(found).T
            a.append(f[s + i])
            b.append(f[s + j])
    return np.concatenate(a), np.concatenate(b)


LINK = "a long, b long, c byte"


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    lo, hi = np.minimum(a, b).view(np.int64), np.maximum(a, b).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi), pa.nulls(len(lo), pa.int8())], names=["a", "b", "c"])


def _lists(bits: int, hot: int):
    """Rows ``(c, k, fp)`` sorted by list -> links (a, b); of lists beyond ``hot`` members the members, as (fp, k, c)."""

    def run(batches):
        c, k, f = np.zeros(0, np.int8), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        away = None  # the open list if it is dealt to blocks

        def settle(c, k, f, last):
            nonlocal away
            new = np.flatnonzero((c[1:] != c[:-1]) | (k[1:] != k[:-1])) + 1
            start, end = np.concatenate(([0], new)), np.concatenate((new, [len(c)]))
            big = end - start > hot
            if away == (c[0], k[0]):
                big[0] = True
            whole = len(start) if last or big[-1] else len(start) - 1  # the last list may go on
            away = (c[-1], k[-1]) if big[-1] else None
            for s, e in zip(start[big], end[big], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(f[s:e].view(np.int64)), pa.array(k[s:e]), pa.array(c[s:e])], names=["a", "b", "c"])
            here = ~big[:whole]
            a, b = list_links(f, start[:whole][here], end[:whole][here], bits)
            if len(a):
                yield _links(a, b)
            return start[whole] if whole < len(start) else len(c)

        for batch in batches:
            c = np.concatenate((c, batch.column(0).to_numpy()))
            k = np.concatenate((k, batch.column(1).to_numpy()))
            f = np.concatenate((f, batch.column(2).to_numpy().view(np.uint64)))
            if len(c):
                cut = yield from settle(c, k, f, False)
                c, k, f = c[cut:], k[cut:], f[cut:]
        if len(c):
            yield from settle(c, k, f, True)

    return run


def _cells(bits: int):
    """Rows ``(c, k, x, y, fp)`` sorted by cell (two blocks of a hot list) -> links."""

    def run(batches):
        held: list[np.ndarray] = []
        own = None

        def settle():
            f = np.unique(np.concatenate(held))
            a, b = list_links(f, np.array([0]), np.array([len(f)]), bits)
            if len(a):
                yield _links(a, b)

        for batch in batches:
            f = batch.column(4).to_numpy().view(np.uint64)
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], 1)
            new = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for s, e in zip([0, *new], [*new, len(f)], strict=True) if len(f) else []:
                key = tuple(keys[s])
                if held and key != own:
                    yield from settle()
                    held = []
                own = key
                held.append(f[s:e])
        if held:
            yield from settle()

    return run


def links(distinct: DataFrame, bits: int = 4, together: int = 3, hot: int = HOT) -> DataFrame:
    """``(a, b)`` fingerprints: enough verified links (<= ``bits`` bits apart) to span every component."""
    if not 0 <= bits <= 7:
        raise ValueError("bits must be 0 to 7: fingerprints further apart need not share a byte")
    together = min(together, 8 - bits)
    masks = [sum(0xFF << (8 * p) for p in c) for c in combinations(range(8), together)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.posexplode(F.transform(F.array(*[F.lit(m).cast("long") for m in signed]), lambda m: F.col("fp").bitwiseAND(m)))
    n, kept = shuffle_partitions(distinct.sparkSession), Written(distinct.sparkSession, "postings")
    index = distinct.select("fp", keys.alias("c", "k")).select(F.col("c").cast("byte").alias("c"), "k", "fp").repartition(n, "c", "k").sortWithinPartitions("c", "k")
    found = kept.cut(index.mapInArrow(lean(_lists(bits, hot)), LINK))
    out = found.filter("c is null").select("a", "b")
    crowd = found.filter("c is not null").select("c", F.col("b").alias("k"), F.col("a").alias("fp"))
    if not crowd.isEmpty():
        size = crowd.groupBy("c", "k").agg(F.ceil(F.count("*") / F.lit(hot)).cast("int").alias("blocks"))
        dealt = crowd.join(size, ["c", "k"]).withColumn("x", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        dealt = dealt.withColumn("o", other).select("c", "k", F.least("x", "o").alias("x"), F.greatest("x", "o").alias("y"), "fp")
        out = out.unionByName(dealt.repartition(n, "c", "k", "x", "y").sortWithinPartitions("c", "k", "x", "y").mapInArrow(lean(_cells(bits)), LINK).select("a", "b"))
    return out.distinct()


def named_fingerprints(fps: DataFrame, kept: Written, bits: int = 4) -> DataFrame:
    """``(fp, root, label)``: every fingerprint with the smallest doc_id that has it and its component's label."""
    distinct = kept.cut(fps.groupBy("fp").agg(F.min("doc_id").alias("root")))
    pairs = links(distinct, bits)
    label = connected_components(pairs, "a", "b", contract=False).select(F.col("node").alias("fp"), F.col("component").alias("label"))
    return distinct.join(label, "fp", "left").select("fp", "root", F.coalesce("label", "fp").alias("label"))


def near_components(docs: DataFrame, bits: int = 4, shingle: int = 4) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every document; component_id is its smallest reachable doc_id."""
    bound_text_batches(docs.sparkSession)
    spark = docs.sparkSession
    kept = Written(spark, "simhash")
    fps = kept.cut(fingerprints(docs, shingle))
    named = kept.cut(named_fingerprints(fps, kept, bits))
    names = named.groupBy("label").agg(F.min("root").alias("component_id"))
    by_fp = named.join(names, "label").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, bits: int = 4, shingle: int = 4) -> DataFrame:
    """One document of each component stays (its smallest doc_id); rows without an id and repeated rows of the kept id stay; columns as given."""
    return keep_first(docs, near_components(docs, bits, shingle))


def keep_first(docs: DataFrame, components: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is not its component's."""
    comp = components.filter("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    key = docs["doc_id"].cast("long")
    return docs.join(comp, key == comp["_gone"], "left_anti")


def op8_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production parameters: 4-word shingles, links at 4 or fewer differing bits, all documents."""
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
