"""Near-duplicate texts by word shingles: an exact join at a Jaccard similarity of 0.8 (pipeline stage).

A text is the set of its ``SHINGLE``-word sequences (64-bit hashes). Two sets A and B are similar if
|A & B| / |A | B| is 4/5 or more. Fingerprint links of ``simhash`` count as well and come first: they settle copies cheaply.

1. *Prefixes.* A similar partner holds 4/5 of a set of n or more, so in any order that is common to all sets two similar ones share
   one of their first ``n // 5 + 1`` members. Order: frequent shingles last, then by hash. The frequent ones are read from a
   sample; a poor sample costs time and no pair.
2. *Candidates.* Members of one list whose sizes allow it, that are not yet linked, and whose parity bitmaps differ in no more bits
   than similar sets may differ in members (a bitmap never differs in more bits than its sets do in members). For pairs of long
   texts, which may differ in more members than that bitmap has bits, a wide one of at least a bit a member decides once more.
3. *Check.* The sets of each candidate pair are intersected.

Nothing is sampled, cut or estimated in what is found. Nulls, null ids and repeated rows: as in ``simhash``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synframe.llm import simhash
from synframe.operators.components import connected_components
from synframe.runtime import Written, bound_text_batches, lean, shuffle_partitions

SHINGLE = 5
#: Bits of a parity bitmap.
BITS = 1024
#: Members from which a set has a wide bitmap as well.
WIDE = 1024
#: Parts of the prefix lists that are searched one after the other.
PARTS = 4
#: Most ids that are broadcast.
IDS = 4_000_000
#: Texts of the sample, how many of them make a shingle frequent, and most frequent shingles that are sent to tasks.
SAMPLE, OFTEN, MOST = 20_000, 3, 400_000


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word sequences of a UTF-8 text; a shorter text is one sequence."""
    words = text.lower().split() if text else []
    if not words:
        return np.array([], np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + shingle]), simhash.SEED) for i in range(max(1, len(words) - shingle + 1))], np.uint64))


def _parity(h: np.ndarray) -> bytes:
    return np.packbits((np.bincount((h % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def _wide(h: np.ndarray) -> bytes | None:
    """Parity bitmap of a power of two of bits, one or two a member; None for small sets."""
    if len(h) < WIDE:
        return None
    bits = 1 << (len(h) - 1).bit_length()
    return np.packbits((np.bincount((h % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """Bits in which two wide bitmaps differ; the longer one is folded."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def similar(common: int, a: int, b: int) -> bool:
    """Jaccard similarity of 4/5 or more, of sets of ``a`` and ``b`` members."""
    return 9 * common >= 4 * (a + b)


def _texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, tk, text)``: tk is a hash of the text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("text"))


def _sid(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes(), simhash.SEED)


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).view(np.int64)))


def _long(x) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def _sets(texts: DataFrame, each, schema: str, shingle: int) -> DataFrame:
    """``each(batch, sets)`` for small batches of rows ``(doc_id, tk, text)``."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                yield each(part, [shingles(t, shingle) for t in part.column(2).cast(pa.binary()).to_pylist()])

    return texts.mapInArrow(lean(run), schema)


def members(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(sid, h)``: the sets of the texts and their ids."""
    each = lambda b, sets: pa.RecordBatch.from_arrays([_long([_sid(h) for h in sets]), _lists(sets)], names=["sid", "h"])
    return _sets(texts, each, "sid long, h array<long>", shingle)


def _frequent(texts: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """Frequent shingles of a sample of different texts, the most frequent last."""
    share = min(1.0, SAMPLE / max(1, texts.count()))
    some = texts.filter(F.pmod(F.col("tk"), F.lit(1_000_000)) < int(share * 1_000_000)).dropDuplicates(["tk"])
    per = members(some, shingle).select(F.explode("h").alias("k")).groupBy("k").count().filter(F.col("count") >= OFTEN)
    top = per.orderBy(F.desc("count"), "k").limit(MOST).select("k").toArrow()["k"].to_numpy()
    return top[::-1].astype(np.int64).view(np.uint64)


def shingled(texts: DataFrame, frequent: np.ndarray, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, tk, fp, sid, n, sig, wide, p)``: fingerprint, the set's id, size and parity bitmaps, and its prefix."""
    by = np.argsort(frequent)
    keys = frequent[by]

    def prefix(h):
        if len(keys):
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hot = keys[at] == h
            h = np.concatenate((h[~hot], frequent[np.sort(by[at[hot]])]))
        return h[: len(h) // 5 + 1]

    def each(b, sets):
        fp = _long([simhash.fingerprint(t) for t in b.column(2).cast(pa.binary()).to_pylist()])
        cols = [b.column(0), b.column(1), fp, _long([_sid(h) for h in sets]), pa.array(np.array([len(h) for h in sets], np.int32))]
        cols += [pa.array([_parity(x) for x in sets], pa.binary()), pa.array([_wide(x) for x in sets], pa.binary()), _lists([prefix(h) for h in sets])]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "tk", "fp", "sid", "n", "sig", "wide", "p"])

    return _sets(texts, each, "doc_id long, tk long, fp long, sid long, n int, sig binary, wide binary, p array<long>", shingle)


def _by_list(df: DataFrame, order: list[str], each, schema: str) -> DataFrame:
    """``each(columns) -> record batch or None`` for whole lists: ``columns`` hold the rows of one or more complete values of ``k``."""
    df = df.repartition(shuffle_partitions(df.sparkSession), "k").sortWithinPartitions("k", *order)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            k = b.column(0).to_numpy()
            new = np.flatnonzero(k[1:] != k[:-1]) + 1
            if held and len(k) and held[-1].column(0)[-1].as_py() != k[0]:
                new = np.concatenate(([0], new))
            if not len(new):
                held += [b] if b.num_rows else []
                continue
            cut = int(new[-1])
            done = pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()
            held = [b.slice(cut)]
            if done.num_rows:
                yield from each(done)
        if held:
            yield from each(pa.Table.from_batches(held).combine_chunks())

    return df.mapInArrow(lean(run), schema)


def _bounds(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.flatnonzero(k[1:] != k[:-1]) + 1
    return np.concatenate(([0], new)), np.concatenate((new, [len(k)]))


def _shared(t: pa.Table):
    """Rows of lists with two different sets or more, each set once."""
    k, sid = t.column(0).to_numpy(), t.column(1).to_numpy()
    fresh = np.concatenate(([True], (k[1:] != k[:-1]) | (sid[1:] != sid[:-1])))
    t, k = t.filter(pa.array(fresh)), k[fresh]
    start, end = _bounds(k)
    yield from t.filter(pa.array(np.repeat(end - start > 1, end - start))).to_batches()


def _candidates(t: pa.Table):
    """Pairs of a list (sorted by size) that sizes, links and bitmaps allow."""
    k, sid, n, label = (t.column(i).to_numpy() for i in range(4))
    sig = np.frombuffer(b"".join(t.column(4).to_pylist()), np.uint64).reshape(len(k), -1)
    a, b, held = [], [], 0
    for s, e in zip(*_bounds(k), strict=True):
        last = np.searchsorted(n[s:e], n[s:e] * 5 // 4, "right") + s
        for i in range(s, e - 1):
            j = np.arange(i + 1, last[i - s])
            j = j[label[j] != label[i]]
            if len(j):
                j = j[9 * np.bitwise_count(sig[j] ^ sig[i]).sum(1, dtype=np.int64) <= n[j].astype(np.int64) + n[i]]
                a.append(np.full(len(j), sid[i]))
                b.append(sid[j])
                held += len(j)
                if held > 50_000:
                    yield _pairs(a, b)
                    a, b, held = [], [], 0
    if held:
        yield _pairs(a, b)


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    x, y = np.concatenate(a), np.concatenate(b)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _narrowed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of set ids without those that wide bitmaps tell apart."""
    wide = sets.filter("wide is not null").select("sid", "n", "wide").dropDuplicates(["sid"])
    side = lambda k: wide.select(F.col("sid").alias(k), F.col("n").alias(f"n{k}"), F.col("wide").alias(f"w{k}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "wa", "wb")

    def run(batches):
        for b in batches:
            ok = [n is None or 9 * _apart(x.as_py(), y.as_py()) <= n for n, x, y in zip(b.column(2).to_pylist(), b.column(3), b.column(4), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(lean(run), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, kept: Written, shingle: int) -> DataFrame:
    """The similar ones of the pairs of set ids; whole sets are made again, for the texts of pairs only."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    need = sets.select("sid", "tk").join(need, "sid", "left_semi").groupBy("sid").agg(F.min("tk").alias("tk"))
    need = texts.join(need.select("tk").distinct(), "tk", "left_semi").dropDuplicates(["tk"]).select("doc_id", "tk", "text")
    need = kept.cut(members(need, shingle).dropDuplicates(["sid"]))
    both = pairs.join(need.select(F.col("sid").alias("a"), F.col("h").alias("ha")), "a").join(need.select(F.col("sid").alias("b"), F.col("h").alias("hb")), "b").select("a", "b", "ha", "hb")

    def run(batches):
        for b in batches:
            one, two = b.column(2), b.column(3)
            ok = []
            for i in range(b.num_rows):
                x, y = one[i].values.to_numpy(), two[i].values.to_numpy()
                ok.append(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(lean(run), "a long, b long")


def _release(df: DataFrame) -> None:
    """Spark deletes the shuffle files of finished jobs when the driver collects its garbage; their results are written tables by now."""
    df.sparkSession.sparkContext._jvm.System.gc()


def text_components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, component_id)`` for every document: smallest doc_id among texts linked by fingerprints or similar sets."""
    bound_text_batches(docs.sparkSession)
    kept = Written(docs.sparkSession, "near")
    texts = _texts(docs)
    sets = kept.cut(shingled(texts, _frequent(texts, shingle), shingle))
    named = kept.cut(simhash.named_fingerprints(sets.select("doc_id", "fp"), kept))
    of_set = sets.select("sid", "fp", "sig").join(named.select("fp", "label"), "fp")
    # texts of equal sets may have different fingerprints
    one = kept.cut(of_set.groupBy("sid").agg(F.min("label").alias("label"), F.max("label").alias("other"), F.first("sig").alias("sig")))
    equal = of_set.select("sid", F.col("label").alias("v")).join(one.filter("label <> other").select("sid", F.col("label").alias("u")), "sid").filter("u <> v").select("u", "v")
    prefixes = sets.filter("n > 0").select(F.explode("p").alias("k"), "sid", "n")
    lists, path = kept.put(_by_list(prefixes, ["sid"], _shared, "k long, sid long, n int"))
    # the lists' bitmaps are many times the texts' size on the way: a part of the lists at a time, and shuffles that are done go
    pairs = None
    for part in range(PARTS):
        _release(docs)
        own = lists.filter(F.pmod(F.xxhash64("k"), F.lit(PARTS)) == part).join(one.select("sid", "label", "sig"), "sid").select("k", "sid", "n", "label", "sig")
        own = kept.cut(_by_list(own, ["n", "sid"], _candidates, "a long, b long").distinct())
        pairs = own if pairs is None else pairs.unionByName(own)
    kept.drop(path)
    _release(docs)
    pairs = kept.cut(_narrowed(pairs.distinct(), sets))
    _release(docs)
    found = _verified(pairs, sets, texts, kept, shingle)
    to = one.select("sid", "label")
    found = found.join(to.select(F.col("sid").alias("a"), F.col("label").alias("u")), "a").join(to.select(F.col("sid").alias("b"), F.col("label").alias("v")), "b").select("u", "v")
    joined = connected_components(found.unionByName(equal), "u", "v", contract=False).select(F.col("node").alias("label"), "component")
    final = kept.cut(named.join(joined, "label", "left").select("fp", "root", F.coalesce("component", "label").alias("label")))
    names = final.groupBy("label").agg(F.min("root").alias("component_id"))
    return sets.select("doc_id", "fp").join(final.join(names, "label").select("fp", "component_id"), "fp").select("doc_id", "component_id")


def earlier_texts(docs: DataFrame, earlier: DataFrame) -> DataFrame:
    """``(doc_id, text)``: of documents whose lines are some, not all, of those of their row in ``earlier``, that row's text."""
    row = lambda df: df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    now, old = row(docs), row(earlier)
    mark = now.select("doc_id", F.xxhash64("text").alias("h")).join(old.select("doc_id", F.xxhash64("text").alias("h2")), "doc_id")
    changed = Written(docs.sparkSession, "changed").cut(mark.filter("h <> h2").select("doc_id").distinct())
    if changed.limit(IDS + 1).count() <= IDS:  # then no text moves to be told apart; beyond, texts meet their ids in a shuffle
        changed = F.broadcast(changed)
    both = old.join(changed, "doc_id", "left_semi").join(now.join(changed, "doc_id", "left_semi").select("doc_id", F.col("text").alias("now")), "doc_id")
    lines = lambda c: F.split(c, "\n")
    return both.filter((F.size(F.array_except(lines("now"), lines("text"))) == 0) & (F.col("now") != F.col("text"))).select("doc_id", "text")


def drop_near_texts(docs: DataFrame, shingle: int = SHINGLE, earlier: DataFrame | None = None) -> DataFrame:
    """One document of each component stays, as in ``simhash.drop_near_duplicates``. With ``earlier``, the documents before their repeated
    lines were cut, a document that lost lines is compared by both texts: a near copy of which only a remnant is left is still one."""
    texts = docs
    if earlier is not None:
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        texts = own.unionByName(Written(docs.sparkSession, "earlier").cut(earlier_texts(docs, earlier)))
    return simhash.keep_first(docs, text_components(texts, shingle))
