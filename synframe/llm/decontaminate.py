"""Benchmark decontamination by suffix arrays over the training words (operator 13).

Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case. A window is ``window`` consecutive words of an item; an
item of fewer words, but not none, is one window. A document is affected if it holds a window of any item.

1. *Shards.* A task reads the documents in Arrow batches of a few MiB of whole texts; a batch is a shard. Its words become their numbers
   in the items' vocabulary, looked up exactly, with one number for all other words.
2. *Suffix array.* The shard's suffixes that begin with words with which some window begins (by a small table of hashes that only
   passes too many, never too few) are sorted by their first ``window`` words.
3. *Search.* Every window of every item is a prefix of one of the items' suffixes. All of them are binary-searched in the array at once:
   the range found holds the places of the window.
4. *Longest matches.* A place is grown word by word, beyond the window, unless the words before it are equal as well (then an earlier
   place covers it). Of each document and item the longest match stays, with its location on both sides.

The items meet every shard as a broadcast of at most ``BLOCK_BYTES`` of text; a larger set is cut into blocks, one pass for each, and a
document carries what earlier passes found. No document is split and nothing is shuffled.

A null text has no words. A null item_id is an id of its own, written as the empty string. Rows of one item_id are one item
with several texts. Repeated rows of documents stay. An empty table of documents gives no rows, one of items leaves every document
clean. At equal lengths the first place in the document wins, then the first in the item. Extra columns of either table are ignored
by ``contamination`` and kept by ``decontaminate``, whatever their names. A very long text is a shard of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synframe.llm.columns import freed, held
from synframe.llm.words import ALPHANUMERIC, split_words
from synframe.runtime import Written, bound_text_batches, lean

WINDOW = 10
#: Most bytes of item texts that are broadcast at once.
BLOCK_BYTES = 8 << 20
#: Words whose hash decides whether a suffix enters the array, and pairs of places that are grown at once.
LEAD, GROWN = 4, 1 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)
FOUND = "hits array<struct<start:int,length:int>>, matches array<struct<item_id:string,doc_word:int,item_word:int,length:int>>"
_HITS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
_MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("doc_word", pa.int32()), ("item_word", pa.int32()), ("length", pa.int32())]))


def _keys(s: np.ndarray, at: np.ndarray, length: np.ndarray | int, window: int, fill: int = 0) -> np.ndarray:
    """The first ``length`` words at the places as byte strings that sort like the words, three bytes a word."""
    out = np.empty((len(at), window, 3), np.uint8)
    for t in range(window):
        v = s[at + t] + 1
        out[:, t, 0], out[:, t, 1], out[:, t, 2] = v >> 16, v >> 8 & 255, v & 255
        if not np.isscalar(length):
            out[length <= t, t] = fill
    return out.reshape(len(at), 3 * window).view(f"S{3 * window}")[:, 0]


def _hash(s: np.ndarray, at: np.ndarray | slice, words: int) -> np.ndarray:
    """Hash of the words at the places (a slice: at all of them)."""
    h = np.zeros(1, np.uint64)
    for t in range(words):
        v = s[at + t] if isinstance(at, np.ndarray) else s[at.start + t : at.stop + t]
        h = (h + v.astype(np.uint64)) * _MUL
        h ^= h >> np.uint64(29)
    return h


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and every number in it."""
    size = end - start
    of = np.repeat(np.arange(len(size)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


class Items:
    """Numbered words of a block of items, their distinct windows, and the places of each window, by the word before it."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int = WINDOW):
        words, counts = split_words(pa.array(texts, pa.string()), ALPHANUMERIC, lower=True)
        self.window, self.ids = window, ["" if i is None else i for i in ids]
        self.vocabulary = pc.unique(words)
        item = np.repeat(np.arange(len(counts)), counts)
        start = np.cumsum(counts) - counts + np.arange(len(counts)) + 1  # a separator before each item
        self.first = start
        self.s = np.full(len(words) + len(counts) + 1 + window, -2, np.int64)
        self.item = np.full(len(self.s), -1)
        place = np.arange(len(words)) + item + 1
        self.s[place], self.item[place] = pc.index_in(words, value_set=self.vocabulary).to_numpy(), item
        at = place[(np.arange(len(words)) - (np.cumsum(counts) - counts)[item]) <= np.maximum(0, counts - window)[item]]
        size = np.minimum(window, counts)[self.item[at]]
        keys = _keys(self.s, at, size, window)
        order = np.lexsort((self.s[at - 1], keys, size))
        at, size, keys = at[order], size[order], keys[order]
        new = np.ones(len(at), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (size[1:] != size[:-1])
        self.places, self.size, self.at = at, size[new], at[new]
        self.bounds = np.concatenate((np.flatnonzero(new), [len(at)]))
        self.low, self.high = keys[new], _keys(self.s, self.at, self.size, window, 255)
        self.bits = np.uint64(64 - max(16, (32 * max(1, len(self.at))).bit_length()))
        self.tables = []
        for g in sorted({min(LEAD, int(x)) for x in np.unique(self.size)}):
            own = np.flatnonzero(np.minimum(self.size, LEAD) == g)
            table = np.zeros(1 << (64 - int(self.bits)), bool)
            h = _hash(self.s, self.at[own], g) >> self.bits
            table[h] = True
            self.tables.append((g, table, own, h))

    def suffixes(self, s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of ``s[:n]`` at which a window may begin, sorted by their words, and the windows that may begin at one."""
        able, own = np.zeros(n, bool), []
        for g, table, windows, h in self.tables:
            here = _hash(s, slice(0, n), g) >> self.bits
            ok = table[here] & (s[:n] >= 0)
            able |= ok
            seen = np.zeros(len(table), bool)
            seen[here[ok]] = True
            own.append(windows[seen[h]])
        return np.flatnonzero(able), np.concatenate(own) if own else np.zeros(0, np.int64)

    def search(self, s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """``(place, window)``: all places of all windows in ``s[:n]``."""
        at, windows = self.suffixes(s, n)
        keys = _keys(s, at, self.window, self.window)
        order = np.argsort(keys, kind="stable")
        keys, array = keys[order], at[order]
        low, high = np.searchsorted(keys, self.low[windows]), np.searchsorted(keys, self.high[windows], "right")
        of, k = _ranges(low, high)
        return array[k], windows[of]

    def grown(self, s: np.ndarray, place: np.ndarray, window: np.ndarray):
        """``(place, item place, length)`` of the matches that no word before them prolongs, in bounded portions."""
        before = s[place - 1] if len(place) else place
        for k in np.split(np.arange(len(place)), np.flatnonzero(np.diff(np.cumsum(np.diff(self.bounds)[window]) // GROWN)) + 1):
            of, j = _ranges(self.bounds[window[k]], self.bounds[window[k] + 1])
            for p in range(0, len(of), GROWN):
                i, j_ = k[of[p : p + GROWN]], self.places[j[p : p + GROWN]]
                fresh = self.s[j_ - 1] != before[i]
                a, b = place[i[fresh]], j_[fresh]
                length = self.size[window[i[fresh]]].copy()
                todo = np.arange(len(a))
                while len(todo):
                    x, y = a[todo] + length[todo], b[todo] + length[todo]
                    todo = todo[(self.s[y] >= 0) & (self.s[y] == s[np.minimum(x, len(s) - 1)])]
                    length[todo] += 1
                yield a, b, length


def _longest(rows: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Of each document and item id the longest match; columns: document, id number, document word, item word, length."""
    doc, item, d, i, n = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((i, d, -n, item, doc))
    doc, item, d, i, n = (x[order] for x in (doc, item, d, i, n))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    return doc[new], item[new], d[new], i[new], n[new]


def search_shard(items: Items, text: pa.Array, hits: pa.Array | None = None, matches: pa.Array | None = None) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """``(number of words, hits, matches)`` of every text, united with what earlier passes found."""
    words, counts = split_words(text, ALPHANUMERIC, lower=True)
    rows = len(counts)
    first = np.cumsum(counts) - counts + np.arange(rows) + 1  # a separator before each document
    s = np.full(len(words) + rows + 1 + items.window, -1, np.int64)
    doc = np.repeat(np.arange(rows), counts)
    at = np.arange(len(words)) + doc + 1
    if len(items.vocabulary):
        s[at] = pc.fill_null(pc.index_in(words, value_set=items.vocabulary), -1).to_numpy()
    n = len(words) + rows + 1
    place, window = items.search(s, n)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + items.size[window], -1)
    if hits is not None:
        of = np.repeat(np.arange(rows), pc.list_value_length(hits).fill_null(0).to_numpy())
        old = hits.flatten()
        start = first[of] + old.field("start").to_numpy()
        np.add.at(edge, start, 1)
        np.add.at(edge, start + old.field("length").to_numpy(), -1)
    covered = np.concatenate(([False], np.cumsum(edge) > 0, [False]))
    starts, ends = np.flatnonzero(covered[1:] & ~covered[:-1]), np.flatnonzero(~covered[1:] & covered[:-1])
    of = np.searchsorted(first, starts, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array((starts - first[of]).astype(np.int32)), pa.array((ends - starts).astype(np.int32))], fields=list(_HITS.value_type))
    hits_out = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(rows + 1)).astype(np.int32)), spans)

    names, number = np.unique(np.array([*items.ids, *([] if matches is None else matches.flatten().field("item_id").to_pylist())], object).astype(str), return_inverse=True)
    found = []
    for a, b, length in items.grown(s, place, window):
        d, i = np.searchsorted(first, a, "right") - 1, items.item[b]
        found.append((d, number[i], a - first[d], b - items.first[i], length))
        if len(found) > 8:
            found = [_longest(found)]
    if matches is not None and len(matches.flatten()):
        old = matches.flatten()
        of = np.repeat(np.arange(rows), pc.list_value_length(matches).fill_null(0).to_numpy())
        found.append((of, number[len(items.ids) :], *[old.field(c).to_numpy() for c in ("doc_word", "item_word", "length")]))
    d, i, x, y, length = _longest(found) if found else (np.zeros(0, np.int64),) * 5
    kinds = [pa.array(names[i].tolist(), pa.string()), *[pa.array(c.astype(np.int32)) for c in (x, y, length)]]
    longest = pa.StructArray.from_arrays(kinds, fields=list(_MATCHES.value_type))
    return counts, hits_out, pa.ListArray.from_arrays(pa.array(np.searchsorted(d, np.arange(rows + 1)).astype(np.int32)), longest)


def _pass(docs: DataFrame, block) -> DataFrame:
    """One block of items over all documents; columns beside text, n_words, hits and matches go through."""
    beside = [c for c in docs.columns if c not in ("text", "n_words", "hits", "matches")]
    again = "hits" in docs.columns
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in beside)

    def run(batches):
        items = block.value
        for b in batches:
            old = [b.column(b.schema.get_field_index(c)) for c in ("hits", "matches")] if again else []
            text = b.column(b.schema.get_field_index("text"))
            n, hits, matches = search_shard(items, text, *old)
            cols = [b.column(b.schema.get_field_index(c)) for c in beside]
            yield pa.RecordBatch.from_arrays([*cols, text, pa.array(n.astype(np.int64)), hits, matches], names=[*beside, "text", "n_words", "hits", "matches"])

    return docs.mapInArrow(lean(run), f"{kinds}, text string, n_words long, {FOUND}")


def _searched(docs: DataFrame, items: DataFrame, window: int, block_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    bound_text_batches(spark)
    kept = Written(spark, "clean13")
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):  # one block is on the driver at a time
        rows = items.filter(of == k).distinct().orderBy("item_id", "text").collect()
        block = spark.sparkContext.broadcast(Items([r.item_id for r in rows], [r.text for r in rows], window))
        docs = _pass(docs, block)
        if k < blocks - 1:
            docs = kept.cut(docs)
    return docs


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_words, hits, matches)`` of every document: the runs of words covered by windows, and of each item with an
    occurring window the longest verbatim match: ``item_id`` (as text; in its order), ``doc_word``, ``item_word`` and ``length``."""
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    return _searched(docs, items, window, block_bytes).drop("text")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with all their columns, that hold no window of any item."""
    clean = _searched(held(docs.withColumn("text", F.col("text").cast("string")), "text"), items, window, block_bytes).filter(F.size("hits") == 0)
    return freed(clean, docs, "text")


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production parameters: windows of ten words, all documents, all items of ``benchmark``."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.array_sort(F.transform("matches", lambda m: m.item_id))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h.length)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("matches").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated")
    )


ORACLE_SQL = r"""
with low as (select row_number() over () as r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
     docs as (select r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from low),
     items as (select coalesce(cast(item_id as varchar), '') as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
     windows as (select distinct item_id, least(10, len(w)) as n, w[j : j + least(10, len(w)) - 1] as g from items, unnest(range(1, len(w) - least(10, len(w)) + 2)) u(j) where len(w) > 0),
     places as (select r, p, n, w[p : p + n - 1] as g from docs, (select distinct n from windows) l, unnest(range(1, len(w) - n + 2)) u(p) where len(w) >= n),
     found as (select r, p, n, item_id from places join windows using (n, g)),
     hit as (select r, count(distinct p + k) as n_hit from (select distinct r, p, n from found) f, unnest(range(0, n)) u(k) group by r),
     held as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, item_id from found) f group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (r) left join held using (r)
"""
