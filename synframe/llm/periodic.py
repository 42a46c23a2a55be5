"""Periodic runs of words by power-of-two naming (Karp, Miller and Rosenberg, 1972; operator 12).

Words are runs of bytes other than the six ASCII white spaces. A run is a stretch of consecutive words whose smallest period is q (words q
apart are identical), which no neighbouring word extends, and which is at least ``exponent`` periods and ``least`` words long.

1. *Names.* Words are numbered. A stretch of 2L words is named by the pair of names of its halves of L words, pairs numbered in order.
   Only stretches that occur twice in their text get a name at the next level: a stretch that occurs once is equal to none.
2. *Grid candidates.* Take L = 1, 2, 4 ... A run whose period p is in (L/2, L] is at least 4p long, so it holds a place on the
   grid of step max(1, L/2) whose stretch of L words occurs again p words later, and, L being p or more, not before. So of the grid places
   only those are candidates whose next equal stretch lies in (L/2, L] words ahead; its distance is then the smallest period.
3. *Extension.* A candidate grows to both sides by the longest common extension of the two places: names are compared from the highest
   level down, a stretch of 2^k words at a time. No hash and no sorted suffix takes part.

All texts of an Arrow batch (a few MiB) are worked on together in NumPy; a text is never split. Nothing is shuffled.

A null text has no words. Repeated rows stay. Empty table: no rows. Extra columns, whatever their names, are ignored by ``periodic_runs``
and kept by ``collapse_runs``. A text of any length is worked on as a whole: names take 4 bytes a word and level where
repeats are dense and follow the repeats elsewhere. Runs of one text are ordered by start, then period.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synframe.llm.columns import freed, held
from synframe.llm.words import NOT_SPACE, split_words
from synframe.runtime import bound_text_batches, lean

LEAST, EXPONENT = 6, 4
RUN = "struct<start:long,length:long,period:long>"
_RUNS = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _grouped(a: np.ndarray, b: np.ndarray | None, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places ordered by the pair of names (all below ``n``) and then by place, and where a new pair begins."""
    bits = int(n).bit_length()
    if (3 if b is not None else 2) * bits <= 63:  # pair and place in one integer
        key = a.astype(np.int64) if b is None else a.astype(np.int64) << bits | b
        key = np.sort(key << bits | at)
        at, key = key & ((1 << bits) - 1), key >> bits
        return at, np.concatenate(([True], key[1:] != key[:-1]))[: len(at)]
    order = np.lexsort((at, a) if b is None else (at, b, a))
    new = np.ones(len(order), bool)
    new[1:] = a[order][1:] != a[order][:-1]
    if b is not None:
        new[1:] |= b[order][1:] != b[order][:-1]
    return at[order], new


class Names:
    """Names of stretches of 2^k words of all texts of a batch; ``candidates`` are collected on the way."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        self.n, counts = len(words), np.diff(bounds)
        self.text = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        self.first, self.end = bounds[:-1], bounds[1:]
        self.levels: list[tuple[np.ndarray | None, np.ndarray]] = []
        self.candidates: list[tuple[np.ndarray, np.ndarray]] = []
        at, new = _grouped(words, None, np.arange(self.n), max(self.n, int(words.max(initial=0)) + 1))
        length = 1
        while len(at):
            at = self._level(at, new, length)
            two = at[at + 2 * length <= self.end[self.text[at]]]
            left, right = self.names(len(self.levels) - 1, two), self.names(len(self.levels) - 1, two + length)
            ok = right >= 0
            at, new = _grouped(left[ok], right[ok], two[ok], self.n + 1)
            length *= 2

    def _level(self, at: np.ndarray, new: np.ndarray, length: int) -> np.ndarray:
        """Name the stretches that occur twice in one text; their places, ascending."""
        text = self.text[at]
        again = np.zeros(len(at), bool)  # the next of the group is in the same text
        again[:-1] = ~new[1:] & (text[1:] == text[:-1])
        step = max(1, length // 2)
        here = np.flatnonzero(again)
        apart = at[here + 1] - at[here]
        ok = (at[here] % step == 0) & (2 * apart > length) & (apart <= length)
        place, apart = at[here[ok]], apart[ok]
        order = np.argsort(place)
        place, apart = place[order], apart[order]
        if len(place):  # of candidates a step apart with one period the first stands for all
            same = (place[1:] - place[:-1] == step) & (apart[1:] == apart[:-1]) & (self.text[place[1:]] == self.text[place[:-1]])
            self.candidates.append((place[np.concatenate(([True], ~same))], apart[np.concatenate(([True], ~same))]))
        alive = again.copy()
        alive[1:] |= again[:-1]
        name = np.cumsum(new)[alive].astype(np.int32)
        at = at[alive]
        if 16 * len(at) > self.n:
            dense = np.full(self.n, -1, np.int32)
            dense[at] = name
            self.levels.append((None, dense))
            return np.flatnonzero(dense >= 0)
        order = np.argsort(at)
        self.levels.append((at[order], name[order]))
        return at[order]

    def names(self, k: int, at: np.ndarray) -> np.ndarray:
        """Names at the places, -1 where the stretch has none."""
        places, name = self.levels[k]
        if places is None:
            return name[at]
        if not len(places):
            return np.full(len(at), -1, np.int32)
        i = np.minimum(np.searchsorted(places, at), len(places) - 1)
        return np.where(places[i] == at, name[i], -1)

    def extension(self, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
        """Number of equal words from ``a`` and ``b`` on (``back``: before them) within the text; a < b."""
        out = np.zeros(len(a), np.int64)
        edge = self.first[self.text[a]] if back else self.end[self.text[b]]
        for k in range(len(self.levels) - 1, -1, -1):
            size = 1 << k
            i, j = (a - out - size, b - out - size) if back else (a + out, b + out)
            todo = np.flatnonzero(i >= edge if back else j + size <= edge)
            x, y = self.names(k, i[todo]), self.names(k, j[todo])
            out[todo[(x == y) & (x >= 0)]] += size
        return out


def find_runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(place, length, period)`` of all runs, by place and period; text t is ``words[bounds[t]:bounds[t + 1]]``."""
    if exponent < 4:
        raise ValueError("the grid holds a place of every run of four periods or more only")
    names = Names(words, bounds)
    if not names.candidates:
        return (np.zeros(0, np.int64),) * 3
    a, period = map(np.concatenate, zip(*names.candidates, strict=True))
    start = a - names.extension(a, a + period, back=True)
    length = a + period + names.extension(a, a + period, back=False) - start
    ok = (length >= least) & (length >= exponent * period)
    start, period, length = np.unique(np.stack((start[ok], period[ok], length[ok])), axis=1)
    return start, length, period


def _texts(texts: pa.Array, least: int, exponent: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """``(number of words, runs, collapsed text)`` of every text."""
    words, counts = split_words(texts, NOT_SPACE)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    numbers = words.dictionary_encode().indices.to_numpy() if len(words) else np.zeros(0, np.int64)
    start, length, period = find_runs(numbers, bounds, least, exponent)
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    kept = np.cumsum(edge[:-1]) == 0
    left = words if kept.all() else words.filter(pa.array(kept))
    ends = np.concatenate(([0], np.cumsum(kept)))[bounds]
    text = pa.compute.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), left), pa.scalar(b" ", pa.large_binary()))
    of = np.searchsorted(bounds, start, "right") - 1
    runs = pa.StructArray.from_arrays([pa.array(start - bounds[of]), pa.array(length), pa.array(period)], fields=list(_RUNS))
    runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(start, bounds).astype(np.int32)), runs)
    return counts, runs, text.cast(pa.large_string()).cast(pa.string())


def _mapped(docs: DataFrame, beside: list[str], least: int, exponent: int) -> DataFrame:
    bound_text_batches(docs.sparkSession)
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in beside)

    def run(batches):
        for b in batches:
            n, runs, text = _texts(b.column(b.schema.get_field_index("text")), least, exponent)
            cols = [b.column(b.schema.get_field_index(c)) for c in beside]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n.astype(np.int64)), runs, text], names=[*beside, "n_words", "runs", "collapsed"])

    return docs.mapInArrow(lean(run), f"{kinds}n_words long, runs array<{RUN}>, collapsed string")


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` of every document: its runs (``start``, ``length`` and ``period`` in words), and its words,
    joined by one space, without those that some run holds after its first period."""
    return _mapped(docs.select("doc_id", F.col("text").cast("string").alias("text")), ["doc_id"], least, exponent)


def collapse_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """The documents with all their columns; a text that holds a run is replaced by its collapsed text, others stay as they are."""
    text = F.col("text").cast("string")
    rows = held(docs.withColumns({"text": text}), "text").select("text", F.struct("text", "_rest").alias("_row"))
    out = _mapped(rows, ["_row"], least, exponent)
    out = out.select(F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("_row.text")).alias("text"), F.col("_row._rest").alias("_rest"))
    return freed(out, docs, "text")


def _planted(doc_id: Column, text: Column) -> Column:
    """The text in which, for one document of ten, all words from some place on repeat with a period, as the query's contract says."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))), " ")

    some = F.when(F.size(words) > 0, F.get(F.transform(F.array(words), repeated), F.lit(0))).otherwise(text)
    return F.when(F.pmod(h, F.lit(10)) == 0, some).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production parameters: runs of six words and four periods or more, in all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(docs.select("doc_id", _planted(F.col("doc_id"), F.col("text")).alias("text")))
    none = F.lit(None).cast(RUN)
    greater = lambda b, r: b.isNull() | (r.length * b.period > b.length * r.period)
    best = F.aggregate("runs", none, lambda b, r: F.when(greater(b, r), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("(1000 * b.length) div b.period")
    return out.select("doc_id", "n_runs", "b.start", "b.length", "b.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
