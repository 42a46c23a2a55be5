"""Language identification with bit-sliced Bloom filters over character n-grams (operator 4).

Training counts the character n-grams of every language over all training texts, keeps for each language
those that it uses ``least`` times or more and at least ``share`` times as often as the language that uses them most, and sets the
language's bit in ``HASHES`` slots of one table: the Bloom filters of all languages side by side, so that a
single look-up returns the mask of all languages that hold an n-gram. The table has a fixed number of slots
whatever the corpus. A text's hits per language are popcounts of these masks, corrected by each filter's
false-positive rate; the language with most corrected hits is the prediction (ties: the first by name; a text with letters, but
without any known n-gram, gets the first by name with score 0).

Nulls: a null text, or one without a letter, is ``und`` with score 0; rows with a null lang are predicted but
never learned from; a null ``doc_id`` counts as the empty text in the fold. Long words count
whole. Repeated rows are judged one by one. With no training row at all every text is ``und``.
Empty table: no rows. Extra columns are ignored; kept columns named ``lang_pred`` or ``score`` are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synframe.llm.columns import named
from synframe.runtime import Written, bound_text_batches, lean

NGRAMS = (3, 4)
SLOTS = 1 << 20
HASHES = 3
LETTERS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """Words of the training counts: maximal runs of letters, as ``Model.hits`` cuts them."""
    out = []
    for w in LETTERS.findall(text):
        out += [w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split()
    return out


def fold(doc_id: str = "doc_id", folds: int = 4) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def grams(word: str) -> list[str]:
    w = f"_{word}_"
    return [w[i : i + n] for n in NGRAMS for i in range(len(w) - n + 1)]


_PRIMES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
_M64 = (1 << 64) - 1
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For every code point: is it a letter?"""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def gram_hashes(codes: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of n-grams given as n arrays of code points (0: word edge)."""
    h = np.full(len(codes[0]), len(codes) * 0x632BE59BD9B4E019 & _M64, np.uint64)
    for c, p in zip(codes, _PRIMES, strict=False):
        h += c.astype(np.uint64) * np.uint64(p)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def hash_slots(h: np.ndarray) -> list[np.ndarray]:
    """Slots of every hash by double hashing."""
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(i) * b) % np.uint64(SLOTS)).astype(np.int64) for i in range(HASHES)]


def slots(gram: str) -> list[int]:
    """Slots of one n-gram."""
    return [int(s[0]) for s in hash_slots(gram_hashes([np.array([0 if c == "_" else ord(c)]) for c in gram]))]


@dataclass
class Model:
    """table: (SLOTS, words of 64 languages); rate: false-positive rate of every language's filter."""

    langs: list[str]
    table: np.ndarray
    rate: np.ndarray

    def hits(self, text: str) -> np.ndarray:
        """Number of the text's n-grams found in each language's filter, and (last) the number of its n-grams; all 0 without letters."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[codes]
        out = np.zeros(len(self.langs) + 1, np.int64)
        if not letter.any():
            return out
        # words with one edge (0) between them
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        c = np.concatenate(([0], np.where(letter, codes, 0)[keep], [0]))
        for n in NGRAMS:
            m = len(c) - n + 1
            if m < 1:
                continue
            whole = c[1 : m + 1] != 0
            for i in range(2, n - 1):
                whole &= c[i : m + i] != 0
            at = np.flatnonzero(whole)
            s = hash_slots(gram_hashes([c[at + i] for i in range(n)]))
            out[-1] += len(at)
            for w in range(self.table.shape[1]):
                col = self.table[:, w]
                mask = col[s[0]]
                for x in s[1:]:
                    mask = mask & col[x]
                for i in range(64 * w, min(64 * w + 64, len(self.langs))):
                    out[i] += np.count_nonzero(mask & np.uint64(1 << (i % 64)))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        out, scores = [], []
        for t in texts:
            total = self.hits(t) if t and self.langs else None
            if total is None or not total[-1]:
                out.append("und")
                scores.append(0.0)
                continue
            own = np.maximum(0.0, (total[:-1] - self.rate * total[-1]) / (1 - self.rate))
            best = int(own.argmax())
            out.append(self.langs[best])
            scores.append(float(own[best] / own.sum()) if own.sum() else 0.0)
        return out, scores


def gram_counts(train: DataFrame) -> DataFrame:
    """``(lang, gram, n)`` over all texts of ``train`` (lang not null)."""

    def run(batches):
        words: dict[str, Counter] = {}
        size = 0

        def flush():
            for lang, c in words.items():
                g: Counter = Counter()
                for w, n in c.items():
                    for x in grams(w):
                        g[x] += n
                keys = list(g)
                for k in range(0, len(keys), 100_000):
                    part = keys[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part), pa.array([g[x] for x in part], pa.int64())], names=["lang", "gram", "n"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c = words.setdefault(lang, Counter())
                before = len(c)
                c.update(letter_runs((text.as_py() or "").lower()))
                size += len(c) - before
                if size > 300_000:
                    yield from flush()
                    words, size = {}, 0
        yield from flush()

    bound_text_batches(train.sparkSession)
    rows = train.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "lang string, gram string, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, share: float = 0.4, least: int = 3) -> Model:
    """Learn from all rows of ``docs`` with a lang; only the fixed-size table and per-language totals reach the driver."""
    counts = Written(docs.sparkSession, "grams").cut(gram_counts(docs.filter(F.col("lang").isNotNull())))
    totals = {r["lang"]: r["t"] for r in counts.groupBy("lang").agg(F.sum("n").alias("t")).collect()}
    langs = sorted(totals)
    if not langs:
        return Model([], np.zeros((SLOTS, 1), np.uint64), np.zeros(0))
    width = -(-len(langs) // 64)
    place = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])
    total = F.create_map(*[F.lit(x) for lang in langs for x in (lang, float(max(1, totals[lang])))])
    per = counts.filter(F.col("n") >= least).groupBy("gram").agg(F.collect_list(F.struct(place[F.col("lang")].alias("l"), (F.col("n") / total[F.col("lang")]).alias("r"))).alias("ls"))
    top = F.array_max(F.transform("ls", lambda x: x["r"]))
    per = per.withColumn("top", top).withColumn("ls", F.filter("ls", lambda x: x["r"] >= share * F.col("top")))

    def place_bits(batches):
        for b in batches:
            at, word, bit = [], [], []
            for g, ls in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for s in slots(g):
                    for l in ls:
                        at.append(s)
                        word.append(l // 64)
                        bit.append(1 << (l % 64))
            v = np.array(bit, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(word, pa.int32()), pa.array(v)], names=["slot", "word", "bits"])

    bits = per.select("gram", F.transform("ls", lambda x: x["l"]).alias("ls")).mapInArrow(lean(place_bits), "slot int, word int, bits long")
    found = bits.groupBy("slot", "word").agg(F.expr("bit_or(bits)").alias("bits")).toPandas()  # at most SLOTS rows for each 64 languages
    table = np.zeros((SLOTS, width), np.uint64)
    table[found["slot"].to_numpy(), found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.int64).view(np.uint64)
    fill = np.array([((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))])
    return Model(langs, table, np.minimum(0.99, fill**HASHES))


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default doc_id), lang_pred and score of every text."""
    spark = docs.sparkSession
    kept = ["doc_id"] if keep is None else [c for c in keep if c not in ("lang_pred", "score")]
    shared = spark.sparkContext.broadcast(model)  # SLOTS * 8 bytes for each 64 languages, whatever the corpus
    inner = docs.select(F.struct(*map(named, kept)).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches):
        m = shared.value
        for b in batches:
            lang, score = m.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["row", "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType().add("row", inner.schema["row"].dataType).add("lang_pred", StringType()).add("score", DoubleType())
    return inner.mapInArrow(lean(run), schema).select(*[F.col("row")[c].alias(c) for c in kept], "lang_pred", "score")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production parameters: learn from folds other than 2 of 4, predict all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(fold() != 2))
    out = predict(docs.withColumn("held_out", fold() == 2), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")
