"""Best-fit packing by linear grouping (operator 2).

Texts are tokenised, an end token is added, and documents longer than a sequence are cut (the first piece is
the short one). What is packed is the histogram of piece lengths, which has at most ``capacity`` entries
whatever the corpus:

1. Large lengths are sorted and split into groups of equal cardinality; each is rounded up to its group's
   largest length, so that few sizes are left.
2. Configurations of these few sizes are optimised: the largest size that is left is combined with the subset
   of sizes that fills the sequence best (bounded knapsack), as often as the demand allows.
3. Actual lengths take the places of the rounded ones, which frees the rounding loss.
4. Small lengths are put, longest first, where they fit best; new sequences are opened for what is left.

The plan is a list of sequence types: lengths and how many sequences look like that. It becomes slots (length,
range of ranks -> sequence, offset). Pieces get their rank within their length from counts per (length, salt),
so a length that a third of all pieces share is ranked in many tasks.

Nulls: a null text is empty and packs as its end token alone; a null ``doc_id`` is kept. Repeated rows are
packed one by one. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from synframe.runtime import Written, bound_text_batches, lean, shuffle_partitions

CAPACITY = 1024
END_ID = 2
_LOADED: dict[str, object] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    """``texts -> lists of ids`` of the tokenizer file; loaded once in a process.

    Where the same vocabulary lies beside it as ranks, the ids are made by that library (four times as fast, the
    same ids); texts that hold an added token's string go through the tokenizer file itself.
    """
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        plain = lambda ts: [e.ids for e in tok.encode_batch_fast(ts, add_special_tokens=False)]
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            special = [t.content for t in tok.get_added_tokens_decoder().values()]
            _LOADED[path] = lambda ts: [plain([t])[0] if any(s in t for s in special) else fast.encode_ordinary(t) for t in ts]
        else:
            _LOADED[path] = plain
    return _LOADED[path]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every piece, with ``ids`` if asked for."""
    bound_text_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches):
        encode = encoder(path)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                out: list[tuple] = []
                for own, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = np.array([*encode([text.as_py() or ""])[0], END_ID], "<u4")
                    at, first = 0, len(ids) % capacity or capacity
                    for n, end in enumerate(range(first, len(ids) + 1, capacity)):
                        piece = ids[at:end]
                        out.append((own, n, at, end - at, zlib.crc32(piece.tobytes()), *([piece.astype(np.int32).tolist()] if with_ids else [])))
                        at = end
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                cols = list(zip(*out, strict=True)) or [()] * (5 + with_ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), schema)


def linear_groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths, largest first, in groups of (almost) equal cardinality: lists of (length, count)."""
    total = sum(counts.values())
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = -(-total // groups)
            n = min(left, room)
            out[-1].append((length, n))
            left, room = left - n, room - n
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(how many of each size index, times): the largest size left with the subset that fills the sequence best."""
    left = list(demand)
    out: list[tuple[dict[int, int], int]] = []
    while any(left):
        top = next(i for i, n in enumerate(left) if n)  # sizes fall with the index
        room = capacity - sizes[top]
        reach = np.full(room + 1, -1, np.int32)  # last size used to fill exactly so much
        used = np.zeros(room + 1, np.int32)
        reach[0] = len(sizes)
        for i in range(top, len(sizes)):
            n = left[i] - (i == top)
            s = sizes[i]
            if n <= 0 or s > room:
                continue
            turns = min(n, room // s)
            fresh = reach >= 0
            for t in range(turns):
                src = np.flatnonzero(fresh[: room + 1 - s])
                to = src + s
                to = to[reach[to] < 0]
                if not len(to):
                    break
                reach[to], used[to] = i, t + 1
                fresh = np.zeros(room + 1, bool)
                fresh[to] = True
        fill = int(np.flatnonzero(reach >= 0)[-1])
        conf: dict[int, int] = defaultdict(int)
        conf[top] += 1
        while fill:
            i = int(reach[fill])
            conf[i] += 1
            fill -= sizes[i]
        times = min(left[i] // n for i, n in conf.items())
        for i, n in conf.items():
            left[i] -= n * times
        out.append((dict(conf), times))
    return out


class _Bins:
    """Sequence types by free room: free -> list of (composition, times)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
        self.rooms: list[int] = []

    def put(self, lengths: tuple[int, ...], times: int) -> None:
        free = self.capacity - sum(lengths)
        if times:
            if not self.by[free]:
                self.rooms.insert(bisect_left(self.rooms, free), free)
            self.by[free].append((lengths, times))

    def tightest(self, size: int) -> tuple[tuple[int, ...], int] | None:
        at = bisect_left(self.rooms, size)
        if at == len(self.rooms):
            return None
        free = self.rooms[at]
        got = self.by[free].pop()
        if not self.by[free]:
            self.rooms.pop(at)
        return got


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = 96, small: int = 200) -> list[tuple[tuple[int, ...], int]]:
    """Sequence types (lengths in order, how many sequences) that hold exactly ``counts`` pieces of every length."""
    bins = _Bins(capacity)
    bins.put((capacity,), counts.get(capacity, 0))
    grouped = linear_groups({k: v for k, v in counts.items() if small < k < capacity and v}, groups)
    sizes = [g[0][0] for g in grouped]
    queue = [list(g) for g in grouped]
    for conf, times in configurations(sizes, [sum(n for _, n in g) for g in grouped], capacity):
        places = [i for i, n in sorted(conf.items()) for _ in range(n)]
        done = 0
        while done < times:
            # the actual lengths in the places, for as many sequences as none of them changes
            need: dict[int, int] = defaultdict(int)
            for i in places:
                need[i] += 1
            lengths, step = [], times - done
            for i, k in need.items():
                length, n = queue[i][0]
                if n >= k:
                    step = min(step, n // k)
                    lengths += [length] * k
                else:  # a sequence that takes the last of one length and the first of the next ones
                    step = 1
                    j, rest = 0, k
                    while rest:
                        m = min(rest, queue[i][j][1])
                        lengths += [queue[i][j][0]] * m
                        rest, j = rest - m, j + 1
            for i, k in need.items():
                rest = k * step
                while rest:
                    length, n = queue[i][0]
                    m = min(n, rest)
                    rest -= m
                    queue[i][0] = (length, n - m)
                    if n == m:
                        queue[i].pop(0)
            bins.put(tuple(lengths), step)
            done += step
    for length in sorted((k for k in counts if k <= small and k < capacity), reverse=True):
        left = counts[length]
        while left:
            got = bins.tightest(length)
            if got is None:
                per = capacity // length
                full, rest = divmod(left, per)
                bins.put((length,) * per, full)
                if rest:
                    bins.put((length,) * rest, 1)
                break
            lengths, times = got
            per = min((capacity - sum(lengths)) // length, left)
            use = min(times, left // per)
            bins.put(lengths + (length,) * per, use)
            bins.put(lengths, times - use)
            left -= per * use
    return [x for types in bins.by for x in types]


def slots(types: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per length an array of rows (first rank, first sequence, offset), by rank: rank r is at sequence first + r - first rank."""
    rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    seq = 0
    for lengths, times in types:
        at = 0
        for n in lengths:
            rows[n].append((used[n], seq, at))
            used[n] += times
            at += n
        seq += times
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, groups: int = 96, with_ids: bool = False) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    p = Written(spark, "pack").cut(pieces(docs, tokenizer, capacity, with_ids))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(64, shuffle_partitions(spark)))).cast("int")
    p = p.withColumn("salt", salt)
    per = p.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    table = spark.sparkContext.broadcast(slots(plan(counts, capacity, groups)))
    ranked = p.withColumn("_r", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(before, ["length", "salt"]).withColumn("_rank", F.col("_r") - 1 + F.col("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches):
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(b.num_columns - 1).to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                rows, own = table.value[int(n)], np.flatnonzero(length == n)
                at = np.searchsorted(rows[:, 0], rank[own], "right") - 1
                seq[own] = rows[at, 1] + rank[own] - rows[at, 0]
                off[own] = rows[at, 2]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    return ranked.select(*names, F.col("_rank").cast("long").alias("_rank")).mapInArrow(lean(run), schema)


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production parameters: sequences of 1024 tokens of the 50k byte-level BPE, end token 2, all documents."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
