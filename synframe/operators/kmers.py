"""K-mers of nucleotide sequences, cut from pieces of bounded size so that a long sequence is no unit of work."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synframe.functions.sequence import reverse_complement_acgt

#: Positions of a piece.
PIECE = 8192
#: Largest k whose k-mers are coded in a long, four bits a nucleotide.
CODED = 15
#: Largest k whose k-mers are packed in a long, two bits a nucleotide, with a bit to spare for a side.
PACKED = 31


def pieces(seqs: DataFrame, before: int, after: int, piece: int = PIECE) -> DataFrame:
    """``seqs`` with ``seq`` replaced by ``(at, size, p)``: pieces of ``piece`` positions from ``at`` on, with up to ``before`` bytes ahead
    of it and ``after`` behind it in the binary ``p``; ``size`` is the whole sequence's length. Case is ignored."""
    beside = [c for c in seqs.columns if c != "seq"]
    s = seqs.filter("length(seq) > 0").select(*beside, F.upper("seq").cast("binary").alias("_s"), F.length("seq").cast("long").alias("size"))
    s = s.select(*beside, "size", "_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(piece).cast("long"))).alias("at"))
    return s.select(*beside, "at", "size", F.expr(f"substring(_s, int(greatest(at - {before}, 0)) + 1, int({piece + after} + least(at, {before})))").alias("p"))


def kmer(p: Column, i: Column, k: int) -> Column:
    """The k-mer at offset ``i`` of a binary piece; null where it is cut off or holds another letter than A, C, G, T."""
    s = F.substring(p, i + 1, F.lit(k)).cast("string")
    return F.when((i >= 0) & (F.length(s) == k) & (F.translate(s, "ACGT", "") == ""), s)


def canonical(s: Column) -> tuple[Column, Column]:
    """The smaller of a k-mer and its reverse complement, and 1 or -1 for which it is."""
    r = reverse_complement_acgt(s)
    return F.least(s, r), F.when(s <= r, 1).when(s > r, -1)


def code(s: Column) -> Column:
    """A k-mer of up to ``CODED`` letters as a long, a hexadecimal digit a letter."""
    return F.conv(F.translate(s, "ACGT", "0123"), 16, 10).cast("long")


def packed(p: bytes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every k-mer of a piece: the smaller code of it and its reverse complement, whether it is the k-mer's own, and whether all its
    letters are A, C, G or T. Codes of two bits a letter sort as the k-mers do."""
    v = _DIGIT[np.frombuffer(p, np.uint8)]
    n = max(0, len(v) - k + 1)
    bad = np.concatenate(([0], np.cumsum(v > 3)))
    d = (v & 3).astype(np.int64)
    f, r = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for j in range(k if n else 0):
        f = (f << 2) | d[j : j + n]
        r |= (3 - d[j : j + n]) << (2 * j)
    return np.minimum(f, r), f <= r, bad[k : k + n] == bad[:n]


def coded(p: bytes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``packed``, for k up to ``CODED`` and codes of four bits a letter (``code``)."""
    two, own, ok = packed(p, k)
    four = np.zeros(len(two), np.int64)
    for j in range(k):
        four |= ((two >> (2 * j)) & 3) << (4 * j)
    return four, own, ok


_DIGIT = np.full(256, 4, np.uint8)
_DIGIT[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4, dtype=np.uint8)


def packed_walk(k: int, piece: int):
    """Batches of pieces ``(genome, chr, at, o, p)`` -> rows of ``blockfinder.kmer_walk``, an Arrow batch for about 65,000 of them."""

    def rows(p, at, o):
        node, own, ok = packed(p, k)
        h = np.arange(o, min(o + piece, len(node)))
        h = h[ok[h]]
        ahead = np.minimum(h + 1, len(node) - 1)
        some = (h + 1 < len(node)) & ok[ahead]
        return at + h - o, node[h], np.where(own[h], 1, -1), node[ahead] * 2 + np.where(own[ahead], 0, 1), ~some, (h == 0) | ~ok[h - 1]

    def run(batches):
        for b in batches:
            at, o, ps = b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4)
            held, who, n = [], [], 0
            for i in range(b.num_rows):
                held.append(rows(ps[i].as_py(), at[i], o[i]))
                who.append(np.full(len(held[-1][0]), i))
                n += len(who[-1])
                if n and (n >= 65_536 or i == b.num_rows - 1):
                    take = pa.array(np.concatenate(who))
                    pos, node, sign, right, end, left = (np.concatenate(x) for x in zip(*held, strict=True))
                    cols = [b.column(0).take(take), b.column(1).take(take), pa.array(pos.astype(np.int64)), pa.array(node), pa.array(sign.astype(np.int32)), pa.array(right, pa.int64(), mask=end), pa.array(left)]
                    yield pa.RecordBatch.from_arrays(cols, names=["genome", "chr", "pos", "node", "sign", "right", "left_end"])
                    held, who, n = [], [], 0

    return run


def letter_bits(v: np.ndarray, k: int, node: np.ndarray, own: np.ndarray, ok: np.ndarray, h: np.ndarray) -> np.ndarray:
    """What the k-mers at ``h`` of a piece with digits ``v`` lead to, six bits for the right side of the node and six more for its left:
    1, 2, 4 or 8 for the letter that follows, 16 for an end; 32 if the next k-mer is of the same node."""

    def near(to, ahead, letter):
        some = ahead & ok[to]
        x = v[np.clip(letter, 0, len(v) - 1)] & 3
        return np.where(some, np.left_shift(1, np.where(own[h], x, 3 - x).astype(np.int32)) + np.where(node[to] == node[h], 32, 0), 16)

    after, before = near(np.minimum(h + 1, len(node) - 1), h + 1 < len(node), h + k), near(np.maximum(h - 1, 0), h > 0, h - 1)
    return np.where(own[h], after, before) | np.where(own[h], before, after) << 6


def packed_steps(k: int, piece: int, cols: list[str]):
    """Batches of pieces ``(sid, at, p)`` -> columns ``cols`` of ``blockfinder.piece_steps``, an Arrow batch for about 65,000 rows."""

    def rows(sid, at, p):
        node, own, ok = packed(p, k)
        h = np.arange(1, min(1 + piece, len(node)))
        h = h[ok[h]]
        made = {
            "sid": lambda: np.full(len(h), sid, np.int64),
            "pos": lambda: (at + h - 1).astype(np.int64),
            "place": lambda: (sid * piece + h - 1).astype(np.int64),
            "node": lambda: node[h],
            "sign": lambda: np.where(own[h], 1, -1).astype(np.int32),
            "bits": lambda: letter_bits(_DIGIT[np.frombuffer(p, np.uint8)], k, node, own, ok, h).astype(np.int32),
        }
        return [made[c]() for c in cols]

    def run(batches):
        for b in batches:
            sid, at, ps = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            held, n = [], 0
            for i in range(b.num_rows):
                held.append(rows(sid[i], at[i], ps[i].as_py()))
                n += len(held[-1][0])
                if n and (n >= 65_536 or i == b.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=cols)
                    held, n = [], 0

    return run


def _nodes(p: bytes, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the k-mers at some places of a piece, and whether they read as the k-mers do."""
    if k <= PACKED:
        node, own, _ = packed(p, k)
        return node[at], own[at]
    text, turned = p.decode(), p.translate(bytes.maketrans(b"ACGT", b"TGCA"))[::-1].decode()
    both = [(text[i : i + k], turned[len(text) - i - k : len(text) - i]) for i in at]
    node = np.empty(len(both), object)
    node[:] = [min(x) for x in both]
    return node, np.array([f <= r for f, r in both], bool)


def stretches(k: int, piece: int):
    """Rows ``(code, p)`` in order, a piece and then its places (place times eight, plus one and a bit for a simple right and left side of the
    node) -> ``(pid, s, e, before, after, node, sign)``: the contracted stretches within pieces, whether their ends are simple sides, and the
    smallest node with its smallest sign."""

    def found(pid, pos, x, node, right):
        r, l = x & 1 > 0, x & 2 > 0
        after, before = np.where(right, r, l), np.where(right, l, r)
        on = (pid[1:] == pid[:-1]) & (pos[1:] == pos[:-1] + 1) & after[:-1] & before[1:]
        s = np.concatenate(([0], np.flatnonzero(~on) + 1))
        e = np.append(s[1:], len(pos)) - 1
        if node.dtype == object:  # k-mers too long to be packed
            sign = np.where(right, 1, -1)
            low, least = zip(*[min(zip(node[i : j + 1], sign[i : j + 1], strict=True)) for i, j in zip(s, e, strict=True)], strict=True)
            low, least = pa.array(low, pa.string()), np.array(least, np.int32)
        else:
            key = np.minimum.reduceat(node * 2 + right, s)
            low, least = key >> 1, np.where(key & 1, 1, -1).astype(np.int32)
        cols = [pid[s], pos[s].astype(np.int32), pos[e].astype(np.int32), before[s], after[e], low, least]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["pid", "s", "e", "before", "after", "node", "sign"])

    def whole(parts):
        """Pieces and their codes -> rows."""
        cols = []
        for first, p, codes in parts:
            c = (np.concatenate(codes) if len(codes) > 1 else codes[0]) - first
            if len(c):
                cols.append((np.full(len(c), first // (8 * piece)), c >> 3, (c & 7) - 1, *_nodes(p, k, (c >> 3) + 1)))
        if cols:
            yield found(*[np.concatenate(c) for c in zip(*cols, strict=True)])

    def run(batches):
        last = None  # the piece whose places may go on
        for b in batches:
            code, p = b.column(0).to_numpy(), b.column(1)
            new = np.flatnonzero(p.is_valid().to_numpy(zero_copy_only=False))
            if last:
                last[2].append(code[: new[0] if len(new) else len(code)])
            if len(new):
                done = [last] if last else []
                done += [(code[i], p[i].as_py(), [code[i + 1 : j]]) for i, j in zip(new[:-1], new[1:], strict=True)]
                yield from whole(done)
                i = new[-1]
                last = (code[i], p[i].as_py(), [code[i + 1 :]])
        if last:
            yield from whole([last])

    return run
