"""Removal of repeated byte strings by a hash-compared suffix sort (operator 1).

Every byte covered by a ``min_len``-byte string that starts at two or more places is removed.

1. *Windows meet at anchors.* Each ``min_len``-byte window has one anchor: the leftmost smallest ``GRAM``-gram
   hash inside it. That depends on the window's bytes only, so equal windows have their anchor at the same
   relative place. A document's windows fall into runs with a common anchor (one per ~170 bytes); a run is cut
   in two by the anchor's distance, so that all windows of a part share at least 232 bytes of known context.
   A part is one row: context hash, 128-bit BLAKE2b digest of its bytes, place.
2. *Equal parts* repeat as a whole. The polynomial context hash only brings them together; that they are equal is
   verified by the digests of their bytes, which no polynomial hash enters. Each map task settles those that it
   holds itself and sends one of them on, which is the pre-aggregation before the shuffle by context. Contexts
   that occur once are settled as well: nothing else can match there.
3. *The rest*, the edges of passages and of edits, is sorted: suffixes that start at the windows, in their class
   (context, anchor distance), by a bottom-up merge sort whose comparisons find the common extension by binary
   search over prefix polynomial hashes. Neighbours that agree on ``min_len`` bytes are verified byte by byte.
   A context with more than ``CROWD`` open parts (a passage that very many documents quote, each in its own
   surroundings) is not gathered: its windows are spread by the 128-bit digests of their own ``min_len`` bytes and
   verified by them, as in step 2.

Texts are cut into overlapping segments of ``SEGMENT`` windows, so memory does not grow with one text's arrays. Prefix hashes are polynomial sums modulo 2**64 (``numpy`` wraps), made position-free by the inverse powers of the
odd base.

Nulls: a null text is empty (0 bytes, nothing removed); a null ``doc_id`` is kept as null. Repeated rows are
separate places, so they remove each other. Texts shorter than ``min_len`` are never cut. Empty table: no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synframe.runtime import Written, bound_text_batches, lean, shuffle_partitions

GRAM = 64
POS_BITS = 24
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
ROWS_HELD = 300_000
BYTES_HELD = 1 << 21
#: A context with more open parts than this is not compared in one task: its windows are grouped by their own hashes.
CROWD = 1000
#: Windows of a text whose arrays are made at once.
SEGMENT = 1 << 22


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown when longer texts come."""

    def __init__(self, base: int):
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def grown(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inv)):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down


_POWERS = [_Powers(b) for b in BASES]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class PrefixHash:
    """Polynomial prefix sums of a byte array; the hash of any substring is two look-ups."""

    def __init__(self, data: np.ndarray, which: int = 0):
        up, self.down = _POWERS[which].grown(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]


def _window_anchor(gram: np.ndarray, w: int) -> np.ndarray:
    """For every run of ``w`` grams the index of its leftmost smallest (van Herk's sliding minimum)."""
    n, mask = len(gram), np.uint64((1 << POS_BITS) - 1)
    key = (gram & ~mask) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    padded = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[: n - w + 1], ahead[w - 1 : n]) & mask).astype(np.int64)


def digests(text: bytes, start: np.ndarray, end: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """128-bit digests (two columns) of ``text[start:end]``, each with its integer tag."""
    raw = b"".join([blake2b(text[a:z], digest_size=16, salt=t.to_bytes(8, "little")).digest() for a, z, t in zip(start.tolist(), end.tolist(), tag.tolist(), strict=True)])
    return np.frombuffer(raw, "<u8").reshape(-1, 2)


def parts(text: bytes, min_len: int) -> tuple[np.ndarray, ...]:
    """Rows of one text: context hash, content digest (two), first window, number of windows, anchor distance of the first window."""
    most = len(text) - min_len + 1
    if most < 1:
        return (np.zeros(0, np.uint64),) * 3 + (np.zeros(0, np.int64),) * 3
    cut = [_parts(text[a : a + SEGMENT + min_len - 1], min_len, a) for a in range(0, most, SEGMENT)]
    return tuple(map(np.concatenate, zip(*cut, strict=True)))


def _parts(text: bytes, min_len: int, offset: int) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(text, np.uint8)
    h0, h1 = PrefixHash(data, 0), PrefixHash(data, 1)
    w, most = min_len - GRAM + 1, len(data) - min_len + 1
    anchor = _window_anchor(_mix(h0.of(np.arange(most + w - 1), GRAM)), w)
    new = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    lo, hi = np.concatenate(([0], new)), np.concatenate((new, [most])) - 1
    at = anchor[lo]
    turn = (min_len - GRAM) // 2  # windows up to this far before the anchor are named by what follows it, others by what precedes it
    p0, p1 = np.maximum(lo, at - turn), np.minimum(hi, at - turn - 1)
    near, far = p0 <= hi, lo <= p1
    start = np.concatenate((p0[near], lo[far]))
    count = np.concatenate((hi[near], p1[far])) - start + 1
    anchor = np.concatenate((at[near], at[far]))
    ctx = np.concatenate((_mix(h1.of(at[near], min_len - turn)), _mix(h1.of(at[far] - turn - 1, turn + 1 + GRAM) ^ np.uint64(0x5851F42D4C957F2D))))
    dist = anchor - start
    s = digests(text, start, start + count + min_len - 1, dist)
    return ctx, s[:, 0], s[:, 1], start + offset, count, dist


def _same(*cols: np.ndarray) -> np.ndarray:
    out = np.ones(len(cols[0]) - 1, bool)
    for c in cols:
        out &= c[1:] == c[:-1]
    return out


NAMES = ("ctx", "s0", "s1", "known", "doc_id", "tk", "start", "count", "dist")
PART_SCHEMA = "ctx long, s0 long, s1 long, known boolean, doc_id long, tk int, start long, count int, dist int"
SPAN_SCHEMA = "kind byte, ctx long, doc_id long, tk int, start long, count int, dist int"


def _part_rows(min_len: int):
    def run(batches):
        held, n = [], 0

        def flush():
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            ctx, s0, s1, start, count, dist, own, tk, null = cols
            order = np.lexsort((start, own, s1, s0, ctx))
            ctx, s0, s1, start, count, dist, own, tk, null = (c[order] for c in (ctx, s0, s1, start, count, dist, own, tk, null))
            same = _same(ctx, s0, s1)
            after, before = np.append(same, False), np.insert(same, 0, False)
            known = after | before  # repeated within this task: settled here; only the first goes on to its context
            ctx = np.where(before, _mix(own.view(np.uint64) + start.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)), ctx)
            s0 = np.where(before, 0, s0)
            s1 = np.where(before, 0, s1)
            dist = np.where(before, -1, dist)
            cols = [pa.array(ctx.view(np.int64)), pa.array(s0.view(np.int64)), pa.array(s1.view(np.int64)), pa.array(known), pa.array(own, mask=null), pa.array(tk), pa.array(start), pa.array(count.astype(np.int32)), pa.array(dist.astype(np.int32))]
            whole = pa.RecordBatch.from_arrays(cols, names=list(NAMES))
            for k in range(0, whole.num_rows, 100_000):
                yield whole.slice(k, 100_000)

        for b in batches:
            ids = b.column(0)
            for i, text in enumerate(b.column(1).cast(pa.binary())):
                text = text.as_py() or b""
                if len(text) < min_len:
                    continue
                p = parts(text, min_len)
                m, own = len(p[0]), ids[i].as_py()
                held.append((*p, np.full(m, own or 0, np.int64), np.full(m, zlib.crc32(text) - (1 << 31), np.int32), np.full(m, own is None)))
                n += m
                if n >= ROWS_HELD:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    return run


def _settle_parts(batches):
    """Rows sorted by (ctx, s0, s1): kind 0 = windows known to repeat, kind 1 = to be compared, kind 2 = its known partner.

    A row is judged once the next one is seen, so no group is held. Rows of a context that holds one
    content only need no comparison; a context is told to hold several at the first change of content,
    and the rows read before that are sent on with it.
    """
    def emit(rows):
        if rows:
            k, c = zip(*rows, strict=True)
            t = list(zip(*c, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int8()), pa.array(t[0], pa.int64()), pa.array(t[4], pa.int64()), pa.array(t[5], pa.int32()), pa.array(t[6], pa.int64()), pa.array(t[7], pa.int32()), pa.array(t[8], pa.int32())], names=["kind", "ctx", "doc_id", "tk", "start", "count", "dist"])

    pending = None  # last content of the block before: (first row, rows seen, several, any known)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ctx, s0, s1 = (batch.column(i).to_numpy() for i in range(3))
        known, dist = batch.column(3).to_numpy(zero_copy_only=False), batch.column(8).to_numpy()
        out = []
        new = np.concatenate(([True], ~_same(ctx, s0, s1)))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, n))
        more = (size > 1)[np.cumsum(new) - 1]
        newctx = np.concatenate(([True], ctx[1:] != ctx[:-1]))[start]
        row = lambda i: tuple(batch.column(j)[int(i)].as_py() for j in range(len(NAMES)))
        first = 0
        if pending is not None:
            p_row, p_size, p_several, p_known = pending
            same_ctx = p_row[0] == int(ctx[0])
            if same_ctx and p_row[1] == int(s0[0]) and p_row[2] == int(s1[0]):
                # the open content goes on: this block's rows of it repeat
                if p_size == 1 and not p_known:
                    out.append((0, p_row))
                out += [(0, row(i)) for i in range(int(size[0]))]
                p_size, p_known, first = p_size + int(size[0]), True, 1
                if len(start) == 1:
                    pending = (p_row, p_size, p_several, True)
                    yield from emit(out)
                    continue
                same_ctx = p_row[0] == int(ctx[start[1]])
            several = p_several or same_ctx
            if several and p_row[8] >= 0:
                out.append((2 if p_size > 1 or p_known else 1, p_row))
            carry = several and same_ctx
            pending = None
        else:
            carry = False
        start, size, newctx = start[first:], size[first:], newctx[first:].copy()
        if len(start):
            newctx[0] = True
            # contexts of this block: groups of contents; the first may go on from the block before
            grp = np.cumsum(newctx) - 1
            many = np.bincount(grp) > 1
            if carry:
                many[0] = True
            several = many[grp]
            last = len(start) - 1
            anyknown = np.logical_or.reduceat(known[start[0] :], start - start[0])
            rep = (size > 1) | anyknown
            # all rows of repeated contents are settled; a single known row was settled by its own task
            hit = (more | known) & (np.arange(n) >= start[0])
            tail = int(start[last])
            kinds = np.where(rep, 2, 1)
            send = several & (dist[start] >= 0)
            send[last] = False
            take = np.concatenate((np.flatnonzero(hit), start[send]))
            kind = np.concatenate((np.zeros(int(hit.sum()), np.int8), kinds[send].astype(np.int8)))
            if len(take):
                part = batch.take(pa.array(take))
                yield pa.RecordBatch.from_arrays([pa.array(kind), part.column(0), *(part.column(j) for j in range(4, 9))], names=["kind", "ctx", "doc_id", "tk", "start", "count", "dist"])
            pending = (row(tail), int(size[last]), bool(several[last]), bool(rep[last]))
        yield from emit(out)
    if pending is not None:
        p_row, p_size, p_several, p_known = pending
        if p_several and p_row[8] >= 0:
            yield from emit([(2 if p_size > 1 or p_known else 1, p_row)])


def _less(h: PrefixHash, data: np.ndarray, a: np.ndarray, b: np.ndarray, size: int, ties: np.ndarray) -> np.ndarray:
    """Suffix a before suffix b within ``size`` bytes; for equal ones ``ties``. The common extension is found by binary search."""
    equal = h.of(a, size) == h.of(b, size)
    out = ties.copy()
    odd = np.flatnonzero(~equal)
    x, y = a[odd], b[odd]
    lo, hi = np.zeros(len(odd), np.int64), np.full(len(odd), size - 1, np.int64)
    while (lo < hi).any():
        mid = (lo + hi + 1) >> 1
        ok = h.of(x, mid) == h.of(y, mid)
        lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
    out[odd] = data[x + lo] < data[y + lo]
    return out


def sort_suffixes(h: PrefixHash, data: np.ndarray, pos: np.ndarray, first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """Bottom-up merge sort of all classes at once. ``pos``: suffixes, class by class; ``first``/``last``: bounds of each one's class."""
    pos, idx, width = pos.copy(), np.arange(len(pos)), 1
    longest = int((last - first).max(initial=0))
    while width < longest:
        act = np.flatnonzero(last - first > width)
        f, l = first[act], last[act]
        local = idx[act] - f
        run = local // width
        own, other = f + run * width, f + (run ^ 1) * width
        lo = np.minimum(other, l)
        hi = np.minimum(other + width, l)
        base, right = lo.copy(), (run & 1).astype(bool)
        me = pos[act]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            # elements of the right run go after equal ones of the left run
            before = _less(h, data, pos[mid], me[open_], size, right[open_])
            lo[open_] = np.where(before, mid + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], mid)
        to = np.minimum(own, np.where(right, other, own)) + (idx[act] - own) + (lo - base)
        nxt = pos.copy()
        nxt[to] = me
        pos, width = nxt, width * 2
    return pos


def _repeated(seg: list[bytes], group: np.ndarray, dist: np.ndarray, count: np.ndarray, min_len: int) -> np.ndarray:
    """Flags of all windows of ``seg`` (row by row): does the same window exist in another place of its context?"""
    data = np.frombuffer(b"".join(seg), np.uint8)
    off = np.concatenate(([0], np.cumsum([len(s) for s in seg])))[:-1]
    total = int(count.sum())
    row = np.repeat(np.arange(len(seg)), count)
    t = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    d, pos, g = dist[row] - t, off[row] + t, group[row]
    order = np.lexsort((d, g))
    gs, dsorted = g[order], d[order]
    new = np.concatenate(([True], (gs[1:] != gs[:-1]) | (dsorted[1:] != dsorted[:-1])))
    cls = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], total)
    keep = (end - begin)[cls] > 1
    out = np.zeros(total, bool)
    if not keep.any():
        return out
    order, cls = order[keep], cls[keep]
    new = np.concatenate(([True], cls[1:] != cls[:-1]))
    begin = np.flatnonzero(new)
    sizes = np.diff(np.append(begin, len(cls)))
    first, last = np.repeat(begin, sizes), np.repeat(begin + sizes, sizes)
    h = PrefixHash(data)
    where = np.empty(len(data), np.int64)
    where[pos[order]] = order
    sorted_ = sort_suffixes(h, data, pos[order], first, last, min_len)
    adj = np.flatnonzero(np.arange(1, len(cls)) < last[:-1])
    adj = adj[h.of(sorted_[adj], min_len) == h.of(sorted_[adj + 1], min_len)]
    span = np.arange(min_len)
    good = np.empty(len(adj), bool)
    for k in range(0, len(adj), 4096):  # what the hashes call equal is compared byte by byte
        a, b = sorted_[adj[k : k + 4096], None] + span, sorted_[adj[k : k + 4096] + 1, None] + span
        good[k : k + 4096] = (data[a] == data[b]).all(1)
    for f in np.unique(first[adj[~good]]):  # a collision: this class is settled by its bytes
        own = sorted_[f : last[f]]
        texts = [data[p : p + min_len].tobytes() for p in own]
        for p, s in zip(own, texts, strict=True):
            out[where[p]] |= texts.count(s) > 1
    out[where[sorted_[adj[good]]]] = True
    out[where[sorted_[adj[good] + 1]]] = True
    return out


def _compare(min_len: int):
    """Rows (ctx, known, doc_id, tk, start, count, dist, seg) sorted by ctx -> windows found to repeat."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def settle(rows):
            ctx = np.array([r[0] for r in rows])
            new = np.concatenate(([True], ctx[1:] != ctx[:-1]))
            group = np.cumsum(new) - 1
            several = np.bincount(group)[group] > 1
            rows = [r for r, s in zip(rows, several, strict=True) if s]
            if not rows:
                return
            group = group[several]
            dist, count = np.array([r[6] for r in rows]), np.array([r[5] for r in rows])
            flags, at = _repeated([r[7] for r in rows], group, dist, count, min_len), 0
            out = []
            for r in rows:
                f = flags[at : at + r[5]]
                at += r[5]
                if r[1] or not f.any():
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate(([0], f.view(np.int8), [0]))))
                out += [(r[2], r[3], r[4] + int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
            if out:
                t = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(t[0], pa.int64()), pa.array(t[1], pa.int32()), pa.array(t[2], pa.int64()), pa.array(t[3], pa.int32())], names=["doc_id", "tk", "start", "count"])

        last = None  # the window row before, of a crowded context

        def spans(rows):
            if rows:
                t = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(t[2], pa.int64()), pa.array(t[3], pa.int32()), pa.array(t[4], pa.int64()), pa.array(t[5], pa.int32())], names=["doc_id", "tk", "start", "count"])

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(8)]
            told = []
            for r in zip(*cols, strict=True):
                if r[6] < 0:
                    if r[6] == -2:
                        told.append(r)
                    elif last and last[0] == r[0] and last[7] == r[7]:
                        # equal windows stand together: each is told once, nothing is held
                        told += [x for x in (last, r) if not x[1]]
                        last = (r[0], True, *r[2:])
                    else:
                        last = r
                    continue
                if size >= BYTES_HELD and r[0] != held[-1][0]:
                    yield from settle(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[7])
            yield from spans(told)
        if held:
            yield from settle(held)

    return run


def _fetch(min_len: int):
    """Documents with their open parts -> one row per part with its bytes.

    A part of a crowded context gives a row per window instead: ctx and seg are then the window's digest, dist is -1. Windows
    that one task holds twice are settled here (dist -2) and only one of them goes on.
    """
    names = ["ctx", "known", "doc_id", "tk", "start", "count", "dist", "seg"]

    def windows(held):
        h0, h1, known, own, null, tk, start = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((h1, h0))
        h0, h1, known, own, null, tk, start = (c[order] for c in (h0, h1, known, own, null, tk, start))
        same = _same(h0, h1)
        after, before = np.append(same, False), np.insert(same, 0, False)
        settled = (after | before) & ~known
        seg = h1.astype("<u8").tobytes()
        for k in range(0, len(h0), 50_000):
            e = min(len(h0), k + 50_000)
            go = np.flatnonzero(~before[k:e]) + k  # to the other tasks: one of each, known here if it repeats here
            yield pa.RecordBatch.from_arrays([pa.array(h0[go].view(np.int64)), pa.array(known[go] | after[go]), pa.array(own[go], mask=null[go]), pa.array(tk[go]), pa.array(start[go]), pa.array(np.ones(len(go), np.int32)), pa.array(np.full(len(go), -1, np.int32)), pa.array([seg[8 * i : 8 * i + 8] for i in go.tolist()], pa.binary())], names=names)
            at = np.flatnonzero(settled[k:e]) + k
            if len(at):
                away = _mix(own[at].view(np.uint64) + start[at].astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
                yield pa.RecordBatch.from_arrays([pa.array(away.view(np.int64)), pa.array(np.zeros(len(at), bool)), pa.array(own[at], mask=null[at]), pa.array(tk[at]), pa.array(start[at]), pa.array(np.ones(len(at), np.int32)), pa.array(np.full(len(at), -2, np.int32)), pa.array([b""] * len(at), pa.binary())], names=names)

    def run(batches):
        crowd, n = [], 0
        for b in batches:
            out: list[tuple] = []
            held = 0
            for own, text, todo in zip(b.column(0), b.column(1).cast(pa.binary()), b.column(2), strict=True):
                own, text = own.as_py(), text.as_py()
                for x in todo.as_py():
                    if x["crowded"]:
                        p = np.arange(x["start"], x["start"] + x["count"])
                        m = len(p)
                        h = digests(text, p, p + min_len, np.zeros(m, np.int64))
                        crowd.append((h[:, 0], h[:, 1], np.full(m, x["kind"] == 2), np.full(m, own or 0, np.int64), np.full(m, own is None), np.full(m, x["tk"], np.int32), p))
                        n += m
                        continue
                    out.append((x["ctx"], x["kind"] == 2, own, x["tk"], x["start"], x["count"], x["dist"], text[x["start"] : x["start"] + x["count"] + min_len - 1]))
                    held += len(out[-1][7])
                if held > 1 << 23:
                    yield _batch(out, names)
                    out, held = [], 0
                if n > ROWS_HELD:
                    yield from windows(crowd)
                    crowd, n = [], 0
            if out:
                yield _batch(out, names)
        if crowd:
            yield from windows(crowd)

    return run


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def repeated_windows(docs: DataFrame, min_len: int = 400) -> DataFrame:
    """``(doc_id, tk, start, count)``: runs of window starts whose ``min_len`` bytes also start elsewhere; tk tells rows of one id apart."""
    bound_text_batches(docs.sparkSession)
    spark = docs.sparkSession
    kept, n = Written(spark, "suffix"), shuffle_partitions(spark)
    rows = docs.select("doc_id", "text").mapInArrow(lean(_part_rows(min_len)), PART_SCHEMA)
    rows = rows.repartition(n, "ctx").sortWithinPartitions("ctx", "s0", "s1")
    told = kept.cut(rows.mapInArrow(lean(_settle_parts), SPAN_SCHEMA))
    sure = told.filter("kind = 0").select("doc_id", "tk", "start", "count")
    todo = told.filter("kind > 0")
    crowded = kept.cut(todo.groupBy("ctx").count().filter(F.col("count") > CROWD).select(F.col("ctx").alias("_c")))
    todo = todo.join(crowded, F.col("ctx") == F.col("_c"), "left").withColumn("crowded", F.col("_c").isNotNull())
    todo = todo.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("kind", "ctx", "tk", "start", "count", "dist", "crowded")).alias("todo"))
    j = docs.join(todo.withColumnsRenamed({"doc_id": "_id", "tk": "_tk"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk")))
    segs = j.select("doc_id", "text", "todo").mapInArrow(lean(_fetch(min_len)), "ctx long, known boolean, doc_id long, tk int, start long, count int, dist int, seg binary")
    found = segs.repartition(n, "ctx").sortWithinPartitions("ctx", "seg").mapInArrow(lean(_compare(min_len)), "doc_id long, tk int, start long, count int")
    return sure.unionByName(found)


def _spans(runs: list[dict], n: int, min_len: int) -> np.ndarray:
    """Maximal byte ranges covered by the windows of ``runs``."""
    if not runs:
        return np.zeros((0, 2), np.int64)
    a = np.array([(r["start"], r["start"] + r["count"] - 1 + min_len) for r in runs], np.int64)
    a = a[np.argsort(a[:, 0], kind="stable")]
    reach = np.maximum.accumulate(a[:, 1])
    new = np.concatenate(([True], a[1:, 0] > reach[:-1]))
    return np.stack((a[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)]), 1)


def removed_spans(docs: DataFrame, min_len: int = 400) -> DataFrame:
    """``(doc_id, kept, text, n_bytes, n_removed, n_spans)``: ``kept`` the remaining bytes of every document, ``text`` its remaining
    characters (those of which no byte is removed)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = d.withColumn("tk", (F.crc32(F.coalesce("text", F.lit("")).cast("binary")) - F.lit(1 << 31)).cast("int"))
    runs = repeated_windows(d, min_len).groupBy("doc_id", "tk").agg(F.collect_list(F.struct("start", "count")).alias("runs"))
    j = d.join(runs.withColumnsRenamed({"doc_id": "_id", "tk": "_tk"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk")), "left")

    def run(batches):
        for b in batches:
            out = []
            for text, runs in zip(b.column(1).cast(pa.binary()), b.column(2), strict=True):
                text = text.as_py() or b""
                spans = _spans(runs.as_py() or [], len(text), min_len)
                edges = [0, *spans.ravel().tolist(), len(text)]
                rest = [text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)]
                kept = b"".join(rest)
                out.append((kept, "".join(x.decode("utf-8", "ignore") for x in rest), len(text), len(text) - len(kept), len(spans)))
            kept, left, n, gone, k = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), pa.array(left, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(k, pa.int64())], names=["doc_id", "kept", "text", "n_bytes", "n_removed", "n_spans"])

    return j.select("doc_id", "text", "runs").mapInArrow(lean(run), "doc_id long, kept binary, text string, n_bytes long, n_removed long, n_spans long")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production parameters: strings of 400 bytes, all documents."""
    out = removed_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "text")


# Bytes are pairs of hexadecimal digits; a piece between two removed runs loses the bytes of a character cut in two.
ORACLE_SQL = """
with d as (select row_number() over () as n, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
     w as (select n, i, md5_number(substr(h, 2 * i + 1, 800)) as k from d, unnest(range(0, length(h) // 2 - 399)) t(i)),
     r as (select n, i, i - lag(i) over (partition by n order by i) as step from (select n, i, count(*) over (partition by k) as c from w) where c > 1),
     s as (select n, min(i) as a, max(i) + 400 as z from (select n, i, sum(case when step <= 400 then 0 else 1 end) over (partition by n order by i) as run from r) group by n, run),
     e as (select n, a, z, coalesce(lag(z) over (partition by n order by a), 0) as b from s union all select n, len, len, z from (select d.n, length(h) // 2 as len, coalesce(max(z), 0) as z from d left join s on d.n = s.n group by d.n, h)),
     p as (select e.*, substr(h, 2 * b + 1, 2 * (a - b)) as x from e join d on e.n = d.n),
     o as (select n, sum(z - a) as gone, count(*) - 1 as spans, string_agg(x, '' order by a, z desc) as kept,
             string_agg(regexp_replace(regexp_replace(x, '^([89AB].)+', ''), '([CD].|E.([89AB].)?|F.([89AB].){0,2})$', ''), '' order by a, z desc) as chars from p group by n)
select doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(gone as bigint) as n_removed, cast(spans as bigint) as n_spans, sha256(unhex(kept)) as kept_sha256, decode(unhex(chars)) as text
from d join o on d.n = o.n
"""
