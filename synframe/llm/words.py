"""Words of a batch of whole texts, split over the bytes of the Arrow buffer at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tables over bytes: which belong to words. A byte of 128 or more is part of a code point beyond ASCII, a word character in both.
NOT_SPACE = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
ALPHANUMERIC = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 or 0x41 <= b <= 0x5A for b in range(256)])
#: A-Z to a-z, all else as it is.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row (one more than rows); null: empty."""
    text = pc.fill_null(text.cast(pa.string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(text) else (data[:0], np.zeros(1, np.int64))


def split_words(text: pa.Array, letters: np.ndarray, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """``(words, counts)``: the maximal runs of bytes for which ``letters`` holds, row after row, and their number in each row."""
    data, offsets = text_bytes(text)
    inside = letters[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    first[offsets[:-1][filled]] = inside[offsets[:-1][filled]]
    last[offsets[1:][filled] - 1] = inside[offsets[1:][filled] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    values = LOWER[data[inside]] if lower else data[inside]
    ends = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(values)])
    return words, np.diff(np.searchsorted(starts, offsets))
