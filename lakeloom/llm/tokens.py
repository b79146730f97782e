"""Words of whole Arrow text columns, as numpy arrays.

A word is a run of digits, ASCII letters and non-ASCII characters; only A-Z are
lower-cased. Texts are split some megabytes at a time, byte by byte in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are split at once; a longer text is split by itself.
SLICE = 1 << 21
#: The same words as a separator pattern of Spark's regular expressions, for lower-cased text.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE = 32
#: 2^64 divided by the golden ratio, for mixing.
GOLDEN = np.uint64(int((1 << 64) * (5**0.5 - 1) / 2) | 1)


def _lowered() -> np.ndarray:
    """Each byte as it stands in a word, or a space where it separates words."""
    out = np.full(256, SPACE, np.uint8)
    for i in range(256):
        if i >= 128 or chr(i).isalnum():
            out[i] = ord(chr(i).lower()) if i < 128 else i
    return out


LOWERED = _lowered()
_MASK = np.array([(1 << 8 * min(k, 8)) - 1 for k in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * GOLDEN
    return x ^ (x >> np.uint64(29))


@dataclass
class Words:
    """The words of texts lo to hi - 1 of a column."""

    lo: int
    hi: int
    #: Bytes of the texts, each followed by a line feed, and where each begins.
    raw: np.ndarray
    offset: np.ndarray
    #: The words, lower-cased, each followed by one space.
    text: bytes
    #: Where each word begins in `text`, its bytes, where it begins in `raw`, and its text (from 0).
    start: np.ndarray
    length: np.ndarray
    origin: np.ndarray
    row: np.ndarray
    #: First and last eight bytes; with the length they are the whole word, if it has 16 bytes at most.
    head: np.ndarray
    tail: np.ndarray

    def count(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.hi - self.lo)

    def keys(self) -> np.ndarray:
        """A 64-bit key of each word; equal words have equal keys, others seldom."""
        return mixed(self.head ^ mixed(self.tail + self.length.astype(np.uint64)))

    def word(self, i: int) -> bytes:
        return self.text[self.start[i] : self.start[i] + self.length[i]]

    def run(self, i: int, n: int) -> bytes:
        """Words i to i + n - 1, joined by spaces."""
        return self.text[self.start[i] : self.start[i + n - 1] + self.length[i + n - 1]]

    def windows(self, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each run of n words: its key, and whether it lies in one text."""
        m = max(len(keys) - n + 1, 0)
        out = keys[:m].copy()
        for j in range(1, n):
            out *= GOLDEN
            out += keys[j : j + m]
        return mixed(out), self.row[:m] == self.row[n - 1 : n - 1 + m]


def _split(texts: pa.Array, lo: int) -> Words:
    end = pa.scalar("\n", pa.large_string())
    joined = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), end)
    offset = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    raw = np.frombuffer(joined.buffers()[2], np.uint8)[offset[0] : offset[-1]]
    low = LOWERED[raw]
    inside = low != SPACE
    after = np.zeros_like(inside)
    after[1:] = inside[:-1]
    origin, stop = np.flatnonzero(inside & ~after), np.flatnonzero(after & ~inside)
    # Eight bytes on either side, so that every word has eight bytes to be read from its start and up to its end.
    text = np.empty(8 + int((stop - origin).sum()) + len(origin) + 8, np.uint8)
    text[8:-8] = low[inside | after]
    eight = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))
    length = stop - origin
    start = np.cumsum(length + 1) - length - 1
    head = eight[start + 8] & _MASK[np.minimum(length, 8)]
    tail = np.where(length > 8, eight[start + length], np.uint64(0))
    row = np.searchsorted(offset - offset[0], origin, "right") - 1
    return Words(lo, lo + len(texts), raw, offset - offset[0], text[8:-8].tobytes(), start, length, origin, row, head, tail)


def split(column: pa.Array | pa.ChunkedArray) -> Iterator[Words]:
    """The words of all texts, in slices of whole texts; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    size = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)) if len(column) else np.zeros(0, np.int64)
    lo = 0
    while lo < len(column):
        before = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, before + SLICE, "right")))
        yield _split(column.slice(lo, hi - lo), lo)
        lo = hi
