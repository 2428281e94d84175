"""Word hashes of whole Arrow columns at once, for use inside mapInArrow tasks.

A word is read in lanes of eight bytes, A-Z as a-z; each lane is added to the state and every bit of the state is spread
before the next one comes (a sum of powers would give words of a and b by bit parity equal hashes). Words longer than
LONG bytes are hashed one by one with blake2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
P = 0x9E3779B97F4A7C15
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: By the bytes that are left of a word: the bits of a lane that belong to it.
MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
LONG = 256
#: Bytes of text handled at once; a longer text is handled by itself.
SLICE_BYTES = 1 << 21


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


class Words:
    """The words of a slice of texts: 64-bit hashes, byte places (start, end) and where each text's words begin."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off
        n = len(data)
        inside = ~BLANK[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        begins, ends = off[:-1], off[1:]
        full = begins < ends
        first[begins[full]] = inside[begins[full]]
        last[ends[full] - 1] = inside[ends[full] - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.low = np.zeros(n + 8, np.uint8)
        self.low[:n] = LOWER[data]
        self.lanes = np.ndarray(n + 1, "<u8", self.low, strides=(1,))  # the eight bytes from each byte on
        self.hash = self._hash(self.end)
        self.text_at = np.searchsorted(self.start, off)

    def _hash(self, end: np.ndarray) -> np.ndarray:
        size = end - self.start
        h = mix(size.astype(U64) * U64(P) ^ (self.lanes[self.start] & MASK[np.minimum(size, 8)]))
        on, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(on):
            h[on] = mix(h[on] + U64(P) ^ (self.lanes[self.start[on] + at] & MASK[np.minimum(size[on] - at, 8)]))
            at += 8
            on = on[size[on] > at]
        for k in np.flatnonzero(size > LONG):
            h[k] = int.from_bytes(hashlib.blake2b(self.low[self.start[k] : end[k]], digest_size=8).digest(), "little")
        return h

    def prefix_hash(self, n_bytes: int) -> np.ndarray:
        """The hash of each word's first n_bytes (the whole word where it is shorter)."""
        return self._hash(np.minimum(self.start + n_bytes, self.end))

    def text_of(self) -> np.ndarray:
        """The index of the text of each word."""
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.text_at))


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of runs of rows with about `size` bytes of text; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        j = min(j, len(column))
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_hash(word: str) -> int:
    """The same hash of a single word, for small tables and tests."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(Words(raw, np.array([0, len(raw)])).hash[0])


def shingle_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of `width` words (of the whole text where it is shorter), and the text of each."""
    h, at = words.hash, words.text_at
    counts = np.diff(at)
    out = np.zeros(max(len(h) - width + 1, 0), U64)
    for j in range(width):
        out = out * U64(P) + h[j : len(h) - width + 1 + j] if len(out) else out
    text = words.text_of()
    inside = text[: len(out)] == text[width - 1 : width - 1 + len(out)] if len(out) else np.zeros(0, bool)
    out, of = mix(out[inside]), text[: len(inside)][inside]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = np.array([_fold(h[at[i] : at[i + 1]]) for i in short], U64)
        out, of = np.concatenate([out, whole]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def _fold(h: np.ndarray) -> int:
    x = len(h)
    for v in h.tolist():
        x = (x * P + v) & (2**64 - 1)
    return int(mix(np.array([x], U64))[0])
