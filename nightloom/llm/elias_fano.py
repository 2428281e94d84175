"""Elias-Fano coded monotone sequences over memory-mapped bytes, with access and successor search for whole arrays."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: By byte and k: the place of its k-th one, from the low end.
_PLACE = np.array([[p[k] if k < len(p) else 0 for k in range(8)] for p in ([i for i in range(8) if b >> i & 1] for b in range(256))], np.int64)
#: Bits of the upper part between two entries of its directory.
STRIDE = 128


class EliasFano:
    """values: ascending uint64 below `universe`. The low bits are packed; the high bits are unary in a bit vector."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, rank: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.rank = n, low_bits, low, high, rank
        self.zeros = np.arange(len(rank), dtype=np.int64) * STRIDE - rank

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        values = values.astype(U64)
        low_bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        at = np.arange(n, dtype=U64) * U64(low_bits)
        low = np.zeros((n * low_bits + 63) // 64 + 1, U64)
        if low_bits:
            part = values & U64((1 << low_bits) - 1)
            word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + U64(low_bits) > U64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (U64(64) - shift[over]))
        upper = (values >> U64(low_bits)).astype(np.int64)
        size = n + int(universe >> low_bits) + 2
        bits = np.zeros(-(-size // STRIDE) * STRIDE, np.uint8)
        bits[upper + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little")
        per = bits.reshape(-1, STRIDE).sum(axis=1, dtype=np.int64)
        return EliasFano(n, low_bits, low, high, np.concatenate([[0], np.cumsum(per)]).astype(np.int64))

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high, self.rank]

    @staticmethod
    def decode(arrays: list[np.ndarray]) -> EliasFano:
        head, low, high, rank = arrays
        return EliasFano(int(head[0]), int(head[1]), low, high, rank)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """The place of the k-th (from 0) one or zero of the upper bits."""
        marks = self.rank if ones else self.zeros
        block = np.searchsorted(marks, k, side="right") - 1
        left = k - marks[block]
        byte = block * (STRIDE // 8)
        for step in (8, 4, 2, 1):  # halve the block by counting bits in its bytes
            count = self._ones(byte, step)
            count = count if ones else step * 8 - count
            go = left >= count
            left = np.where(go, left - count, left)
            byte = np.where(go, byte + step, byte)
        bits = self.high[np.minimum(byte, len(self.high) - 1)]
        bits = bits if ones else ~bits
        return byte * 8 + _PLACE[bits, np.clip(left, 0, 7)]

    def _ones(self, byte: np.ndarray, step: int) -> np.ndarray:
        if step == 1:
            return _ONES[self.high[np.minimum(byte, len(self.high) - 1)]].astype(np.int64)
        words = self.high.view(f"<u{min(step, 8)}")
        total = np.zeros(len(byte), np.int64)
        for part in range(max(1, step // 8)):
            total += np.bitwise_count(words[np.minimum(byte // min(step, 8) + part, len(words) - 1)])
        return total

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        upper = (self._select(i, True) - i).astype(U64)
        return (upper << U64(self.low_bits)) | self._low(i)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U64)
        at = i.astype(U64) * U64(self.low_bits)
        word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
        more = np.where(shift > 0, self.low[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
        return ((self.low[word] >> shift) | more) & U64((1 << self.low_bits) - 1)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of the first value >= x, and whether it equals x."""
        x = x.astype(U64)
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        upper = (x >> U64(self.low_bits)).astype(np.int64)
        last = len(self.high) * 8 - self.n - 1  # zeros there are
        inside = upper < last
        u = np.minimum(upper, last - 1)
        first = np.where(u > 0, self._select(np.maximum(u - 1, 0), False) - (u - 1), 0)
        end = np.minimum(self._select(u, False) - u, self.n)
        low = x & U64((1 << self.low_bits) - 1)
        lo, hi = first.copy(), end.copy()
        while True:  # all values between first and end share the upper bits: halve by the low bits
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            less = self._low(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        rank = np.where(inside, lo, self.n)
        found = inside & (lo < end)
        hit = np.flatnonzero(found)
        found[hit] = self._low(lo[hit]) == low[hit]
        return rank, found
