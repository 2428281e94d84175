"""A table of exact integer keys that looks up whole arrays at once."""

from __future__ import annotations

import numpy as np

from nightloom.llm import wordhash as H


class Lookup:
    """Non-negative 64-bit keys -> non-negative values; a key stands at its spot or at one of the places after it."""

    def __init__(self, pairs: dict[int, int]):
        self.bits = max(4, (2 * len(pairs)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1), np.zeros(1 << self.bits, np.int64)
        key, value = (np.fromiter(x, np.int64, len(pairs)) for x in (pairs.keys(), pairs.values()))
        spot = self._spot(key)
        while len(key):
            free = self.keys[spot] < 0
            self.keys[spot[free]] = key[free]
            here = self.keys[spot] == key
            self.values[spot[here]] = value[here]
            key, value, spot = key[~here], value[~here], (spot[~here] + 1) & (len(self.keys) - 1)

    def _spot(self, key: np.ndarray) -> np.ndarray:
        return (H.mix(key.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, key: np.ndarray, other: int) -> np.ndarray:
        """The keys' values, and `other` for those that are not there."""
        spot = self._spot(key)
        there = self.keys[spot]
        out = np.where(there == key, self.values[spot], other)
        on = np.flatnonzero((there != key) & (there >= 0))
        while len(on):
            spot[on] = (spot[on] + 1) & (len(self.keys) - 1)
            there = self.keys[spot[on]]
            hit = there == key[on]
            out[on[hit]] = self.values[spot[on[hit]]]
            on = on[~hit & (there >= 0)]
        return out
