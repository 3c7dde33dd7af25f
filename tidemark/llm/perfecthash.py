"""Minimal perfect hashing of 128-bit keys: each level is a bitvector of the places that one key alone took."""

from __future__ import annotations

import numpy as np

from tidemark.llm.bits import Bits
from tidemark.llm.jaccard import mixed

#: Places for each key that is left on a level.
ROOM = 2.0
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _places(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        scattered = mixed(high + np.uint64(level) * (_STEP ^ low))
    return ((scattered >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


class PerfectHash:
    """Numbers distinct keys from 0 without a gap. A key that was not there may get any number, or -1."""

    def __init__(self, sizes: list[int], bits: Bits):
        self.sizes, self.bits = sizes, bits

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        """Keys that meet on a level go to the next, so a level holds the better part of those left."""
        sizes, levels = [], []
        while len(high):
            size = max(64, int(ROOM * len(high)))
            at = _places(high, low, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = ~alone[at]
            high, low = high[left], low[left]
        return cls(sizes, Bits.of(np.concatenate(levels) if levels else np.zeros(0, bool)))

    def number(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        found = np.full(len(high), -1, np.int64)
        left, start = np.arange(len(high)), 0
        for level, size in enumerate(self.sizes):
            at = start + _places(high[left], low[left], level, size)
            here = self.bits.get(at)
            found[left[here]] = self.bits.rank(at[here])
            left, start = left[~here], start + size
        return found
