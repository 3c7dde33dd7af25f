"""Packed bitvectors with rank and select."""

from __future__ import annotations

import numpy as np

#: Words of 64 bits in a block of the directory.
WORDS = 8
BLOCK = 64 * WORDS
_FROM = np.arange(WORDS) * 64


class Bits:
    """Bits in 64-bit words, eight words to a block, with the number of set bits before each block.

    `rank` and `select` look at one entry of the directory and the words of one block. Both take
    arrays of queries at once.
    """

    def __init__(self, words: np.ndarray):
        """`words` are whole blocks, the last of which is empty."""
        self.words = words.reshape(-1, WORDS)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words).sum(axis=1, dtype=np.int64))))

    @classmethod
    def of(cls, flags: np.ndarray) -> Bits:
        packed = np.packbits(flags, bitorder="little")
        room = np.zeros((len(flags) // BLOCK + 1) * WORDS * 8, np.uint8)
        room[: len(packed)] = packed
        return cls(room.view("<u8"))

    def get(self, at: np.ndarray) -> np.ndarray:
        word = self.words.reshape(-1)[at >> 6]
        return (word >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Number of set bits at positions below `at`, which may be the length."""
        block = at // BLOCK
        taken = np.clip((at % BLOCK)[:, None] - _FROM, 0, 64)
        masks = np.where(taken == 64, np.uint64(2**64 - 1), (np.uint64(1) << (taken & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[block] + np.bitwise_count(self.words[block] & masks).sum(axis=1, dtype=np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Positions of the set bits with `k` set ones before them."""
        block = np.searchsorted(self.before, k, side="right") - 1
        left = k - self.before[block]
        through = np.cumsum(np.bitwise_count(self.words[block]), axis=1, dtype=np.int64)
        word = (through <= left[:, None]).sum(axis=1)
        rows = np.arange(len(k))
        left = left - np.where(word > 0, through[rows, np.maximum(word - 1, 0)], 0)
        bits = np.unpackbits(self.words[block, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return block * BLOCK + word * 64 + np.argmax(np.cumsum(bits, axis=1) > left[:, None], axis=1)
