"""Minimal perfect hash functions of integer sets, with numpy. Used inside tasks only.

Every level has a bit per place. Keys that are alone at their place set its bit and are done, all others go on to the next
level. A key's number is the number of bits set before its own, so ``n`` keys get the numbers 0 to n - 1. Any other integer
gets some number too, or none: callers compare with the key that they keep under that number.
"""

from __future__ import annotations

import numpy as np

from fleetfit.llm.wordhash import mix

#: Places per key of a level: more make fewer levels.
PLACES = 2
LEVELS = 64


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    return ((mix(keys ^ seed) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


def build(keys: np.ndarray) -> np.ndarray:
    """The function for distinct ``keys``: the number of levels, their sizes in places, and their bits."""
    rest, sizes, bits = keys.astype(np.uint64), [], []
    while len(rest):
        if len(sizes) == LEVELS:
            raise ValueError("keys are not distinct")
        size = max(64, -(-PLACES * len(rest) // 64) * 64)
        at = _places(rest, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(np.packbits(alone, bitorder="little").view("<u8"))
        rest = rest[~alone[at]]
    return np.concatenate([np.array([len(sizes), *sizes], np.uint64), *bits])


class PerfectHash:
    def __init__(self, built: np.ndarray):
        levels = int(built[0])
        self.sizes = [int(s) for s in built[1 : levels + 1]]
        self.words = np.asarray(built[levels + 1 :])
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.first = np.cumsum([0, *(s // 64 for s in self.sizes)])

    @property
    def kinds(self) -> int:
        return int(self.before[-1])

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for integers that no level holds."""
        keys = keys.astype(np.uint64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = _places(keys[open_], level, size)
            word = self.first[level] + (at >> 6)
            bit = np.uint64(1) << (at & 63).astype(np.uint64)
            held = self.words[word]
            hit = (held & bit) != 0
            out[open_[hit]] = self.before[word[hit]] + np.bitwise_count(held[hit] & (bit[hit] - np.uint64(1)))
            open_ = open_[~hit]
            if not len(open_):
                break
        return out
