"""FM-index over integer sequences, compressed in a wavelet tree, with numpy. Used inside tasks only.

The tree follows a prefix code in which a symbol's length is the logarithm of how rare it is, so a sequence of ``n`` symbols
takes about ``n`` times its entropy in bits, and a rank takes as many steps as the code has bits. Suffixes are sorted by
their first ``depth`` symbols, which suffices for patterns of up to so many.
"""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Rank of symbols 0 .. k-1 of a sequence, numbered so that commoner ones come first. Every one occurs."""

    def __init__(self, sequence: np.ndarray):
        counts = np.bincount(sequence)
        n, k = len(sequence), len(counts)
        # Lengths by rarity, longer for rarer symbols, satisfy Kraft's inequality; codes are given out in order.
        length = np.maximum(1, np.ceil(np.log2(n / counts)).astype(np.int64)) if k else np.zeros(0, np.int64)
        self.length = np.maximum.accumulate(length)
        deepest = int(self.length[-1]) if k else 0
        code = np.concatenate([[0], np.cumsum(np.int64(1) << (deepest - self.length))])[:-1]
        before = np.concatenate([[0], np.cumsum(counts)])
        self.levels = []
        now = sequence.astype(np.int64)
        # Symbols of one node in a row, nodes in the order of their codes.
        start = np.zeros(k, np.int64)
        for level in range(deepest):
            active = int(np.searchsorted(self.length, level, side="right"))  # symbols from here on have a bit
            bit_of = ((code >> (deepest - 1 - level)) & 1).astype(bool)
            bits = bit_of[now]
            ones = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
            words = np.packbits(bits, bitorder="little")
            words = np.concatenate([words, np.zeros(-len(words) % 8 + 8, np.uint8)]).view("<u8")
            sums = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int32)])[:-1].astype(np.int32)
            self.levels.append((words, sums, bit_of, start, ones[start].astype(np.int64), active))
            # The next level: where the child node of every symbol that goes on begins.
            going = int(np.searchsorted(self.length, level + 1, side="right"))
            if going == k:
                break
            prefix = code >> (deepest - 1 - level)
            first = np.searchsorted(prefix[going:], prefix) + going
            following = before[np.minimum(first, k)] - before[going]
            kept = now >= going
            own, at = now[kept], np.flatnonzero(kept)
            node = start[own]
            within = np.where(bit_of[own], ones[at] - ones[node], at - node - (ones[at] - ones[node]))
            after = np.empty(len(own), np.int64)
            after[following[own] + within] = own
            now, start = after, following

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place, or its places, one row of them after the other.

        ``symbols`` fall, so those with longer codes come first."""
        out = places.copy()
        going, rising = len(symbols), -symbols
        for words, sums, bit_of, start, ones, active in self.levels:
            going = int(np.searchsorted(rising[:going], -active, side="right"))
            if not going:
                break
            own, now = symbols[:going], out[..., :going]
            at = start[own] + now
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            inside = sums[word] + np.bitwise_count(words[word] & mask) - ones[own]
            np.copyto(now, np.where(bit_of[own], inside, now - inside))
        return out


def suffixes(sequence: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, sorted by their first ``depth`` symbols or more; a suffix that ends is the smaller one."""
    n, known = len(sequence), 1
    rank = sequence.astype(np.uint64) + np.uint64(1)
    order = np.argsort(rank)
    while known < depth:
        key = rank << np.uint64(32)
        key[: max(0, n - known)] |= rank[known:]
        order = np.argsort(key)
        ordered = key[order]
        steps = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if n else np.zeros(0, bool)
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(steps).astype(np.uint64)
        known *= 2
        if steps.all():
            break
    return order


class FMIndex:
    """Index of a sequence of symbols 0 .. k-1, which all occur, commoner ones first.

    The last symbol is one that no pattern holds: the place before the first symbol is read as if it stood there."""

    def __init__(self, sequence: np.ndarray, depth: int):
        self.order = suffixes(sequence, depth)
        self.tree = WaveletTree(sequence[self.order - 1])
        self.before = np.concatenate([[0], np.cumsum(np.bincount(sequence))])

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the patterns that have each symbol in front; ``symbols`` fall."""
        low, high = self.before[symbols] + self.tree.rank(symbols, np.stack([low, high]))
        return low, high

    def matching(self, sequence: np.ndarray, ends: np.ndarray, length: int, alone) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics by backward search, for the ``length`` symbols of ``sequence`` up to each of ``ends``.

        Gives (number of symbols matched, low, high); a search stops early where ``alone(low, high)`` says so."""
        matched = np.zeros(len(ends), np.int64)
        low_of, high_of = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        going = np.arange(len(ends))
        for step in range(length):
            symbols = sequence[ends[going] - step]
            if step:
                order = np.argsort(-symbols)
                going, symbols = going[order], symbols[order]
                low, high = self.extend(symbols, low[order], high[order])
            else:  # from the range of all
                low, high = self.before[symbols], self.before[symbols + 1]
            held = high > low
            going, low, high = going[held], low[held], high[held]
            matched[going], low_of[going], high_of[going] = step + 1, low, high
            on = ~alone(low, high)
            going, low, high = going[on], low[on], high[on]
            if not len(going):
                break
        return matched, low_of, high_of
