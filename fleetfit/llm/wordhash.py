"""Word hashes of many texts at once, with numpy. Used inside tasks only."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import zstandard
from xxhash import xxh3_64_intdigest

from fleetfit.llm.common import FOLD

GROUP_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Words are told apart by 64-bit hashes of their bytes under this key (any number would do).
KEY = 0x5851F42D4C957F2D
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words, repeat(KEY)), np.uint64, len(words))


def word_hashes(text: bytes, fold: bool = True) -> np.ndarray:
    """Hash of every word of a text, with A-Z folded unless told otherwise. Words are made a megabyte at a time."""
    parts, at = [], 0
    while at < len(text):
        space = _SPACE.search(text, at + GROUP_BYTES) if len(text) - at > GROUP_BYTES else None
        end = space.start() if space else len(text)
        words = (text[at:end].translate(FOLD) if fold else text[at:end]).split()
        parts.append(hashes_of(words))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words located by ``located`` are hashed eight bytes at a time, longer ones than this on their own.
LONG = 64
#: Joins the hash of a word's bytes so far with the next eight (an odd number; any would do).
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: The first 0 to 8 bytes of a little-endian integer.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _hashed(part: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of every word; ``part`` ends with eight bytes that are in none. Words of up to eight bytes and one size never meet."""
    eights = np.ndarray(len(part) - 7, "<u8", part, strides=(1,))
    out = mix(mix(size.astype(np.uint64) ^ np.uint64(KEY)) + (eights[first] & _FIRST[np.minimum(size, 8)]))
    going = np.flatnonzero((size > 8) & (size <= LONG))
    for at in range(8, LONG, 8):
        going = going[size[going] > at]
        if not len(going):
            break
        more = eights[first[going] + at] & _FIRST[np.minimum(size[going] - at, 8)]
        out[going] = mix(out[going] * _STEP + more)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxh3_64_intdigest(part[first[i] : first[i] + size[i]].data, KEY)
    return out


def located(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, hash) of every word, letters as they are; worked on about a megabyte at a time.

    For texts whose words are needed as places: no object is made for a word, unless it is a long one."""
    starts, ends, hashes, at = [], [], [], 0
    while at < len(data):
        space = _SPACE.search(data, at + GROUP_BYTES) if len(data) - at > GROUP_BYTES else None
        size = (space.start() if space else len(data)) - at
        part = np.zeros(size + 8, np.uint8)
        part[:-8] = np.frombuffer(data, np.uint8, size, at)
        inside = np.zeros(size + 2, bool)
        np.logical_not(_IS_SPACE[part[:-8]], out=inside[1:-1])
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        first, end = turns[::2], turns[1::2]
        hashes.append(_hashed(part, first, end - first))
        starts.append(first + at)
        ends.append(end + at)
        at += size
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else e for x, e in ((starts, empty), (ends, empty), (hashes, empty.astype(np.uint64))))


def located_hashes(texts: Iterable[bytes]) -> np.ndarray:
    """Hashes as by ``located`` of the words of all texts, which may be many with few words: about a megabyte at a time."""
    parts, held, size = [], [], 0
    for text in texts:
        held.append(text)
        size += len(text) + 1
        if size >= GROUP_BYTES:
            parts.append(located(b" ".join(held))[2])
            held, size = [], 0
    return np.concatenate([*parts, located(b" ".join(held))[2]])


def grouped(texts: list[str | None], fold: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For stretches of texts of about a megabyte (or one longer text): (first, end, words per text, hashes)."""
    first = 0
    while first < len(texts):
        end, parts, size = first, [], 0
        while end < len(texts) and (end == first or size < GROUP_BYTES):
            text = (texts[end] or "").encode()
            parts.append(word_hashes(text, fold))
            size += len(text) + 1
            end += 1
        yield first, end, np.array([len(p) for p in parts], np.int64), np.concatenate(parts)
        first = end


def pack(ascending: np.ndarray) -> bytes:
    """Ascending 64-bit integers, compressed: differences, byte by byte."""
    steps = np.diff(ascending, prepend=np.uint64(0)).astype("<u8")
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]
