"""Removal of passages that repeat across documents, with one compressed FM-index per shard.

A window is ``words`` consecutive words; it is removed where the same words also start in a document of a smaller id.

1. The words of a document are cut into segments: runs of windows that share an anchor, the least hash of all four words
   in a row. Equal windows have equal anchors, so all their segments come together in one shard.
2. A first pass counts the segments per hash of their anchor, in a fixed number of places.
3. Tasks send each different segment once to its shard, as compressed text, with the places where they met it. A shard builds
   an FM-index over its different segments and streams them through it: backward search gives the matching statistics of
   every window, and where all words match, the range of equal windows, whose least and largest ids decide. Segments of one
   document whose anchor no other has stay out of the index. Intervals of windows that some smaller document has are
   reported for each place.
4. Documents are joined with their intervals.

An anchor of very many segments is hot. If few of them differ (copies), only the extreme ids go to the shard, and the places
are joined with the intervals by Spark, which splits a hot key. If many differ (one passage in changing surroundings), each
window is a segment of its own, dealt by the hash of all its words.

Words are told apart by 64-bit hashes of their bytes. Defined results: a null text counts as empty; a row with a null id loses
nothing and takes nothing from others; rows with the same id do not take from each other; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from fleetfit.llm.common import stored, text_of
from fleetfit.llm.fm_index import FMIndex
from fleetfit.llm.wordhash import located, located_hashes, mix, pack, pack_counts, unpack, unpack_counts

WORDS = 13
#: Words of an anchor, and the most windows of a segment.
ANCHOR, MOST_WINDOWS = 4, 4096
#: Level of compression of texts on their way.
LEVEL = 3
#: Hashes of anchors are counted in 2 ** PLACE_BITS places, 2 ** SLICE_BITS of them in one group.
PLACE_BITS, SLICE_BITS = 27, 21
#: Segments, and words of different segments, from which an anchor's place is hot, if that is this many times the mean:
#: as many as a shard has.
HOT_SEGMENTS, HOT_WORDS = 1 << 16, 1 << 20
TIMES_MEAN = 8
#: Bytes of text that a task works on at once, and words of a shard's segments.
BATCH_BYTES, SHARD_WORDS = 6_000_000, 1_000_000
#: Two ways of joining hashes of neighbouring stretches (odd numbers; any would do).
BY = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# --- segments ----------------------------------------------------------------------------------


def run_hashes(hashes: np.ndarray, size: int, by: np.uint64 = BY[0]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``min(ANCHOR, size)`` and of all ``size`` hashes in a row, put together from runs of powers of two."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    out, at, level, now = None, 0, 1, hashes
    while level <= size:
        if level <= ANCHOR:
            short = now
        if size & level:
            piece = now[at : at + n]
            out = piece if out is None else mix(out * by + piece)
            at += level
        if 2 * level <= size:
            now = mix(now[:-level] * by + now[level:])
        level *= 2
    return (short, out) if size >= ANCHOR else (out, out)


def run_least(values: np.ndarray, size: int) -> np.ndarray:
    """Least of every ``size`` values in a row."""
    now, level = values, 1
    while 2 * level <= size:
        now = np.minimum(now[:-level], now[level:])
        level *= 2
    rest = size - level
    return np.minimum(now[: len(now) - rest], now[rest:]) if rest else now


def expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places from each start on, as many as its size, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class Segments(NamedTuple):
    """Runs of windows: first word in the batch, number of windows, anchor, text, first word in the text."""

    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    text: np.ndarray
    place: np.ndarray

    def take(self, rows: np.ndarray) -> Segments:
        return Segments(*[column[rows] for column in self])

    def single(self) -> Segments:
        """A segment for each window."""
        n = self.windows
        repeated = [np.repeat(c, n) for c in (self.anchor, self.text)]
        return Segments(expand(self.start, n), np.ones(int(n.sum()), np.int64), *repeated, expand(self.place, n))


def cut(runs: np.ndarray, sizes: np.ndarray, words: int) -> Segments:
    """Segments of all texts, whose words are ``sizes`` in number and one after the other; ``runs`` are those of anchors."""
    count = int(sizes.sum()) - words + 1
    text = np.repeat(np.arange(len(sizes)), sizes)
    window = np.flatnonzero(text[:count] == text[words - 1 :]) if count > 0 else np.zeros(0, np.int64)
    if not len(window):
        return Segments(*[np.zeros(0, kind) for kind in (np.int64, np.int64, np.uint64, np.int64, np.int64)])
    size = min(ANCHOR, words)
    anchor, text = run_least(runs, words - size + 1)[window], text[window]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    since = np.arange(len(window)) - np.repeat(first, np.diff(np.append(first, len(window))))
    first = np.flatnonzero(since % MOST_WINDOWS == 0)
    before = np.cumsum(sizes) - sizes
    text = text[first]
    return Segments(window[first], np.diff(np.append(first, len(window))), anchor[first], text, window[first] - before[text])


def digests(runs: np.ndarray, start: np.ndarray, windows: np.ndarray, by: np.uint64 = BY[0]) -> np.ndarray:
    """A 64-bit digest of every segment from the hashes of its windows."""
    if not len(start):
        return np.zeros(0, np.uint64)
    at, first = expand(start, windows), np.cumsum(windows) - windows
    nth = (np.arange(len(at)) - np.repeat(first, windows)).astype(np.uint64)
    return np.add.reduceat(mix(runs[at] + nth * by), first)


def place_of(anchors: np.ndarray) -> np.ndarray:
    return (mix(anchors ^ BY[1]) >> np.uint64(64 - PLACE_BITS)).astype(np.int64)


def starts_of(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted rows."""
    if not len(sorted_columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in sorted_columns], axis=0)]))


class Batch(NamedTuple):
    """Texts of a task that are worked on at once: their bytes, and where each word starts and ends."""

    ids: np.ndarray
    rows: np.ndarray
    data: bytes
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    runs: np.ndarray
    segments: Segments


def batches_of(batches: Iterator[pa.RecordBatch], words: int, most: int) -> Iterator[Batch]:
    ids, rows, texts, size = [], [], [], 0

    def made() -> Batch:
        data, bounds = b"\n".join(texts), np.cumsum([0, *(len(t) + 1 for t in texts)])
        start, end, hashes = located(data)
        sizes = np.diff(np.searchsorted(start, bounds))
        short, runs = run_hashes(hashes, words)
        return Batch(np.array(ids, np.int64), np.array(rows, np.int64), data, start, end, hashes, runs, cut(short, sizes, words))

    for batch in batches:
        binary = batch.column("text").cast(pa.binary())
        for at, (id_, row) in enumerate(zip(batch.column("id").to_pylist(), batch.column("row").to_pylist())):
            texts.append(binary[at].as_py())
            ids.append(id_)
            rows.append(row)
            size += len(texts[-1]) + 1
            if size >= most:
                yield made()
                ids, rows, texts, size = [], [], [], 0
    if texts:
        yield made()


# --- the first pass ----------------------------------------------------------------------------


class Places:
    """What is known of anchors by their places: 0 usual ones, 1 very many copies, 3 very many different segments."""

    def __init__(self, planes: tuple[bytes, bytes]):
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]

    def state(self, place: np.ndarray) -> np.ndarray:
        low, high = ((plane[place >> 3] >> (place & 7).astype(np.uint8)) & 1 for plane in self.planes)
        return low + 2 * high


class Counted(NamedTuple):
    planes: tuple[bytes, bytes]
    words: int  # of all segments that are sent
    hot: bool


def count_places(texts: DataFrame, words: int) -> Counted:
    """Add up the segments of all places; each group of places gives its part of the two bitmaps.

    As places are dealt by a hash, the mean of a group of them is that of all."""
    slices = 1 << (PLACE_BITS - SLICE_BITS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, words, BATCH_BYTES):
            own = batch.segments
            if not len(own.start):
                continue
            place, size = place_of(own.anchor), own.windows + words - 1
            digest = digests(batch.runs, own.start, own.windows)
            order = np.lexsort((digest, place))
            place, digest = place[order], digest[order]
            different = np.zeros(len(place), np.int64)
            once = starts_of(place, digest)
            different[once] = size[order][once]
            first = starts_of(place)
            place, found = place[first], np.diff(np.append(first, len(order)))
            load = np.add.reduceat(different, first)
            cuts = np.searchsorted(place >> SLICE_BITS, np.arange(slices + 1))
            used = [i for i in range(slices) if cuts[i] < cuts[i + 1]]
            parts = [slice(cuts[i], cuts[i + 1]) for i in used]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(used, pa.int64()),
                    pa.array([pack(place[p].astype(np.uint64)) for p in parts], pa.binary()),
                    pa.array([pack_counts(found[p]) for p in parts], pa.binary()),
                    pa.array([pack_counts(load[p]) for p in parts], pa.binary()),
                ],
                names=["slice", "places", "found", "load"],
            )

    def add(table: pa.Table) -> pa.Table:
        slice_ = table["slice"][0].as_py()
        found, load = np.zeros((2, 1 << SLICE_BITS), np.int64)
        for place, f, n in zip(*(table[c].to_pylist() for c in ("places", "found", "load"))):
            at = unpack(place).astype(np.int64) - (slice_ << SLICE_BITS)
            found[at] += unpack_counts(f).astype(np.int64)
            load[at] += unpack_counts(n).astype(np.int64)
        hot, various = (x > max(most, TIMES_MEAN * x.mean()) for x, most in ((found, HOT_SEGMENTS), (load, HOT_WORDS)))
        state = np.where(various, 3, hot).astype(np.uint8)
        expanded = np.where(various, load * words, load)
        planes = [np.packbits(state >> k & 1, bitorder="little").tobytes() for k in (0, 1)]
        columns = {"slice": [slice_], "low": [planes[0]], "high": [planes[1]]}
        return pa.table({**columns, "words": [int(expanded.sum())], "hot": [bool(state.any())]})

    made = texts.mapInArrow(work, "slice long, places binary, found binary, load binary").groupBy("slice")
    made = made.applyInArrow(add, "slice long, low binary, high binary, words long, hot boolean").collect()  # at most 32 MB; nearly all of it zeros
    planes = [bytearray(1 << (PLACE_BITS - 3)) for _ in range(2)]
    for r in made:
        at = r["slice"] << (SLICE_BITS - 3)
        for plane, part in zip(planes, (r["low"], r["high"])):
            plane[at : at + len(part)] = part
    return Counted(tuple(map(bytes, planes)), sum(r["words"] for r in made), any(r["hot"] for r in made))


# --- shards ------------------------------------------------------------------------------------

SENT = "shard long, words binary, windows binary, hot binary, times binary, ids binary, rows binary, texts binary, places binary"


def dealt_segments(batch: Batch, places: Places, words: int) -> tuple[Segments, np.ndarray, np.ndarray]:
    """(segments of a batch, whether they are hot, shard as a fraction of 2 ** 32)."""
    place = place_of(batch.segments.anchor)
    state = places.state(place)
    usual, various = state < 3, state == 3
    own = batch.segments.take(usual)
    dealt = place[usual].astype(np.uint64) << np.uint64(32 - PLACE_BITS)
    single = batch.segments.take(various).single()
    by_words = mix(batch.runs[single.start]) >> np.uint64(32)
    hot = np.concatenate([state[usual] == 1, np.ones(len(single.start), bool)])
    return Segments(*map(np.concatenate, zip(own, single))), hot, np.concatenate([dealt, by_words])


def send(batch: Batch, places: Places, words: int, shards: int) -> pa.RecordBatch | None:
    """A row per shard: its different segments of a batch, and the places of each (the extreme ids of a hot one)."""
    own, hot, dealt = dealt_segments(batch, places, words)
    if not len(own.start):
        return None
    shard = (dealt * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    digest = digests(batch.runs, own.start, own.windows)
    order = np.lexsort((batch.ids[own.text], digest, shard))
    own, hot, shard, digest = own.take(order), hot[order], shard[order], digest[order]
    first = starts_of(shard, digest)
    end = np.append(first[1:], len(order))
    kept = ~hot
    kept[first], kept[end - 1] = True, True
    kinds = np.cumsum(np.bincount(first, minlength=len(order))) - 1
    cuts = np.searchsorted(shard[first], np.arange(shards + 1))
    rows: list[tuple] = []
    small = zstandard.ZstdCompressor(level=LEVEL)
    for s in np.flatnonzero(cuts[:-1] < cuts[1:]):
        part = first[cuts[s] : cuts[s + 1]]
        of = np.flatnonzero(kept[first[cuts[s]] : end[cuts[s + 1] - 1]]) + first[cuts[s]]
        last = own.start[part] + own.windows[part] + words - 2
        sent = b" ".join([batch.data[i:j] for i, j in zip(batch.start[own.start[part]].tolist(), batch.end[last].tolist())])
        texts, back = np.unique(own.text[of], return_inverse=True)
        by_id = np.argsort(batch.ids[texts].astype(np.uint64), kind="stable")
        place_in = np.empty(len(by_id), np.int64)
        place_in[by_id] = np.arange(len(by_id))
        texts = texts[by_id]
        counts = (own.windows[part], hot[part], np.bincount(kinds[of] - cuts[s], minlength=len(part)))
        rows.append(
            (
                int(s),
                small.compress(sent),
                *(pack_counts(c) for c in counts),
                pack(batch.ids[texts].astype(np.uint64)),
                pack_counts(batch.rows[texts].astype(np.int64)),
                pack_counts(place_in[back]),
                pack_counts(own.place[of]),
            )
        )
    names = [f.split()[0] for f in SENT.split(", ")]
    kinds_of = [pa.int64()] + [pa.binary()] * (len(names) - 1)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds_of)], names=names)


class Shard:
    """The different segments of a shard, and the places where they stand."""

    def __init__(self, table: pa.Table, words: int):
        windows, hot, of, ids, rows, place, at = [], [], [], [], [], [], 0
        columns, large = [table[f.split()[0]].to_pylist() for f in SENT.split(", ")[1:]], zstandard.ZstdDecompressor()
        hashes = located_hashes(map(large.decompress, columns[0]))
        for n, h, times, i, r, texts, p in zip(*columns[1:]):
            windows.append(unpack_counts(n).astype(np.int64))
            hot.append(unpack_counts(h).astype(bool))
            of.append(np.repeat(np.arange(len(windows[-1])) + at, unpack_counts(times).astype(np.int64)))
            texts = unpack_counts(texts).astype(np.int64)
            ids.append(unpack(i).view(np.int64)[texts])
            rows.append(unpack_counts(r).view(np.int64)[texts])
            place.append(unpack_counts(p).astype(np.int64))
            at += len(windows[-1])
        windows, hot = map(np.concatenate, (windows, hot))
        self.of, self.ids, self.rows, self.place = map(np.concatenate, (of, ids, rows, place))
        size = windows + words - 1
        start = np.cumsum(size) - size
        self.short, runs = run_hashes(hashes, words)
        digest = digests(runs, start, windows)
        order = np.argsort(digest)
        first = starts_of(digest[order])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(np.bincount(first, minlength=len(order))) - 1
        chosen = order[first]
        self.words, self.of = words, number[self.of]
        self.start, self.windows, self.hot, self.digest = start[chosen], windows[chosen], hot[chosen], digest[chosen]
        self.hashes = hashes
        self.least = np.full(len(chosen), np.iinfo(np.int64).max)
        self.largest = np.full(len(chosen), np.iinfo(np.int64).min)
        np.minimum.at(self.least, self.of, self.ids)
        np.maximum.at(self.largest, self.of, self.ids)

    def candidates(self) -> np.ndarray:
        """Segments of several documents, and those whose anchor another one has too: no other can have a window in common."""
        size = min(ANCHOR, self.words)
        runs = self.windows + self.words - size
        anchor = np.minimum.reduceat(self.short[expand(self.start, runs)], np.cumsum(runs) - runs)
        _, number, count = np.unique(anchor, return_inverse=True, return_counts=True)
        return np.flatnonzero((self.least < self.largest) | (count[number] > 1))

    def intervals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(segment, first window, last window, least id) of windows in a row that a document of that id has, smaller than
        the largest one of the segment."""
        kept = self.candidates()
        if not len(kept):
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        size = self.windows[kept] + self.words - 1
        with_end = np.cumsum(size + 1) - size - 1  # every segment is followed by an end of its own
        sequence = np.zeros(int((size + 1).sum()), np.int64)
        at = expand(with_end, size)
        _, codes = np.unique(self.hashes[expand(self.start[kept], size)], return_inverse=True)
        sequence[at] = codes + 1
        by_count = np.argsort(-np.bincount(sequence), kind="stable")
        number = np.empty(len(by_count), np.int64)
        number[by_count] = np.arange(len(by_count))
        sequence = number[sequence]
        index = FMIndex(sequence, self.words)
        segment_at = np.repeat(kept, size + 1)[index.order]
        least, largest = self.least[segment_at], self.largest[segment_at]
        same = least == largest

        def alone(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            return (high - low == 1) & same[low]

        windows = self.windows[kept]
        begin = expand(with_end, windows)
        segment, nth = np.repeat(kept, windows), begin - np.repeat(with_end, windows)
        matched, low, high = index.matching(sequence, begin + self.words - 1, self.words, alone)
        full = matched == self.words
        segment, nth, low, high = segment[full], nth[full], low[full], high[full]
        if not len(segment):
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        ranges, back = np.unique(low, return_inverse=True)
        ends = np.empty(len(ranges), np.int64)
        ends[back] = high
        both = np.column_stack([ranges, ends]).reshape(-1)
        smallest = np.minimum.reduceat(np.append(least, np.iinfo(np.int64).max), both)[::2][back]
        some = smallest < self.largest[segment]
        segment, nth, smallest = segment[some], nth[some], smallest[some]
        if not len(segment):
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        broken = (segment[1:] != segment[:-1]) | (nth[1:] != nth[:-1] + 1) | (smallest[1:] != smallest[:-1])
        first = np.flatnonzero(np.concatenate([[True], broken]))
        last = np.append(first[1:], len(segment)) - 1
        return segment[first], nth[first], nth[last], smallest[first]

    def reported(self) -> pa.Table:
        """Rows of (hot, x, y, first, last, least): for a place its id, row and words; for a hot segment its digests and windows."""
        segment, first, last, least = self.intervals()
        hot = self.hot[segment]
        own = np.flatnonzero(~hot)
        begin, end = (np.searchsorted(segment[own], self.of, side=side) for side in ("left", "right"))
        of, which = np.repeat(np.arange(len(self.of)), end - begin), own[expand(begin, end - begin)]
        later = least[which] < self.ids[of]
        of, which, h = of[later], which[later], np.flatnonzero(hot)
        at = self.place[of]
        # Hot segments of all shards are joined, so they have a second digest.
        two = digests(run_hashes(self.hashes, self.words, BY[1])[1] if len(h) else self.short, self.start[segment[h]], self.windows[segment[h]], BY[1])
        columns = [
            np.concatenate([np.zeros(len(of), bool), np.ones(len(h), bool)]),
            np.concatenate([self.ids[of], self.digest[segment[h]].view(np.int64)]),
            np.concatenate([self.rows[of], two.view(np.int64)]),
            np.concatenate([at + first[which], first[h]]),
            np.concatenate([at + last[which] + self.words - 1, last[h]]),
            np.concatenate([least[which], least[h]]),
        ]
        return pa.table(columns, names=["hot", "x", "y", "first", "last", "least"])


# --- the operator ------------------------------------------------------------------------------


def without_repeats(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_removed``, ``kept`` (the words that stay, joined by one space).

    See the module for the method and for the defined results."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    # A row is known by its id and a hash of its text, for ids that repeat.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.hash(text_of(text_col)).cast("long").alias("row"), text_of(text_col).alias("text"))
    texts = rows.where("id IS NOT NULL")
    counted = count_places(texts, words)
    planes = spark.sparkContext.broadcast(counted.planes)  # 2 ** PLACE_BITS bits each
    shards = max(8, -(-counted.words // SHARD_WORDS))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(planes.value)
        for batch in batches_of(batches, words, BATCH_BYTES):
            out = send(batch, places, words, shards)
            if out is not None:
                yield out

    def indexed(table: pa.Table) -> pa.Table:
        return Shard(table, words).reported()

    def hot_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(planes.value)
        for batch in batches_of(batches, words, BATCH_BYTES):
            own, hot, _ = dealt_segments(batch, places, words)
            own = own.take(hot)
            one = digests(batch.runs, own.start, own.windows)
            two = digests(run_hashes(batch.hashes, words, BY[1])[1] if len(one) else batch.runs, own.start, own.windows, BY[1])
            columns = [one.view(np.int64), two.view(np.int64), batch.ids[own.text], batch.rows[own.text], own.place]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["x", "y", "id", "row", "place"])

    found = texts.mapInArrow(sent, SENT).groupBy("shard")
    found = stored(found.applyInArrow(indexed, "hot boolean, x long, y long, first long, last long, least long"), "repeats")
    covered = found.where("NOT hot").select(F.col("x").alias("id"), F.col("y").alias("row"), "first", "last")
    if counted.hot:
        places = texts.mapInArrow(hot_places, "x long, y long, id long, row long, place long")
        joined = places.join(found.where("hot"), ["x", "y"]).where("least < id")
        last = (F.col("place") + F.col("last") + words - 1).alias("last")
        covered = covered.union(joined.select("id", "row", (F.col("place") + F.col("first")).alias("first"), last))
    covered = covered.groupBy("id", "row").agg(F.collect_list(F.struct("first", "last")).alias("covered"))

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            texts = pa.array([small.compress(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), texts], names=["id", "row", "text"])

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [_kept(large.decompress(t), c) for t, c in zip(part.column("text").to_pylist(), part.column("covered").to_pylist())]
                columns = zip(*made)
                kinds = (pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["id", "n_words", "n_removed", "kept"]
                )

    # Texts go compressed into the join: they are most of what it shuffles.
    texts = rows.mapInArrow(compressed, "id long, row long, text binary")
    out = texts.join(covered, ["id", "row"], "left").select("id", "text", "covered")
    out = out.mapInArrow(cleaned, "id long, n_words long, n_removed long, kept string")
    return out.select(F.col("id").cast(kind).alias(id_col), "n_words", "n_removed", "kept")


def _kept(text: bytes, covered: list[dict] | None) -> tuple[int, int, str]:
    """(words, words removed, the others joined by a space) of a text."""
    words = text.split()
    if not covered:
        return len(words), 0, b" ".join(words).decode()
    turns = np.zeros(len(words) + 1, np.int64)
    np.add.at(turns, [c["first"] for c in covered], 1)
    np.add.at(turns, [c["last"] + 1 for c in covered], -1)
    stays = np.cumsum(turns[:-1]) == 0
    return len(words), int((~stays).sum()), b" ".join([words[i] for i in np.flatnonzero(stays)]).decode()
