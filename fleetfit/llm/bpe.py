"""BPE encoding and decoding with content-defined chunks.

Texts are cut where a rolling hash over the last 32 bytes has its low bits at zero, so equal passages are cut alike
wherever they stand. Each chunk's inside (from its first to its last white space) is encoded on its own; a chunk met
again is not encoded again. What straddles a join is repaired: the window between the last white space of the left chunk
and the first of the right one is re-encoded, and widened over further chunks until both ends stand at white space,
where the tokenizer's word pattern makes the encodings on either side agree with that of the whole text.

Chunks that make up at least ``1 / SHARED_CHUNKS`` of all chunks, so at most that many, are encoded once for the whole
corpus and handed to all tasks. Other chunks are encoded once per worker in which they are met twice or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetfit.llm.common import stored, text_of
from fleetfit.llm.wordpieces import definition_at, drops_white_space, encoder, joined

#: Low bits of the rolling hash that are zero at a cut: chunks of 512 bytes on average.
CUT_BITS = 9
SHARED_CHUNKS = 4096
#: Chunks kept per worker, about 3 kB each.
CACHE_CHUNKS = 10_000
SPACES = b" \t\n\x0b\x0c\r"


def _table() -> np.ndarray:
    """256 random 32-bit values by a fixed rule (a multiplicative mix of the byte)."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _table()


def cuts(text: bytes, bits: int = CUT_BITS) -> list[int]:
    """Ends of the chunks. The hash at a place is the sum of ``GEAR[byte] << age`` over the last 32 bytes."""
    h = GEAR[np.frombuffer(text, np.uint8)]
    span = 1
    while span < 32 and span < len(h):
        later = h.copy()
        later[span:] += h[:-span] << np.uint32(span)
        h, span = later, span * 2
    # High bits of the hash depend on all 32 bytes.
    ends = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    found = ends.tolist()
    if not found or found[-1] != len(text):
        found.append(len(text))
    return found


def chunks(text: bytes, bits: int = CUT_BITS) -> Iterator[bytes]:
    start = 0
    for end in cuts(text, bits) if text else []:
        yield text[start:end]
        start = end


def outer_spaces(chunk: bytes) -> tuple[int, int]:
    """First and last white space of a chunk; (-1, -1) if it has none."""
    places = [(chunk.find(s), chunk.rfind(s)) for s in (SPACES[i : i + 1] for i in range(len(SPACES)))]
    places = [p for p in places if p[0] >= 0]
    return (min(p[0] for p in places), max(p[1] for p in places)) if places else (-1, -1)


class ChunkEncoder:
    """Encodes texts chunk by chunk; ``shared`` holds encodings that came with the task."""

    def __init__(self, definition: str, shared: dict[bytes, tuple] | None = None):
        self.words = encoder(definition)
        self.shared = shared or {}
        self.seen: set[int] = set()
        self.kept: dict[bytes, tuple] = {}

    def inside(self, chunk: bytes) -> tuple:
        """(head, encoding of the inside, tail); head is None for a chunk without white space."""
        known = self.shared.get(chunk) or self.kept.get(chunk)
        if known is not None:
            return known
        first, last = outer_spaces(chunk)
        if first < 0:
            return None, None, chunk
        encode = self.words.encode
        found = chunk[:first], joined([encode(w) for w in chunk[first:last].split()]), chunk[last + 1 :]
        mark = hash(chunk)
        if mark in self.seen:
            if len(self.kept) >= CACHE_CHUNKS:
                self.kept.clear()
            self.kept[chunk] = found
        else:
            if len(self.seen) >= 20 * CACHE_CHUNKS:
                self.seen.clear()
            self.seen.add(mark)
        return found

    def encode(self, text: bytes) -> tuple[int, bytes, bytes]:
        parts, window = [], []
        for chunk in chunks(text):
            head, inner, tail = self.inside(chunk)
            if head is None:  # no white space: the window goes on into the next chunk
                window.append(tail)
                continue
            window.append(head)
            repaired = b"".join(window)
            if repaired:
                parts.append(self.words.encode(repaired))
            parts.append(inner)
            window = [tail]
        if rest := b"".join(window):
            parts.append(self.words.encode(rest))
        return joined(parts)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for value in batch.column("text"):
        yield (value.as_py() or "").encode()


def _digest(chunk: bytes) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(chunk, digest_size=8).digest(), "big", signed=True)


def shared_chunks(texts: DataFrame, definition: str, most: int = SHARED_CHUNKS) -> dict[bytes, tuple]:
    """Encodings of the chunks that make up at least ``1 / most`` of all: at most ``most``, each encoded once."""
    spark = texts.sparkSession

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        total, found = 0, Counter()
        for batch in batches:
            for text in _texts(batch):
                for chunk in chunks(text):
                    total += 1
                    found[_digest(chunk)] += 1
            if len(found) > 200_000:  # what was met once is handed on at once, the sum is the same
                yield _pairs(found)
                found.clear()
        yield _pairs(found)

    def _pairs(found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=["chunk", "n"]
        )

    counts = stored(texts.mapInArrow(counted, "chunk long, n long").groupBy("chunk").agg(F.sum("n").alias("n")), "chunk-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.where((F.col("n") > 1) & (F.col("n") * most >= total)).select("chunk")
    wanted = {r["chunk"] for r in often.collect()}
    if not wanted:
        return {}
    send = spark.sparkContext.broadcast(wanted)

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = set(send.value)
        for batch in batches:
            for text in _texts(batch):
                new = [c for c in chunks(text) if (d := _digest(c)) in left and not left.discard(d)]
                if new:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([_digest(c) for c in new], pa.int64()), pa.array(new, pa.binary())], names=["chunk", "bytes"]
                    )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = ChunkEncoder(definition)
        for batch in batches:
            rows = []
            for chunk in batch.column("bytes").to_pylist():
                head, inner, tail = work.inside(chunk)
                if head is not None:
                    rows.append((chunk, head, tail, *inner))
            kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["bytes", "head", "tail", "n", "ids", "decoded"])

    once = texts.mapInArrow(texts_of, "chunk long, bytes binary").groupBy("chunk").agg(F.min("bytes").alias("bytes"))
    done = once.mapInArrow(encoded, "bytes binary, head binary, tail binary, n long, ids binary, decoded binary").collect()
    return {
        bytes(r["bytes"]): (bytes(r["head"]), (r["n"], bytes(r["ids"]), bytes(r["decoded"])), bytes(r["tail"])) for r in done
    }


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", reuse: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, ``n_tokens``, ``ids`` (decimal ids joined by one space) and ``decoded`` (the text
    that the ids decode to), as the tokenizers library gives them for the file at ``path`` without added special tokens.

    A null text counts as empty and has no tokens; rows repeat as they do in ``docs``; extra columns are ignored.
    """
    definition = definition_at(path)
    if not drops_white_space(definition):
        raise ValueError(f"{path}: its tokens depend on white space; chunks cannot be joined at white space")
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(shared_chunks(texts.select("text"), definition) if reuse else {})
    known = context.broadcast(definition)
    kind = dict(docs.dtypes)[id_col]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = ChunkEncoder(known.value, shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [work.encode(t) for t in _texts(part)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1].decode() for r in rows], pa.string()),
                        pa.array([r[2].decode() for r in rows], pa.string()),
                    ],
                    names=["id", "n_tokens", "ids", "decoded"],
                )

    out = texts.mapInArrow(encoded, f"id {kind}, n_tokens long, ids string, decoded string")
    return out.withColumnRenamed("id", id_col)


def digest(column: str) -> Column:
    return F.sha2(F.col(column).cast("binary"), 256)
