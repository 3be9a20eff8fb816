"""Alignment of two tokenizers' tokens over the same bytes, and how many documents link each pair of ids.

Tokenizer A is a byte-level BPE of the tokenizers library, B a sentencepiece model that puts a space in front. Places where
tokens of both end cut a text into groups; every A token of a group is linked with every B token of it.

1. Documents are encoded once, and their ids stored. Both tokenizers end a token before a single space that follows a visible
   character, so the stretches between such places are encoded on their own, many documents' at a time, and kept per worker:
   of a full cache the half used most often stays. A document with a stretch that does not come back is encoded whole.
2. Distinct pairs of linked ids are gathered per task and dealt by a hash. There are at most as many as ids of A times ids of
   B. Each part gets a minimal perfect hash function of its pairs, and keeps them in the order of their numbers to verify.
3. Documents are aligned once more: tasks add up dense vectors of counts indexed by number, which are summed in two steps.
   The largest count of every A id is taken from them.
4. Documents are aligned a last time, and links look up their counts.

Defined results: a null or empty text, or one whose tokens do not give it back, has no tokens, zeros and '' as digest. Rows
with the same id, or none, are documents of their own. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from fleetfit import session
from fleetfit.llm.arrays import load, save
from fleetfit.llm.common import stored
from fleetfit.llm.perfect_hash import PerfectHash, build
from fleetfit.llm.substring_dedup import expand
from fleetfit.llm.wordhash import mix, pack, pack_counts, summed, unpack, unpack_counts

#: A visible character, after which a space begins a new stretch.
VISIBLE = r"[!-~\w]"
SPLIT_HERE = re.compile(f"(?<={VISIBLE}) (?=[^ ])")
ENDS_VISIBLE = re.compile(f"{VISIBLE}\\Z")
#: Where not every space begins a new stretch.
UNEVEN = re.compile(f"(?<!{VISIBLE}) | \\Z")
#: Characters of a text that are cut into stretches at once; bytes of stretches that a worker keeps.
SLICE = 1 << 20
#: Stretches that are encoded as one text.
TOGETHER = 256
CACHE_BYTES = 1 << 27
#: Rows and bytes of text that are worked on at once, if that is more than one row.
SLAB_ROWS, SLAB_BYTES = 512, 1 << 22
#: Links of a group from which on its different ids are paired instead of its tokens.
LARGE_GROUP = 1 << 12
#: Bytes of text for each part of the pairs, the most parts, pairs held at once in a task, and branches of the first sum.
BYTES_PER_PART, PARTS = 1 << 26, 256
HELD = 2_000_000
BRANCHES = 16
#: Ids are stored in so many bytes.
ID, SIZE = np.dtype("<u2"), 2


class Tokenizers(NamedTuple):
    """Contents of the two files; sent to the workers, which need not have them."""

    a: str
    b: bytes


def read_tokenizers(path_a: str, path_b: str) -> Tokenizers:
    with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
        return Tokenizers(a.read(), b.read())


def stretches(text: str) -> Iterator[str]:
    """Stretches of a non-empty text with a space in front; each begins with a space."""
    at = 0
    while at < len(text):
        cut = SPLIT_HERE.search(text, at + SLICE) if len(text) - at > SLICE else None
        part = text[at : cut.start() if cut else len(text)]
        at = cut.end() if cut else len(text)
        if not UNEVEN.search(part):
            yield from (" " + p for p in part.split(" "))
            continue
        held: list[str] = []
        for p in part.split(" "):
            if held and p and ENDS_VISIBLE.search(held[-1]):
                yield " " + " ".join(held)
                held = []
            held.append(p)
        yield " " + " ".join(held)


class Encoder:
    """Both tokenizers in a worker, with the stretches that it met, their first space left out.

    Stretches are numbered in the order of ``known``. ``ids`` are those of A and of B of all stretches one after the other,
    ``start`` and ``size`` where those of a stretch are; ``back`` whether they give it back, ``uses`` in how many slabs it was."""

    def __init__(self, files: Tokenizers):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.a = Tokenizer.from_str(files.a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.b)
        rules, shown = json.loads(files.a), {c: b for b, c in enumerate(_byte_letters())}
        cut = rules.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        if not plain or rules.get("normalizer") or set(shown) != set(pre_tokenizers.ByteLevel.alphabet()):
            raise ValueError("tokenizer A is not a byte-level one without a normalizer")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces) or self.b.encode("a", out_type=str) != ["▁a"]:
            raise ValueError("tokenizer B puts no space in front, or has pieces across spaces")
        names = self.a.get_vocab()
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for t, i in names.items():
            self.bytes_a[i] = bytes(shown[c] for c in t) if all(c in shown for c in t) else t.encode()
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self._keep_none()

    def _keep_none(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = [np.zeros(0, ID) for _ in range(2)]
        self.start, self.size = ([np.zeros(0, np.int64) for _ in range(2)] for _ in range(2))
        self.back, self.uses = np.zeros(0, bool), np.zeros(0, np.int64)
        self.held = 0

    def _keep_half(self) -> None:
        """Forget the stretches that were used least; all, if the others are still too many."""
        kept = np.sort(np.argsort(self.uses, kind="stable")[len(self.uses) // 2 :])
        names = list(self.known)
        names = [names[i] for i in kept.tolist()]
        self.held = sum(map(_cost, names))
        if self.held > CACHE_BYTES:
            return self._keep_none()
        self.known = dict(zip(names, range(len(names))))
        self.back, self.uses = self.back[kept], self.uses[kept] // 2
        for k in range(2):
            size = self.size[k][kept]
            self.ids[k] = self.ids[k][expand(self.start[k][kept], size)]
            self.start[k], self.size[k] = np.cumsum(size) - size, size

    def _checked(self, whole: str, a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray] | None:
        data, of_a, of_b = whole.encode(), self.bytes_a, self.bytes_b
        if b"".join([of_a[i] for i in a]) != data or b"".join([of_b[i] for i in b]) != data:
            return None
        return np.array(a, ID), np.array(b, ID)

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and B for a text with a space in front; None if they do not give it back."""
        return self._checked(" " + text, self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text, num_threads=1))

    def learn(self, new: list[str]) -> None:
        """Encode stretches, many at a time as one text: each begins where a token of both begins."""
        joint, alone = [], []
        for s in new:
            (joint if ENDS_VISIBLE.search(s) and s[:1] not in ("", " ") else alone).append(s)
        names, back, ids, sizes = [], [], ([], []), ([], [])
        for at in range(0, len(joint), TOGETHER):
            some = joint[at : at + TOGETHER]
            found = self.whole(" ".join(some))
            cuts = []
            if found is not None:
                ends = np.cumsum([len(s.encode()) + 1 for s in some])
                for own, length in zip(found, (self.length_a, self.length_b)):
                    sums = np.cumsum(length[own])
                    after = np.searchsorted(sums, ends) + 1
                    if not np.array_equal(sums[after - 1], ends):
                        break
                    cuts.append(np.diff(after, prepend=0))
            if len(cuts) < 2:
                alone += some
                continue
            names += some
            back.append(np.ones(len(some), bool))
            for k in range(2):
                ids[k].append(found[k])
                sizes[k].append(cuts[k])
        for s in alone:
            found = self.whole(s)
            names.append(s)
            back.append(np.array([found is not None]))
            for k in range(2):
                ids[k].append(found[k] if found else np.zeros(0, ID))
                sizes[k].append([len(ids[k][-1])])
        self.known.update(zip(names, range(len(self.known), len(self.known) + len(names))))
        self.back = np.concatenate([self.back, *back])
        self.uses = np.concatenate([self.uses, np.zeros(len(names), np.int64)])
        for k in range(2):
            self.ids[k] = np.concatenate([self.ids[k], *ids[k]])
            self.size[k] = np.concatenate([self.size[k], *sizes[k]]).astype(np.int64)
            self.start[k] = np.cumsum(self.size[k]) - self.size[k]
        self.held += sum(map(_cost, names))

    def _numbers(self, different: list[str]) -> np.ndarray:
        """Numbers of different stretches, until others are asked for."""
        if self.held > CACHE_BYTES:
            self._keep_half()
        new = [s for s in different if s not in self.known]
        if new:
            self.learn(new)
        numbers = np.fromiter(map(self.known.__getitem__, different), np.int64, len(different))
        self.uses[numbers] += 1
        return numbers

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """Ids of A and of B as bytes; none for a text without tokens."""
        if not text:
            return b"", b""
        parts, found = ([], []), stretches(text)
        while some := [s[1:] for s in islice(found, 100_000)]:
            different = dict.fromkeys(some)
            numbers = dict(zip(different, self._numbers(list(different)).tolist()))
            own = np.array([numbers[s] for s in some], np.int64)
            if not self.back[own].all():
                return self._alone(text)
            for k in range(2):
                parts[k].append(self.ids[k][expand(self.start[k][own], self.size[k][own])].tobytes())
        return b"".join(parts[0]), b"".join(parts[1])

    def _alone(self, text: str) -> tuple[bytes, bytes]:
        ids = self.whole(text)
        return (ids[0].tobytes(), ids[1].tobytes()) if ids else (b"", b"")

    def encode_all(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """As ``encode``, of the texts of a slab: each of their stretches is looked up once."""
        out = [(b"", b"")] * len(texts)
        even, other = [], []
        for i, text in enumerate(texts):
            if text and len(text) > SLICE:
                out[i] = self.encode(text)
            elif text:
                (other if UNEVEN.search(text) else even).append(i)
        if not even and not other:
            return out
        cut = pc.split_pattern(pa.array([texts[i] for i in even], pa.large_string()), " ")
        lists = [[s[1:] for s in stretches(texts[i])] for i in other]
        rest = pa.array([s for found in lists for s in found], pa.large_string())
        coded = pa.concat_arrays([cut.flatten(), rest]).dictionary_encode()
        counts = np.concatenate([pc.list_value_length(cut).to_numpy(zero_copy_only=False), [len(x) for x in lists]]).astype(np.int64)
        numbers = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        first = np.cumsum(counts) - counts
        back = np.logical_and.reduceat(self.back[numbers], first)
        data, ends = [], []
        for k in range(2):
            size = self.size[k][numbers]
            data.append(self.ids[k][expand(self.start[k][numbers], size)].tobytes())
            ends.append((SIZE * np.cumsum(np.add.reduceat(size, first))).tolist())
        at_a = at_b = 0
        for i, whole, end_a, end_b in zip([*even, *other], back.tolist(), *ends):
            out[i] = (data[0][at_a:end_a], data[1][at_b:end_b]) if whole else self._alone(texts[i])
            at_a, at_b = end_a, end_b
        return out


def _cost(stretch: str) -> int:
    """Bytes that a worker keeps for a stretch, about."""
    return 2 * len(stretch) + 220


def _byte_letters() -> list[str]:
    """The letter that byte-level tokenizers show for each byte: printable Latin-1 as itself, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


@lru_cache(maxsize=1)
def _encoder(files: Tokenizers) -> Encoder:
    return Encoder(files)


def encoder(shared) -> Encoder:
    return _encoder(shared.value)


class Lengths(NamedTuple):
    """Bytes of every token of A and of B."""

    a: np.ndarray
    b: np.ndarray


class Links(NamedTuple):
    """Alignment of a batch of documents, one after the other.

    ``a`` and ``b`` are the ids; ``end_a`` and ``end_b`` the tokens up to the end of each group; ``group_ends`` the groups up
    to the end of each document. Every link has a document, a key of two ids, and how many pairs of tokens it stands for."""

    a: np.ndarray
    b: np.ndarray
    tokens_a: np.ndarray
    tokens_b: np.ndarray
    end_a: np.ndarray
    end_b: np.ndarray
    group_ends: np.ndarray
    document: np.ndarray
    key: np.ndarray
    times: np.ndarray


def align(ids_a: list[np.ndarray], ids_b: list[np.ndarray], lengths: Lengths) -> Links:
    a, b = (np.concatenate(i).astype(np.int64) if i else np.zeros(0, np.int64) for i in (ids_a, ids_b))
    tokens_a, tokens_b = (np.array([len(x) for x in i], np.int64) for i in (ids_a, ids_b))
    # Documents have as many bytes in A as in B, so places of all documents can be compared at once.
    place_a, place_b = np.cumsum(lengths.a[a]), np.cumsum(lengths.b[b])
    size = int(place_a[-1]) + 1 if len(a) else 1
    ends = np.zeros((2, size), bool)
    ends[0, place_a], ends[1, place_b] = True, True
    end_a, end_b = np.flatnonzero(ends[1, place_a]) + 1, np.flatnonzero(ends[0, place_b]) + 1
    group_ends = np.searchsorted(end_a, np.cumsum(tokens_a), side="right")
    start_a, start_b = (np.concatenate([[0], e])[:-1] for e in (end_a, end_b))
    n_a, n_b = end_a - start_a, end_b - start_b
    document = np.repeat(np.arange(len(ids_a)), np.diff(np.concatenate([[0], group_ends])))
    # Most groups are a token of each.
    pairs = n_a * n_b
    one = np.flatnonzero(pairs == 1)
    usual = np.flatnonzero((pairs > 1) & (pairs < LARGE_GROUP))
    group = np.repeat(usual, pairs[usual])
    nth, width = expand(np.zeros(len(usual), np.int64), pairs[usual]), n_b[group]
    row = nth // width
    many = a[start_a[group] + row] * len(lengths.b) + b[start_b[group] + nth - row * width]
    key = np.concatenate([a[start_a[one]] * len(lengths.b) + b[start_b[one]], many])
    times, document_of = np.ones(len(key), np.int64), document[np.concatenate([one, group])]
    for g in np.flatnonzero(pairs >= LARGE_GROUP):
        x, n = np.unique(a[start_a[g] : end_a[g]], return_counts=True)
        y, m = np.unique(b[start_b[g] : end_b[g]], return_counts=True)
        key = np.concatenate([key, (x[:, None] * len(lengths.b) + y).reshape(-1)])
        times = np.concatenate([times, (n[:, None] * m).reshape(-1)])
        document_of = np.concatenate([document_of, np.full(len(x) * len(y), document[g])])
    return Links(a, b, tokens_a, tokens_b, end_a, end_b, group_ends, document_of, key.astype(np.uint64), times)


def distinct_keys(links: Links) -> tuple[np.ndarray, np.ndarray]:
    """Different keys of links, in any order, and which of them each link has."""
    coded = pa.array(links.key).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def shown_groups(links: Links, table: np.ndarray, ids_a: int, ids_b: int) -> list[bytes]:
    """Per document the groups as text. ``table`` holds every id of A with ',' and with '|', and of B with ',' and with ';'."""
    start_a, start_b = (np.concatenate([[0], e])[:-1] for e in (links.end_a, links.end_b))
    n_a, n_b = links.end_a - start_a, links.end_b - start_b
    shown = np.empty(len(links.a) + len(links.b), table.dtype)
    last_a, last_b = np.zeros(len(links.a), bool), np.zeros(len(links.b), bool)
    last_a[links.end_a - 1], last_b[links.end_b - 1] = True, True
    shown[np.arange(len(links.a)) + np.repeat(start_b, n_a)] = table[links.a + ids_a * last_a]
    shown[np.arange(len(links.b)) + np.repeat(links.end_a, n_b)] = table[links.b + 2 * ids_a + ids_b * last_b]
    out, at = [], 0
    for n in (links.tokens_a + links.tokens_b).tolist():
        out.append(shown[at : at + n].tobytes().translate(None, b"\0")[:-1])
        at += n
    return out


def shown_ids(ids_a: int, ids_b: int) -> np.ndarray:
    """Ids of up to five digits with what follows them, as eight bytes, zeros behind."""
    shown = [b"%d%c" % (i, end) for n, ends in ((ids_a, b",|"), (ids_b, b",;")) for end in ends for i in range(n)]
    return np.array(shown, "S8").view(np.uint64)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((mix(keys.astype(np.uint64)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places of its keys)."""
    part = part_of(keys, parts)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        if cuts[p] < cuts[p + 1]:
            yield p, order[cuts[p] : cuts[p + 1]]


def _slabs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Rows of a bounded number of bytes in ``column``, at least one."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            end = np.searchsorted(ends, (ends[at - 1] if at else 0) + SLAB_BYTES, side="right")
            end = min(max(int(end), at + 1), at + SLAB_ROWS, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


# --- the passes --------------------------------------------------------------------------------


def encoded(rows: DataFrame, shared, kind: str) -> DataFrame:
    """Stored table of (id, a, b): the ids of each document, compressed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, small = encoder(shared), zstandard.ZstdCompressor(level=1)
        for slab in _slabs(batches, "text"):
            both = known.encode_all(slab.column("text").to_pylist())
            columns = [pa.array([small.compress(_planes(p[k])) for p in both], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([slab.column("id"), *columns], names=["id", "a", "b"])

    return stored(rows.mapInArrow(work, f"id {kind}, a binary, b binary"), "token-ids")


def _planes(ids: bytes) -> bytes:
    """Low bytes before high bytes, which compress better apart."""
    return np.ascontiguousarray(np.frombuffer(ids, np.uint8).reshape(-1, SIZE).T).tobytes()


def _aligned(slab: pa.RecordBatch, lengths: Lengths) -> Links:
    large = zstandard.ZstdDecompressor()

    def ids(column: str) -> list[np.ndarray]:
        planes = [np.frombuffer(large.decompress(x), np.uint8) for x in slab.column(column).to_pylist()]
        return [np.ascontiguousarray(p.reshape(SIZE, -1).T).view(ID).reshape(-1) for p in planes]

    return align(ids("a"), ids("b"), lengths)


def distinct_pairs(ids: DataFrame, lengths, folder: str, parts: int) -> list[int]:
    """Perfect hash functions and keys of all linked pairs, as files; how many pairs each part has."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, size = np.zeros(0, np.uint64), [], 0
        for slab in _slabs(batches, "a"):
            held.append(np.unique(_aligned(slab, lengths.value).key))
            size += len(held[-1])
            if size >= HELD:
                keys, held, size = np.unique(np.concatenate([keys, *held])), [], 0
                if len(keys) >= HELD:
                    yield sent(keys)
                    keys = keys[:0]
        yield sent(np.unique(np.concatenate([keys, *held])))

    def sent(keys: np.ndarray) -> pa.RecordBatch:
        rows = [(p, pack(keys[at])) for p, at in _by_part(keys, parts)]
        columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["part", "keys"])

    def merge(table: pa.Table) -> pa.Table:
        part, keys = table["part"][0].as_py(), np.zeros(0, np.uint64)
        for column in table["keys"].to_pylist():
            keys = np.union1d(keys, unpack(column))
        built = build(keys)
        by_number = np.empty(len(keys), np.uint64)
        by_number[PerfectHash(built).numbers(keys)] = keys
        save(f"{folder}/hash-{part}.npy", built)
        save(f"{folder}/keys-{part}.npy", by_number)
        return pa.table({"part": [part], "kinds": [len(keys)]})

    made = ids.mapInArrow(work, "part long, keys binary").groupBy("part").applyInArrow(merge, "part long, kinds long").collect()
    kinds = {r["part"]: r["kinds"] for r in made}
    for p in set(range(parts)) - set(kinds):
        save(f"{folder}/hash-{p}.npy", build(np.zeros(0, np.uint64)))
        save(f"{folder}/keys-{p}.npy", np.zeros(0, np.uint64))
        save(f"{folder}/counts-{p}.npy", np.zeros(0, np.int64))
    return [kinds.get(p, 0) for p in range(parts)]


@lru_cache(maxsize=512)
def _hash_of(folder: str, part: int) -> tuple[PerfectHash, np.ndarray]:
    return PerfectHash(load(f"{folder}/hash-{part}.npy")), load(f"{folder}/keys-{part}.npy")


@lru_cache(maxsize=512)
def _counts_of(folder: str, part: int) -> np.ndarray:
    return load(f"{folder}/counts-{part}.npy")


def numbers_of(folder: str, part: int, keys: np.ndarray) -> np.ndarray:
    """Numbers of pairs of a part; -1 for a key that is not the one kept under its number."""
    known, by_number = _hash_of(folder, part)
    numbers = known.numbers(keys)
    if not len(by_number):
        return np.full(len(keys), -1, np.int64)
    return np.where(by_number[np.maximum(numbers, 0)] == keys.astype(np.uint64), numbers, -1)


def slab_counts(links: Links) -> tuple[np.ndarray, np.ndarray]:
    """(different keys, number of documents of the batch that hold each)."""
    keys, which = distinct_keys(links)
    small = len(links.tokens_a) * len(keys) <= np.iinfo(np.int32).max
    held = np.unique((links.document * len(keys) + which).astype(np.int32 if small else np.int64))
    return keys, np.bincount(held % max(1, len(keys)), minlength=len(keys)).astype(np.uint64)


def document_counts(ids: DataFrame, lengths, folder: str, kinds: list[int]) -> dict[int, int]:
    """Numbers of documents that hold each pair, as files in the order of the pairs' numbers; the largest one of each A id."""
    parts = len(kinds)

    def vectors(keys: np.ndarray, counts: np.ndarray, branch: int) -> Iterator[pa.RecordBatch]:
        for p, at in _by_part(keys, parts):
            dense, numbers = np.zeros(kinds[p], np.uint64), numbers_of(folder, p, keys[at])
            if (numbers < 0).any():
                raise ValueError("documents have changed since the first pass")
            dense[numbers] = counts[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p], pa.int64()), pa.array([branch], pa.int64()), pa.array([pack_counts(dense)], pa.binary())],
                names=["part", "branch", "counts"],
            )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        branch, held, size = TaskContext.get().partitionId() % BRANCHES, [], 0
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for slab in _slabs(batches, "a"):
            held.append(slab_counts(_aligned(slab, lengths.value)))
            size += len(held[-1][0])
            if size >= HELD:
                keys, counts = added(keys, counts, held)
                held, size = [], 0
                if len(keys) >= HELD:
                    yield from vectors(keys, counts, branch)
                    keys, counts = keys[:0], counts[:0]
        yield from vectors(*added(keys, counts, held), branch)

    def added(keys: np.ndarray, counts: np.ndarray, held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        return summed(np.concatenate([keys, *(h[0] for h in held)]), np.concatenate([counts, *(h[1] for h in held)]))

    def add(table: pa.Table) -> np.ndarray:
        total = np.zeros(kinds[table["part"][0].as_py()], np.uint64)
        for column in table["counts"].to_pylist():
            total += unpack_counts(column)
        return total

    def branch_sum(table: pa.Table) -> pa.Table:
        return pa.table({"part": [table["part"][0].as_py()], "counts": pa.array([pack_counts(add(table))], pa.binary())})

    def part_sum(table: pa.Table) -> pa.Table:
        part, total = table["part"][0].as_py(), add(table)
        save(f"{folder}/counts-{part}.npy", total.astype(np.int64))
        a = (load(f"{folder}/keys-{part}.npy") // np.uint64(len(lengths.value.b))).astype(np.int64)
        order = np.argsort(a, kind="stable")
        ids, first = np.unique(a[order], return_index=True)
        return pa.table({"a": ids, "most": np.maximum.reduceat(total[order], first).astype(np.int64)})

    made = ids.mapInArrow(work, "part long, branch long, counts binary")
    made = made.groupBy("part", "branch").applyInArrow(branch_sum, "part long, counts binary")
    best = made.groupBy("part").applyInArrow(part_sum, "a long, most long").groupBy("a").agg(F.max("most").alias("most"))
    return {r["a"]: r["most"] for r in best.collect()}  # at most as many rows as A has ids


OUT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and
    ``groups_sha256``. See the module for the method and for the defined results."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    files = read_tokenizers(path_a, path_b)
    both = Encoder(files)
    if max(len(both.bytes_a), len(both.bytes_b)) > np.iinfo(ID).max + 1:
        raise ValueError(f"ids are kept in {8 * SIZE} bits")
    shared = spark.sparkContext.broadcast(files)  # two files, and one number per id: of fixed size
    lengths = spark.sparkContext.broadcast(Lengths(both.length_a, both.length_b))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ids = encoded(rows, shared, kind)
    folder = session.scratch_path(spark, "llm-token-pairs")
    kinds = distinct_pairs(ids, lengths, folder, min(PARTS, 8 + size // BYTES_PER_PART))
    best = spark.sparkContext.broadcast(document_counts(ids, lengths, folder, kinds))
    parts = len(kinds)

    def look_up(keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        for p, at in _by_part(keys, parts):
            numbers = numbers_of(folder, p, keys[at])
            if (numbers < 0).any():
                raise ValueError("documents have changed since the first pass")
            out[at] = _counts_of(folder, p)[numbers]
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_a, ids_b = (len(x) for x in lengths.value)
        most, table = np.zeros(ids_a, np.int64), shown_ids(ids_a, ids_b)
        most[list(best.value)] = list(best.value.values())
        for slab in _slabs(batches, "a"):
            links = _aligned(slab, lengths.value)
            keys, which = distinct_keys(links)
            counts = look_up(keys)
            is_best = (counts == most[(keys // np.uint64(ids_b)).astype(np.int64)])[which]
            counts = counts[which]
            sums = np.zeros((3, slab.num_rows), np.int64)
            for row, values in zip(sums, (links.times, links.times * is_best, links.times * counts)):
                np.add.at(row, links.document, values)
            groups = np.diff(np.concatenate([[0], links.group_ends]))
            texts = shown_groups(links, table, ids_a, ids_b)
            digests = [hashlib.sha256(t).hexdigest() if t else "" for t in texts]
            columns = [pa.array(c, pa.int64()) for c in (links.tokens_a, links.tokens_b, groups, *sums)]
            yield pa.RecordBatch.from_arrays(
                [slab.column("id"), *columns, pa.array(digests, pa.string())],
                names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

    return ids.mapInArrow(work, f"id {kind}, {OUT}").withColumnRenamed("id", id_col)
