"""Interpolated modified Kneser-Ney bigram model, counted in Spark, stored as sorted arrays, memory-mapped by workers.

1. Words are counted as sorted arrays of 64-bit hashes, one file per range of hashes. A word's number is its place.
2. Pairs of neighbouring words are counted as 64-bit integers (number of the first, number of the second). Ranges of pairs
   are laid so that each holds the same share of tokens, splitting a frequent first word over several ranges.
3. The kinds of continuations of each word, and the kinds of words before it, are added up from the distinct pairs.
4. Workers map the files and look up the pairs of a document with binary searches over sorted keys.

Between steps only packed arrays are shuffled, already added up in the tasks. Files go to the shared folder, each written
whole under another name and then renamed, so that a repeated task does no harm. The model grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetfit import session
from fleetfit.llm.arrays import load, save
from fleetfit.llm.common import fold, stored, text_of
from fleetfit.llm.wordhash import grouped, pack, pack_counts, summed, unpack, unpack_counts

#: Hash of the token that ends every document; as the first of a pair it stands for the document's beginning.
END = np.uint64(0)
#: Tokens added up at once in a task, and tokens per range of pairs.
TOKENS_AT_ONCE = 2_000_000
TOKENS_PER_RANGE = 4_000_000
SMALL = np.uint64(32)
ADD = 0.1


# --- the model as workers see it ---------------------------------------------------------------


class Words(NamedTuple):
    """Where the word arrays are: ``sizes`` has the number of words of each range."""

    folder: str
    sizes: tuple[int, ...]
    tokens: int

    @property
    def kinds(self) -> int:
        return sum(self.sizes)


class Model(NamedTuple):
    words: Words
    bounds: tuple[int, ...]
    discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    pair_kinds: int
    rest: float  # share of the lowest level that goes to all words alike


class Vocabulary:
    def __init__(self, words: Words):
        self.parts = [load(f"{words.folder}/words-{i}.npy") for i in range(len(words.sizes))]
        self.counted = [load(f"{words.folder}/counts-{i}.npy") for i in range(len(words.sizes))]
        self.first = np.cumsum([0, *words.sizes])
        self.ranges = len(words.sizes)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, count) of each hash; unknown ones have number -1 and count 0."""
        distinct, back = np.unique(hashes, return_inverse=True)
        number, count = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.int64)
        cuts = np.searchsorted(word_range(distinct, self.ranges), np.arange(self.ranges + 1))
        for i, part in enumerate(self.parts):
            own = distinct[cuts[i] : cuts[i + 1]]
            if len(own) and len(part):
                at = np.minimum(np.searchsorted(part, own), len(part) - 1)
                hit = part[at] == own
                number[cuts[i] : cuts[i + 1]] = np.where(hit, at + self.first[i], -1)
                count[cuts[i] : cuts[i + 1]] = np.where(hit, self.counted[i][at], 0)
        return number[back], count[back]


def word_range(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> SMALL) * np.uint64(ranges) >> SMALL).astype(np.int64)


@lru_cache(maxsize=2)
def vocabulary(words: Words) -> Vocabulary:
    return Vocabulary(words)


class Scorer:
    def __init__(self, model: Model):
        folder, ranges = model.words.folder, len(model.words.sizes)
        self.model = model
        self.vocabulary = vocabulary(model.words)
        self.bounds = np.array(model.bounds, np.uint64)
        self.pairs = [load(f"{folder}/pairs-{i}.npy") for i in range(len(model.bounds))]
        self.counts = [load(f"{folder}/pair-counts-{i}.npy") for i in range(len(model.bounds))]
        self.backoff = [load(f"{folder}/backoff-{i}.npy") for i in range(ranges)]
        self.before = [load(f"{folder}/before-{i}.npy") for i in range(ranges)]
        self.sizes = model.words.sizes

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(keys, return_inverse=True)
        out = np.zeros(len(distinct), np.int64)
        cuts = np.concatenate([[0], np.searchsorted(distinct, self.bounds[1:]), [len(distinct)]])
        for i, part in enumerate(self.pairs):
            own = distinct[cuts[i] : cuts[i + 1]]
            if len(own) and len(part):
                at = np.minimum(np.searchsorted(part, own), len(part) - 1)
                out[cuts[i] : cuts[i + 1]] = np.where(part[at] == own, self.counts[i][at], 0)
        return out[back]

    def of_words(self, parts: list[np.ndarray], numbers: np.ndarray) -> np.ndarray:
        """Values of a per-word array; 0 for unknown words."""
        out = np.zeros(len(numbers))
        at = np.searchsorted(self.vocabulary.first, numbers, side="right") - 1
        for i, part in enumerate(parts):
            own = (at == i) & (numbers >= 0)
            if own.any():
                out[own] = part[numbers[own] - self.vocabulary.first[i]]
        return out

    def log10(self, first: np.ndarray, first_count: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Log probability of the word numbered ``second`` after ``first`` (-1: unknown)."""
        m = self.model
        kinds = self.of_words(self.before, second)
        low = np.maximum(kinds - _discounted(kinds, m.word_discounts), 0) / max(m.pair_kinds, 1) + m.rest / (m.words.kinds + 1)
        known = (first >= 0) & (second >= 0)
        count = np.zeros(len(first))
        count[known] = self.pair_counts((first[known].astype(np.uint64) << SMALL) | second[known].astype(np.uint64))
        seen = first_count > 0
        share = np.maximum(count - _discounted(count, m.discounts), 0) / np.where(seen, first_count, 1)
        return np.log10(np.where(seen, share + self.of_words(self.backoff, first) * low, low))


def _discounted(counts: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *discounts])[np.minimum(counts, 3).astype(np.int64)]


@lru_cache(maxsize=1)
def scorer(model: Model) -> Scorer:
    return Scorer(model)


def discounts(of: np.ndarray) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of things counted once, twice, three and four times.

    Where a number is zero, half of the count is discounted instead."""
    n1, n2, n3, n4 = (float(x) for x in of)
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = [k - (k + 1) * y * b / a if a and b else k / 2 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.05), k) for k, d in zip((1, 2, 3), raw))


# --- counting ----------------------------------------------------------------------------------

PACKED = "part long, keys binary, counts binary"


def _with_ends(sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of texts: their words and one end each; and the place of every end."""
    ends = np.cumsum(sizes + 1) - 1
    tokens = np.empty(len(hashes) + len(sizes), np.uint64)
    is_word = np.ones(len(tokens), bool)
    is_word[ends] = False
    tokens[is_word], tokens[ends] = hashes, END
    return tokens, ends


def _packed(keys: np.ndarray, counts: np.ndarray, part: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows of (part, keys, counts); ``keys`` ascend and ``part`` does not fall."""
    cuts = np.searchsorted(part, np.arange(parts + 1))
    used = [i for i in range(parts) if cuts[i] < cuts[i + 1]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(used, pa.int64()),
            pa.array([pack(keys[cuts[i] : cuts[i + 1]]) for i in used], pa.binary()),
            pa.array([pack_counts(counts[cuts[i] : cuts[i + 1]]) for i in used], pa.binary()),
        ],
        names=["part", "keys", "counts"],
    )


def _counting(keys_of, part_of, parts: int):
    """For the tasks: keys of all texts, added up, in rows of one part each."""

    def emit(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        return _packed(keys, counts, part_of(keys), parts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for _, _, sizes, hashes in grouped(batch.column("text").slice(start, 256).to_pylist()):
                    held.append(keys_of(sizes, hashes))
                    size += len(held[-1])
                    if size >= TOKENS_AT_ONCE:
                        yield emit(held)
                        held, size = [], 0
        if size:
            yield emit(held)

    return work


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = [unpack(k) for k in table["keys"].to_pylist()]
    counts = [unpack_counts(c) for c in table["counts"].to_pylist()]
    return summed(np.concatenate(keys), np.concatenate(counts))


def count_words(texts: DataFrame, folder: str, ranges: int) -> Words:
    """Count all tokens of ``texts`` (a column ``text``) into word files of ``folder``."""
    work = _counting(lambda sizes, hashes: _with_ends(sizes, hashes)[0], lambda keys: word_range(keys, ranges), ranges)

    def merge(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        keys, counts = _merged(table)
        save(f"{folder}/words-{part}.npy", keys)
        save(f"{folder}/counts-{part}.npy", counts)
        return pa.table({"part": [part], "kinds": [len(keys)], "tokens": [int(counts.sum())]})

    made = texts.mapInArrow(work, PACKED).groupBy("part").applyInArrow(merge, "part long, kinds long, tokens long").collect()
    for i in set(range(ranges)) - {r["part"] for r in made}:
        save(f"{folder}/words-{i}.npy", np.zeros(0, np.uint64))
        save(f"{folder}/counts-{i}.npy", np.zeros(0, np.uint64))
    sizes = dict((r["part"], r["kinds"]) for r in made)
    return Words(folder, tuple(sizes.get(i, 0) for i in range(ranges)), sum(r["tokens"] for r in made))


def pair_bounds(words: Words, ranges: int) -> tuple[int, ...]:
    """Lowest pair of each range. With ``f`` the share of all tokens up to a word, range ``r`` begins with the first
    word at which ``f`` passes ``r / ranges`` and, inside it, with the second word at the share left over."""
    total, out = max(words.tokens, 1), [0]
    counts = [load(f"{words.folder}/counts-{i}.npy") for i in range(len(words.sizes))]
    sums = np.cumsum([0, *(int(c.sum()) for c in counts)])
    first = np.cumsum([0, *words.sizes])

    def word_at(tokens: float) -> tuple[int, float]:
        """The word that the token numbered ``tokens`` belongs to, and the share of its tokens before that one."""
        i = min(int(np.searchsorted(sums, tokens, side="right")) - 1, len(counts) - 1)
        inside = np.cumsum(counts[i])
        k = min(int(np.searchsorted(inside, tokens - sums[i], side="right")), len(inside) - 1)
        return int(first[i]) + k, (tokens - sums[i] - (inside[k] - counts[i][k])) / float(counts[i][k])

    for r in range(1, ranges):
        word, share = word_at(r * total / ranges)
        second, _ = word_at(min(share, 1 - 1e-9) * total)
        key = (word << 32) | second
        if key > out[-1]:
            out.append(key)
    return tuple(out)


def train(texts: DataFrame, tokens_per_range: int = TOKENS_PER_RANGE) -> Model:
    """A model of the column ``text`` of ``texts``; an empty table gives a model without words."""
    spark = texts.sparkSession
    folder = session.scratch_path(spark, "llm-ngrams")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    words = count_words(texts, folder, max(4, size // (8 * tokens_per_range)))
    if words.kinds >= 1 << 32:
        raise OverflowError("a pair holds two numbers of words below 2 ** 32; train on fewer distinct tokens")
    ranges = len(words.sizes)
    bounds = pair_bounds(words, max(4, words.tokens // tokens_per_range)) if words.tokens else (0,)
    low = np.array(bounds, np.uint64)
    first = np.cumsum([0, *words.sizes])

    def pairs_of(sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        tokens, ends = _with_ends(sizes, hashes)
        number, _ = vocabulary(words).look_up(tokens)
        before = np.empty_like(number)
        before[1:] = number[:-1]
        if len(ends):
            before[0] = number[ends[0]]  # the end's number stands for the beginning
        return (before.astype(np.uint64) << SMALL) | number.astype(np.uint64)

    work = _counting(pairs_of, lambda keys: np.searchsorted(low, keys, side="right") - 1, len(bounds))

    def split(ids: np.ndarray, columns: list[np.ndarray], kind: str) -> list[tuple]:
        cuts = np.searchsorted(ids, first)
        return [
            (i, kind, pack(ids[cuts[i] : cuts[i + 1]]), *(pack_counts(c[cuts[i] : cuts[i + 1]]) for c in columns))
            for i in range(ranges)
            if cuts[i] < cuts[i + 1]
        ]

    def merge_pairs(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        keys, counts = _merged(table)
        save(f"{folder}/pairs-{part}.npy", keys)
        save(f"{folder}/pair-counts-{part}.npy", counts.astype(np.uint8 if counts.max() < 256 else np.uint64))
        ones = np.ones(len(keys), np.uint64)
        left, at = np.unique(keys >> SMALL, return_index=True)
        after = [np.add.reduceat((c).astype(np.uint64), at) for c in (counts == 1, counts == 2, counts >= 3)]
        right, kinds = summed(keys & np.uint64(0xFFFFFFFF), ones)
        none = np.zeros(len(right), np.uint64)
        rows = split(left, after, "after") + split(right, [kinds, none, none], "before")
        of = np.array([(counts == k).sum() for k in (1, 2, 3, 4)] + [len(keys)], np.uint64)
        rows.append((-1, str(part), pack_counts(of), b"", b"", b""))
        return pa.table(list(map(list, zip(*rows))), names=["part", "kind", "ids", "a", "b", "c"])

    schema = "part long, kind string, ids binary, a binary, b binary, c binary"
    made = stored(texts.mapInArrow(work, PACKED).groupBy("part").applyInArrow(merge_pairs, schema), "ngram-kinds")
    seen = {int(r["kind"]): unpack_counts(r["ids"]) for r in made.where("part = -1").collect()}  # five numbers per range
    for i in set(range(len(bounds))) - set(seen):
        save(f"{folder}/pairs-{i}.npy", np.zeros(0, np.uint64))
        save(f"{folder}/pair-counts-{i}.npy", np.zeros(0, np.uint8))
    total = np.sum(list(seen.values()), axis=0) if seen else np.zeros(5)
    d = discounts(total[:4])

    def merge_kinds(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        after, before = np.zeros((3, words.sizes[part])), np.zeros(words.sizes[part], np.uint32)
        for kind, ids, *columns in zip(*(table[c].to_pylist() for c in ("kind", "ids", "a", "b", "c"))):
            at = (unpack(ids) - np.uint64(first[part])).astype(np.int64)
            if kind == "after":
                for k, column in enumerate(columns):
                    after[k, at] += unpack_counts(column)
            else:
                before[at] += unpack_counts(columns[0]).astype(np.uint32)
        counts = load(f"{folder}/counts-{part}.npy")
        save(f"{folder}/backoff-{part}.npy", (np.array(d) @ after) / counts)
        save(f"{folder}/before-{part}.npy", before)
        return pa.table({"part": [part], **{f"n{k}": [int((before == k).sum())] for k in (1, 2, 3, 4)}, "more": [int((before >= 3).sum())]})

    kinds = made.where("part >= 0").groupBy("part").applyInArrow(merge_kinds, "part long, n1 long, n2 long, n3 long, n4 long, more long").collect()
    for i in range(ranges):
        if not words.sizes[i]:
            save(f"{folder}/backoff-{i}.npy", np.zeros(0))
            save(f"{folder}/before-{i}.npy", np.zeros(0, np.uint32))
    of = [sum(r[f"n{k}"] for r in kinds) for k in (1, 2, 3, 4)]
    e = discounts(of)
    more = sum(r["more"] for r in kinds)
    pair_kinds = int(total[4])
    rest = (e[0] * of[0] + e[1] * of[1] + e[2] * more) / pair_kinds if pair_kinds else 1.0
    return Model(words, bounds, d, e, pair_kinds, rest)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Scores are log10 probabilities of the whole text with its end; a null text counts as empty and has the end only.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = dict(docs.dtypes)[id_col]
    total, kinds = model.words.tokens, model.words.kinds

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = scorer(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                for low, high, sizes, hashes in grouped(part.column("text").to_pylist()):
                    tokens, ends = _with_ends(sizes, hashes)
                    number, count = known.vocabulary.look_up(tokens)
                    before, before_count = np.roll(number, 1), np.roll(count, 1)
                    firsts = np.concatenate([[0], ends[:-1] + 1])
                    base = np.log10((count + ADD) / (total + ADD * (kinds + 1)))
                    own = known.log10(before, before_count, number)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("id").slice(low, high - low),
                            pa.array(sizes + 1, pa.int64()),
                            pa.array(np.add.reduceat((count > 0).astype(np.int64), firsts), pa.int64()),
                            pa.array(np.add.reduceat(base, firsts)),
                            pa.array(np.add.reduceat(own, firsts)),
                        ],
                        names=["id", "n_tokens", "n_known", "base_score", "score"],
                    )

    out = rows.mapInArrow(scored, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select(
        F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"
    )


def held_out_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all documents by a model of those outside the held-out tenth."""
    texts = docs.where(~fold(id_col, 10)).select(text_of(text_col).alias("text"))
    found = score(docs, train(texts), id_col, text_col)
    return found.select(id_col, fold(id_col, 10).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
