"""Token alignment beside encoding whole texts with the libraries, and perfect hashing."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from text_fixtures import documents  # noqa: F401
from conftest import TESTDATA
from fleetfit.llm import perfect_hash, queries, token_alignment
from fleetfit.llm.queries import BYTE_LEVEL, PIECES
from tokenizers import Tokenizer, pre_tokenizers

PATHS = public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def letters():
    """Byte of every letter of tokenizer A, found from the library's own cut of characters with all leading bytes."""
    cut, out = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), {}
    for c in [*range(0x800), *range(0x800, 0xD800, 0x400), *range(0xE000, 0x110000, 0x400)]:
        out.update(zip(cut.pre_tokenize_str(chr(c))[0][0], chr(c).encode()))
    return out


def brute(rows, libraries):
    """Expected rows, by whole texts, all pairs of each group, and a count per pair."""
    a, b = libraries
    byte = letters()
    docs, counts = [], Counter()
    for i, text in rows:
        links, groups, n_a, n_b = [], [], 0, 0
        if text:
            whole = (" " + text).encode()
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            parts_a = [bytes(byte.get(c, 0) for c in a.id_to_token(x)) for x in ids_a]
            parts_b = [
                bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids_b
            ]
            if b"".join(parts_a) == whole and b"".join(parts_b) == whole:
                n_a, n_b = len(ids_a), len(ids_b)
                ends_a, ends_b = np.cumsum([len(p) for p in parts_a]), np.cumsum([len(p) for p in parts_b])
                cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
                in_a, in_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
                of_a, of_b = defaultdict(list), defaultdict(list)
                for g, x in zip(in_a.tolist(), ids_a):
                    of_a[g].append(x)
                for g, x in zip(in_b.tolist(), ids_b):
                    of_b[g].append(x)
                groups = [(of_a[g], of_b[g]) for g in range(len(cuts))]
                links = [(x, y) for p, q in groups for x in p for y in q]
        counts.update(set(links))
        docs.append((i, n_a, n_b, groups, links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    for i, n_a, n_b, groups, links in docs:
        shown = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        yield (
            i, n_a, n_b, len(groups), len(links), sum(counts[k] == best[k[0]] for k in links), sum(counts[k] for k in links),
            hashlib.sha256(shown.encode()).hexdigest() if groups else "",
        )


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def same(found, rows, libraries):
    assert found.columns == COLUMNS
    assert Counter(tuple(r) for r in found.collect()) == Counter(brute(rows, libraries))


def test_given_documents(spark, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").select("doc_id", "text").collect()]
    same(queries.QUERIES["op12_token_alignment"](spark, TESTDATA), rows, libraries)


def odd_texts(count):
    random.seed(5)
    alphabet = list("aZ 0.,'’\n\t\r\x0b\x1c\x85\xa0é ﬁ▁中文字ิ́😀  <>|_ ") + ["<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "it's ", " the", "  ", "　", " ", "word "]
    return ["".join(random.choices(alphabet, k=random.randint(1, 40))) for _ in range(count)]


def test_odd_texts(documents, libraries):
    rows = [(1, None), (2, ""), (3, " "), (4, "a "), (5, "  a"), (6, "▁a"), (7, "a\x00b"), (8, "same text"), (8, "same text"), (None, "same"), (9, "x" * 5000)]
    rows += [(100 + i, t) for i, t in enumerate(odd_texts(600))]
    same(token_alignment.aligned(documents(rows), *PATHS), rows, libraries)


def test_sums_in_pieces(documents, libraries, monkeypatch):
    """Counts that are given on in pieces, many parts and tasks: one result."""
    random.seed(6)
    words = ["alpha", "beta,", "Gamma", "naïve", "\ndelta", "x1", "  ", "日本語", "end."]
    rows = [(i, " ".join(random.choices(words, k=random.choice([3, 40, 3000])))) for i in range(60)]
    for name, value in (("HELD", 20), ("BYTES_PER_PART", 1000)):
        monkeypatch.setattr(token_alignment, name, value)
    same(token_alignment.aligned(documents(rows).repartition(3), *PATHS), rows, libraries)


def test_small_caches_and_slices(libraries, monkeypatch):
    """Long texts in slices and a cache that overflows give what whole texts give."""
    monkeypatch.setattr(token_alignment, "SLICE", 30)
    monkeypatch.setattr(token_alignment, "CACHE_BYTES", 3000)
    known, cleared = token_alignment.Encoder(token_alignment.read_tokenizers(*PATHS)), 0
    for text in [" ".join(odd_texts(20)[i:]) for i in range(20)] + ["plain words only " * 30, "中文字 " * 50, *odd_texts(300)]:
        cleared += known.held > 3000
        found = known.encode(text)
        a, b = libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text)
        if next(brute([(0, text)], libraries))[-1]:
            assert [np.frombuffer(f, token_alignment.ID).tolist() for f in found] == [a, b]
        else:
            assert found == (b"", b"")
    assert cleared and known.encode(None) == known.encode("") == (b"", b"")


def test_documents_of_a_slab_are_encoded_together(libraries, monkeypatch):
    """Stretches of all documents of a slab are looked up once and encoded as few texts; uneven and long texts among them."""
    known, calls = token_alignment.Encoder(token_alignment.read_tokenizers(*PATHS)), []
    whole = known.whole
    monkeypatch.setattr(known, "whole", lambda text: calls.append(text) or whole(text))
    texts = [f"word{i % 50} of document {i}, and others." for i in range(400)]
    found = known.encode_all(texts)
    assert len(calls) <= 1 + len(known.known) // token_alignment.TOGETHER
    monkeypatch.setattr(token_alignment, "SLICE", 200)
    texts += [None, "", "two  spaces ", "plain words only " * 30, *odd_texts(300)]
    found += known.encode_all(texts[400:])
    for text, ids in zip(texts, found):
        a, b = (libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text)) if text else ([], [])
        if not next(brute([(0, text)], libraries))[-1]:
            a, b = [], []
        assert [np.frombuffer(f, token_alignment.ID).tolist() for f in ids] == [a, b]


def test_full_cache_keeps_common_stretches(monkeypatch):
    monkeypatch.setattr(token_alignment, "CACHE_BYTES", 30_000)
    known = token_alignment.Encoder(token_alignment.read_tokenizers(*PATHS))
    common = [f"common{i}" for i in range(20)]
    for n in range(60):
        known.encode_all([" ".join([*common, *(f"rare{n}x{i}" for i in range(20))])])
        assert n < 2 or set(common) <= set(known.known)
    assert len(known.known) < 200


def test_large_groups(monkeypatch):
    """Groups whose different ids are paired have the links of all their tokens."""
    lengths = token_alignment.Lengths(np.array([1, 3, 5]), np.array([2, 7]))
    a, b = [np.array([2, 1, 2], np.uint16)], [np.array([0, 1, 0, 0], np.uint16)]
    small = token_alignment.align(a, b, lengths)
    monkeypatch.setattr(token_alignment, "LARGE_GROUP", 1)
    large = token_alignment.align(a, b, lengths)
    total = lambda links: sum((Counter({int(k): int(n)}) for k, n in zip(links.key, links.times)), Counter())
    assert total(small) == total(large) and large.times.max() == 6


def test_slabs(monkeypatch):
    monkeypatch.setattr(token_alignment, "SLAB_ROWS", 3)
    monkeypatch.setattr(token_alignment, "SLAB_BYTES", 10)
    texts = ["a", "b", "c", "d", "x" * 50, None, "yyyyyy", "zzzzzz", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    slabs = [s.column("text").to_pylist() for s in token_alignment._slabs([batch], "text")]
    assert sum(slabs, []) == texts and slabs == [["a", "b", "c"], ["d"], ["x" * 50], [None, "yyyyyy"], ["zzzzzz", ""]]


def test_no_documents(documents):
    assert token_alignment.aligned(documents([]), *PATHS).collect() == []
    assert token_alignment.aligned(documents([(1, None)]), *PATHS).first()["n_links"] == 0


def test_stretches_give_the_text_back():
    for text in odd_texts(500):
        found = list(token_alignment.stretches(text))
        assert "".join(found) == " " + text and all(s.startswith(" ") for s in found)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(1 << 31, n, replace=False).astype(np.uint64)
    known = perfect_hash.PerfectHash(perfect_hash.build(keys))
    assert known.kinds == n and np.array_equal(np.sort(known.numbers(keys)), np.arange(n))
    other = np.setdiff1d(np.arange(1000, dtype=np.uint64), keys)
    assert known.numbers(other).max(initial=-1) < max(n, 1)


def test_perfect_hash_refuses_repeated_keys():
    with pytest.raises(ValueError):
        perfect_hash.build(np.array([5, 5], np.uint64))
