"""Repeated passages and the FM-index beside brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from text_fixtures import documents  # noqa: F401
from fleetfit.llm import fm_index, substring_dedup, wordhash


def brute(rows, words):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, t in texts:
        if i is not None:
            for k in range(len(t) - words + 1):
                key = tuple(t[k : k + words])
                least[key] = min(i, least.get(key, i))
    out = Counter()
    for i, t in texts:
        gone = set()
        for k in range(len(t) - words + 1):
            if i is not None and least[tuple(t[k : k + words])] < i:
                gone.update(range(k, k + words))
        out[i, len(t), len(gone), " ".join(w for k, w in enumerate(t) if k not in gone)] += 1
    return out


def prose(count, length=30):
    return " ".join(f"w{int(random.paretovariate(0.6)) % 5000}" for _ in range(random.randrange(count, count + length)))


def corpus():
    """Passages in changing surroundings, copies, near copies, periods, and rows of every odd kind."""
    random.seed(11)
    passage, line, page = prose(25), "accept all cookies and go on to the site now please dear reader of ours", prose(200)
    rows = [(i, prose(10, 90)) for i in range(60)]
    rows += [(100 + i, f"{prose(5)} {passage} {prose(5)}") for i in range(40)]
    rows += [(200 + i, page) for i in range(30)]
    rows += [(300 + i, page.replace(" ", f" x{i} ", 1) if i % 2 else page[: -i or None] + f" {i}") for i in range(30)]
    rows += [(400 + i, "\n".join([line] * (i + 1))) for i in range(6)]
    rows += [(500, "a " * 300), (499, "a " * 100), (498, "a b " * 50), (497, "b a " * 60)]
    rows += [(600, None), (601, ""), (602, " \t"), (None, page), (None, passage), (200, passage), (200, page), (-5, page + " negative id")]
    rows += [(700, "é😀\xa0z " * 20), (701, "É😀\xa0z " * 20), (702, "é😀\xa0z " * 9), (703, page.upper())]
    random.shuffle(rows)
    return rows


def same(found, rows, words):
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found.collect()) == brute(rows, words)


@pytest.mark.parametrize("hot", [None, "copies", "various"])
def test_repeats(documents, monkeypatch, hot):
    """All anchors usual; copies of hot anchors joined by Spark; windows of hot anchors dealt one by one."""
    if hot:
        monkeypatch.setattr(substring_dedup, "HOT_SEGMENTS", 5)
    if hot == "various":
        monkeypatch.setattr(substring_dedup, "HOT_WORDS", 60)
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", 2500)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 700)
    rows = corpus()
    same(substring_dedup.without_repeats(documents(rows).repartition(4)), rows, 13)


def test_other_lengths(documents):
    rows = corpus()[:120]
    for words in (1, 3, 4, 7):
        same(substring_dedup.without_repeats(documents(rows), words=words), rows, words)


def test_nothing_to_do(documents):
    assert substring_dedup.without_repeats(documents([])).collect() == []
    rows = [(1, None), (2, "few words"), (3, "few words")]
    same(substring_dedup.without_repeats(documents(rows)), rows, 13)


def test_words_of_a_shard_are_hashed_together(monkeypatch):
    """A shard gets as many texts as there were batches, each of few words: they are not hashed one by one."""
    random.seed(3)
    calls, one = [], wordhash.located
    texts = [(" ".join([prose(20)] * (1 + i % 3))).encode() for i in range(50)]
    made = substring_dedup.batches_of([pa.RecordBatch.from_pydict({"id": [i], "row": [i], "text": [t.decode()]}) for i, t in enumerate(texts)], 13, 1)
    places = substring_dedup.Places((bytes(1 << 24), bytes(1 << 24)))
    sent = pa.Table.from_batches([substring_dedup.send(batch, places, 13, 1) for batch in made])
    assert sent.num_rows == 50
    for module in (wordhash, substring_dedup):
        monkeypatch.setattr(module, "located", lambda data: calls.append(data) or one(data))
    assert len(substring_dedup.Shard(sent, 13).windows) and len(calls) == 1


def test_segments(monkeypatch):
    """Every window is in one segment, whose windows share the least hash of four words; long segments are cut."""
    monkeypatch.setattr(substring_dedup, "MOST_WINDOWS", 5)
    random.seed(2)
    sizes = np.array([0, 40, 12, 13, 0, 100])
    hashes = np.array([random.choice([1, 2, 3, 4]) * (i % 60 > 30) + 7 for i in range(sizes.sum())], np.uint64)
    four, _ = substring_dedup.run_hashes(hashes, 13)
    found = substring_dedup.cut(four, sizes, 13)
    before = np.cumsum(sizes) - sizes
    windows = []
    for start, n, anchor, text, place in zip(*(c.tolist() for c in found)):
        assert 1 <= n <= 5 and start == before[text] + place
        windows += range(start, start + n)
        assert {int(four[k : k + 10].min()) for k in range(start, start + n)} == {anchor}
    assert windows == [b + k for b, s in zip(before.tolist(), sizes.tolist()) for k in range(s - 12)]


def test_run_hashes():
    values = np.random.default_rng(1).integers(7, 10, 500).astype(np.uint64)
    for size in (1, 2, 4, 5, 8, 13):
        seen = {}
        short, runs = substring_dedup.run_hashes(values, size)
        assert len(runs) == 501 - size and len(short) == 501 - min(size, 4)
        for n, found in ((min(size, 4), short), (size, runs)):
            for k, h in enumerate(found.tolist()):
                assert seen.setdefault((n, *values[k : k + n].tolist()), h) == h
        assert len(set(seen.values())) == len(seen) or size <= 4
        assert substring_dedup.run_least(values, size).tolist() == [values[k : k + size].min() for k in range(501 - size)]
    assert [len(r) for r in substring_dedup.run_hashes(values[:3], 4)] == [0, 0]


@pytest.mark.parametrize("n, kinds", [(1, 1), (2, 1), (60, 2), (400, 7), (3000, 400)])
def test_index(n, kinds):
    """Ranks of the wavelet tree, and ranges of all patterns, beside counting."""
    raw = np.minimum(np.random.default_rng(n).zipf(1.3, n), kinds)
    raw[n // 2] = raw[-1] = kinds + 1  # ends, in no pattern
    _, codes, counts = np.unique(raw, return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    sequence, end = rank[codes], rank[codes[-1]]
    symbols, places = np.sort(np.tile(sequence, 2))[::-1], np.random.default_rng(0).integers(0, n + 1, 2 * n)
    tree = fm_index.WaveletTree(sequence)
    assert tree.rank(symbols, places).tolist() == [int((sequence[:p] == s).sum()) for s, p in zip(symbols, places)]
    index = fm_index.FMIndex(sequence, 13)
    for length in (1, 2, 13):
        ends = np.array([e for e in range(length - 1, n) if end not in sequence[e - length + 1 : e + 1]], np.int64)
        matched, low, high = index.matching(sequence, ends, length, lambda a, b: np.zeros(len(a), bool))
        assert (matched == length).all()
        count = Counter(tuple(sequence[k : k + length].tolist()) for k in range(n - length + 1))
        for e, a, b in zip(ends.tolist(), low.tolist(), high.tolist()):
            pattern = tuple(sequence[e - length + 1 : e + 1].tolist())
            assert b - a == count[pattern]
            assert all(tuple(sequence[s : s + length].tolist()) == pattern for s in index.order[a:b])


def test_rank_of_both_ends(monkeypatch):
    """Both ends of all ranges are ranked in one go, and none for the first symbol."""
    random.seed(9)
    sequence = np.array(sorted(random.choices(range(9), [2.0**-k for k in range(9)], k=500), key=lambda x: random.random()) + list(range(9)))
    sequence = np.argsort(np.argsort(-np.bincount(sequence), kind="stable"))[sequence]
    tree = fm_index.WaveletTree(sequence)
    symbols, places = np.sort(sequence)[::-1], np.random.default_rng(0).integers(0, len(sequence) + 1, (2, len(sequence)))
    assert tree.rank(symbols, places).tolist() == [tree.rank(symbols, p).tolist() for p in places]
    index, calls, one = fm_index.FMIndex(sequence, 4), [], fm_index.WaveletTree.rank
    monkeypatch.setattr(fm_index.WaveletTree, "rank", lambda *a: calls.append(a) or one(*a))
    index.matching(sequence, np.arange(3, len(sequence)), 4, lambda a, b: np.zeros(len(a), bool))
    assert len(calls) == 3


def test_matching_statistics_of_another_text():
    """What matches of a text that is not in the index, up to the first symbol that does not."""
    sequence = np.array([1, 2, 1, 2, 1, 3, 0], np.int64)
    counts = np.bincount(sequence)
    number = np.empty(4, np.int64)
    number[np.argsort(-counts, kind="stable")] = np.arange(4)
    index = fm_index.FMIndex(number[sequence], 4)
    other = number[np.array([3, 2, 1, 2, 2, 1, 3])]
    matched, _, _ = index.matching(other, np.array([3, 6]), 4, lambda a, b: np.zeros(len(a), bool))
    assert matched.tolist() == [3, 3]


def test_wavelet_tree_is_compressed():
    """A skewed sequence takes little more than its entropy, not the logarithm of the number of symbols."""
    counts = np.array([1 << 16] + [1] * 4096)
    sequence = np.random.default_rng(0).permutation(np.repeat(np.arange(len(counts)), counts))
    share = counts / counts.sum()
    entropy = float(-(share * np.log2(share)).sum() * len(sequence))
    bits = sum(8 * (level[0].nbytes + level[1].nbytes) for level in fm_index.WaveletTree(sequence).levels)
    assert bits < 3 * entropy < 0.3 * 12 * len(sequence)
