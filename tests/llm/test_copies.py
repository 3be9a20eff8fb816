"""Exact and near copies beside brute force."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from text_fixtures import documents  # noqa: F401
from fleetfit import session
from fleetfit.llm import components as connected
from fleetfit.llm import exact_dedup, jaccard_join, syncmers
from fleetfit.llm.common import stored
from pyspark.sql import functions as F

ODD = [(900, None), (901, ""), (902, "a b"), (903, "A B"), (904, "a"), (905, " \n"), (906, "x y z q"), (906, "x y z q"), (None, "x y z Q")]


def copies():
    long = "é😀 word\n" * 3000
    return ODD + [(1, long), (2, long), (3, long + "!"), (4, long[:-1]), (None, "a"), *[(10 + i, "same text") for i in range(40)]]


def test_unlike_words_of_one_pattern(documents):
    """Two long words that differ in every letter, with equal polynomials modulo 2 ** 64, are not linked."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    found = jaccard_join.jaccard_components(documents([(1, f"{word} x y"), (2, f"{other} x y"), (3, f"{word} x y")]))
    assert {r.doc_id: r.component_id for r in found.collect()} == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("hot", [1, 200])
def test_equal_texts(documents, monkeypatch, hot):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", hot)
    rows = copies()
    found = exact_dedup.exact_duplicates(documents(rows), block_chars=64).collect()
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == Counter(
        (i, max((m for m in groups[t or ""] if m is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())
        for i, t in rows
    )
    assert sum(r.kept for r in found) == len(groups)
    kept = exact_dedup.drop_duplicates(documents(rows))
    assert kept.columns == documents(rows).columns and kept.count() == len(groups)
    assert {r.text or "" for r in kept.collect()} == set(groups)


def test_no_rows(documents):
    empty = documents(ODD).limit(0)
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert syncmers.edited_likeness(empty).count() == 0


def near_copies():
    random.seed(2)
    words = [f"w{i}" for i in range(300)]
    rows = list(ODD)
    for _ in range(4):
        base = [random.choice(words) for _ in range(random.randrange(30, 70))]
        for _ in range(25):
            text = list(base)
            for _ in range(random.randrange(0, 3)):
                text[random.randrange(len(text))] = random.choice(words)
            rows.append((len(rows), " ".join(text)))
    return rows


def components(rows, k, num, den):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label, links = list(range(len(rows))), [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                label = [label[b] if x == label[a] else x for x in label]
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[label[i]].append(doc)
    return Counter(
        (doc, len(sets[i]), min((d for d in least[label[i]] if d is not None), default=None) if sets[i] else doc, links[i])
        for i, (doc, _) in enumerate(rows)
    )


@pytest.mark.parametrize("usual, block, rule", [(30, 256, (3, 90, 100)), (2, 4, (5, 80, 100))])
def test_jaccard_components(documents, monkeypatch, usual, block, rule):
    """Both ways, by pairs and by blocks of hot groups, give what comparing all pairs gives."""
    monkeypatch.setattr(jaccard_join, "USUAL", usual)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_copies()
    found = jaccard_join.jaccard_components(documents(rows), *rule).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in found) == components(rows, *rule)


def test_stored_tables_leave_no_shuffle(spark, documents):
    """The files of a step's shuffles go when the step is stored, not when the driver collects its garbage."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {name for name in map(str, disk.getAllFiles().mkString("|").split("|")) if name.endswith(".data")}
    before, setting = shuffles(), spark.conf.get(session.CLEANUP, None)
    found = stored(documents(near_copies()).groupBy("text").count().join(documents(ODD).hint("merge"), "text"), "test")
    assert found.count() > 0 and spark.conf.get(session.CLEANUP, None) == setting
    for _ in range(50):  # they are removed in the background
        left = shuffles() - before
        if len(left) <= 1:  # that of the count above may stay
            break
        time.sleep(0.1)
    assert len(left) <= 1


def test_late_shingles_make_no_candidates(spark):
    """Of 100 shingles 89 must be shared: a first common one at place 15 is too late, one at place 5 is not."""
    rule = jaccard_join.Rule(5, 80, 100)
    rows = spark.createDataFrame([(1, 100, 7, 15), (2, 100, 7, 3), (3, 100, 8, 11), (4, 100, 8, 5)], "cid long, n int, shingle long, place long")
    pairs = jaccard_join.candidate_pairs(rows, spark.createDataFrame([], "cid long, hot long"), rule)
    assert [(r.a, r.b) for r in pairs.collect()] == [(3, 4)]


def test_blocks_of_long_documents(spark, documents, monkeypatch):
    """A block is bounded by shingles too, and more blocks give the same links."""
    members = spark.createDataFrame([(1, 7, 1_000_000)] * 40 + [(2, 7, 400)] * 300, "hot long, band int, n int")
    found = {r.hot: r.blocks for r in jaccard_join.block_counts(members).collect()}
    assert 40 * 1_000_000 / found[1] <= 1 << 22 and found[2] == 2
    monkeypatch.setattr(jaccard_join, "USUAL", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 200)
    rows = near_copies()
    got = jaccard_join.jaccard_components(documents(rows), 5, 80, 100).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == components(rows, 5, 80, 100)


def test_one_of_each_group_stays(documents):
    rows = near_copies()
    kept = jaccard_join.one_of_each(documents(rows))
    assert kept.columns == documents(rows).columns
    expected = {doc for doc, _, label, _ in components(rows, 5, 80, 100) if doc == label}
    assert {r.doc_id for r in kept.collect()} == expected


def test_bitmaps_never_differ_more_than_sets():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(100):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, rng.integers(0, 40), dtype=np.uint64)]))
        if len(b):
            assert jaccard_join.differing(jaccard_join.parity(a), jaccard_join.parity(b)) <= len(np.setxor1d(a, b))


def test_closed_syncmers(spark):
    """Anchors are the runs whose least inner hash stands at an edge, wherever the passage stands."""
    random.seed(4)
    passage = " ".join(random.choice("abcdefgh") * random.randrange(1, 5) for _ in range(80))
    frame = spark.createDataFrame([(1, passage), (2, "other words come first here " + passage)], "doc_id long, text string")
    first, second = syncmers.fingerprints(frame).orderBy("doc_id").collect()
    shifted = {(a.pos + 5, a.hash) for a in first.anchors}
    assert shifted <= {(a.pos, a.hash) for a in second.anchors} and len(shifted) > 5
    words = passage.split()
    runs = spark.createDataFrame([(i, *words[i : i + 3]) for i in range(len(words) - 2)], "i int, a string, b string, c string")
    g = [r.h for r in runs.select("i", F.xxhash64("a", "b", "c").alias("h")).orderBy("i").collect()]
    inner = syncmers.OUTER - syncmers.INNER
    chosen = [i for i in range(len(words) - syncmers.OUTER + 1) if min(g[i : i + inner + 1]) in (g[i], g[i + inner])]
    assert [a.pos for a in first.anchors] == chosen


def test_every_word_of_an_anchor_is_in_its_hash(spark):
    """Anchors of edited texts that stay at their place have another hash if the edit is within them, and only then."""
    random.seed(6)
    words = [f"w{random.randrange(1000)}" for _ in range(40)]
    rows = [(i, " ".join([*words[:i], "edited", *words[i + 1 :]])) for i in range(40)]
    frame = spark.createDataFrame([*rows, (99, " ".join(words))], "doc_id long, text string")
    found = {r.doc_id: {a.pos: a.hash for a in r.anchors} for r in syncmers.fingerprints(frame).collect()}
    own, inside = found.pop(99), set()
    for i, anchors in found.items():
        for pos in own.keys() & anchors.keys():
            within = pos <= i < pos + syncmers.OUTER
            assert (own[pos] != anchors[pos]) == within, (pos, i)
            inside |= {i - pos} if within else set()
    assert inside == set(range(syncmers.OUTER))


def test_texts_without_spaces_and_short_texts(spark):
    """What stands before a passage does not change its anchors, and one edit leaves something in common."""
    random.seed(12)
    pairs = []
    for letters, size in (("的一是不了人我在有他这为之大来以个中上们", 4000), ("abcdefghijklmnopqrstuvwxyz0123456789+/", 4000), ("กขคงจฉชซ", 200), ("的一是不了人我在有他", 30)):
        text = "".join(random.choice(letters) for _ in range(size))
        pairs.append((text, random.choice(letters) + text, 0.8))
    for n in range(6, 50):
        words = [f"w{random.randrange(1000)}" for _ in range(n)]
        pairs.append((" ".join(words), " ".join([*words[:-1], "edited"]), 0.01))
        pairs.append((" ".join(words), " ".join(words[:-1]), 0.01))
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string, least double")
    found = frame.select("i", "least", *[syncmers.hashes(syncmers.anchors(F.col(c))).alias(c) for c in "ab"])
    low = found.select("i", "least", syncmers.likeness(F.col("a"), F.col("b")).alias("near")).where("near < least").collect()
    assert not low


def test_edited_texts(documents):
    rows = ODD[:8] + [(None, "word " * 30), (7, "déjà vu 😀 " * 40), (8, "one two three " * 20)]
    found = syncmers.edited_likeness(documents(rows)).collect()
    assert len(found) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault((i is not None, i or 0), t or "")
    keys = sorted(texts)
    for k, key in enumerate(keys):
        text, after = texts[key], texts[keys[(k + 1) % len(keys)]]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        for r in (r for r in found if r.doc_id == (key[1] if key[0] else None)):
            assert r.n_chars == len(text)
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            assert edited != text or r.near_edited == 1
    # The two texts without words have the same, empty fingerprint.
    assert {r.fingerprint for r in found if r.doc_id in (900, 901)} == {""}


@pytest.mark.parametrize("tasks", [1, 6])
def test_connected_components(spark, tasks):
    """Chains, stars and cycles, contracted in one task or in several."""
    random.seed(9)
    nodes = random.sample(range(10**12), 400)
    edges = [(nodes[i], nodes[i + 1]) for i in range(0, 120)] + [(nodes[150], n) for n in nodes[151:260]]
    edges += [(a, b) for a, b in zip(nodes[300:340], nodes[301:340] + [nodes[300]])] + [(nodes[399], nodes[399])]
    random.shuffle(edges)
    table = spark.createDataFrame(edges + edges[:50], "u long, v long").repartition(6)
    found = {r.node: r.label for r in connected.components(table, -(-table.count() // tasks)).collect()}
    parts = [nodes[:121], nodes[150:260], nodes[300:340]]
    assert found == {n: min(p) for p in parts for n in p}
