"""Toxicity by a weighted finite-state grammar over clauses.

Insults are words or word beginnings learned from labelled documents: those that are far more frequent in toxic ones, by
a log-likelihood ratio that allows for the number of candidates, and that stand after several different words, the
commonest of which does not stand before nearly all of them (so that a passage repeated in copies of one toxic document
does not count, while the size of the sample has no say). Small transducers each follow one thing along a clause
(negation, reported speech, target, threat); their composition marks every insult with what governs it. A clause adds the
weight of its marked insults and threats to the document's sums, and a logistic model turns these into a score. Its
weights are learned too, from given starting values, so that a construction without examples keeps its starting value.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetfit.llm.common import fold, stored, text_of

#: Most labelled documents that lexicon and model are fitted on, chosen by a hash of their id.
FIT_DOCUMENTS = 20_000
SHORTEST, LONGEST = 3, 10
MIN_DOCS, MIN_SHARE = 3, 0.003
MIN_WEIGHT = 3.0
#: Different words before an insult, and the share of its documents after any but the commonest of these.
MIN_BEFORE, MIN_OTHER = 3, 0.25
#: Words kept per worker before the cache is started anew.
CACHE_WORDS = 200_000

# Closed word classes in the four languages of the corpus, and insults known beforehand.
SEEDS = "idiot moron imbecile scum loser stupid pathetic worthless disgusting trash clown".split()
SEED_DOCS = 3
NEGATION = frozenset("not no never neither nor without isn't aren't wasn't don't nicht kein keine nie pas jamais aucun nunca jamás sin".split())
REPORT = frozenset(
    "said says say wrote writes called calls claimed claims quoted quote allegedly reportedly sagte sagt schrieb nannte "
    "angeblich dit écrit déclaré appelé dijo dice escribió llamó".split()
)
TARGET = frozenset("you your yours you're he she they them him du dich dir ihr euch tu te toi vous tú te ti usted ustedes".split())
THREAT = frozenset("kill murder hurt destroy shoot stab strangle töten umbringen erschießen tuer frapper matar golpear".split())
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?;:\n]|[\"“”„«»]")

#: What follows a negation within so many words is negated; report holds until the end of the clause.
NEGATION_SPAN = 3


class Transducer(NamedTuple):
    """Reads symbols and writes one mark for each: ``step(state, symbol) -> (state, mark)``."""

    start: object
    step: Callable[[object, str], tuple[object, object]]


def _negation(left: int, symbol: str) -> tuple[int, bool]:
    if symbol == "negation":
        return NEGATION_SPAN, False
    if symbol == "boundary":
        return 0, False
    return max(0, left - 1), left > 0


def _report(state: tuple[bool, bool], symbol: str) -> tuple[tuple[bool, bool], bool]:
    said, quoted = state
    if symbol == "report":
        said = True
    elif symbol == "quote":
        quoted = not quoted
    elif symbol == "boundary":
        said = False
    return (said, quoted), said or quoted


def _target(seen: bool, symbol: str) -> tuple[bool, bool]:
    if symbol == "boundary":
        return False, False
    seen = seen or symbol == "target"
    return seen, seen


def _threat(open_: bool, symbol: str) -> tuple[bool, bool]:
    """A threat is a verb of violence followed by its target in the same clause."""
    if symbol == "threat":
        return True, False
    if symbol == "boundary":
        return False, False
    return (False, True) if open_ and symbol == "target" else (open_, False)


def compose(*parts: Transducer) -> Transducer:
    """The parts run side by side: states and marks are tuples."""
    memory: dict = {}

    def step(states, symbol):
        known = memory.get((states, symbol))
        if known is None:
            moves = [p.step(s, symbol) for p, s in zip(parts, states)]
            known = memory[states, symbol] = tuple(m[0] for m in moves), tuple(m[1] for m in moves)
        return known

    return Transducer(tuple(p.start for p in parts), step)


GRAMMAR = compose(
    Transducer(0, _negation), Transducer((False, False), _report), Transducer(False, _target), Transducer(False, _threat)
)
CLOSED = {
    **dict.fromkeys(NEGATION, "negation"), **dict.fromkeys(REPORT, "report"),
    **dict.fromkeys(TARGET, "target"), **dict.fromkeys(THREAT, "threat"),
}

#: The model's inputs, and the starting values of its weights: constant, then sums over clauses.
FEATURES = ("constant", "insult", "targeted", "negated", "reported", "threat", "clauses")
START = np.array([-4.0, 1.5, 0.5, 0.7, 0.5, 2.0, 1.0])


class Lexicon(dict):
    """Word -> weight; words are looked up by their beginnings once and kept."""

    def __init__(self, entries: dict[str, float]):
        super().__init__()
        self.entries = entries

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ends = [word + "$", *(word[:n] for n in range(min(len(word), LONGEST), SHORTEST - 1, -1))]
        value = self[word] = next((self.entries[e] for e in ends if e in self.entries), 0.0)
        return value

    def __reduce__(self):
        return Lexicon, (self.entries,)


def sums(text: str, lexicon: Lexicon) -> list[float]:
    """The model's inputs for a text: logarithms of the marked weights over all clauses."""
    lowered = text.lower()
    words = WORD.findall(lowered)
    found = {w for w in set(words) if lexicon[w]}
    if not found and THREAT.isdisjoint(words):
        return [1.0] + [0.0] * (len(FEATURES) - 1)
    plain = targeted = negated = reported = threats = 0.0
    clauses, hit = 0, False
    state = GRAMMAR.start
    for token in TOKEN.findall(lowered):
        if token in ".!?;:\n":
            clauses, hit = clauses + hit, False
            state, _ = GRAMMAR.step(state, "boundary")
            continue
        symbol = CLOSED.get(token) or ("quote" if token in "\"“”„«»" else "word")
        state, (is_negated, is_reported, has_target, is_threat) = GRAMMAR.step(state, symbol)
        threats += is_threat and not is_negated
        if token in found:
            weight, hit = lexicon[token], True
            if is_negated:
                negated += weight
            elif is_reported:
                reported += weight
            else:
                plain += weight
                targeted += weight * has_target
    values = (plain, targeted, negated, reported, threats, clauses + hit)
    return [1.0, *(math.log1p(v) for v in values)]


def beginnings(text: str) -> dict[str, str]:
    """Every word (with ``$``) and word beginning of a text, with the word before its first place."""
    out: dict[str, str] = {}
    seen = {""}
    before = ""
    for word in WORD.findall(text.lower()):
        if word not in seen:
            seen.add(word)
            out.setdefault(word + "$", before)
            for n in range(SHORTEST, min(len(word), LONGEST) + 1):
                out.setdefault(word[:n], before)
        before = word
    return out


def _ratio(n1: float, n0: float, all1: float, all0: float) -> float:
    """Log-likelihood ratio (G squared) of a feature with toxic and clean document counts."""
    total, n = all1 + all0, n1 + n0

    def part(k, m):
        return k * math.log(k / m) if k else 0.0

    return 2 * (part(n1, n * all1 / total) + part(n0, n * all0 / total) + part(all1 - n1, (total - n) * all1 / total) + part(all0 - n0, (total - n) * all0 / total))


def varied(n1: int, different: int, commonest: int) -> bool:
    """Whether ``n1`` documents have a feature in several surroundings, and not nearly all in one. Both are the same for
    a sample of any size; one document fewer is asked for, as the commonest word is one of the different ones."""
    return different >= MIN_BEFORE and n1 - commonest >= MIN_OTHER * n1 - 1


def choose(counts: list[tuple[str, int, int, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """The lexicon from (feature, toxic documents, clean documents, different words before it, toxic documents with the
    commonest of these)."""
    known = {f: (n1, n0, d, most) for f, n1, n0, d, most in counts}
    for seed in SEEDS:
        n1, n0, d, most = known.get(seed + "$", (0, 0, 0, 0))
        known[seed + "$"] = (n1 + SEED_DOCS, n0, d + SEED_DOCS, most)
    least = 2 * math.log(max(2, len(counts))) + 6
    passed = {}
    for feature, (n1, n0, different, commonest) in known.items():
        weight = math.log((n1 + 0.5) / (toxic + SEED_DOCS + 1)) - math.log((n0 + 0.5) / (clean + 1))
        seed = feature[-1] == "$" and feature[:-1] in SEEDS
        strong = _ratio(min(n1, toxic), n0, toxic, clean) >= least and varied(n1, different, commonest) if toxic and clean else False
        if weight >= MIN_WEIGHT and strong or seed and (weight > 0 or not clean):
            passed[feature] = max(weight, 1.0)
    out = {}
    for feature in sorted(passed, key=lambda f: (len(f), f)):
        n1 = known[feature][0]
        # A longer beginning (or the whole word) that loses next to nothing says the same more precisely.
        finer = any(g.startswith(feature) and g != feature and known[g][0] >= 0.95 * n1 for g in passed)
        # A shorter one that was kept covers this one already.
        covered = any(feature[:n] in out for n in range(SHORTEST, len(feature)))
        if not finer and not covered:
            out[feature] = passed[feature]
    return out


def fit_model(x: np.ndarray, y: np.ndarray, pull: float = 0.05, rounds: int = 100) -> np.ndarray:
    """Logistic weights near ``START``: Newton steps on the mean loss plus a quadratic pull towards it."""
    w = START.copy()
    if not len(x):
        return w
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (q - y) / len(x) + pull * (w - START) / 10
        curve = (x * (q * (1 - q))[:, None]).T @ x / len(x) + pull / 10 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model(NamedTuple):
    entries: dict[str, float]
    weights: list[float]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = FIT_DOCUMENTS) -> Model:
    """Lexicon and weights from the labelled documents outside the held-out fold (at most ``most`` of them).

    A document labelled twice is toxic if one label says so; null labels and labels without a document are ignored.
    """
    spark = docs.sparkSession
    marked = labels.where(F.col("toxic").isNotNull()).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    chosen = marked.where(~fold(id_col, 5)).orderBy(F.xxhash64(id_col), id_col).limit(most)
    named = chosen.select(F.col(id_col).alias("_id"), (F.col("toxic") > 0).alias("toxic"))
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    sample = stored(rows.join(F.broadcast(named), F.col("id") == F.col("_id")).select("text", "toxic"), "toxicity-sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                found = beginnings(text.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.string())], names=["feature", "before"])

    least = max(MIN_DOCS, math.ceil(MIN_SHARE * toxic))
    places = sample.where("toxic").select("text").mapInArrow(listed, "feature string, before string").groupBy("feature", "before").count()
    often = places.groupBy("feature").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("different"), F.max("count").alias("commonest"))
    # Bounded by the sample: every toxic document of it has a share in ``least`` features at most as often as it has words.
    hits = {r["feature"]: (r["n"], r["different"], r["commonest"]) for r in often.where(F.col("n") >= least).collect()}
    wanted = spark.sparkContext.broadcast(frozenset(hits))

    def clean_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        found: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                found.update(wanted.value.intersection(beginnings(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["feature", "n"])

    other = sample.where("not toxic").select("text").mapInArrow(clean_counts, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    clean_hits = {r["feature"]: r["n"] for r in other.collect()}
    counts = [(f, n, clean_hits.get(f, 0), d, most) for f, (n, d, most) in hits.items()]
    entries = choose(counts, toxic, clean)
    names = ", ".join(f"{f} double" for f in FEATURES)
    inputs = sample.mapInArrow(_summing(entries, [], ["toxic"]), f"toxic boolean, {names}").collect()
    x = np.array([[r[f] for f in FEATURES] for r in inputs]).reshape(-1, len(FEATURES))
    weights = fit_model(x, np.array([float(r["toxic"]) for r in inputs]))
    return Model(entries, weights.tolist())


def _summing(entries: dict[str, float], weights: list[float], keep: list[str]):
    """For the tasks: the model's inputs, or with ``weights`` the score, beside the columns ``keep``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(entries)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = np.array([sums(t.as_py(), lexicon) for t in part.column("text")]).reshape(-1, len(FEATURES))
                own = [part.column(k) for k in keep]
                if weights:
                    score = 1 / (1 + np.exp(-np.clip(x @ np.array(weights), -30, 30)))
                    yield pa.RecordBatch.from_arrays([*own, pa.array(score)], names=[*keep, "score"])
                else:
                    yield pa.RecordBatch.from_arrays([*own, *map(pa.array, x.T)], names=[*keep, *FEATURES])

    return work


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score``, ``predicted``. A null text scores as an empty one."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = dict(docs.dtypes)[id_col]
    out = rows.mapInArrow(_summing(model.entries, model.weights, ["id"]), f"id {kind}, score double")
    return out.select(
        F.col("id").alias(id_col), fold("id", 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, unchanged."""
    model = train(docs, labels)
    kinds = dict(docs.dtypes)
    keep = list(docs.columns)
    work = _summing(model.entries, model.weights, [f"c{i}" for i in range(len(keep))])
    # Names are set aside while rows pass through the tasks, so that a column called text or score cannot clash.
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], text_of().alias("text"))
    schema = ", ".join([f"c{i} {kinds[c]}" for i, c in enumerate(keep)] + ["score double"])
    kept = rows.mapInArrow(work, schema).where("score < 0.5")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)])
