"""Personal data by weak supervision.

Candidate spans come from strict patterns (the base) and looser ones. Labelers of three sorts vote on every candidate:
patterns and checksums, gazetteers, and words in the context. Expectation-maximisation over the counts of vote patterns
estimates how often each labeler votes which way on true and on false spans, and with that the probability of each
pattern. A logistic model trained on those probabilities, which also sees the shape of the span, decides.
Base spans always stay; spans that the model accepts are added: written-out mail addresses, long addresses of hosts, numbers
of cards and telephones in other forms, and secrets such as tokens and keys, which have no base pattern at all.
"""

from __future__ import annotations

import ipaddress
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetfit.llm.common import stored, text_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Probability from which a span that is not in the base is added.
ACCEPT = 0.9
CONTEXT_CHARS = 40

# The base patterns (fixed values), in forms that take time in proportion to the text.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

# Looser candidates.
_NAME, _LABEL, _DOT = r"\b[a-z0-9][a-z0-9._%+-]{0,63}", "[a-z0-9-]{1,63}", r"(?:\s?\[dot\]\s?|\s?\(dot\)\s?|\sdot\s)"
WRITTEN_MAIL = re.compile(
    rf"{_NAME}(?:\s?(?:\[at\]|\(at\))\s?{_LABEL}(?:(?:{_DOT}|\.){_LABEL}){{0,4}}(?:{_DOT}|\.)[a-z]{{2,24}}\b"
    rf"|\sat\s{_LABEL}(?:{_DOT}{_LABEL}){{0,4}}{_DOT}[a-z]{{2,24}}\b)",
    re.I,
)
WRITTEN = re.compile(r"dot|[\[(]at[\])]", re.I)
SIX = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f:]{4,39}(?![0-9A-Za-z:])")
SECRET = re.compile(r"(?<![0-9A-Za-z_+/=-])(?=[A-Za-z_+/=-]{0,255}[0-9])(?=[0-9_+/=-]{0,255}[A-Za-z])[A-Za-z0-9_+/=-]{20,256}(?![0-9A-Za-z_+/=-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:00[1-9][0-9]{0,2}[\x20.-])?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,5}(?![0-9])")

# Gazetteers and context words (fixed values).
ENDINGS = frozenset("com org net edu gov info biz io de fr es uk it eu ch at nl be us ca example test".split())
PROVIDERS = re.compile(r"mail|gmx|yahoo|outlook|proton|icloud|example", re.I)
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|3[068]|35|60|62|64|65|67")
COUNTRIES = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21|22|23|24|25|26|29|35|37|38|42|50|59|67|68|85|88|96|97|99")
CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|kontakt|courriel|correo|schreib)\w*", re.I),
    "ip": re.compile(r"\b(?:ip|server|host|addr\w*|login|client|ping|adresse|servidor)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|credit|debit|karte|kredit\w*|carte|tarjeta|payment|amex|master\w*)\b", re.I),
    "secret": re.compile(r"(?:token|secret|passw\w*|passwd|pwd|api.?key|key|auth\w*|bearer|credential\w*)\W{0,5}$", re.I),
    "phone": re.compile(r"(?:\b(?:tel|phone|call|fax|mobile|cell|ruf|appel\w*|tél\w*|teléfono|llam\w*|handy)\b)", re.I),
}
AGAINST = re.compile(r"\b(?:sha\d*|md5|checksum|digest|commit|hash|version|release|section|chapter|isbn|issn|doi|order|invoice|ticket|bestell\w*|v)\b[.:#\s]*$", re.I)
GIVEN = re.compile(r"""[\w"'][:=]\s?["']?$|\w\s[:=]\s["']?$""")
LABELERS = 5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for run in DOTTED.finditer(text):
        if "." not in run[0]:
            continue
        at, parts = run.start(), run[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                yield at, end
            at = end + 1


def cards(text: str) -> Iterator[tuple[int, int, bool]]:
    """All digit groups of a card's length, and whether the check digit is right."""
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = "".join(DIGIT.findall(m[0]))
            if 12 <= len(digits) <= 19:
                yield m.start(), m.end(), luhn(digits)


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= len(DIGIT.findall(m[0])) <= 15:
            yield m.start(), m.end()


Span = tuple[int, int, int]  # kind (place in KINDS), start, end


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns, by start and then kind; places count code points."""
    found: list[Span] = []
    if "@" in text:
        found += [(0, a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        found += [(1, a, b) for a, b in addresses(text)]
        found += [(2, a, b) for a, b, right in cards(text) if right]
        if "+" in text:
            found += [(3, a, b) for a, b in phones(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def _six(value: str) -> bool:
    """Whether this is an address of version 6 with two groups at least."""
    try:
        return len(re.findall("[0-9A-Fa-f]+", value)) >= 2 and ipaddress.IPv6Address(value) is not None
    except ValueError:
        return False


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Base spans and looser ones that overlap no base span of their kind."""
    more: list[Span] = []
    if WRITTEN.search(text):
        more += [(0, m.start(), m.end()) for m in WRITTEN_MAIL.finditer(text)]
    if ":" in text and DIGIT.search(text):
        more += [(1, m.start(), m.end()) for m in SIX.finditer(text) if _six(m[0])]
    if DIGIT.search(text):
        more += [(2, a, b) for a, b, right in cards(text) if not right]
        more += [(3, m.start(), m.end()) for m in LOCAL_PHONE.finditer(text)]
        more += [(4, m.start(), m.end()) for m in SECRET.finditer(text)]
    taken = {k: [(a, b) for kind, a, b in base if kind == k] for k in range(len(KINDS))} if more else {}
    return base + [s for s in more if not any(a < s[2] and s[1] < b for a, b in taken[s[0]])]


def votes(text: str, span: Span, is_base: bool) -> tuple[int, ...]:
    """The labelers' votes: 1 for, -1 against, 0 none."""
    kind, start, end = span
    name, value = KINDS[kind], text[start:end]
    before = text[max(0, start - CONTEXT_CHARS) : start]
    context = 1 if CONTEXT[name].search(before) else 0
    against = -1 if AGAINST.search(before) else 0
    digits = "".join(DIGIT.findall(value))
    if name == "email":
        ending = re.split(r"[.\s\])]+", value.rstrip("."))[-1].lower()
        own = (1 if ending in ENDINGS else -1, 1 if PROVIDERS.search(value) else 0)
    elif name == "ip":
        first = int(value.split(".")[0][-4:]) if "." in value else 32
        own = (1 if 0 < first < 224 else -1, -1 if re.search(r"(?:^|\.)0[0-9]", value) else 0)
    elif name == "card":
        own = (1 if ISSUERS.match(digits) else -1, 1 if luhn(digits) else -1)
    elif name == "secret":
        # A secret is spread evenly over its letters; words and runs are not.
        spread = len(set(value.lower())) / min(len(value), 16 if re.fullmatch("[0-9A-Fa-f]+", value) else 32)
        own = (1 if spread > 0.5 and len(digits) * 8 > len(value) else -1, 1 if len(value) in (24, 32, 36, 40, 44, 48, 64) else 0)
    else:
        own = (1 if 10 <= len(digits) <= 13 else -1, (1 if COUNTRIES.match(digits) else -1) if value[0] == "+" or digits[:2] == "00" else 0)
    # There is no base pattern for secrets: the first labeler asks whether the span is given to a name.
    given = int(is_base) if name != "secret" else 1 if GIVEN.search(before) else -1
    return (given, *own, context, against)


def shape(text: str, span: Span) -> tuple[int, int]:
    """Length class and whether the span stands alone between characters that are no letters or digits."""
    _, start, end = span
    alone = not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())
    return min(3, (end - start) // 8), int(alone)


def fit(counts: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for one kind over (votes, count): probability of each pattern, and per labeler and vote
    the rates on false and true spans. Rates are smoothed by one span each way; the start is the mean vote."""
    v = np.array([p[:LABELERS] for p, _ in counts], int).reshape(-1, LABELERS)
    n = np.array([c for _, c in counts], float)
    p = np.clip(0.5 + 0.2 * v.sum(1), 0.05, 0.95)
    rates = np.zeros((LABELERS, 3, 2))
    for _ in range(rounds):
        prior = np.clip((n * p).sum() / n.sum(), 0.01, 0.99)
        log = np.log([1 - prior, prior])[None, :].repeat(len(v), 0)
        for j in range(LABELERS):
            for k in (-1, 0, 1):
                hit = v[:, j] == k
                rates[j, k + 1] = [(n * (1 - p))[hit].sum() + 1, (n * p)[hit].sum() + 1]
            # A labeler that votes for a span is taken to be right more often than not, and so the other way round.
            rates[j] /= rates[j].sum(0)
            log += np.log(rates[j][v[:, j] + 1])
        p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
    return p, rates


def _features(patterns: list[tuple[int, ...]]) -> np.ndarray:
    x = np.array(patterns, float).reshape(-1, LABELERS + 2)
    return np.column_stack([np.ones(len(x)), x, x[:, LABELERS] ** 2])


def train(counts: list[tuple[tuple[int, ...], int]], rounds: int = 300) -> dict[tuple[int, ...], float]:
    """The span classifier of one kind: probability per pattern of votes and shape."""
    if not counts:
        return {}
    target, _ = fit(counts)
    x, n = _features([p for p, _ in counts]), np.array([c for _, c in counts], float)
    weight = np.sqrt(n) / np.sqrt(n).sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):  # Newton steps with a small ridge
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (weight * (target - q)) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return dict(zip([p for p, _ in counts], (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """One row per row of ``docs``: id, ``base`` and ``spans``, arrays of (kind, start, end) by start, then kind.

    A null text counts as empty; rows repeat as in ``docs``; extra columns are ignored. The model sees counts of vote
    patterns of all documents; their number does not grow with the data (three votes of five labelers and a shape).
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    span = "array<struct<kind:int,start:int,end:int,pattern:string>>"
    kinds = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.string())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for value in part.column("text"):
                    text = value.as_py()
                    base = base_spans(text)
                    known = set(base)
                    out.append(
                        [
                            (*s, ",".join(map(str, (int(s in known), s[0], *votes(text, s, s in known), *shape(text, s)))))
                            for s in candidates(text, base)
                        ]
                    )
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(out, kinds)], names=["id", "found"])

    kind = dict(docs.dtypes)[id_col]
    found = stored(rows.mapInArrow(scanned, f"id {kind}, found {span}"), "pii-candidates")
    patterns = found.select(F.explode("found.pattern").alias("pattern")).groupBy("pattern").count()
    counts: dict[int, Counter] = {k: Counter() for k in range(len(KINDS))}
    for r in patterns.collect():  # at most 2 * 5 * 3**5 * 4 * 2 rows
        _, kind_no, *rest = map(int, r["pattern"].split(","))
        counts[kind_no][tuple(rest)] += r["count"]
    accepted = [
        ",".join(map(str, (0, k, *pattern))) for k, c in counts.items() for pattern, p in train(sorted(c.items())).items() if p >= accept
    ]
    stays = lambda s: s["pattern"].startswith("1,") | s["pattern"].isin(accepted)
    bare = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    ordered = lambda spans: F.array_sort(F.transform(spans, bare))
    return found.select(
        F.col("id").alias(id_col),
        ordered(F.filter("found", lambda s: s["pattern"].startswith("1,"))).alias("base"),
        ordered(F.filter("found", stays)).alias("spans"),
    )


def as_text(spans):
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def count_of(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
