"""Main text of HTML pages by minimum-cut labelling.

A page becomes a list of text blocks. Each block gets evidence for content or boilerplate from a linear classifier over
its tag path, class names, length, punctuation and links; positive evidence is its capacity from the source, negative
evidence its capacity to the sink. Neighbouring blocks, and consecutive blocks of one parent or grandparent, are tied by
smoothness edges. The minimum cut is the labelling with the least total cost; the source side is the main text.

Names of classes, ids and roles are evidence of two strengths. One that says what an element is ("sidebar", "post-comments",
"cookie-notice") outweighs the rest. One that says what a wrapper also has or is for ("has-sidebar", "content-sidebar-wrap",
"social-story", "ad-free"), like a form round the whole page, is moderate: text and ties decide.

A page is read once, forwards, in time proportional to its length, however broken its tags are.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element names of the HTML standard, by what they do here.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
HIDDEN = frozenset("head noscript template svg math canvas object audio video select button datalist map dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
SCOPES = frozenset("ul ol dl table div section article main aside nav header footer form body".split())

CONTENT_TAGS = frozenset(("article", "main"))
BOILERPLATE_TAGS = frozenset("nav footer aside menu".split())
#: Words in class, id or role that mark what is not the article.
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs captcha comment comments "
    "commentlist complementary consent contentinfo cookie cookies copyright disqus footer gdpr login menu modal navbar "
    "navigation nav newsletter notice notices alert notification pager pagination paywall popup promo promotion promoted "
    "recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored sponsors "
    "subscribe subscription tagcloud toolbar widget widgets".split()
)
#: A name that ends in one of these, or has one of these before the mark, names a wrapper and not what the mark says ...
WRAPPER_ENDS = frozenset("wrap wrapper layout supported free enabled story news article entry post page".split())
WRAPPER_STARTS = frozenset("has have with without no non is".split())
#: ... but for these, which turn what they stand before into something else.
TURNING_WORDS = frozenset("related recommended sponsored promoted".split())
CONTENT_WORDS = frozenset("article entry post story articlebody content".split())

# Weights of the classifier, in log-odds.
BIAS, IN_CONTENT, IN_BOILERPLATE, PAGE_HEADER, IN_WRAPPER, MAIN_WORD = 0.25, 3.0, -10.0, -8.0, -1.5, 1.0
TEXT_TAG, LIST_ITEM, HEADING, TITLE, LONG, SENTENCE, SHORT, LINKS = 0.7, 0.4, 0.7, 1.5, 0.8, 0.5, -0.8, -3.0
# Smoothness: neighbours on the page, consecutive under one parent, consecutive under one grandparent.
NEXT, SAME_PARENT, SAME_GRANDPARENT = 0.8, 0.4, 0.2

TAG_NAME = re.compile(r"[A-Za-z][^\s/>]*")
QUOTE_OR_END = re.compile("[>\"']")
MARKS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
CONCEALED = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block:
    """White-space normalised text, its evidence, and the numbers of its parent and grandparent elements."""

    __slots__ = ("text", "score", "parent", "grandparent")

    def __init__(self, text: str, score: float, parent: int, grandparent: int):
        self.text, self.score, self.parent, self.grandparent = text, score, parent, grandparent


def _marks(rest: str) -> set[str]:
    found = set()
    for groups in MARKS.findall(rest):
        found.update(w.lower() for w in NAME_PART.findall("".join(groups)))
        found.update("".join(groups).lower().split())
    return found


def _strength(rest: str) -> int:
    """What class, id and role say: 2 that the element is boilerplate, 1 that it is a wrapper that has some, 0 neither."""
    found = 0
    for groups in MARKS.findall(rest):
        for name in "".join(groups).split():
            parts = [w.lower() for w in NAME_PART.findall(name)] or [name.lower()]
            marked = [i for i, w in enumerate(parts) if w in BOILERPLATE_WORDS]
            if name.lower() in BOILERPLATE_WORDS:
                return 2
            if marked:
                wrapper = parts[-1] in WRAPPER_ENDS or not WRAPPER_STARTS.isdisjoint(parts[: marked[0]])
                if not wrapper or not TURNING_WORDS.isdisjoint(parts):
                    return 2
                found = 1
    return found


class Path(NamedTuple):
    """Evidence of the elements round a text: in content, in boilerplate (1 a page's header, 2 other), named as content,
    number of wrappers that have boilerplate too."""

    content: bool = False
    boilerplate: int = 0
    named: bool = False
    wrappers: int = 0

    def below(self, name: str, rest: str, parent: str) -> Path:
        content, boilerplate, named, wrappers = self
        if name == "main":
            content, boilerplate, wrappers = True, 0, 0  # there is one, and what is round it is a wrapper
        elif name == "article":
            content = True
        elif name in BOILERPLATE_TAGS:
            boilerplate = 2
        elif name == "header" and not content:
            boilerplate = max(boilerplate, 1)
        elif name == "form":
            # A form round the whole page is a wrapper.
            if parent in ("#", "html", "body"):
                wrappers += 1
            else:
                boilerplate = 2
        if rest and name != "body" and name != "html":
            strength = 2 if CONCEALED.search(rest) else _strength(rest)
            if strength == 2:
                boilerplate = 2
            wrappers += strength == 1
            named = named or not CONTENT_WORDS.isdisjoint(_marks(rest))
        return Path(content, boilerplate, named, wrappers)


def _score(text: str, links: int, tag: str, path: Path) -> float:
    words = text.count(" ") + 1
    score = BIAS + (IN_CONTENT if path.content else 0.0) + IN_WRAPPER * min(path.wrappers, 2)
    if path.boilerplate == 2:
        score += IN_BOILERPLATE
    elif path.boilerplate:
        score += PAGE_HEADER
    if path.named:
        score += MAIN_WORD
    if tag in ("p", "pre", "blockquote"):
        score += TEXT_TAG
    elif tag in ("li", "dd", "dt"):
        score += LIST_ITEM
    elif tag == "h1":
        score += TITLE
    elif tag[0] == "h" and tag[1:].isdigit():
        score += HEADING
    if words >= 10:
        score += LONG
    elif words < 4 and not path.content:
        score += SHORT
    if text[-1] in ".!?…:\"'”»":
        score += SENTENCE
    return score + LINKS * min(1.0, links / len(text))


class Tags:
    """The tags of a page, one after the other, found in one pass forwards.

    A tag ends at the first ``>`` outside quotes. Where a quote never closes, it and all later tags end at the first ``>``
    whatever the quotes; a tag that never ends is the end of the page, as for a browser.
    """

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def _end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag whose name ends at ``at``; -1 if there is none."""
        page, place = self.page, at
        while self.quotes:
            found = QUOTE_OR_END.search(page, place)
            if found is None:
                break
            if found[0] == ">":
                return found.start()
            place = page.find(found[0], found.end()) + 1
            if not place:
                break
        self.quotes = False  # looked through to the end once, never again
        return page.find(">", at)

    def after(self, at: int) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, name, whether it closes, attributes) from ``at`` on; '' as the name of a comment or declaration.
        A place that is sent in is where to go on."""
        page = self.page
        while True:
            start = page.find("<", at)
            if start < 0:
                return
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = (yield start, end + 3 if end >= 0 else len(page), "", False, "") or (end + 3 if end >= 0 else len(page))
                continue
            closes = page.startswith("/", start + 1)
            name = TAG_NAME.match(page, start + 1 + closes)
            if name is None and (closes or page.startswith(("!", "?"), start + 1)):
                end = page.find(">", start)
                at = (yield start, end + 1 if end >= 0 else len(page), "", False, "") or (end + 1 if end >= 0 else len(page))
                continue
            if name is None:
                at = start + 1
                continue
            end = self._end(name.end())
            if end < 0:
                yield start, len(page), "", False, ""
                return
            at = (yield start, end + 1, name[0].lower(), closes, page[name.end() : end]) or end + 1


class Open(NamedTuple):
    """An open element. ``around`` has the nearest elements that hold blocks, itself included, at most three."""

    name: str
    number: int
    path: Path
    around: tuple[tuple[str, int], ...]


class Stack:
    """The open elements. What is open is counted by name, so that a search is made only for what will be found:

    ``scopes`` counts since the innermost element that scopes, ``inlines`` inline elements since the innermost other one."""

    def __init__(self) -> None:
        self.items = [Open("#", 0, Path(), (("#", 0),))]
        self.names: Counter[str] = Counter()
        self.scopes, self.inlines = [Counter[str]()], [Counter[str]()]
        self.hidden = self.number = self.links = 0

    def push(self, name: str, rest: str) -> None:
        self.number += 1
        top = self.items[-1]
        parent = top.around[0][0]
        around = top.around if name in INLINE else ((name, self.number), *top.around[:2])
        self.items.append(Open(name, self.number, top.path.below(name, rest, parent), around))
        self.names[name] += 1
        self.hidden += name in HIDDEN
        self.links += name == "a"
        if name in SCOPES:
            self.scopes.append(Counter())
        else:
            self.scopes[-1][name] += 1
        if name in INLINE:
            self.inlines[-1][name] += 1
        else:
            self.inlines.append(Counter())

    def pop(self) -> str:
        name = self.items.pop().name
        self.names[name] -= 1
        self.hidden -= name in HIDDEN
        self.links -= name == "a"
        if name in SCOPES:
            self.scopes.pop()
        else:
            self.scopes[-1][name] -= 1
        if name in INLINE:
            self.inlines[-1][name] -= 1
        else:
            self.inlines.pop()
        return name

    def close(self, name: str) -> None:
        """An end tag: of a block, up to the innermost open one; of an inline element, not beyond its block."""
        if (self.inlines[-1] if name in INLINE else self.names)[name]:
            while self.pop() != name:
                pass

    def close_before(self, name: str) -> None:
        """What the start of a block element closes: an open paragraph, and what cannot hold it, in the same scope."""
        for closed in ("p", *CLOSES.get(name, ())):
            while self.scopes[-1][closed]:
                while self.pop() != closed:
                    pass


def blocks(page: str) -> list[Block]:
    """The visible text of a page, cut at block elements, in page order."""
    out: list[Block] = []
    stack, pieces = Stack(), []
    links = at = 0

    def flush() -> None:
        nonlocal links
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                around, path = stack.items[-1].around, stack.items[-1].path
                # The elements around the one that holds the text; at the top the outermost counts again.
                parent, grandparent = around[min(1, len(around) - 1)][1], around[-1][1]
                out.append(Block(text, _score(text, links, around[0][0], path), parent, grandparent))
        links = 0

    def take(text: str) -> None:
        nonlocal links
        if text and not stack.hidden:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if stack.links:
                links += len(text.strip())

    tags = Tags(page).after(0)
    found = next(tags, None)
    while found is not None:
        start, end, name, closes, rest = found
        take(page[at:start])
        at, go_on = end, None
        if closes:
            if name not in INLINE:
                flush()
            stack.close(name)
        elif name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = go_on = close.start() if close else len(page)
        elif name == "br":
            take(" ")
        elif name:
            if name not in INLINE:
                flush()
                stack.close_before(name)
            if name not in VOID:
                stack.push(name, rest)
        found = next(tags, None) if go_on is None else _sent(tags, go_on)
    take(page[at:])
    flush()
    return out


def _sent(tags, at: int):
    try:
        return tags.send(at)
    except StopIteration:
        return None


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness: adjacency on the page and proximity in the element tree."""
    out = [(i, i + 1, NEXT) for i in range(len(found) - 1)]
    for weight, of in ((SAME_PARENT, "parent"), (SAME_GRANDPARENT, "grandparent")):
        last: dict[int, int] = {}
        for i, block in enumerate(found):
            key = getattr(block, of)
            if key in last:
                out.append((last[key], i, weight))
            last[key] = i
    return out


def minimum_cut(scores: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source side of a minimum cut (the smallest such side).

    Nodes whose evidence outweighs all their ties keep their side in every minimum cut; they are merged with the
    terminals first, and flow is pushed through the rest only.
    """
    around = [0.0] * len(scores)
    for a, b, w in ties:
        around[a] += w
        around[b] += w
    side = [s > 0 if abs(s) > t else None for s, t in zip(scores, around)]
    names = [i for i, s in enumerate(side) if s is None]
    if not names:
        return [bool(s) for s in side]
    place = {i: k for k, i in enumerate(names)}
    source, sink = len(names), len(names) + 1
    net = [scores[i] for i in names]
    to: list[list[int]] = [[] for _ in range(len(names) + 2)]  # arcs leaving a node
    head: list[int] = []
    room: list[float] = []

    def arc(a: int, b: int, forward: float, backward: float) -> None:
        to[a].append(len(head))
        to[b].append(len(head) + 1)
        head.extend((b, a))
        room.extend((forward, backward))

    for a, b, w in ties:
        if side[a] is None and side[b] is None:
            arc(place[a], place[b], w, w)
        elif side[a] is None:
            net[place[a]] += w if side[b] else -w
        elif side[b] is None:
            net[place[b]] += w if side[a] else -w
    for k, value in enumerate(net):
        if value > 0:
            arc(source, k, value, 0.0)
        elif value < 0:
            arc(k, sink, -value, 0.0)
    least = 1e-9
    while True:
        level = [-1] * len(to)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in to[a]:
                if room[e] > least and level[head[e]] < 0:
                    level[head[e]] = level[a] + 1
                    queue.append(head[e])
        if level[sink] < 0:
            break
        turn = [0] * len(to)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                pushed = min(room[e] for e in path)
                for e in path:
                    room[e] -= pushed
                    room[e ^ 1] += pushed
                cut = next(i for i, e in enumerate(path) if room[e] <= least)
                a = head[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[a] < len(to[a]):
                e = to[a][turn[a]]
                if room[e] > least and level[head[e]] == level[a] + 1:
                    path.append(e)
                    a = head[e]
                    break
                turn[a] += 1
            else:
                if a == source:
                    break
                e = path.pop()
                a = head[e ^ 1]
                turn[a] += 1
    return [bool(s) if s is not None else level[place[i]] >= 0 for i, s in enumerate(side)]


def main_text(page: str | None) -> str:
    """Blocks labelled as content, joined by an empty line."""
    found = blocks(page or "")
    kept = minimum_cut([b.score for b in found], edges(found))
    return "\n\n".join(b.text for b, c in zip(found, kept) if c)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per row of ``pages``: id, the columns ``keep``, ``text`` and ``n_chars``.

    A null page, or one without main text, has the empty text; repeated rows stay repeated; other columns are ignored.
    """
    columns = [F.col(c) for c in (id_col, *keep)]
    rows = pages.select(*columns, F.col(html_col).alias("_html"))
    kinds = dict(pages.dtypes)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [main_text(v.as_py()) for v in part.column("_html")]
                own = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string())], names=[id_col, *keep, "text"])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in (id_col, *keep)] + ["text string"])
    return rows.mapInArrow(extracted, schema).withColumn("n_chars", F.length("text").cast("long"))
