"""Extraction, toxicity, personal data and the pipeline beside brute force."""

import html
import random
import re
import time
from collections import Counter

import pytest
from text_fixtures import documents  # noqa: F401
from fleetfit.llm import html_extract, pii, toxicity

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body>
<header class="page"><h2>Site name</h2></header><nav><ul><li><a href="/a">First</a><li><a href="/b">Second</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this long sentence appear on each and every page.</p></div>
<!-- ad --><div class="ad">Buy now, this is a long enough advert to look like a sentence.</div>
<main><article><header><h1>A &lt;title&gt; &amp; more</h1></header><p><b>First   paragraph,
with a <a href="x">link</a> inside.<br><p>Second&nbsp;one.</p><p>Short</p>
<aside><p>Something else that the reader may also like to read some time.</p></aside>
<form><label>Mail</label><input name=q><p>Subscribe to the letter of this site, it is free of charge.</p></form>
<p>Last &eacute;l&#233;ment.</p></article>
<section id="comments"><p>What a wonderful article, thank you very much for all of it!</p></section></main>
<footer>&copy; all rights, a long line of small print at the end of the page.</footer></body>"""


def test_main_text():
    assert html_extract.main_text(PAGE).split("\n\n") == [
        "A <title> & more",
        "First paragraph, with a link inside.",
        "Second one.",
        "Short",
        "Last élément.",
    ]


@pytest.mark.parametrize("page", [None, "", "<", '<a "', "<!-- x", "<script>if(a</script", "<div>" * 5000, "&#xffffffff; <p>" * 50, "</p></b></x>"])
def test_odd_pages(page):
    assert isinstance(html_extract.main_text(page), str)


def test_without_semantic_tags():
    body = "".join(f"<p>Paragraph {i} is a whole sentence with a good number of words in it.</p>" for i in range(4))
    page = f'<body><div class="menu"><a href=1>One</a> <a href=2>Two</a></div><div id=x>{body}<p>Fine.</p></div><div class="sidebar">See also these other things here, and more of them.</div>'
    text = html_extract.main_text(page).split("\n\n")
    assert len(text) == 5 and text[-1] == "Fine."


@pytest.mark.parametrize("wrapper", ['div class="content-sidebar-wrap"', 'div class="layout has-sidebar"', 'div id="page-with-comments"', 'div class="social-news"', "form action=x"])
@pytest.mark.parametrize("inner", ["main", "article", "div"])
def test_wrappers_of_article_and_sidebar(wrapper, inner):
    paragraphs = [f"Paragraph {i} is a whole sentence with a good number of words in it." for i in range(4)]
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    side = '<div class="sidebar"><p>See also these other things here, and many more of them.</p></div><aside><p>An aside that is long enough to look like a sentence.</p></aside>'
    page = f"<body><nav><a href=1>One</a></nav><{wrapper}><{inner}><h1>The title</h1>{body}</{inner}>{side}</{wrapper.split()[0]}><footer>All rights reserved by the owner of this page.</footer>"
    assert html_extract.main_text(page).split("\n\n") == ["The title", *paragraphs]


PARAGRAPHS = [f"Paragraph {i} is a whole sentence with a good number of words in it." for i in range(10)]
SIDE = '<div class="sidebar"><p>See also these other things here, and many more of them.</p></div>'


@pytest.mark.parametrize(
    "before, after",
    [
        ('<main><h1>The title</h1><div class="ad-supported entry">', "</div></main>"),
        ('<article><h1>The title</h1><div class="content has-sidebar">', "</div></article>"),
        ('<article><h1>The title</h1><section class="story social-story">', "</section></article>"),
        ('<article class="post social-news"><h1>The title</h1>', "</article>"),
        ('<article class="ad-free"><h1>The title</h1>', "</article>"),
        ('<div class="page-with-comments"><div class="post"><h1>The title</h1>', "</div></div>"),
        ('<form id="f"><div><h1>The title</h1>', "</div></form>"),
        ('<div class="hasSidebar layoutNavWrapper"><div><h1>The title</h1>', "</div></div>"),
        ('<div class="social"><main><h1>The title</h1>', "</main></div>"),
    ],
)
def test_marked_wrappers_keep_their_article(before, after):
    body = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    page = f"<body><nav><a href=1>One</a> <a href=2>Two</a></nav>{before}{body}{after}{SIDE}<footer>All rights reserved by the owner of this page.</footer>"
    assert html_extract.main_text(page).split("\n\n") == ["The title", *PARAGRAPHS]


@pytest.mark.parametrize(
    "name",
    ["post-comments", "article-footer", "related-posts", "sponsored-story", "cookie-notice", "newsletter-box", "comment-content", "share share-wrap", "noSidebar promo"],
)
def test_names_of_what_an_element_is(name):
    """Names that say what an element is leave it out, also inside an article."""
    body = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    for page in (f"<article>{body}<div class='{name}'><p>A sentence of quite another sort, and long enough to count.</p></div></article>",):
        assert html_extract.main_text(page).split("\n\n") == PARAGRAPHS


def test_the_cut_decides():
    """Labels that the ties give against a block's own evidence, and that are right: short parts of an article kept, none added."""
    steps = "".join(f"<li>{w}</li>" for w in ("Flour", "Water", "Salt"))
    body = f"<h1>Bread</h1><p>{PARAGRAPHS[0]}</p><h4>You need</h4><ul>{steps}</ul><p>{PARAGRAPHS[1]}</p><div>Mix well</div><p>{PARAGRAPHS[2]}</p>"
    around = '<div class="menu"><a href=1>Home page</a> <a href=2>All the recipes</a></div>{}<div>Top</div><div class="footer">All rights reserved.</div>'
    found = html_extract.blocks(around.format(f"<div id=x>{body}</div>"))
    labels = html_extract.minimum_cut([b.score for b in found], html_extract.edges(found))
    against = [(b.text, c) for b, c in zip(found, labels) if c != (b.score > 0)]
    assert {t for t, c in against if c} >= {"Flour", "Water", "Salt", "Mix well"} and len(against) >= 4
    assert [b.text for b, c in zip(found, labels) if c] == ["Bread", PARAGRAPHS[0], "You need", "Flour", "Water", "Salt", PARAGRAPHS[1], "Mix well", PARAGRAPHS[2]]


@pytest.mark.parametrize(
    "part",
    ["<a ", '<a "', "</b>", "<b></i>", "<div>x", "<center>x", "<b>x", "<i>x<p>", "<a b='>", "<!--", "&amp", "<li><p>x", "<table><td>x", "<p a=\">", "<h1", "<"],
)
def test_broken_pages_take_linear_time(part):
    """A megabyte of unfinished or unclosed markup; quadratic work would take hours."""
    started = time.process_time()
    html_extract.main_text(part * ((1 << 20) // len(part)))
    assert time.process_time() - started < 30


def test_quotes_in_tags():
    page = f'<article><p title="a > b">{PARAGRAPHS[0]}</p><p title=\'"\'>{PARAGRAPHS[1]}</p><p title="open>{PARAGRAPHS[2]}</p><p>{PARAGRAPHS[3]}</p></article>'
    assert html_extract.main_text(page).split("\n\n") == PARAGRAPHS[:4]
    assert html_extract.main_text(f"<article><p>{PARAGRAPHS[0]}</p><a href=") == PARAGRAPHS[0]


def test_teasers_and_hidden_articles_stay_out():
    body = "".join(f"<p>Paragraph {i} is a whole sentence with a good number of words in it.</p>" for i in range(4))
    teaser = "<article><p>Another story that can be read on this site some time.</p></article>"
    for around in ('<div class="sidebar">', '<div class="related-posts">', "<aside>", '<div hidden class="has-sidebar">'):
        text = html_extract.main_text(f"<body><div id=x>{body}</div>{around}{teaser}</div>")
        assert text.count("Paragraph") == 4 and "Another" not in text


def test_minimum_cut_is_a_minimum():
    random.seed(3)
    for _ in range(300):
        n = random.randrange(1, 9)
        scores = [round(random.uniform(-2, 2), 2) for _ in range(n)]
        ties = [(a, b, round(random.uniform(0, 1), 2)) for a in range(n) for b in range(a) if random.random() < 0.4]

        def cost(side):
            cut = sum(w for a, b, w in ties if side[a] != side[b])
            return cut + sum(max(0, s) if not x else max(0, -s) for s, x in zip(scores, side))

        best = min(cost([(m >> i) & 1 for i in range(n)]) for m in range(2**n))
        assert abs(cost(html_extract.minimum_cut(scores, ties)) - best) < 1e-6


def test_extracted_pages(spark):
    rows = [(1, "u", PAGE), (2, None, None), (2, None, None), (None, "v", "<article>x</article>")]
    frame = spark.createDataFrame([(*r, 1, "a") for r in rows], "page_id long, url string, html string, n_chars int, text string")
    found = html_extract.extract(frame).collect()
    assert Counter((r.page_id, r.url, r.text, r.n_chars) for r in found) == Counter(
        (i, u, html_extract.main_text(h), len(html_extract.main_text(h))) for i, u, h in rows
    )
    assert html_extract.extract(frame.limit(0)).count() == 0


def test_text_of_the_given_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    found = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows)).collect()}
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:h1|p)>", article)]
        assert found[r.page_id] == "\n\n".join(p for p in parts if p)


# --- toxicity ------------------------------------------------------------------------------------


def marks(text):
    state, out = toxicity.GRAMMAR.start, []
    for token in toxicity.TOKEN.findall(text.lower()):
        symbol = toxicity.CLOSED.get(token) or ("quote" if token == '"' else "boundary" if token in ".!?;:\n" else "word")
        state, mark = toxicity.GRAMMAR.step(state, symbol)
        out.append((token, *map(bool, mark)))
    return {t: m for t, *m in out}


def test_transducers():
    assert marks("you are an idiot")["idiot"] == [False, False, True, False]
    assert marks("you are not an idiot")["idiot"] == [True, False, True, False]
    assert marks("he said idiot. moron")["idiot"] == [False, True, True, False]
    assert marks("he said idiot. moron")["moron"] == [False, False, False, False]
    assert marks('"idiot" moron')["idiot"][1] and not marks('"idiot" moron')["moron"][1]
    assert marks("I will kill you")["you"][3] and not marks("to kill time. you")["you"][3]


def test_scores_follow_the_grammar():
    lexicon = toxicity.Lexicon({"idiot$": 4.0, "vequ": 4.0})
    weights = toxicity.START
    plain, denied = (sum(a * b for a, b in zip(toxicity.sums(t, lexicon), weights)) for t in ("you idiot, idiot", "you not idiot, not idiot"))
    assert plain > denied > toxicity.START[0]
    assert toxicity.sums("Vequment idiots", lexicon)[1] > 0 and toxicity.sums("idiots", lexicon)[1] == 0
    assert toxicity.sums("", lexicon) == [1.0] + [0.0] * 6


def test_learning(spark, documents):
    random.seed(7)
    clean = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(600):
        words = [random.choice(clean) for _ in range(30)]
        if i % 6 == 0:
            for _ in range(3):
                words.insert(random.randrange(30), "zork" + random.choice(["a", "ib", "ud", "en"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(700, None), (701, ""), (None, "zorkel zorkis w1"), (5, rows[5][1])]
    labels += [(9999, 1, 1), (3, 1, None), (None, 1, 1), (6, 0, 0)]
    docs, table = documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, table)
    assert "zork" in model.entries and not any(e.startswith("w") and e[:-1] in clean for e in model.entries)
    found = toxicity.scores(docs, model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert all(r.predicted == int(r.score >= 0.5) for r in found)
    known = dict((i, t) for i, _, t in labels[:600])
    assert all(r.predicted == known[r.doc_id] for r in found if r.doc_id in known and r.doc_id < 600)
    assert {r.doc_id: r.predicted for r in found if r.doc_id in (700, 701, None)} == {700: 0, 701: 0, None: 1}
    kept = toxicity.drop_toxic(docs, table)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in found if not r.predicted)
    assert toxicity.scores(docs.limit(0), model).count() == 0
    # Nothing to learn from: what is known beforehand decides.
    bare = toxicity.train(docs, table.limit(0))
    assert {r.predicted for r in toxicity.scores(docs, bare).collect()} == {0}


def test_an_insult_is_learned_from_a_sample_of_any_size(spark, documents, monkeypatch):
    """Few words stand before an insult however many documents have it; a passage in copies still teaches nothing."""
    monkeypatch.setattr(toxicity, "SEEDS", [])
    for size in (60, 600):
        random.seed(11)
        plain = [f"w{i}" for i in range(60)]
        rows, before = [], [f"b{i}" for i in range(12)]
        for i in range(4 * size):
            words = [random.choice(plain + before) for _ in range(30)]
            if i % 4 == 0:
                at = random.randrange(30)
                words[at:at] = [min(random.choice(before), random.choice(before)), "zorkel"]
            elif i % 4 == 1:
                at = random.randrange(30)
                words[at:at] = "here comes a passage of blarg in copies".split()
            rows.append((i, " ".join(words)))
        labels = spark.createDataFrame([(i, 1, int(i % 4 < 2)) for i in range(4 * size)], "doc_id long, quality int, toxic int")
        learned = toxicity.train(documents(rows), labels).entries
        assert any("zorkel$".startswith(e) for e in learned), size
        assert not any("blarg$".startswith(e) for e in learned), size


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.scores(docs, toxicity.train(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in found) / len(found)
    caught = sum(r.predicted for r in found if r.toxic) / sum(r.toxic for r in found)
    assert right > 0.97 and caught > 0.85
    assert sum(r.predicted for r in found if not r.toxic) <= 0.01 * len(found)


# --- personal data -------------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, (name, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                name == "email"
                or name == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                or name == "card" and 12 <= len(digits) <= 19 and pii.luhn(digits)
                or name == "phone" and 9 <= len(digits) <= 15
            ):
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def test_base_spans_are_those_of_the_patterns():
    random.seed(5)
    letters = "0123456789" * 3 + "...@@+-- ()aZ_%é😀"
    for _ in range(5000):
        text = "".join(random.choice(letters) for _ in range(random.randrange(0, 60)))
        assert pii.base_spans(text) == plain_spans(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 150_000, "1 " * 150_000):
        pii.candidates(text, pii.base_spans(text))


def test_estimated_reliabilities():
    """Labelers that agree with the truth at known rates are told apart without it."""
    random.seed(8)
    counts = Counter()
    rates = [(0.95, 0.05), (0.9, 0.2), (0.8, 0.1), (0.6, 0.1), (0.5, 0.5)]
    truth = {}
    for _ in range(5000):
        true = random.random() < 0.4
        votes = tuple(1 if random.random() < r[0 if true else 1] else -1 for r in rates)
        counts[votes] += 1
        truth.setdefault(votes, Counter())[true] += 1
    p, found = pii.fit(sorted(counts.items()))
    for j, (yes, no) in enumerate(rates):
        assert abs(found[j, 2, 1] - yes) < 0.06 and abs(found[j, 2, 0] - no) < 0.06
    right = sum(truth[v][q > 0.5] for (v, _), q in zip(sorted(counts.items()), p))
    assert right > 0.93 * 5000


def test_personal_data(spark, documents):
    random.seed(9)
    rows = []
    for i in range(300):
        known = random.choice(["mail me: anna.b{0}@mail{0}.example.com", "host 10.1.{0}.7 up", "visa 4111 1111 1111 1111", "call +1 (212) 555-01{0:02d}", "order 1234567890123456"])
        rows.append((i, "é some words " + known.format(i % 99) + " and more"))
    rows += [(900, None), (901, ""), (5, rows[5][1]), (None, "x@y.z"), (902, "phone (212) 555-0199 and anna at mail dot example dot com")]
    found = pii.personal_data(documents(rows)).select("doc_id", "base", pii.as_text("base").alias("b"), pii.as_text("spans").alias("s")).collect()
    want = Counter((i, ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in plain_spans(t or ""))) for i, t in rows)
    assert Counter((r.doc_id, r.b) for r in found) == want
    assert all(set(filter(None, r.b.split(","))) <= set(r.s.split(",")) for r in found)
    assert pii.personal_data(documents(rows).limit(0)).count() == 0


def test_added_spans(documents):
    """Accepted spans outside the base with their exact ends, and candidates that stay out."""
    random.seed(12)
    secret = lambda: "".join(random.choice("0123456789abcdef") for _ in range(40))
    rows, want = [], {}

    def add(text, kind=None, value=None):
        rows.append((len(rows), text))
        want[len(rows) - 1] = {f"{kind}:{text.index(value)}:{text.index(value) + len(value)}"} if kind else set()

    for i in range(60):
        value = secret()
        add(f'some é text token = "{value}" and more', "secret", value)
        mail = random.choice(["anna{0} at mail dot example dot com", "B{0}.c [AT] gmx [DOT] de", "x{0} (at) proton.example.org", "d{0}[at]mail[dot]com"]).format(i)
        add(f"please write to {mail} or call", "email", mail)
        add(f"order 12345678901{i:05d} of that day")
        add(f"commit {secret()} is the last one")
        add(f"the words a-long-word-with-hyphens{i} and nothing else")
    for i in range(30):
        add(f"server 2001:db8::{i:x}:1 is up", "ip", f"2001:db8::{i:x}:1")
        add(f"ping 10.0.0.{i} now")
        add(f"mail z{i}@mail.example.com")
    found = {r.doc_id: (set(filter(None, r.b.split(","))), set(filter(None, r.s.split(",")))) for r in
             pii.personal_data(documents(rows)).select("doc_id", pii.as_text("base").alias("b"), pii.as_text("spans").alias("s")).collect()}
    added = {i: s - b for i, (b, s) in found.items()}
    assert added == want and sum(map(len, added.values())) == 150


def test_scanning_for_candidates_takes_linear_time():
    for part in ("a at ", "a1-", "a dot ", "1:", "Z9", "(at)a.", "0 0", "a1=_", "x[at]y[dot]"):
        started = time.process_time()
        pii.candidates(part * 100_000, [])
        assert time.process_time() - started < 20


# --- the pipeline --------------------------------------------------------------------------------


def test_pipeline(spark):
    """Every stage beside a plain version, on what its predecessor kept."""
    import corpus_pipeline
    from fleetfit.llm.common import stored
    from test_copies import components

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, folder), name)
        assert out.columns == columns
        after = out.collect()
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
            bad = {r.doc_id for r in toxicity.scores(docs, model).where("predicted = 1").collect()}
            want = [r for r in before if r.doc_id not in bad]
            assert bad
        elif name == "exact_dedup":
            last = {}
            for r in before:
                last[r.text] = max(last.get(r.text, -1), r.doc_id)
            want = [r for r in before if last[r.text] == r.doc_id]
        elif name == "jaccard_join":
            least = {doc for doc, _, label, _ in components([(r.doc_id, r.text) for r in before], 5, 80, 100) if doc == label}
            want = [r for r in before if r.doc_id in least]
        else:
            copies = Counter(r.doc_id for r in after)
            assert max(copies.values()) <= 3 and {tuple(r) for r in after} <= {tuple(r) for r in before}
            want = after
        assert Counter(map(tuple, after)) == Counter(map(tuple, want))
        docs, before = out, after
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert Counter(r.doc_id for r in encoded) == Counter(r.doc_id for r in before)
    assert all(r.n_tokens == len(r.ids.split()) for r in encoded)
