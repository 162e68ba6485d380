"""Held-out accuracy and pieces of the fitted operators: toxicity, language, pages."""

import math
import random

import numpy as np
import pytest

from corpusloom.llm import html, langid, toxicity
from corpusloom.llm.queries import QUERIES

LETTERS = "abcdefghijklmnop"


# ------------------------------------------------------------ language
def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "ab", "b", "ba", "abc", "c"]
    pieces.remove("▁")
    rng = np.random.default_rng(1)
    probs = rng.dirichlet(np.ones(len(pieces)), 2).T
    lattice = langid.Lattice(pieces, probs)
    index = {p: i for i, p in enumerate(pieces)}

    def total(text, lang):
        sums = [1.0] + [0.0] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(j):
                p = text[i:j]
                if p in index:
                    sums[j] += sums[i] * probs[index[p], lang]
                elif len(p) == 1:
                    sums[j] += sums[i] * langid.FLOOR
        return sums[-1]

    for word in ("a", "abab", "cba", "xyz", "abcabc", "b"):
        got = lattice.log_words([word])[0]
        assert all(math.isclose(got[k], math.log(total("▁" + word, k)), rel_tol=1e-9) for k in (0, 1))
    long = "abc" * 2000
    assert np.isfinite(lattice.log_words([long])).all()
    counts: dict = {}
    lattice.expected("abab", 0, 2, counts)
    letters = sum(n * len(pieces[k].strip("▁")) for (_, k), n in counts.items())
    assert math.isclose(letters, 8.0, rel_tol=1e-6)
    for word in ("ab" * 40, "abcba" * 400):
        counts = {}
        lattice.expected(word, 1, 1, counts)
        assert math.isclose(sum(n * len(pieces[k].strip("▁")) for (_, k), n in counts.items()), len(word), rel_tol=1e-6)


def test_language_query(spark, sf):
    rows = QUERIES["op2_language_id"](spark, sf).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and held
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_predictions_by_brute_force(spark):
    """Language and score of whole texts from sums over all segmentations, letter by letter."""
    from itertools import product

    pieces = ["▁a", "a", "b", "ab", "▁ab", "ba", "▁", "c"]
    probs = np.array([[0.2, 0.1], [0.1, 0.2], [0.1, 0.3], [0.2, 0.1], [0.1, 0.05], [0.1, 0.05], [0.1, 0.1], [0.1, 0.1]])
    index = {p: i for i, p in enumerate(pieces)}

    def word(w, lang):
        text, total = "▁" + w, 0.0
        for cuts in product((0, 1), repeat=len(text) - 1):
            parts, start = [], 0
            for i, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(text[start:i])
                    start = i
            total += float(np.prod([probs[index[p], lang] if p in index else langid.FLOOR if len(p) == 1 else 0.0 for p in parts]))
        return total

    texts = ["ab ba aab", "b, bb-a 12", "ABBA x", "½ ² ① 12 _", "a½b", "", None, "c c c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in langid.predict(docs, pieces, ["x", "y"], probs, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        words = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        if not words:
            assert (rows[i].lang_pred, rows[i].score) == ("und", 0.0)
            continue
        p = [float(np.prod([word(w, k) for w in words])) for k in (0, 1)]
        assert rows[i].lang_pred == ("x" if p[0] >= p[1] else "y")
        assert abs(rows[i].score - max(p) / sum(p)) < 1e-9


def test_language_edges(spark, edge, none):
    pieces = ["▁", "a", "t", "th", "e", "x", "w"]
    train = spark.createDataFrame([(1, "the tea", "en"), (2, "waxa wax", "xx"), (3, None, "en"), (4, "the", None)], "doc_id long, text string, lang string")
    langs, probs = langid.fit(train, pieces)
    assert langs == ["en", "xx"]
    rows = {r.doc_id: r for r in langid.predict(edge, pieces, langs, probs, ["doc_id", "body"]).select("doc_id", "lang_pred").collect()}
    assert {rows[i].lang_pred for i in (1, 2, 3)} == {"und"} and rows[12].lang_pred == "en"
    assert langid.predict(none, pieces, langs, probs, ["doc_id"]).count() == 0
    nothing = langid.fit(train.limit(0), pieces)
    assert {r.lang_pred for r in langid.predict(edge, pieces, *nothing, ["doc_id"]).collect()} == {"und"}


# ------------------------------------------------------------ toxicity
@pytest.fixture(scope="module")
def chars():
    words = ["idiot", "stupid", "loser", "moron", "the", "and", "reader", "house", "green", "paper"] * 30
    grams: dict = {}
    for w in words:
        t = "^^" + w + "$"
        for i in range(len(t) - 2):
            grams[t[i : i + 3]] = grams.get(t[i : i + 3], 0) + 1
    return toxicity.CharModel(grams)


@pytest.mark.parametrize("token, word", [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("i-d-i-o-t", "idiot"), ("l0ser", "loser"), ("idiooot", "idiot"), ("m0r0n!!!", "moron"), ("$tup1d", "stupid")])
def test_deobfuscation(chars, token, word):
    assert word in toxicity.readings(token, chars)


def test_clean_tokens_pass_unchanged(chars):
    assert toxicity.readings("house", chars) == ["house"]
    assert toxicity.readings("house,", chars) == ["house"]
    assert toxicity.readings("$$$", chars) == []
    assert toxicity.spaced_words("the i d i o t reader", chars) == ["idiot"]
    assert toxicity.spaced_words("a b", chars) == []


def test_viterbi_is_the_best_reading(chars):
    """Against all readings of short tokens."""

    def every(token):
        out = [("", 0.0)]
        before, run = "", 0
        for c in token:
            run = run + 1 if c == before else 1
            meant = [(c, 0.0)] if c.isalpha() else [(x, toxicity.COST_LOOK) for x in toxicity.LOOKALIKES.get(c, "")]
            skip = toxicity.COST_REPEAT if run >= 2 and c.isalpha() else None if c.isalpha() else 0.3 if c.isspace() else toxicity.COST_SKIP if c not in toxicity.LOOKALIKES or run >= 2 or before == "" else toxicity.COST_SKIP + 2.0
            if c.isdigit() and skip is not None:
                skip += toxicity.COST_UNKNOWN
            before = c
            out = [(w + x, n + e) for w, n in out for x, e in meant] + [(w, n + skip) for w, n in out if skip is not None]
        return min(n + chars.word(w) for w, n in out)

    rng = random.Random(3)
    for _ in range(60):
        token = "".join(rng.choice("idt01!.-oo3") for _ in range(rng.randint(1, 6)))
        assert math.isclose(toxicity.restore(token, chars)[1], every(token), rel_tol=1e-9)


def test_toxicity_on_planted_words(spark, edge, none):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(LETTERS) for _ in range(5))
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(60)]
        if i % 5 == 0:
            words[rng.randrange(60)] = ["zorgle", "z0rgle", "zorgle!", "z o r g l e"][i // 5 % 4] if i >= 200 else "zorgle"
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs.where("doc_id < 200"), marks.where("doc_id < 200"))
    assert "=zorgle" in model["weights"]
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert all((s >= 0.7) == (i % 5 == 0) for i, s in scores.items())
    out = toxicity.score(edge, model, ["doc_id", "body"]).collect()
    assert len(out) == edge.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(none, model, ["doc_id"]).count() == 0
    blank = toxicity.fit(docs.limit(0), marks)
    assert len({r.score for r in toxicity.score(edge, blank, ["doc_id"]).collect()}) == 1


def test_trigrams_of_all_texts_and_contexts_of_spaced_words(spark):
    docs = spark.createDataFrame([(1, "house"), (2, "xylem")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert model["trigrams"]["xyl"] == model["trigrams"]["hou"] == 1  # text 2 has no label
    grams: dict = {}
    for word in ["idiot"] * 50 + ["opening", "words", "some", "other"]:
        for i in range(len(word) + 1):
            t = ("^^" + word + "$")[i : i + 3]
            grams[t] = grams.get(t, 0) + 1
    chars, opening = toxicity.CharModel(grams), "opening words " * 10
    near = [toxicity.contexts(f"{opening} {before} i d i o t {after}", chars, {})["=idiot"] for before, after in (("some", "other"), ("other", "some"), ("some", "other"))]
    assert near[0] == near[2] != near[1]


def test_toxicity_query(spark, sf):
    rows = QUERIES["op1_toxicity"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


# ------------------------------------------------------------ pages
TREE = html.train()
ARTICLE = "Some words that make a paragraph long enough to be read as the main text of this page by any rule."


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<nav><ul><li><a href=x>Home</a></ul></nav><article><h1>T</h1><p>{ARTICLE}<p>Er.</article><footer>&copy; me</footer>", f"T {ARTICLE} Er."),
        ("<article><p>a&amp;b &lt;i&gt; &#233;&eacute; wo<b>r</b>d<br>x<script>if (a<b) '</p>'</script>y</p></article>", "a&b <i> éé word xy"),
        (f"<article><p>{ARTICLE}</p><aside>see also</aside><div class='ad-box'>buy</div><section id=comments><p>{ARTICLE}</p></section></article>", ARTICLE),
        ("<article><p>cut off here <b>and th", "cut off here and th"),
        ("<article><p>cut inside <a hre", "cut inside"),
        ("<article><form><label>Name</label></form><p>one</p><!-- <p>no</p> --><style>p{}</style></article>", "one"),
        ("", ""),
        ("<script>var x = 1;", ""),
        (f"<div class=sidebar>{ARTICLE}</div><div><p>{ARTICLE}</p><p>{ARTICLE}</p></div>", f"{ARTICLE} {ARTICLE}"),
        ("<article>1 < 2 and 3 > 2</article>", "1 < 2 and 3 > 2"),
        # layouts that must not hide an article
        (f"<html><head><title>t</title><meta charset=x><body><article><p>{ARTICLE}</p></article>", ARTICLE),
        (f"<div class='overflow-hidden'><article><p>{ARTICLE}</p></article></div>", ARTICLE),
        (f"<div aria-hidden='false'><article><p>{ARTICLE}</p></article></div>", ARTICLE),
        (f"<article><p aria-hidden='true'>no</p><p hidden>no</p><p style='display: none'>no</p><p>{ARTICLE}</p></article>", ARTICLE),
        (f"<button>Menu<article><p>{ARTICLE}</p></article>", f"{ARTICLE}"),
        (f"<button>Menu<article><p>{ARTICLE}</p></article><button>other</button>", ARTICLE),
        (f"<article><select><option>one</select><button><span>go</span></button><p>{ARTICLE}</p></article>", ARTICLE),
        (f"<noscript><article><p>{ARTICLE}</p></article>", ARTICLE),
        (f"<article><svg><svg><text>no</text></svg><text>no</text></svg><p>{ARTICLE}</p></article>", ARTICLE),
        *((f"<div class='{c}'><article><p>{ARTICLE}</p></article></div>", ARTICLE) for c in ("content no-sidebar", "has-comments", "with-related", "sidebar", "site-header banner", "content-sidebar-wrap", "newsletter", "ads", "searchbox")),
        (f"<div class='content no-sidebar'><p>{ARTICLE}</p></div>", ARTICLE),
        (f"<form id=aspnet><main><p>{ARTICLE}</p></main></form>", ARTICLE),
        (f"<nav><a href=x>Home</a><article><p>{ARTICLE}</p></article>", ARTICLE),
        (f"<article class='post tag-cookies category-newsletter'><p>{ARTICLE}</p></article>", ARTICLE),
        # and what still goes, by each kind of hint
        *((f"<article><p>{ARTICLE}</p><div class='{c}'><p>{ARTICLE}</p></div></article>", ARTICLE) for c in ("main-nav", "site-banner", "copyright", "sidebar", "cookieNotice", "ad", "sponsored", "comments", "login")),
        (f"<article><p>{ARTICLE}</p></article><div id='comments'><article class='comment'><p>{ARTICLE}</p></article></div>", ARTICLE),
        (f"<article><p>{ARTICLE}</p></article><aside><article><p>{ARTICLE}</p></article></aside>", ARTICLE),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page, TREE).replace("<br>", " ") == text


@pytest.mark.parametrize(
    "wrapper",
    [
        "<form id='aspnetForm'><div id='content'>",
        "<div class='main-content sidebar-right'>",
        "<div class='post tag-social category-legal'>",
        "<div id='page' class='site menu-closed'>",
        "<div class='story ad-free'>",
        "<div class='elementor-widget-text widget'>",
        "<div class='tags-list-wrapper'><div id='main'>",
        "<div class='sidebar'><div role='main'>",
    ],
)
def test_wrappers_of_most_words_hide_nothing(wrapper):
    long = " ".join(f"word{i}" for i in range(80))
    page = f"<body><nav><a href=x>Home</a> <a href=y>About</a></nav>{wrapper}<p>{long}</p><div class='sidebar'>By the way</div></div><footer>Copyright someone</footer></body>"
    assert html.main_text(page, TREE) == long


def test_pages_that_would_come_out_empty():
    linked = " ".join(f"word{i}" for i in range(80))
    assert html.main_text(f"<nav><a>x</a></nav><article><p><a href=z>{linked}</a></p></article>", TREE) == linked
    assert html.main_text("<nav><a>x</a></nav><div><p>Just three words.</p></div>", TREE) == "Just three words."
    for kind in ("div id='comments'", "div class='cookie-notice'", "div class='newsletter'", "nav", "footer", "aside class='ad'"):
        assert html.main_text(f"<nav><a>x</a></nav><{kind}><p>{linked}</p></{kind.split()[0]}>", TREE) == "", kind
    # Wrappers that never end hold the whole page, so their names say nothing about it.
    assert html.main_text("<div class='menu'>" * 4000 + "<p>x" * 1000, TREE) == " ".join(["x"] * 1000)


def test_pages(spark, sf):
    import re
    from html import unescape

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in QUERIES["op9_html_text"](spark, sf).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        want = " ".join(unescape(re.sub(r"<[a-zA-Z/!][^>]*(?:>|\Z)", "\n", re.sub(r"</?b>", "", body))).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (want, len(want))


def test_page_edges(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<article>a", "x"), (3, "u", "<article>twice", "x"), (3, "u", "<article>twice", "x"), (2, "u", "<article>" + "<div>" * 3000 + "w " * 100_000, "x")], "page_id long, url string, html string, text string")
    rows = {r.page_id: r for r in html.extract(pages).collect()}
    assert (rows[1].text, rows[1].n_chars, rows[None].text, rows[2].n_chars) == ("", 0, "a", 199_999)
    assert html.extract(pages.limit(0)).count() == 0
