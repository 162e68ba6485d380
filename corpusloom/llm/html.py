"""Main text of HTML pages: flat text blocks classified by a decision tree.

A page is read once, left to right, into flat blocks (text between block-level
tags).  A block is described by its word count and link density, those of the
blocks before and after it, and what encloses it: the region elements and the
hints in class, id and role values that are open at its start.  A small
decision tree, trained on the labelled table below, keeps or drops each block;
kept blocks are joined in page order.

What a wrapper's class says does not hold inside the ``article`` or ``main`` it
wraps, but for reader comments; words of layout (``no-sidebar``, ``has-comments``)
say nothing.  Nor do hints hold on a wrapper that calls itself the content and
holds most of the page's unlinked words.  A page that would come out empty is
read once more without the hints of whatever wraps most of its unlinked words
(reader comments excepted); if that gives nothing either, its unmarked paragraphs
are the text.

Cases: null and empty pages and pages without main text give an empty string;
repeated rows are extracted each; unclosed elements end with their region or the
page; an unclosed button, list of options or embedded object hides nothing; a tag
cut off by the end of the page is dropped; scripts, styles, titles and comments
that never end take the rest of the page, as in browsers; references without a
semicolon are decoded as browsers do.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import small_batches, tidied

#: Elements of HTML by their role here.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
EMBEDDED = frozenset("noscript template svg math canvas object audio video select button datalist".split())
SKIP = RAW | EMBEDDED
ENDS_CONTROL = re.compile(r"<(?:article|main|p|section|div|h[1-6]|ul|ol|table)\b")
REGIONS = {"nav": "menu", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "menu": "menu", "dialog": "notice"}
MAIN = frozenset(("article", "main"))
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc skip",
    "header": "masthead banner topbar siteheader",
    "footer": "footer copyright colophon legal",
    "aside": "sidebar aside related recommended widget promo share sharing social tags meta byline trending popular",
    "notice": "cookie cookies consent gdpr notice popup modal overlay alert paywall newsletter subscribe subscription signup",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored adsense dfp",
    "comments": "comment comments commentlist disqus reply replies respond discussion",
    "form": "form login signin search searchbox",
}
HINT_OF = {word: kind for kind, words in HINTS.items() for word in words.split()}
KINDS = ("menu", "header", "footer", "aside", "notice", "advert", "comments", "form")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^<>]*(?:>|\Z)|[^<]+|<", re.S)
ATTRS = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Names of elements that hold the content of a page.
CONTENT = frozenset("main content article post story entry page site".split())
#: Words that make a class name a statement about the layout.
LAYOUT = frozenset("no not non has have with without hide is enable enabled disable disabled layout".split())
LOWER = {c: c + 32 for c in range(65, 91)}
#: Kinds that may stand for a wrapper of the whole page when nothing else is left; notices, adverts and footers never do.
WRAPPING = frozenset(("menu", "header", "aside", "form"))
#: Region elements around an article or main element that still say something about it.
KEPT_REGIONS = {"article": frozenset(("aside", "footer", "notice")), "main": frozenset()}


@dataclass
class Block:
    text: str
    words: int
    linked: int  # words inside links
    tag: str
    main: bool
    kinds: frozenset

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def read_attrs(attrs: str, main: bool) -> tuple:
    """(kinds that class, id and role hint at, hidden, does a name say content, is it main by role or id).

    main: the attributes are those of an article or main element.
    """
    found, hidden, names = set(), False, set()
    for m in ATTRS.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            for token in value.split():
                words = [w.lower() for w in SPLIT.split(token) if w]
                if words and CONTENT.issuperset(words):
                    names.add((name, *words))
                if not words or words[0] == "content" or LAYOUT.intersection(words):
                    continue
                kinds = {HINT_OF[w] for w in words if w in HINT_OF}
                if main:  # an article's classes often name its topics
                    kinds &= {"comments"} if len(words) > 1 else {"comments", "advert", "aside", "notice"}
                found |= kinds
        elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and INVISIBLE.search(value):
            hidden = True
    return frozenset(found), hidden, bool(names), ("role", "main") in names or ("id", "main") in names or ("id", "content") in names


def skipped(low: str, name: str, at: int) -> int:
    """Where a skipped element that starts before ``at`` ends; ``at`` itself if it never does. low: the page in lower case.

    A control without an end, or with a long one, ends where a block begins.
    """
    if name in RAW:
        close = low.find("</" + name, at)
        return len(low) if close < 0 else close
    control, depth, end = name in ("button", "select", "datalist"), 1, -1
    for m in re.compile(rf"<(/?){name}(?=[\s/>])").finditer(low, at):
        depth += -1 if m[1] else 1
        if not depth or control:
            end = m.start()
            break
    if control and (end < 0 or depth or len(low[at:end].split()) > 30):
        block = ENDS_CONTROL.search(low, at, end if end >= 0 else len(low))
        end = block.start() if block else end
    return end if end >= 0 else at


def lowered(page: str) -> str:
    """The page in lower case, every character in its place."""
    low = page.lower()
    return low if len(low) == len(page) else page.translate(LOWER)


def blocks(page: str, free: frozenset = frozenset(), marked: dict | None = None) -> list:
    """The flat text blocks of a page.

    free: numbers of elements (in page order) whose hints count for nothing.
    marked: takes number -> [unlinked words, says content, kinds, number around it] of the elements with hints.
    """
    out: list = []
    stack: list = []  # (tag, kinds, main, hidden, kinds by region elements, innermost element with hints) of open elements
    number = 0
    text: list = []
    linked = 0
    tag_of = ""
    anchor = 0

    def flush():
        nonlocal text, linked
        if text:
            flat = " ".join("".join(text).split())
            if flat:
                inside = stack[-1] if stack else ("", frozenset(), False)
                if marked is not None and stack and stack[-1][5]:
                    marked[stack[-1][5]][0] += flat.count(" ") + 1 - linked
                out.append(Block(flat, flat.count(" ") + 1, linked, tag_of or inside[0], inside[2], inside[1]))
            text = []
        linked = 0

    skip = None
    low = None
    at, end = 0, len(page)
    while at < end:
        if skip:
            low = low if low is not None else lowered(page)
            at = skipped(low, skip, at)
            skip = None
            if at == end:
                break
        m = TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            raw = m[0]
            if raw[0] != "<" or raw == "<":
                if not (stack and stack[-1][3]):
                    part = unescape(raw) if "&" in raw else raw
                    if anchor:
                        linked += len(part.split())
                    text.append(part)
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                anchor = max(0, anchor - 1)
            if name in INLINE or name in SKIP or name == "head":
                continue
            flush()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    if name == "p" or not any(s[0] in MAIN or s[0] in REGIONS for s in stack[depth + 1 :]) or name in MAIN or name in REGIONS or name in ("body", "html"):
                        del stack[depth:]
                    break
            tag_of = ""
            continue
        if name in SKIP:
            if not m[3].endswith("/"):
                skip = name
            if name in ("title", "select", "textarea"):
                flush()
            continue
        if name == "head":
            continue
        if name == "a":
            anchor += 1
        if name in INLINE:
            continue
        flush()
        if name in VOID:
            continue
        anchor = 0
        if name in CLOSES_P and stack and stack[-1][0] == "p":
            stack.pop()
        if name in ("li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:
            stack.pop()
        kinds, main, hidden, regions = stack[-1][1:5] if stack else (frozenset(), False, False, frozenset())
        if name in MAIN:
            if not main:
                regions = regions & KEPT_REGIONS[name]
                kinds = regions | (kinds & {"comments"})
            main = True
        number += 1
        own, says = frozenset(), False
        region = REGIONS.get(name)
        if region:
            own = frozenset((region,))
        if m[3] and name not in ("html", "body"):
            found, unseen, says, by_name = read_attrs(m[3], name in MAIN)
            hidden = hidden or unseen
            if by_name and not own and name not in MAIN and not main:
                kinds, regions = kinds & {"comments"}, frozenset()
            own = own | found
        around = stack[-1][5] if stack else 0
        hinted = bool(own) and region in (None, "form")  # a form may wrap the page; other region elements mean what they say
        if hinted and marked is not None:
            marked[number] = [0, says, own, around]
        if number not in free:
            kinds = kinds | own
            regions = regions | {region} if region else regions
        stack.append((name, kinds, main, hidden, regions, number if hinted else around))
        tag_of = ""
    flush()
    for n in sorted(marked or (), reverse=True):  # inner elements have greater numbers
        if marked[n][3]:
            marked[marked[n][3]][0] += marked[n][0]
    return out


# ------------------------------------------------------------ features and tree
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "main", "heading", "marked", *KINDS)


def describe(found: list) -> np.ndarray:
    """One row of FEATURES for each block."""
    n = len(found)
    out = np.zeros((n, len(FEATURES)))
    for i, b in enumerate(found):
        out[i, 0], out[i, 1] = b.words, b.density
        out[i, 6], out[i, 7] = b.main, b.tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        out[i, 8] = bool(b.kinds)
        for k, kind in enumerate(KINDS):
            out[i, 9 + k] = kind in b.kinds
    out[1:, 2:4] = out[:-1, 0:2]
    out[:-1, 4:6] = out[1:, 0:2]
    return out


#: The labelled table: blocks of everyday page layouts. Columns: words, link density, words and density before,
#: words and density after, enclosing main element (m) or heading (h) or kinds, main text (1) or not (0).
LABELLED = """
6 1.0 0 0.0 1 1.0 menu 0
1 1.0 6 1.0 8 0.0 menu 0
3 1.0 1 1.0 12 0.0 menu 0
12 0.0 4 1.0 9 0.0 menu 0
5 0.0 0 0.0 1 1.0 header 0
9 0.0 5 0.0 60 0.0 header 0
14 0.0 6 1.0 9 0.0 advert 0
30 0.1 9 0.0 80 0.0 advert 0
8 0.0 90 0.0 70 0.0 m+advert 0
40 0.0 90 0.0 70 0.0 m+advert 0
9 0.0 14 0.0 80 0.0 m+h 1
4 0.0 70 0.0 65 0.0 m+h 1
2 0.0 70 0.0 65 0.0 m+h 1
80 0.0 9 0.0 50 0.0 m 1
50 0.05 80 0.0 1 0.0 m 1
1 0.0 50 0.0 1 0.0 m 1
2 0.0 1 0.0 120 0.1 m 1
120 0.1 2 0.0 15 0.0 m 1
15 0.0 120 0.1 20 0.2 m 1
6 0.0 15 0.0 0 0.0 m 1
1 0.0 14 0.0 12 0.0 m 1
3 0.0 9 0.0 10 0.1 m 1
10 0.5 60 0.0 70 0.0 m 1
18 0.3 60 0.0 70 0.0 m 1
9 0.0 40 0.0 12 0.0 footer 0
25 0.0 60 0.0 0 0.0 footer 0
12 0.4 9 0.0 0 0.0 footer 0
2 0.0 90 0.0 9 0.0 footer 0
60 0.0 9 0.0 5 0.3 aside 0
5 1.0 60 0.0 6 1.0 aside 0
6 0.9 80 0.0 7 0.9 m+aside 0
30 0.0 80 0.0 7 0.9 m+aside 0
25 0.0 40 0.0 3 0.0 notice 0
3 0.5 25 0.1 80 0.0 notice 0
45 0.0 10 0.0 90 0.0 m+notice 0
60 0.0 90 0.0 45 0.0 comments 0
45 0.0 60 0.0 2 0.5 comments 0
4 0.0 90 0.0 45 0.0 m+comments 0
35 0.0 90 0.0 45 0.0 m+comments 0
3 0.0 9 0.0 2 0.0 form 0
20 0.0 9 0.0 80 0.0 form 0
6 0.0 70 0.0 2 0.0 m+form 0
9 0.0 10 0.9 70 0.0 h 1
70 0.0 9 0.0 85 0.0 . 1
85 0.0 70 0.0 30 0.1 . 1
30 0.1 85 0.0 12 0.0 . 1
12 0.0 30 0.1 60 0.0 . 1
60 0.0 12 0.0 6 1.0 . 1
16 0.0 60 0.0 14 0.0 . 1
3 0.0 60 0.0 40 0.0 . 1
30 0.0 0 0.0 60 0.0 . 1
18 0.0 0 0.0 0 0.0 . 1
22 0.1 1 0.0 30 0.0 . 1
28 0.0 6 0.0 20 0.0 . 1
15 0.0 7 0.0 28 0.0 . 1
5 1.0 60 0.0 6 1.0 . 0
6 1.0 5 1.0 4 1.0 . 0
4 0.8 6 1.0 3 0.0 . 0
12 0.9 5 1.0 8 1.0 . 0
25 0.8 6 1.0 10 0.7 . 0
10 0.7 25 0.8 0 0.0 . 0
40 0.7 8 1.0 6 0.9 . 0
3 0.0 4 0.8 0 0.0 . 0
4 0.0 6 1.0 5 1.0 . 0
2 0.0 0 0.0 5 1.0 . 0
"""


def labelled(copies: int = 40, seed: int = 7) -> tuple:
    """The table as (rows of FEATURES, marks), widened by rule.

    What an enclosing element says does not depend on lengths or neighbours, so
    rows with one are repeated with lengths and neighbours of other rows; the
    lengths of rows without one vary by up to a quarter.
    """
    rows, marks, places = [], [], []
    for line in LABELLED.split("\n"):
        if line.strip():
            *numbers, where, mark = line.split()
            where = set(where.split("+"))
            rows.append([*map(float, numbers), float("m" in where), float("h" in where), float(bool(where & {*KINDS})), *(float(k in where) for k in KINDS)])
            marks.append(int(mark))
            places.append(bool(where & {"m", *KINDS}))
    x, y, place = np.array(rows), np.array(marks), np.array(places)
    rng = np.random.default_rng(seed)
    wide = [x]
    for _ in range(copies):
        new = x.copy()
        for columns in ((0,), (2, 3), (4, 5)):
            other = rng.permutation(len(x))
            new[np.ix_(place, columns)] = x[other][np.ix_(place, columns)]
        new[~place] *= np.r_[rng.uniform(0.75, 1.25), 1.0, rng.uniform(0.75, 1.25), 1.0, rng.uniform(0.75, 1.25), np.ones(len(FEATURES) - 5)]
        new[:, [0, 2, 4]] = np.round(new[:, [0, 2, 4]])
        wide.append(new)
    return np.concatenate(wide), np.tile(y, copies + 1)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 1) -> tuple:
    """A binary tree by Gini impurity: (feature, threshold, left, right) or a leaf's share of main text."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return (share,)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            n = int(low.sum())
            if n < least or len(y) - n < least:
                continue
            p, q = y[low].mean(), y[~low].mean()
            loss = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
            if best is None or loss < best[0] - 1e-12:
                best = (loss, f, float(cut), low)
    if best is None:
        return (share,)
    _, f, cut, low = best
    return (f, cut, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def classify(tree: tuple, x: np.ndarray) -> np.ndarray:
    """Share of main text in the leaf of each row."""
    out = np.zeros(len(x))
    todo = [(tree, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if len(node) == 1:
            out[rows] = node[0]
            continue
        f, cut, left, right = node
        low = x[rows, f] <= cut
        todo += [(left, rows[low]), (right, rows[~low])]
    return out


def train() -> tuple:
    return grow(*labelled())


def kept(found: list, tree: tuple) -> list:
    """Texts of the blocks that the tree takes for main text."""
    return [b.text for b, share in zip(found, classify(tree, describe(found))) if share >= 0.5]


def main_text(page: str, tree: tuple) -> str:
    marked: dict = {}
    found = blocks(page, frozenset(), marked)
    if not found:
        return ""
    half = sum(b.words - b.linked for b in found) / 2
    most = {n: (says, kinds) for n, (words, says, kinds, _) in marked.items() if words > half and "comments" not in kinds}
    free = frozenset(n for n, (says, _) in most.items() if says)
    if free:
        found = blocks(page, free)
    texts = kept(found, tree)
    if not texts and len(most) > len(free):
        found = blocks(page, frozenset(n for n, (_, kinds) in most.items() if kinds <= WRAPPING))
        texts = kept(found, tree)
    if not texts:
        texts = [b.text for b in found if not b.kinds and (b.main or b.tag == "p" and b.density < 0.5)]
    return " ".join(texts)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    small_batches(pages.sparkSession)
    tree = train()
    picked = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def run(batches):
        for batch in batches:
            texts = [main_text(page, tree) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return picked.mapInArrow(tidied(run), "page_id long, url string, text string, n_chars long")
