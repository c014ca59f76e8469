"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of tokens: words, which score positive outside of
boilerplate, and tags, which score negative. The weights are log-odds learned
from labelled pages. One linear scan finds the contiguous run of the highest
score; it is widened to the element, and to the article, that holds it. Blocks of that element which
stand in menus, notices, adverts, forms or comments are left out, and outside
of the run those that are mostly links.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Collection, Iterator, Mapping
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed lists of HTML: elements by their content model.
RAW = frozenset("script style noscript template iframe textarea title svg select annotation".split())
#: Of these, those that go on to the end of the page without an end tag, and those that may close themselves.
ENDLESS, FOREIGN = frozenset("script style textarea title".split()), frozenset(("svg", "annotation"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body head html li dd dt td th tr tbody thead tfoot caption summary figcaption".split())
ONE_P = frozenset(("p",))
CLOSED_BY = {
    "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"},
}
SCOPE = frozenset("table ul ol dl body html article section div aside nav header footer main form".split())

#: Elements, and words of class or id, that mark boilerplate.
BOILER_TAGS = frozenset("nav header footer aside form button menu dialog head".split())
BOILER_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login"
    " masthead menu modal nav navbar navigation newsletter notice popup promo related replies respond share sharing sidebar signup social"
    " sponsor sponsored subscribe toolbar topbar widget".split()
)
#: Words that may stand beside these in a class or id without changing what it says.
BESIDE = frozenset(
    "area bar block bottom box container form global inner item items left links list main primary right secondary section site top wrap wrapper".split()
)
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())

#: An element marked by class or id alone that holds this share of the page's words outside of links is the page's frame.
FRAME = 0.9

#: Elements that hold one article and may have a header of its own.
ARTICLE = frozenset(("article", "main"))

#: A quote opens a value after an equals sign alone; anywhere else it is a character like others.
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PART = re.compile(r"[a-z]+|\d+")


@dataclass(slots=True)
class Piece:
    """A run of text with its block's number, the element it stands in and its kind; ``home``: within an article."""

    text: str
    block: int
    node: int
    kind: str
    home: bool = False


@dataclass(slots=True)
class Tag:
    name: str
    node: int
    boiler: bool
    home: bool


class Tree:
    """Elements in the order they begin, from 1; 0 is the page. ``up`` is an element's parent, ``last`` the last one within it."""

    def __init__(self):
        self.up, self.names, self.last = [0], [""], [0]

    def add(self, name: str, up: int) -> int:
        self.up.append(up)
        self.names.append(name)
        self.last.append(len(self.last))
        return len(self.up) - 1

    def close(self) -> None:
        """Elements are all there."""
        for k in range(len(self.up) - 1, 0, -1):
            self.last[self.up[k]] = max(self.last[self.up[k]], self.last[k])

    def holds(self, node: int, other: int) -> bool:
        return node <= other <= self.last[node]

    def meet(self, nodes: list[int]) -> int:
        """The innermost element that holds all ``nodes``: numbers follow the page's order, so that the first and the last one tell."""
        node, last = min(nodes), max(nodes)
        while not self.holds(node, last):
            node = self.up[node]
        return node


def _named(value: str) -> bool:
    """Whether one of the names of a class or id says boilerplate as a whole: cookie-notice does, has-sidebar doesn't."""
    for name in value.split():
        parts = set(PART.findall(name))
        if parts & BOILER_WORDS and all(x in BOILER_WORDS or x in BESIDE or x.isdigit() for x in parts):
            return True
    return False


def _boiler(tag: str, attributes: str, home: bool) -> tuple[bool, bool]:
    """Whether the element is boilerplate, and whether class or id name it so, which its content may gainsay."""
    if tag in BOILER_TAGS:
        # The header of an article holds its title.
        return not (tag == "header" and home), False
    if not attributes or tag in ("body", "html"):
        return False, False
    named = False
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values).lower(), name.lower()
        if name in ("class", "id") and tag not in ARTICLE and _named(value):
            named = True
        if name == "role" and value in BOILER_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True, False
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True, False
    return False, named


def pieces(page: str) -> tuple[list[Piece | Tag], Tree]:
    """The page's text runs and tags in order, and its elements.

    An element that class or id name boilerplate isn't if it holds every
    outermost article of the page, or nearly all of its words.
    """
    tree, named, outermost = Tree(), [], []
    found = list(_parsed(page, tree, named, outermost))
    tree.close()
    held = [k for k in named if not (outermost and all(tree.holds(k, n) for n in (outermost[0], outermost[-1])))]
    if held:
        words = [0] * (len(tree.up) + 1)
        for x in found:
            if isinstance(x, Piece) and x.kind == "word":
                words[x.node] += len(x.text.split())
        upto = [0, *accumulate(words)]
        held = [k for k in held if upto[tree.last[k] + 1] - upto[k] < FRAME * upto[-1] or not upto[-1]]
    if held:
        # Elements within a marked one are marked as well.
        marked = bytearray(len(tree.up))
        for k in held:
            marked[k] = 1
        for k in range(1, len(tree.up)):
            marked[k] |= marked[tree.up[k]]
        for x in found:
            if marked[x.node]:
                if isinstance(x, Piece):
                    x.kind = "boiler"
                else:
                    x.boiler = True
    return found, tree


class Stack:
    """Open elements, as name, number and whether they are boilerplate, and what holds of the innermost one.

    Counts of open names spare searches in vain.
    """

    def __init__(self):
        self.items: list[tuple[str, int, bool]] = []
        self.open: dict[str, int] = {}
        self.node, self.boiler, self.home = 0, False, False

    def _settle(self) -> None:
        _, self.node, self.boiler = self.items[-1] if self.items else ("", 0, False)
        self.home = not ARTICLE.isdisjoint(self.open)

    def push(self, name: str, node: int, boiler: bool) -> None:
        self.items.append((name, node, boiler))
        self.open[name] = self.open.get(name, 0) + 1
        self._settle()

    def cut(self, k: int) -> None:
        for name, _, _ in self.items[k:]:
            self.open[name] -= 1
            if not self.open[name]:
                del self.open[name]
        del self.items[k:]
        self._settle()

    def cut_at(self, names: Collection[str], stop: bool) -> None:
        """End the innermost open element of ``names``; with ``stop`` none beyond the scope."""
        if not any(x in self.open for x in names):
            return
        for k in range(len(self.items) - 1, -1, -1):
            name = self.items[k][0]
            if name in names:
                self.cut(k)
                return
            if stop and name in SCOPE:
                return


def _parsed(page: str, tree: Tree, named: list[int], outermost: list[int]) -> Iterator[Piece | Tag]:
    """As ``pieces``; what is named boilerplate goes to ``named`` and counts as content, articles outside of others to ``outermost``."""
    stack = Stack()
    block = links = 0
    at, n = 0, len(page)
    endless: set[str] = set()

    def piece(raw: str) -> Piece:
        return Piece(raw, block, stack.node, "boiler" if stack.boiler else "link" if links else "word", stack.home)

    while at < n:
        tag = TOKEN.search(page, at)
        if tag is None:
            yield piece(page[at:])
            return
        if tag.start() > at:
            yield piece(page[at : tag.start()])
        at = tag.end()
        if tag[2] is None:
            continue
        name = tag[2].lower()
        if name == "br":
            yield piece(" ")
        if name in BLOCK:
            block += 1
        yield Tag(name, stack.node, stack.boiler, stack.home)
        if tag[1]:
            links -= name == "a" and links > 0
            stack.cut_at((name,), name not in BLOCK)
            continue
        if name in RAW:
            if name in FOREIGN and tag[3].endswith("/") or name in endless:
                continue
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if end is None and name not in ENDLESS:
                endless.add(name)  # searched once: no later one has an end tag either
                continue
            at = end.end() if end else n
            continue
        if name in VOID:
            continue
        closed = CLOSED_BY.get(name, frozenset()) | (ONE_P if name in CLOSES_P else frozenset())
        if closed:
            stack.cut_at(closed, True)
        if name in BLOCK or tag[3]:
            if tag[3].endswith("/") and name not in BLOCK:
                continue
            node = tree.add(name, stack.node)
            sure, by_name = _boiler(name, tag[3], stack.home)
            if by_name:
                named.append(node)
            if name in ARTICLE and not stack.boiler and not stack.home:
                outermost.append(node)
            stack.push(name, node, stack.boiler or sure)
        links += name == "a"


# Labelled pages, written for this purpose: what stands between the marks is content.
START, STOP = "[[", "]]"
LABELLED = (
    """<html><head><title>Rivers</title></head><body><header><a href="/">Home</a> <a href="/n">News</a></header><nav><ul><li><a href="/a">World</a></li>
<li><a href="/b">Sport</a></li><li><a href="/c">Money</a></li></ul></nav>[[<article><h1>How rivers bend</h1><p>Water runs faster along the outer bank of a bend and
carries soil away, while the slow water inside lets it settle.</p><p>Year after year the bend grows until the river cuts through its neck and leaves a lake
behind.</p></article>]]<aside><h3>Read more</h3><ul><li><a href="/x">Lakes</a></li><li><a href="/y">Deltas</a></li></ul></aside><footer><p>All rights reserved.</p></footer></body></html>""",
    """<body><div class="cookie">We use cookies. <button>Accept</button></div><div id="menu"><a href="/1">One</a> <a href="/2">Two</a> <a href="/3">Three</a></div>
[[<div class="post"><h2>Bread without kneading</h2><p>Mix flour, water, salt and very little yeast, cover the bowl and let it stand overnight.</p><p>In the morning fold the dough
twice, rest it for an hour and bake it in a hot pot with the lid on.</p><p>Take off the lid for the last ten minutes so that the crust turns brown.</p></div>]]
<div class="comments"><p>Great, thanks!</p><p>Did not rise for me.</p></div><form><input name="q"><label>Search</label></form><div class="ad">Buy now</div></body>""",
    """<html><body><table><tr><td><a href="/">Index</a></td><td><a href="/l">Links</a></td></tr></table>[[<p>The town kept its walls long after the last siege, for they held the
market's tolls together.</p><blockquote>No cart went in without paying at the gate.</blockquote><p>When the railway came the walls fell within a decade, and the stones went
into the station.</p>]]<div><a href="/p">Previous</a> <a href="/n">Next</a></div><div class="footer"><a href="/i">Imprint</a> <a href="/c">Contact</a></div></body></html>""",
    """<body><nav><a href="/de">Start</a><a href="/de/k">Kultur</a><a href="/de/w">Wetter</a></nav><div class="ad">Jetzt kaufen</div>[[<main><h1>Der lange Winter</h1><p>Im Januar
lag der Schnee so hoch, dass die Post zu Fuss kam und die Schule geschlossen blieb.</p><ul><li>Am See trug das Eis einen Wagen.</li><li>Im Wald brachen die Aeste.</li></ul><p>Erst im
April sah man wieder den Boden, und die Felder standen unter Wasser.</p></main>]]<footer>Impressum <a href="/de/d">Datenschutz</a></footer></body>""",
)


def _tokens(page: str) -> list[tuple[str, int]]:
    """(kind, how many): words of a text run, and tags."""
    out = []
    for x in pieces(page)[0]:
        out.append((x.kind, len(x.text.split())) if isinstance(x, Piece) else (f"<{x.name}>", 1))
    return out


def fit(labelled: tuple[str, ...] = LABELLED) -> dict[str, float]:
    """The weight of each kind: its log-odds in content over elsewhere, smoothed.

    Words keep the sign of what the labels say of their kind; tags are held
    below zero, words outside of links and boilerplate above it, as the method
    has them.
    """
    inside, outside = Counter(), Counter()
    for page in labelled:
        start, stop = page.index(START), page.index(STOP)
        head, body, tail = page[:start], page[start + len(START) : stop], page[stop + len(STOP) :]
        for kind, n in _tokens(body):
            inside[kind] += n
        everything = Counter()
        for kind, n in _tokens(head + body + tail):
            everything[kind] += n
        outside += everything - Counter({k: n for k, n in _sum(_tokens(body)).items()})
    kinds = {*inside, *outside}
    n_in, n_out = sum(inside.values()) + len(kinds), sum(outside.values()) + len(kinds)
    odds = {k: math.log((inside[k] + 1) / n_in) - math.log((outside[k] + 1) / n_out) for k in kinds}
    tags = sum(odds[k] for k in kinds if k[0] == "<") / max(1, sum(k[0] == "<" for k in kinds))
    return {k: max(v, 0.1) if k == "word" else min(v, -0.1) for k, v in odds.items()} | {"": min(tags, -0.1)}


def _sum(tokens: list[tuple[str, int]]) -> Counter:
    out: Counter = Counter()
    for kind, n in tokens:
        out[kind] += n
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, stop) of the contiguous run with the highest sum, the first and shortest of ties; empty if none is positive."""
    best, run, start, span = 0.0, 0.0, 0, (0, 0)
    for k, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, k
        run += s
        if run > best:
            best, span = run, (start, k + 1)
    return span


def extract(page: str | None, weights: Mapping[str, float]) -> str:
    """The main text: its blocks in page order, joined by one space."""
    scores: list[float] = []
    rest = weights[""]
    found, tree = pieces(page or "")
    # Boilerplate within the content is left out anyway, and doesn't part what stands around it.
    whole = not any(x.home or isinstance(x, Tag) and x.name in ARTICLE for x in found)
    for x in found:
        if isinstance(x, Piece):
            x.text = html.unescape(x.text)
            scores.append(0.0 if x.kind == "boiler" and (whole or x.home) else len(x.text.split()) * weights.get(x.kind, rest))
        else:
            scores.append(0.0 if x.boiler and (whole or x.home) else weights.get(f"<{x.name}>", rest))
    start, stop = best_run(scores)
    core = [x for x in found[start:stop] if isinstance(x, Piece) and x.kind != "boiler" and x.text.strip()]
    if not core:
        return ""
    top = tree.meet([x.node for x in core])
    # A run that lies in one paragraph is widened to the paragraph's parent.
    if all(x.node == top for x in core):
        top = tree.up[top]
    # A run within an article is widened to the innermost one that holds it.
    home = top if core[0].home else 0
    while home and tree.names[home] not in ARTICLE:
        home = tree.up[home]
    top = home or top
    blocks: dict[int, list[Piece]] = {}
    within = {x.block for x in core}
    for x in found:
        if isinstance(x, Piece) and x.kind != "boiler" and tree.holds(top, x.node):
            blocks.setdefault(x.block, []).append(x)
    kept = (b for n, b in blocks.items() if n in within or not _mostly_links(b))
    return " ".join(t for b in kept if (t := " ".join("".join(x.text for x in b).split())))


def _mostly_links(block: list[Piece]) -> bool:
    words = Counter()
    for x in block:
        words[x.kind] += len(x.text.split())
    return words["link"] > words["word"]


def extracted(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: tuple[str, ...] = LABELLED
) -> DataFrame:
    """Per row page_id, url, text and n_chars, its code points.

    Nulls: null html has the empty text; null ids and urls stay null. Repeated
    rows each get their row; extra columns are ignored; an empty table gives
    an empty result.
    """
    weights = fit(labelled)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py(), weights) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
