"""Main text of web pages by a tree-structured graphical model.

The elements of a page form a tree. Each has a label, content or not, with a weight from its tag,
names, amount of text, links and signs, and each edge has a potential for the labels of parent and
child. Messages go up and down the tree once (sum-product) and give every element's chance of being
content; text of elements over one half is kept. Weights are learned from labelled pages.

Scripts, styles, heads and comments of the markup are no elements. A tag cut off by the end of a page
is dropped. A null, empty or text-free page gives an empty text. Each page is read by itself, so null
and repeated ids and further columns do not matter. Work and memory grow with the page only.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.llm.html_pages import labelled_pages

# Kinds of elements.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNREAD = frozenset("script style noscript template svg math head title iframe object canvas select option textarea button".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split()
)
#: What can stand in a head; anything else ends it, as a missing end tag would.
_IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
_CLOSES = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
}
_ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
_CUT = re.compile(r"<(?:[A-Za-z/!?][^>]*)?\Z")
_NAME = re.compile(r"[a-z]+")
_SIGNS = re.compile(r"[.!?]")


@dataclass
class Page:
    """Elements in page order (a parent before its children) and stretches of text."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    names: list[list[str]] = field(default_factory=list)
    marks: list[str | None] = field(default_factory=list)
    #: Text, its element, and the block it stands in.
    texts: list[tuple[str, int, int]] = field(default_factory=list)


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page, self.stack, self.open = Page(), [], Counter()
        self.block = self.unread = 0
        self._add("root", [])

    def _add(self, tag: str, attributes: list) -> None:
        page = self.page
        page.parents.append(self.stack[-1] if self.stack else -1)
        page.tags.append(tag)
        got = dict(attributes)
        page.names.append(_NAME.findall(" ".join(got.get(k) or "" for k in ("class", "id", "role")).lower()))
        page.marks.append(got.get("data-main"))
        self.stack.append(len(page.tags) - 1)
        self.open[tag] += 1

    def _close(self, tags: tuple[str, ...]) -> None:
        while len(self.stack) > 1:
            tag = self.page.tags[self.stack.pop()]
            self.open[tag] -= 1
            self.unread -= tag in _UNREAD
            if tag in tags:
                return

    def _end_head(self, tag: str | None) -> None:
        """Close a head that has no end tag, at its body or at anything that cannot stand in it."""
        if self.open["head"] and (tag == "body" or tag not in _IN_HEAD and self.page.tags[self.stack[-1]] == "head"):
            self._close(("head",))

    def handle_starttag(self, tag: str, attributes: list) -> None:
        self._end_head(tag)
        if tag == "br":
            self.page.texts.append((" ", self.stack[-1], self.block))
        if tag not in _INLINE and tag != "br":
            self.block += 1
        if tag in _VOID:
            return
        if tag in _ENDS_P and self.open["p"]:
            self._close(("p",))
        own = _CLOSES.get(tag, ())
        # Only within the nearest list or table, not through it.
        if own and self.page.tags[self.stack[-1]] in (*own, *_INLINE) and any(self.open[t] for t in own):
            self._close(own)
        self._add(tag, attributes)
        self.unread += tag in _UNREAD

    def handle_startendtag(self, tag: str, attributes: list) -> None:
        self.handle_starttag(tag, attributes)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in _INLINE:
            self.block += 1
        if self.open[tag] > 0:
            self._close((tag,))

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._end_head(None)
        if not self.unread:
            self.page.texts.append((data, self.stack[-1], self.block))


def read(html: str) -> Page:
    """The elements and texts of a page, however broken."""
    cut = html.rfind("<")
    if cut >= 0 and _CUT.match(html, cut):
        html = html[:cut]
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader.page


def _features(page: Page) -> list[list[str]]:
    """What is seen of each element."""
    n = len(page.tags)
    size, linked, signs = [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = page.tags[i] == "a" or in_link[page.parents[i]]
    for text, i, _ in page.texts:
        k = len(text.strip())
        size[i] += k
        linked[i] += k * in_link[i]
        signs[i] += len(_SIGNS.findall(text))
    for i in range(n - 1, 0, -1):
        up = page.parents[i]
        size[up] += size[i]
        linked[up] += linked[i]
        signs[up] += signs[i]
    out = []
    for i in range(n):
        tag = page.tags[i]
        share = 4 * linked[i] // size[i] if size[i] else 0
        seen = [f"tag {tag}", f"links {share}", f"size {min(size[i].bit_length(), 10) // 2}", f"signs {min(signs[i].bit_length(), 3)}"]
        out.append(seen + [f"name {w}" for w in set(page.names[i])])
    return out


Edges = Sequence[Sequence[float]]


@dataclass
class Model:
    """Weights of what is seen, and potentials by the labels of parent and child."""

    weights: dict[str, float]
    edges: Edges


def _labels(page: Page) -> list[int]:
    """1 for the main part and all that holds it, 0 for the rest."""
    n = len(page.tags)
    labels = [0] * n
    for i in range(n):
        up = page.parents[i]
        inside = up >= 0 and labels[up] == 1
        labels[i] = int(page.marks[i]) if page.marks[i] else int(inside)
    for i in range(n - 1, 0, -1):
        if page.marks[i] == "1" or labels[i] == 2:
            labels[page.parents[i]] = max(labels[page.parents[i]], 2)
    return [int(x > 0) for x in labels]


def _sum(a: float, b: float) -> float:
    top = max(a, b)
    return top + math.log1p(math.exp(min(a, b) - top))


def _share(a: float, b: float) -> float:
    return 1 / (1 + math.exp(max(-700.0, min(700.0, a - b))))


def _sweep(parents: list[int], on: list[float], edges: Edges) -> tuple[list[float], list[list[float]]]:
    """Marginals of all elements by one sweep of messages up the tree and one down; and expected edges by labels."""
    n = len(parents)
    on, off = list(on), [0.0] * n
    up = [(0.0, 0.0)] * n
    for i in range(n - 1, 0, -1):
        message = tuple(_sum(off[i] + edges[x][0], on[i] + edges[x][1]) for x in (0, 1))
        up[i] = message
        off[parents[i]] += message[0]
        on[parents[i]] += message[1]
    # off and on now hold the element and all below; what the rest of the tree says comes from above.
    expected = [[0.0, 0.0], [0.0, 0.0]]
    for i in range(1, n):
        p = parents[i]
        above = off[p] - up[i][0], on[p] - up[i][1]
        joint = [[above[x] + edges[x][y] + (off[i], on[i])[y] for y in (0, 1)] for x in (0, 1)]
        top = max(map(max, joint))
        joint = [[math.exp(v - top) for v in row] for row in joint]
        total = sum(map(sum, joint))
        for x in (0, 1):
            for y in (0, 1):
                expected[x][y] += joint[x][y] / total
        down = [_sum(above[0] + edges[0][y], above[1] + edges[1][y]) for y in (0, 1)]
        off[i] += down[0]
        on[i] += down[1]
    return [_share(a, b) for a, b in zip(off, on, strict=True)], expected


def train(pages: list[str], *, epochs: int = 10, rate: float = 0.1) -> Model:
    """Weights and edge potentials of greatest likelihood: observed less expected, page by page."""
    rows = []
    for html in pages:
        page = read(html)
        rows.append((page.parents, _features(page), _labels(page)))
    weights: dict[str, float] = defaultdict(float)
    edges = [[0.0, 0.0], [0.0, 0.0]]
    for epoch in range(epochs):
        step = rate / (1 + 0.5 * epoch)
        for parents, seen, labels in rows:
            on = [weights[""] + sum(weights[f] for f in own) for own in seen]
            chances, expected = _sweep(parents, on, edges)
            for own, y, chance in zip(seen, labels, chances, strict=True):
                error = step * (y - chance)
                weights[""] += error
                for f in own:
                    weights[f] += error
            for x in (0, 1):
                for y in (0, 1):
                    real = sum(labels[p] == x and label == y for p, label in zip(parents[1:], labels[1:], strict=True))
                    edges[x][y] += step * (real - expected[x][y])
    return Model(dict(weights), (tuple(edges[0]), tuple(edges[1])))


def marginals(page: Page, model: Model) -> list[float]:
    """Chance of each element to be content."""
    base = model.weights.get("", 0.0)
    on = [base + sum(model.weights.get(f, 0.0) for f in own) for own in _features(page)]
    return _sweep(page.parents, on, model.edges)[0]


def main_text(html: str, model: Model) -> str:
    """The main text: blocks in page order, white space as one space."""
    page = read(html)
    kept = marginals(page, model)
    out, last = [], None
    for text, i, block in page.texts:
        if kept[i] > 0.5:
            out += [" ", text] if block != last else [text]
            last = block
    return " ".join("".join(out).split())


def text_of(html: Column | str, model: Model) -> Column:
    """The main text of a column of pages."""

    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p, model) if p else "" for p in pages.to_pylist()], pa.string())

    return F.arrow_udf(extract, "string")(html)


def extracted(pages: DataFrame) -> DataFrame:
    """The main text of all pages, in the columns of the contract."""
    rows = pages.select("page_id", "url", text_of("html", train(labelled_pages())).alias("text"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
