"""HTML extraction by minimum-cut labelling of blocks.

A page becomes text blocks in page order, each with its chain of open elements. A logistic classifier gives each block
the cost of being called content and of being called boilerplate; these are its capacities to the two terminals. Its
weights for what a block's text looks like (length, links, sentences, legal lines) are fitted: on a bounded sample of
pages that mark their article by <article> or <main>, the blocks within and without are weak labels, and the weights are
the most probable ones given these and a prior. Evidence from elements and class names is graded: a name that says
nothing else ("sidebar", "site-footer") weighs fully, one of several words ("share-price") only tilts.

Blocks that follow one another, or that have the same parent, are joined by smoothness edges, of a strength like that of
a tilt, so that a doubtful block goes with its neighbours. The minimum cut between the terminals is the labelling of
least total cost; a block whose terminal outweighs all its edges is decided at once, which leaves few for max-flow.
Content blocks are joined in page order.

Defined results: a null or empty page gives an empty text; a page without content gives an empty text; unclosed
elements, comments, scripts and cut-off tags end with the page; stray end tags are skipped; a very long page is
parsed in time proportional to its length, and its doubtful blocks are cut by blocking flows; repeated rows are answered alike; nulls in page_id and url stay; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_library
import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tag: a quoted value may hold ">", and only follows "=".
_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:[^>=]|=(?:\s*(?:"[^"]*"|'[^']*'))?)*+)>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_LEGAL = re.compile(r"\u00a9|copyright|all rights reserved", re.I)

#: Elements whose content is no markup and is never shown as text.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
#: An opening tag of the key ends an open element of the values.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul", "figure"}
OUTSIDE_TAGS = {"nav", "footer", "aside", "form", "menu", "button", "select", "datalist", "dialog", "template", "head", "header"}
INSIDE_TAGS = {"article", "main"}
OUTSIDE_WORDS = {"ad", "ads", "advert", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "discussion", "disqus", "dropdown", "footer", "gdpr", "header", "hidden", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tabs", "toolbar", "trending", "widget"}
INSIDE_WORDS = {"article", "articlebody", "body", "content", "entry", "main", "post", "story", "text"}
#: Words of names that say where or what kind of box, so that the other words decide.
PLAIN_WORDS = {"area", "bar", "block", "bottom", "box", "button", "buttons", "center", "col", "column", "container", "content", "footer", "form", "global", "group", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "page", "posts", "primary", "right", "secondary", "section", "site", "thread", "top", "wrap", "wrapper"}
#: Evidence of a name with other words besides.
TILT = 0.35
#: What raises (or lowers) the log odds of content. Those of TEXT are the prior of the fit, the others stand.
WEIGHTS = {"bias": -0.6, "log_words": 0.55, "links": -3.0, "heading": 0.5, "sentence": 0.4, "legal": -2.5, "inside": 3.0, "beside": -2.5, "outside": -7.0}
TEXT = ("bias", "log_words", "links", "heading", "sentence", "legal")
ADJACENT, SIBLING = 0.6, 0.9
#: Pages of the sample, those of the least hashes, and how many blocks the prior counts for.
SAMPLE_PAGES = 2000
PRIOR_BLOCKS = 400.0
#: Of a page of the sample at most so many blocks are learned from, evenly spaced.
LABELS_OF_A_PAGE = 60


def _evidence(tag: str, attributes: str) -> tuple[float, float]:
    """How much an element's tag and names say that it holds content, and that it holds boilerplate; from 0 to 1."""
    inside, outside = float(tag in INSIDE_TAGS), float(tag in OUTSIDE_TAGS)
    if "=" in attributes or "hidden" in attributes.lower():
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id", "role", "itemprop", "aria-label"):
                for one in value.split():
                    words = {w.lower() for w in _TOKEN.findall(one)} | ({one.lower()} & (OUTSIDE_WORDS | INSIDE_WORDS))
                    for bag, other in ((INSIDE_WORDS, OUTSIDE_WORDS), (OUTSIDE_WORDS, INSIDE_WORDS)):
                        if not words.isdisjoint(bag):
                            strength = 1.0 if words <= bag | PLAIN_WORDS and (bag is OUTSIDE_WORDS or words.isdisjoint(other)) else TILT
                            if bag is INSIDE_WORDS:
                                inside = max(inside, strength)
                            else:
                                outside = max(outside, strength)
            elif name == "hidden" or name == "style" and _HIDDEN.search(value) or name == "aria-hidden" and value == "true":
                outside = 1.0
    if tag in ("body", "html"):
        return 0.0, 0.0
    return inside, outside


class _Element:
    __slots__ = ("tag", "inside", "outside", "form", "parent", "block")

    def __init__(self, tag: str, parent: _Element | None, attributes: str):
        self.tag, self.parent = tag, parent
        self.inside, self.outside = _evidence(tag, attributes)
        self.form = tag == "form" and self.outside == 1.0
        self.block = self if tag not in INLINE or parent is None else parent.block  # the nearest element that is a block
        if parent is not None:
            if tag == "header" and parent.inside:
                self.outside = 0.0  # a header within an article holds its title, one elsewhere the page's
            # some pages are one form, and a doubtful name does not reach into an article
            if not (tag in INSIDE_TAGS and (parent.form or parent.outside < 1)):
                self.outside, self.form = max(self.outside, parent.outside), self.form or parent.form
            self.inside = max(self.inside, parent.inside)


class Block:
    __slots__ = ("text", "parent", "link_chars", "heading")

    def __init__(self, text: str, parent: _Element, link_chars: int, heading: bool):
        self.text, self.parent, self.link_chars, self.heading = text, parent, link_chars, heading


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; scripts, styles and comments are none."""
    out: list[Block] = []
    root = here = _Element("", None, "")
    opened: dict[str, int] = {}  # how many elements of a tag are open
    parts: list[str] = []
    link_chars, heading, parent = 0, False, root

    def close() -> None:
        nonlocal parts, link_chars
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, parent, link_chars, heading))
            parts = []
        link_chars = 0

    def pop(node: _Element) -> None:
        """Ends node and all that is open within it."""
        nonlocal here
        while here is not node.parent:
            opened[here.tag] -= 1
            here = here.parent

    def add(text: str) -> None:
        nonlocal parent, heading, link_chars
        if not parts:
            parent = here.block
            heading = parent.tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        parts.append(text)
        if opened.get("a"):
            link_chars += len(text)

    at, n = 0, len(page)
    while at < n:
        mark = page.find("<", at)
        if mark < 0:
            mark = n
        if mark > at:
            text = page[at:mark]
            add(html_library.unescape(text) if "&" in text else text)
            at = mark
            continue
        if page.startswith("<!--", at):
            if page.startswith(("<!-->", "<!--->"), at):
                at = page.find(">", at) + 1
                continue
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        following = page[at + 1 : at + 3]
        if following[:1] in ("!", "?") or following[:1] == "/" and following[1:] and not (following[1:].isascii() and following[1:].isalpha()):
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        tag = _TAG.match(page, at)
        if not tag:
            if re.match(r"/?[a-zA-Z]", following):
                break  # the page was cut within a tag
            add("<")
            at += 1
            continue
        name, closing = tag[1].lower(), following[0] == "/"
        at = tag.end()
        if not closing and name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            close_at = page.find(">", end.end()) if end else -1
            at = n if close_at < 0 else close_at + 1
            continue
        if name not in INLINE:
            close()
        if closing:
            if opened.get(name):
                node = here
                while node.tag != name:
                    node = node.parent
                pop(node)
            continue
        if opened.get("head") and name not in HEAD:
            node = here
            while node.tag != "head":
                node = node.parent
            pop(node)
        ends = CLOSES.get(name, ())
        if name in ENDS_P and opened.get("p") or any(opened.get(x) for x in ends):
            node = here.block
            while node is not root and (node.tag in ends or node.tag == "p"):
                above = node.parent.block
                pop(node)
                if node.tag != "p":
                    break
                node = above
        foreign = tag[2].endswith("/") and (opened.get("svg") or opened.get("math"))  # only there a slash ends an element
        if name not in VOID and not foreign:
            here = _Element(name, here, tag[2])
            opened[name] = opened.get(name, 0) + 1
    close()
    return out


def _features(block: Block, any_inside: bool) -> list[float]:
    """In the order of WEIGHTS."""
    node, text = block.parent, block.text
    return [
        1.0,
        math.log1p(text.count(" ") + 1),
        min(1.0, block.link_chars / max(len(text), 1)),
        float(block.heading),
        float(text[-1] in ".!?:;\"'\u201d\u00bb"),
        float(len(text) < 400 and bool(_LEGAL.search(text))),
        node.inside,
        (1 - node.inside) * any_inside,
        node.outside,
    ]


def weak_labels(found: list[Block]) -> list[tuple[list[float], int]]:
    """(text features, label) of the blocks of a page that marks its article by a tag; none of other pages."""

    def within(node: _Element | None, tags: set[str]) -> bool:
        while node is not None:
            if node.tag in tags:
                return True
            node = node.parent
        return False

    inside = {id(b.parent): within(b.parent, INSIDE_TAGS) and not within(b.parent, OUTSIDE_TAGS) for b in found}
    if not any(inside.values()):
        return []
    return [(_features(b, True)[: len(TEXT)], int(inside[id(b.parent)])) for b in found]


def fit_weights(x: np.ndarray, y: np.ndarray, prior_blocks: float = PRIOR_BLOCKS) -> list[float]:
    """The most probable weights: the TEXT ones of a logistic regression with WEIGHTS as prior, and the others of WEIGHTS. Each label weighs the same."""
    prior = np.array([WEIGHTS[k] for k in TEXT])
    w = prior.copy()
    if len(y):
        weight = np.where(y == 1, 0.5 / max((y == 1).mean(), 1e-9), 0.5 / max((y == 0).mean(), 1e-9)) if 0 < y.mean() < 1 else np.zeros(len(y))
        for _ in range(50):  # Newton steps
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            gradient = x.T @ (weight * (p - y)) + prior_blocks * (w - prior)
            hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + prior_blocks * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w = w - step
            if np.abs(step).max() < 1e-9:
                break
    return [*w.tolist(), *(v for k, v in WEIGHTS.items() if k not in TEXT)]


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut: gain is a node's capacity from the source less that to the sink, edges go both ways."""
    n = len(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    gain = [*gain]
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:  # a node that its terminal binds more than all its edges is decided; its edges then pull as terminals do
        i = todo.popleft()
        if side[i] is None and abs(gain[i]) >= sum(near[i].values()):
            side[i] = gain[i] > 0
            for j, w in near[i].items():
                gain[j] += w if side[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        spot = {i: k for k, i in enumerate(rest)}
        reached = _flow([gain[i] for i in rest], [(spot[i], spot[j], w) for i in rest for j, w in near[i].items() if i < j])
        for i in rest:
            side[i] = reached[spot[i]]
    return [bool(s) for s in side]


def _flow(gain: list[float], edges: list[tuple[int, int, float]], least: float = 1e-12) -> list[bool]:
    """Which nodes a maximum flow leaves within reach of the source, by blocking flows: a round numbers nodes by their distance from supply and saturates all ways on which it grows, to whatever demand they lead, so each demand that is left is farther from supply in the next."""
    n = len(gain)
    supply, demand = [max(g, 0.0) for g in gain], [max(-g, 0.0) for g in gain]
    to, cap, arcs = [], [], [[] for _ in range(n)]
    for a, b, w in edges:  # arc k ^ 1 is the way back of arc k
        arcs[a].append(len(to))
        arcs[b].append(len(to) + 1)
        to += (b, a)
        cap += (w, w)
    while True:
        level = [-1] * n
        front = [i for i in range(n) if supply[i] > least]
        for i in front:
            level[i] = 0
        reached, met = [*front], False
        while front:
            after = []
            for i in front:
                met = met or demand[i] > least
                for k in arcs[i]:
                    if cap[k] > least and level[to[k]] < 0:
                        level[to[k]] = level[i] + 1
                        after.append(to[k])
            reached += after
            front = after
        if not met:
            found = [False] * n
            for i in reached:
                found[i] = True
            return found
        tried = [0] * n
        for start in [i for i in reached if level[i] == 0]:
            nodes, way = [start], []
            while nodes and supply[start] > least:
                i = nodes[-1]
                if demand[i] > least:
                    flow = min(supply[start], demand[i], *(cap[k] for k in way))
                    supply[start] -= flow
                    demand[i] -= flow
                    full = len(way)
                    for at in range(len(way) - 1, -1, -1):
                        k = way[at]
                        cap[k] -= flow
                        cap[k ^ 1] += flow
                        if cap[k] <= least:
                            full = at
                    del way[full:], nodes[full + 1 :]
                    continue
                own = arcs[i]
                while tried[i] < len(own) and not (cap[own[tried[i]]] > least and level[to[own[tried[i]]]] == level[i] + 1):
                    tried[i] += 1
                if tried[i] < len(own):
                    way.append(own[tried[i]])
                    nodes.append(to[own[tried[i]]])
                else:  # no way on from here in this round
                    level[i] = n + 1
                    nodes.pop()
                    if way:
                        way.pop()


def graph(found: list[Block], weights: list[float]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """What binds each block to content rather than boilerplate, and the smoothness edges."""
    any_inside = any(b.parent.inside == 1 and b.parent.outside < 1 for b in found)
    gain = [sum(w * f for w, f in zip(weights, _features(b, any_inside))) for b in found]  # softplus(z) - softplus(-z) = z
    edges, last_of = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, ADJACENT))
        for node, weight in ((b.parent, SIBLING), (b.parent.parent, SIBLING / 2)):
            if node is not None:
                if (j := last_of.get(id(node))) is not None and j != i:
                    edges.append((j, i, weight))
                last_of[id(node)] = i
    return gain, edges


def main_text(page: str | None, weights: list[float] | None = None) -> str:
    """The text of a page's article."""
    found = blocks(page or "")
    keep = minimum_cut(*graph(found, weights or [*WEIGHTS.values()]))
    return " ".join(b.text for b, k in zip(found, keep) if k)


def fit(pages: DataFrame, html: str = "html", page_id: str = "page_id", sample_pages: int = SAMPLE_PAGES) -> list[float]:
    """Weights for these pages, from the sample_pages with the least hashes of their id."""
    code = F.xxhash64(F.col(page_id).cast("string"))
    chosen = pages.select(code.alias("code"), F.col(page_id).cast("string").alias("id")).where("id IS NOT NULL").distinct().orderBy("code", "id").limit(sample_pages)
    rows = pages.select(F.col(page_id).cast("string").alias("id"), F.col(html).cast("string").alias("html")).join(F.broadcast(chosen.select("id")), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                labels = weak_labels(blocks(page or ""))
                labels = labels[:: -(-len(labels) // LABELS_OF_A_PAGE) or 1]
                yield pa.record_batch([pa.array([i] * len(labels), pa.string()), pa.array([x for x, _ in labels], pa.list_(pa.float64())), pa.array([y for _, y in labels], pa.int32())], ["id", "x", "y"])

    got = sorted((r.id, r.y, r.x) for r in rows.mapInArrow(run, "id string, x array<double>, y int").collect())
    return fit_weights(np.array([x for _, _, x in got]).reshape(-1, len(TEXT)), np.array([y for _, y, _ in got]))


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), weights: list[float] | None = None) -> DataFrame:
    """The columns keep with text and n_chars of each page; weights as of fit()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [main_text(x, weights) for x in part.column(0).to_pylist()]
                yield pa.record_batch([*part.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    rows = pages.select(F.col(html).cast("string").alias("__html"), *keep)
    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]), "text string, n_chars long"]))
