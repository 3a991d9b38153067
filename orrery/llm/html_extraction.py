"""Main text of web pages by tree scoring.

A page becomes a tree of elements (void elements, implied ends of p, li, td and the like, raw text of script and style, comments and
entities are understood; what isn't closed ends with its parent). Every paragraph (PARAGRAPHS, and any other block that holds
text itself) of at least LEAST letters earns 1 point, 1 for each comma, and 1 for each 100 letters, at most 3. All of it goes to its parent,
half to the next ancestor, a sixth, an eighth, a tenth, ... to those above, as far as REACH ancestors. An element's score, with a start by its tag, is
discounted by its link density: letters inside links over all letters. The best container, the first of equals, is kept together with
those siblings whose score is at least a fifth of its (and at least 10), or that are paragraphs with few links. Navigation, headers' and
footers' text, forms and the like count for nothing. Time is in proportion to the page, however deep its elements or broken its tags: open
elements are found by tag, and a tag with more than PIECES quoted and unquoted pieces ends at its first >.

Defined results: a null html has a null text and title; an empty page and one without any paragraph give all text outside boilerplate, which
may be ''; broken markup never fails; a null id stays; rows that repeat are extracted alike; an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, REACH, PIECES = 25, 16, 512
PARAGRAPHS = frozenset("p pre td blockquote".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BOILERPLATE = frozenset("nav footer aside form button select header head menu svg object dialog".split())
START = {"article": 5, "main": 5, "section": 2, "div": 2, "pre": 3, "td": 3, "blockquote": 3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5, "th": -5}
#: What an opening tag ends, up to the nearest of the elements that hold it.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"})}
HOLDERS = frozenset("td th table body button object".split())
_TOKEN = re.compile(rf"<!--(?:.*?-->|.*)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'){{0,{PIECES}}}+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|([^<]++|<)", re.S)
_SPACE = re.compile(r"\s+")
_CLASS = re.compile(r"(?:class|id)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_GOOD, _BAD = re.compile(r"article|body|content|entry|main|post|story|text", re.I), re.compile(r"\b(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|cookie\w*|footer|menu|nav\w*|popup|promo\w*|related|share\w*|sidebar|social|sponsor\w*|widget)\b", re.I)
_CLOSE = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in RAW}


class Tree:
    """Elements in document order: tag, parent, and the range of text pieces inside; pieces with their element."""

    def __init__(self, page: str) -> None:
        self.tags, self.parents, self.weights, self.first, self.last = ["#"], [-1], [0], [0], [0]
        self.pieces: list[tuple[int, str]] = []  # element, text; an element number below zero breaks the line
        self.title: str | None = None
        self.stack, self.open = [0], {}  # open elements, and for each tag where in the stack it stands
        stack, at, end = self.stack, 0, len(page)
        closed = page.rfind(">") + 1  # no tag ends behind it
        match = _TOKEN.match
        while at < end:
            if at >= closed and (c := page.find("<!--", at)) != at:
                self.pieces.append((stack[-1], page[at:c] if c > 0 else page[at:]))
                break
            m = match(page, at)
            at = m.end()
            if (text := m[7]) is not None:
                self.pieces.append((stack[-1], text))
                continue
            close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if close:
                if places := self.open.get(tag):
                    self.leave(places[-1])
                if tag in BLOCKS:
                    self.pieces.append((-1, ""))
                continue
            if tag in RAW:
                c = _CLOSE[tag].search(page, at)
                inner = page[at : c.start() if c else end]
                if tag == "title" and self.title is None:
                    self.title = _SPACE.sub(" ", entities.unescape(inner)).strip()
                at = c.start() if c else end
                if c:
                    at = page.find(">", at) + 1 or end
                continue
            if tag in BLOCKS or tag == "br":
                self.pieces.append((-1, ""))
            if tag in VOID:
                continue
            if tag in BLOCKS:
                self.imply({"p"}, HOLDERS)
            if tag in ENDS:
                self.imply(*ENDS[tag])
            if attributes.endswith("/") and tag not in BLOCKS:
                continue
            self.tags.append(tag)
            self.parents.append(stack[-1])
            self.first.append(len(self.pieces))
            self.last.append(-1)
            weight = START.get(tag, 0)
            if attributes and tag in BLOCKS and (names := _CLASS.findall(attributes)):
                weight += 25 * (any(map(_GOOD.search, names)) - any(map(_BAD.search, names)))
            self.weights.append(weight)
            self.open.setdefault(tag, []).append(len(stack))
            stack.append(len(self.tags) - 1)
        self.leave(1)
        self.last[0] = len(self.pieces)

    def leave(self, i: int) -> None:
        for x in self.stack[i:]:
            self.last[x] = len(self.pieces)
        for x in reversed(self.stack[i:]):
            self.open[self.tags[x]].pop()
        del self.stack[i:]

    def imply(self, what: set, within: set) -> None:
        nearest = max((p[-1] for t in what if (p := self.open.get(t))), default=0)
        if nearest and all(not (p := self.open.get(t)) or p[-1] <= nearest for t in within - what):
            self.leave(nearest)


def _joined(pieces: list[tuple[int, str]]) -> str:
    out, line = [], []
    for node, text in [*pieces, (-1, "")]:
        if node >= 0:
            line.append(text)
        elif line:
            if s := _SPACE.sub(" ", entities.unescape("".join(line))).strip():
                out.append(s)
            line = []
    return "\n".join(out)


def extract(page: str, least: int = LEAST) -> tuple[str, str | None, float]:
    """Text, title and the best container's score."""
    tree = Tree(page)
    tags, parents, n = tree.tags, tree.parents, len(tree.tags)
    dead, link, block = [False] * n, [False] * n, list(range(n))  # block: the nearest block around an element
    for i in range(1, n):
        if tags[i] not in BLOCKS:
            block[i] = block[parents[i]]
        dead[i] = dead[parents[i]] or tags[i] in BOILERPLATE
        link[i] = link[parents[i]] or tags[i] == "a"
    letters, links, commas, own, own_commas = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for node, text in tree.pieces:
        if node >= 0 and not dead[node] and (k := len(text) if " " not in text[:1] + text[-1:] else len(text.strip())):
            letters[node] += k
            links[node] += k * link[node]
            commas[node] += (c := text.count(","))
            own[block[node]] += k
            own_commas[block[node]] += c
    for i in range(n - 1, 0, -1):
        letters[parents[i]] += letters[i]
        links[parents[i]] += links[i]
        commas[parents[i]] += commas[i]
    scores: dict[int, float] = {}
    for i in range(1, n):
        if dead[i] or own[i] < least or tags[i] not in BLOCKS or tags[i] in ("h1", "h2", "h3", "h4", "h5", "h6"):
            continue
        size, marks = (letters[i], commas[i]) if tags[i] in PARAGRAPHS else (own[i], own_commas[i])
        points = 1 + marks + min(size // 100, 3)
        points *= 1 - links[i] / letters[i]
        up, level = parents[i], 0
        while up > 0 and level < REACH:
            scores[up] = scores.get(up, tree.weights[up]) + (points if level == 0 else points / 2 if level == 1 else points / (2 * (level + 1)))
            up, level = parents[up], level + 1
    scores = {i: s * (1 - links[i] / letters[i]) if s > 0 else s for i, s in scores.items() if letters[i]}
    if not scores:
        return _joined([(x, t) for x, t in tree.pieces if x < 0 or not dead[x]]), tree.title, 0.0
    best = max(sorted(scores), key=lambda i: scores[i])
    bar, kept = max(10, scores[best] / 5), []
    for i in range(1, n):
        if i == best:
            kept.append(i)
        elif parents[i] == parents[best] and not dead[i] and letters[i]:
            density = links[i] / letters[i]
            if scores.get(i, 0) >= bar or tags[i] == "p" and (letters[i] > 80 and density < 0.25 or density == 0 and re.search(r"[.!?](?:\s|$)", "".join(t for x, t in tree.pieces[tree.first[i] : tree.last[i]] if x >= 0))):
                kept.append(i)
    pieces: list[tuple[int, str]] = []
    for i in kept:
        pieces += [(-1, ""), *((x, t) for x, t in tree.pieces[tree.first[i] : tree.last[i]] if x < 0 or not dead[x])]
    return _joined(pieces), tree.title, scores[best]


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url", least: int = LEAST) -> DataFrame:
    """page_id, url, title, text, n_chars, score: one row for each row of pages. A map without a shuffle."""
    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")

    def extracted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [(None, None, None) if h is None else extract(h, least) for h in b.column("html").to_pylist()]
            text, title, score = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(title, pa.string()), pa.array(text, pa.string()), pa.array([None if t is None else len(t) for t in text], pa.int64()), pa.array(score, pa.float64())],
                names=["page_id", "url", "title", "text", "n_chars", "score"],
            )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(extracted, "page_id long, url string, title string, text string, n_chars long, score double")
