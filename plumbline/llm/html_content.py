"""HTML main text by minimum-cut labelling of blocks.

A page is cut into blocks of text at block-level tags.  A logistic classifier
over a block's markup and wording gives the two costs of calling it content or
boilerplate; these are the capacities of its edges to source and sink.  Blocks
that follow each other, and blocks next to each other under the same DOM parent,
are tied by smoothness edges.  The minimum cut, by max-flow, is the labelling of
least total cost.  A block whose own cost outweighs all its ties takes that
label in every minimum cut, so those are settled first and only the rest goes
through max-flow; the result is the same.

The classifier is trained here, in numpy, on pages made from templates by
``training_pages`` whose blocks carry their label.

Defined results: null html is an empty page and gives an empty text; a page
without content blocks gives an empty text; unclosed tags end with their
surroundings; a tag whose quotes never end is taken to end at the next ``>``;
pages of any length are read whole; repeated rows are read one by one; an empty table gives an empty
result; extra columns are left out.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

# HTML element names by how they shape a page's text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_HIDDEN = frozenset("script style textarea title xmp iframe noembed noframes head template noscript svg math canvas object audio video map datalist select button option".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>\x00]*)", re.S)
_REST = re.compile(r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_READ = frozenset("class id role style hidden aria-hidden itemprop".split())
_HEAD = frozenset("head title style script noscript template meta link base basefont bgsound noframes".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BAD = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs footer foot header masthead banner sidebar side aside widget ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay comment comments reply replies respond disqus social share sharing related recommended recommendations subscribe subscription newsletter signup login search form pagination pager tags tag meta byline toolbar skip copyright legal complementary contentinfo dialog tooltip feedback".split())
_COMMENTS = frozenset("comment comments reply replies respond disqus related recommended".split())
_GOOD = frozenset("article content main story post entry body text prose page articlebody".split())
_TAGS_BAD = frozenset("nav footer aside form header menu dialog button fieldset".split())
_HINTS = re.compile(r"\b(cookies?|copyright|all rights reserved|subscribe|newsletter|sign up|log ?in|privacy policy|terms of (?:use|service)|read more|advertisement|sponsored|share this|related (?:posts|articles)|leave a comment|reply)\b|©|\|", re.I)


@dataclass(frozen=True)
class Params:
    follow: float = 0.6
    sibling: float = 0.8
    sure: float = 8.0


@dataclass(slots=True)
class Block:
    """text; what the elements around it say; how many they are; how many tags from the top it shares with the block before; its parent; linked characters."""

    text: str
    around: _Around
    depth: int
    common: int
    parent: int
    linked: int


@dataclass(slots=True, frozen=True)
class _Around:
    """What the elements from the top down to one say, each step made from the one above."""

    tag: str = ""
    article: bool = False
    main: bool = False
    listed: bool = False
    named: bool = False
    bad: int = 0
    remarks: int = 0
    good: bool = False

    def inside(self, tag: str, marks: frozenset) -> _Around:
        enters = tag == "article" and not self.article
        plain = tag == "body"
        remarks = self.remarks + (not plain and bool(marks & _COMMENTS))
        # Outside an article only comments tell against what is in it.
        bad = (self.remarks if enters else self.bad) + (not plain and bool(marks & _BAD))
        return _Around(
            tag, self.article or enters, self.main or tag == "main", self.listed or tag in ("ul", "ol", "dl", "menu"), not enters and (self.named or tag in _TAGS_BAD),
            bad, remarks, self.good or bool(marks & _GOOD) and not marks & _BAD,
        )

    def features(self) -> tuple[float, ...]:
        return (
            float(self.named), float(min(self.bad, 2)), float(self.good), float(self.article or self.main),
            float(self.tag in ("p", "blockquote", "pre", "figcaption")), float(self.tag in ("h1", "h2", "h3", "h4", "h5", "h6")), float(self.listed),
        )


@dataclass(slots=True)
class _Node:
    tag: str
    around: _Around
    key: int
    hidden: bool
    like: int = 0


class _Stack:
    """Open elements, with the places of each tag and of all block elements."""

    def __init__(self):
        self.nodes = [_Node("", _Around(), 0, False)]
        self.solid: list[_Node] = []  # those that are not inline
        self.solid_at: list[int] = [0]
        self.at: defaultdict[str, list[int]] = defaultdict(list)
        self.low = 0  # the least number of block elements open since the last block
        self.names: dict[tuple[int, str], int] = {}  # numbers a row of tags from the top
        self.before: list[int] = []  # those of the last block

    def push(self, node: _Node) -> None:
        self.at[node.tag].append(len(self.nodes))
        if node.tag not in _INLINE:
            above = self.solid[-1].like if self.solid else 0
            node.like = self.names.setdefault((above, node.tag), len(self.names) + 1)
            self.solid.append(node)
            self.solid_at.append(len(self.nodes))
        self.nodes.append(node)

    def pop(self) -> _Node:
        node = self.nodes.pop()
        self.at[node.tag].pop()
        if node.tag not in _INLINE:
            self.solid.pop()
            self.solid_at.pop()
            self.low = min(self.low, len(self.solid))
        return node

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these tags, or 0."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def shared(self) -> int:
        """How many tags from the top the open block elements share with those of the last call."""
        now, k = self.solid, self.low
        while k < len(now) and k < len(self.before) and now[k].like == self.before[k]:
            k += 1
        del self.before[self.low :]
        self.before += [n.like for n in now[self.low :]]
        self.low = len(now)
        return k


def _marks(rest: str) -> tuple[frozenset, bool]:
    if not rest or rest.isspace():
        return frozenset(), False
    words, hidden = set(), False
    for m in _ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name not in _READ:
            continue
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
        elif name != "style":
            words.update(w.lower() for w in _WORDS.findall(value))
    return frozenset(words), hidden


def blocks(page: str) -> list[Block]:
    """The page's visible blocks of text in order, with what stands around them.

    Takes time in proportion to the page: each tag looks at what it opens or
    closes, never at all that is open.
    """
    out: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    keys = linked = links = at = hidden = 0
    quoted = True  # whether quotes in tags are still trusted to end

    def put(raw: str) -> None:
        nonlocal linked
        if stack.nodes[-1].tag == "head" and raw and not raw.isspace():
            leave("head")
        if raw and not hidden:
            t = entities.unescape(raw) if "&" in raw else raw
            parts.append(t)
            if links:
                linked += len(t)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                own = stack.solid
                # The parent of a block is what holds its own element.
                parent = own[-2].key if len(own) > 1 else 0
                out.append(Block(text, own[-1].around if own else _Around(), len(own), stack.shared(), parent, min(linked, len(text))))
        linked = 0

    def close(depth: int) -> None:
        nonlocal links, hidden
        while len(stack.nodes) > depth:
            node = stack.pop()
            links -= node.tag == "a"
            hidden -= node.hidden

    def leave(tag: str) -> None:
        close(stack.last(tag))

    end = len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            put(page[at:])
            break
        tag, stop, rest = m[2], m.end(), ""
        if tag is not None:
            r = _REST.match(page, stop) if quoted else None
            if r:
                rest, stop = r[1], r.end()
            else:  # a quote without an end: from here on a tag ends at the next >
                quoted = False
                stop = page.find(">", stop) + 1
                if not stop:
                    put(page[at:])
                    break
                rest = page[m.end() : stop - 1]
        if m.start() > at:
            put(page[at : m.start()])
        at = stop
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            depth = stack.last(tag)
            if tag == "br":
                put(" ")
            elif tag == "p" and not depth:
                flush()
            elif depth and not (tag in _INLINE and stack.solid_at[-1] > depth):
                if tag not in _INLINE:
                    flush()
                close(depth)
            continue
        if tag not in _HEAD and stack.nodes[-1].tag == "head" or tag == "body" and stack.last("head"):  # its end tag may be left out
            leave("head")
        if tag in _VOID:
            if tag == "br":
                put(" ")
            elif tag == "hr":
                flush()
            continue
        if tag not in _INLINE and tag not in ("button", "select", "option"):
            flush()
        if tag in _CLOSES_P:
            depth = stack.last("p")
            if depth and stack.solid_at[-1] == depth:
                close(depth)
        elif tag in _CLOSED_BY:
            depth = stack.last(*_CLOSED_BY[tag])
            if depth > stack.last("ul", "ol", "dl", "table", "menu"):
                close(depth)
        if tag in _RAW:
            shut = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = (page.find(">", shut.end()) + 1 if shut else 0) or end
            continue
        keys += 1
        marks, away = _marks(rest)
        away = away or tag in _HIDDEN
        stack.push(_Node(tag, stack.nodes[-1].around if tag in _INLINE else (stack.solid[-1].around if stack.solid else _Around()).inside(tag, marks), keys, away))
        hidden += away
        links += tag == "a"
        if rest.endswith("/") and tag in ("svg", "math", "path"):
            close(len(stack.nodes) - 1)
    flush()
    return out


FEATURES = 12


def features(page: list[Block]) -> np.ndarray:
    x = np.empty((len(page), FEATURES))
    for k, b in enumerate(page):
        n = len(b.text)
        words = b.text.count(" ") + 1
        x[k] = (*b.around.features(), b.linked / n, min(1.0, words / 40), float(b.text[-1] in ".!?…。\"'”»"), float(bool(n < 400 and _HINTS.search(b.text))), float(words < 4))
    return x


def training_pages(count: int = 400, seed: int = 5) -> Iterator[tuple[str, list[tuple[str, bool]]]]:
    """Pages from templates, each with its blocks and whether each is content."""
    rng = random.Random(seed)
    syllables = "ka lo mi ren tas vo du shi ber an el or ti us".split()

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(a, b)))

    def sentence(a: int, b: int) -> str:
        return words(a, b).capitalize() + "."

    def box(tag: str, cls: str, inner: str) -> str:
        return f'<{tag} class="{cls}">{inner}</{tag}>' if cls else f"<{tag}>{inner}</{tag}>"

    for _ in range(count):
        truth: list[tuple[str, bool]] = []

        def say(text: str, good: bool, tag: str = "p", truth: list = truth) -> str:
            truth.append((text, good))
            return f"<{tag}>{text}</{tag}>"

        def links(n: int, truth: list = truth) -> str:
            out = ""
            for _ in range(n):
                t = words(1, 3)
                truth.append((t, False))
                out += f'<li><a href="/x">{t}</a></li>'
            return f"<ul>{out}</ul>"

        body = ""
        if rng.random() < 0.5:
            tag, cls = rng.choice([("header", ""), ("div", "site-header"), ("header", "masthead")])
            body += box(tag, cls, say(words(1, 6), False, rng.choice(["div", "h2", "p"])))
        body += box(*rng.choice([("nav", ""), ("div", "menu"), ("div", "navbar"), ("nav", "main-nav")]), links(rng.randint(2, 8)))
        for _ in range(rng.randint(0, 2)):
            cls, text = rng.choice([("ad", sentence(4, 20)), ("cookie-notice", "We use cookies. " + sentence(3, 15)), ("advert", sentence(4, 25)), ("breadcrumb", words(2, 5)), ("promo banner", sentence(4, 12))])
            body += box("div", cls, say(text, False, rng.choice(["p", "span", "div"])))
        article = ""
        if rng.random() < 0.85:
            article += say(words(2, 10), True, rng.choice(["h1", "h1", "h2"]))
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.1:
                article += say(words(2, 6), True, rng.choice(["h2", "h3"]))
            elif kind < 0.16:
                items = [words(2, 12) for _ in range(rng.randint(1, 4))]
                truth += [(t, True) for t in items]
                article += "<ul>" + "".join(f"<li>{t}</li>" for t in items) + "</ul>"
            elif kind < 0.22:
                article += box("div", rng.choice(["share", "ad", "related-posts", "newsletter"]), say(sentence(2, 14), False))
            else:
                article += say(" ".join(sentence(1, 25) for _ in range(rng.randint(1, 6))), True, rng.choice(["p", "p", "p", "p", "blockquote", "pre"]))
        if rng.random() < 0.7:
            body += box("article", "", article)
        else:
            body += box("div", rng.choice(["content", "post", "entry", "", "main"]), article)
        if rng.random() < 0.4:
            tag, cls = rng.choice([("aside", ""), ("div", "sidebar"), ("aside", "widget")])
            body += box(tag, cls, say(words(1, 4), False, "h3") + (links(3) if rng.random() < 0.5 else say(sentence(5, 30), False)))
        if rng.random() < 0.4:
            tag, cls = rng.choice([("section", "comments"), ("div", "comment-list"), ("div", "comments")])
            body += box(tag, cls, "".join(box("div", "comment", say(" ".join(sentence(3, 20) for _ in range(rng.randint(1, 3))), False)) for _ in range(rng.randint(1, 4))))
        if rng.random() < 0.3:
            body += box("form", "", say(words(1, 4), False, "label"))
        body += box(*rng.choice([("footer", ""), ("div", "footer"), ("footer", "site-footer")]), say("© " + words(2, 12) + rng.choice(["", "."]), False, rng.choice(["p", "div"])))
        yield f"<html><head><title>{words(2, 5)}</title></head><body>{body}</body></html>", truth


@cache
def classifier() -> np.ndarray:
    """Weights and, last, the bias of the block classifier."""
    xs, ys = [], []
    for page, truth in training_pages():
        label: dict[str, list[bool]] = {}
        for text, good in truth:
            label.setdefault(" ".join(text.split()), []).append(good)
        got = [b for b in blocks(page) if len(set(label.get(b.text, ()))) == 1]
        xs.append(features(got))
        ys += [label[b.text][0] for b in got]
    x = np.c_[np.concatenate(xs), np.ones(len(ys))]
    y, w = np.array(ys, float), np.zeros(FEATURES + 1)
    ridge = 0.05 * np.eye(FEATURES + 1)
    ridge[-1, -1] = 1e-6
    for _ in range(30):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
    return w


def min_cut(score: np.ndarray, ties: list[tuple[int, int, float]]) -> list[bool]:
    """The labels of least cost: -score where False, and the weight of every tie with unlike ends.

    score > 0 speaks for True by that much.
    """
    n = len(score)
    s = [float(v) for v in score]
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, c in ties:
        near[a].append((b, c))
        near[b].append((a, c))
    label: list[bool | None] = [None] * n
    rest = [sum(c for _, c in x) for x in near]
    todo = deque(k for k in range(n) if abs(s[k]) > rest[k])
    while todo:
        k = todo.popleft()
        if label[k] is not None:
            continue
        label[k] = s[k] > 0
        for j, c in near[k]:
            if label[j] is None:
                s[j] += c if label[k] else -c
                rest[j] -= c
                if abs(s[j]) > rest[j] + 1e-12:
                    todo.append(j)
    free = [k for k in range(n) if label[k] is None]
    if free:
        for k, v in zip(free, _max_flow(free, s, near, label), strict=True):
            label[k] = v
    return [bool(v) for v in label]


def _max_flow(free: list[int], s: list[float], near: list, label: list) -> list[bool]:
    """Dinic's algorithm over the unsettled nodes; True where the source still reaches."""
    at = {k: i + 2 for i, k in enumerate(free)}
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(len(free) + 2)]

    def edge(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((forth, back))

    for k in free:
        if s[k] > 0:
            edge(0, at[k], s[k], 0.0)
        elif s[k] < 0:
            edge(at[k], 1, -s[k], 0.0)
        for j, c in near[k]:
            if label[j] is None and j > k:
                edge(at[k], at[j], c, c)
    while True:
        level = [-1] * len(out)
        level[0], queue = 0, deque([0])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[1] < 0:
            return [level[at[k]] >= 0 for k in free]
        here = [0] * len(out)
        path: list[int] = []
        node = 0
        while True:
            if node == 1:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if cap[e] <= 1e-12)
                node = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while here[node] < len(out[node]):
                e = out[node][here[node]]
                if cap[e] > 1e-12 and level[to[e]] == level[node] + 1:
                    break
                here[node] += 1
            if here[node] < len(out[node]):
                path.append(out[node][here[node]])
                node = to[path[-1]]
            elif path:
                level[node] = -1
                node = to[path.pop() ^ 1]
            else:
                break


def ties(page: list[Block], params: Params) -> list[tuple[int, int, float]]:
    out, last = [], {}
    for k, b in enumerate(page):
        if k:
            # Blocks in a row are tied the more, the more of their surroundings they share.
            out.append((k - 1, k, params.follow * (b.common + 1) / (max(page[k - 1].depth, b.depth) + 1)))
        if b.parent in last:
            out.append((last[b.parent], k, params.sibling))
        last[b.parent] = k
    return out


def extract(page: str | None, params: Params = Params()) -> str:
    """The main text of a page, its blocks joined by one space."""
    got = blocks(page or "")
    if not got:
        return ""
    w = classifier()
    score = np.clip(features(got) @ w[:-1] + w[-1], -params.sure, params.sure)
    keep = min_cut(score, ties(got, params))
    return " ".join(b.text for b, k in zip(got, keep, strict=True) if k)


def main_text(pages: DataFrame, params: Params = Params()) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""

    text_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def run(html: pd.Series) -> pd.Series:
        return pd.Series([extract(h, params) for h in html], dtype=object)

    df = pages.select("page_id", "url", run(F.col("html")).alias("text"))
    return df.withColumn("n_chars", F.length("text").cast("long"))
