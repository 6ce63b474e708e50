"""Benchmark decontamination with a generalised suffix automaton.

The automaton is built over the words of all test items.  A document's words
stream through it while it keeps the length of the longest match that ends at
each word; where that length reaches an item's window, the window's words are
hit.  A window is ``Params.window`` consecutive words of an item; a shorter item
is one window of all its words.  ``remove`` cuts hit spans of
``Params.max_span`` words or more, and drops every word of a document of which
more than ``Params.max_coverage`` is hit.

The automaton goes to the workers by broadcast only while the items hold at most
``Params.max_words`` words.  Beyond that the items are cut into parts of that
size by a hash of their id, and the parts pass over the documents one after the
other, each with its automaton alone, with a checkpoint between them.  Results
are the same either way.

Only runs of words that occur in some item can match, so the others never enter
the automaton.

Defined results: null texts and items have no words and match nothing; an empty
benchmark hits nothing; equal items all count, each under its own id; repeated
rows are judged one by one; extra columns are kept by ``remove`` and left out by
``contamination``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, release, shielded, text_batches

#: Everything but digits, a-z (after lower-casing A-Z) and bytes from 0x80 on parts words.
_BREAK = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Params:
    window: int = 10
    max_span: int = 1
    max_coverage: float = 0.8
    max_words: int = 100_000


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_BREAK).split()


class Automaton:
    """Generalised suffix automaton of items; every state knows the items below it."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[set] = [set()]
        wholes: dict[int, list] = {}
        for item, ws in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]
            last = 0
            for c in ids:
                last = self._extend(last, c, own)
                own[last].add(item)
        for item, ws in items:
            if 0 < len(ws) < window:
                at = 0
                for w in ws:
                    at = self.next[at][self.vocabulary[w]]
                wholes.setdefault(at, []).append((len(ws), item))
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True)
        for s in order:
            if self.link[s] > 0:
                own[self.link[s]] |= own[s]
        self.items = [frozenset(x) for x in own]
        #: For each state the nearest one, itself included, at which a whole short item ends.
        self.short = [-1] * len(self.link)
        for s in reversed(order):
            self.short[s] = s if s in wholes else self.short[self.link[s]]
        self.wholes = wholes
        self.least = min([window, *(len(ws) for _, ws in items if ws)])

    def _extend(self, last: int, c: int, own: list[set]) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q, own)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        own.append(set())
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q, own)
        return new

    def _clone(self, p: int, c: int, q: int, own: list[set]) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        own.append(set())
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def spans(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """The hit spans [a, b) of words, parted and in order, and the items whose windows occur."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in ws), np.int64, len(ws))
        known = np.r_[False, ids >= 0, False].astype(np.int8)
        edges = np.flatnonzero(np.diff(known))
        spans: list[tuple[int, int]] = []
        found: set = set()

        def hit(a: int, b: int) -> None:
            while spans and spans[-1][1] >= a:
                x, y = spans.pop()
                a, b = min(a, x), max(b, y)
            spans.append((a, b))

        step, link, length, window = self.next, self.link, self.length, self.window
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a < self.least:
                continue
            state = size = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                while state and c not in step[state]:
                    state = link[state]
                    size = length[state]
                if c in step[state]:
                    state = step[state][c]
                    size += 1
                if size >= window:
                    s = state
                    while length[link[s]] >= window:
                        s = link[s]
                    hit(i + 1 - window, i + 1)
                    found |= self.items[s]
                s = self.short[state]
                while s > 0:
                    for n, item in self.wholes[s]:
                        if n <= size:
                            hit(i + 1 - n, i + 1)
                            found.add(item)
                    s = self.short[link[s]]
        return spans, found


def _parts(items: DataFrame, params: Params) -> Iterator[Automaton]:
    """One automaton while the items are few; else one for each part of about max_words words."""
    sized = items.select("item_id", "text", (1 + F.length(F.coalesce("text", F.lit(""))) / 2).cast("long").alias("_n"))
    total = sized.agg(F.sum("_n")).first()[0] or 0  # no text has more words than that
    parts = max(1, -(-total // params.max_words))
    for k in range(parts):
        part = sized if parts == 1 else sized.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k)
        rows = sorted(((r.item_id, words(r.text)) for r in part.select("item_id", "text").collect()), key=lambda r: str(r[0]))
        yield Automaton(rows, params.window)


_FOUND = "n_words long, spans array<int>, items array<string>"


def _spans(automaton: Automaton, text: str | None, before: list, items: list) -> tuple[int, list[tuple[int, int]], set]:
    """The words of a text, its hit spans with those of earlier passes, and the items."""
    ws = words(text)
    spans, found = automaton.spans(ws)
    old = list(map(int, before))
    return len(ws), joined(spans + list(zip(old[::2], old[1::2], strict=True))), {*items, *map(str, found)}


def _pass(docs: DataFrame, automaton: Automaton) -> DataFrame:
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    @F.pandas_udf(_FOUND)
    def run(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for x, before in batches:
            got = (_spans(shared.value, *r) for r in zip(x, before["spans"], before["items"], strict=True))
            yield pd.DataFrame([(n, [i for s in spans for i in s], sorted(found)) for n, spans, found in got], columns=["n_words", "spans", "items"])
        release()

    return docs.withColumn("_m", run(F.col("text"), F.col("_m")))


def _cutting_pass(docs: DataFrame, automaton: Automaton, params: Params) -> DataFrame:
    """The last pass where texts are cut: one trip through Python does both."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    @F.pandas_udf("text string, gone boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for x, before in batches:
            rows = []
            for t, old, items in zip(x, before["spans"], before["items"], strict=True):
                _, spans, _ = _spans(shared.value, t, old, items)
                left = cut(t, spans, params) if spans else t
                rows.append((left, bool(spans) and not words(left)))
            yield pd.DataFrame(rows, columns=["text", "gone"])
        release()

    return docs.withColumn("_new", run(F.col("text"), F.col("_m")))


def _unmatched(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_m", F.struct(F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("spans"), F.array().cast("array<string>").alias("items")))


def matches(docs: DataFrame, items: DataFrame, params: Params = Params()) -> DataFrame:
    """``docs`` with ``_m``: n_words, spans (starts and ends by turns, in words) and items."""
    out = _unmatched(docs)
    for k, automaton in enumerate(_parts(items, params)):
        out = _pass(checkpointed(out) if k else out, automaton)
    return out


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, with those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, items: DataFrame, params: Params = Params()) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    m = matches(docs.select("doc_id", "text"), items, params)
    hit = F.aggregate("_m.spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("s")), lambda a, x: F.struct((a["n"] + x * a["s"]).alias("n"), (-a["s"]).alias("s")), lambda a: a["n"])
    out = m.select("doc_id", F.col("_m.n_words").alias("n_words"), hit.alias("n_hit"), F.size("_m.items").cast("long").alias("n_items"), F.sha2(F.array_join("_m.items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def cut(text: str, spans: list[tuple[int, int]], params: Params) -> str:
    """``text`` without the spans that exceed the limits, or empty if too much of it is hit."""
    lower = text.encode("utf-8", "replace")
    lower = lower.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
    places = [m.span() for m in _WORD.finditer(lower)]
    if sum(b - a for a, b in spans) > params.max_coverage * len(places):
        return ""
    raw, out, at = text.encode("utf-8", "replace"), [], 0
    for a, b in spans:
        if b - a >= params.max_span:
            out.append(raw[at : places[a][0]])
            at = places[b - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")


def remove(docs: DataFrame, items: DataFrame, params: Params = Params()) -> DataFrame:
    """``docs`` with hit spans cut from text; rows left without a word by that go; n_chars follows."""
    own, restore = shielded(docs, ("text", "n_chars"))
    out, last = _unmatched(own), None
    for automaton in _parts(items, params):
        if last is not None:
            out = checkpointed(_pass(out, last))
        last = automaton
    got = _cutting_pass(out, last, params).where(~F.col("_new.gone")).withColumn("text", F.col("_new.text"))
    return restore(got.withColumn("n_chars", F.length("text").cast("long")))
