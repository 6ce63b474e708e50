"""Ranked search against a brute-force ranking, and treaps against their definition."""

from __future__ import annotations

import collections
import math
import re

import numpy as np
import pytest

from plumbline.llm import treaps

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string"


def brute(docs, items, k):
    words = [(d, TERM.findall((t or "").translate(LOW))) for d, t in docs]
    words = [(d, w) for d, w in words if w]
    n_docs, n_terms = len(words), sum(len(w) for _, w in words)
    counts = [(d, len(w), collections.Counter(w)) for d, w in words]
    df = collections.Counter(t for _, _, c in counts for t in c)
    out = []
    for item, text in items:
        asked = collections.Counter(TERM.findall((text or "").translate(LOW)))
        scores = []
        for d, n, c in counts:
            m = 75 + (25 * n * n_docs) // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        scores.sort()
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(scores[:k])]
    return out


def found(spark, docs, items, **params):
    got = treaps.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string"), treaps.Params(**params))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=repr)


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    words = [f"w{int(x)}" for x in range(60)]
    p = 1 / np.arange(1, 61)
    docs = [(int(i), " ".join(rng.choice(words, rng.integers(0, 40), p=p / p.sum()))) for i in rng.permutation(n)]
    items = [(i, " ".join(rng.choice(words, rng.integers(1, 15)))) for i in range(12)]
    return docs, items


@pytest.mark.parametrize(("leaf", "batch", "postings"), [(1, 1, 200), (4, 256, 10**6), (32, 8, 3000)])
def test_ranks_are_those_of_brute_force(spark, leaf, batch, postings):
    docs, items = corpus(leaf, 400)
    docs += [(1000 + i, docs[5][1]) for i in range(60)]  # ties of a large group of copies
    assert found(spark, docs, items, leaf=leaf, batch=batch, postings=postings, probe=4) == sorted(brute(docs, items, 20), key=repr)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "...!"), (4, "Alpha beta"), (4, "Alpha beta"), (None, "alpha ÄÖ"), (5, "alpha " * 5000), (6, "äö ÄÖ 日本"), (7, "nothing of it")]
    items = [(1, "ALPHA alpha beta"), (1, "ALPHA alpha beta"), (None, "ÄÖ"), (2, None), (3, "??"), (4, "unknown"), (5, "日本 beta")]
    assert found(spark, docs, items) == sorted(brute(docs, items, 20), key=repr)
    assert found(spark, docs, items, k=1, terms=1) == sorted(brute(docs, items, 1), key=repr)  # a pass for each query


def test_empty_tables_and_clashing_columns(spark):
    some = [(1, "a b"), (2, "b c")]
    assert found(spark, [], some) == [] and found(spark, some, []) == [] and found(spark, some, [(1, None)]) == []
    docs = spark.createDataFrame([(1, "a b", 5, "x"), (2, "b c", 6, "y")], "doc_id long, text string, score long, rank string")
    items = spark.createDataFrame([(7, "c", 1, "words")], "item_id long, text string, query int, words string")
    assert [r[:3] for r in treaps.search(docs, items).collect()] == [(7, 1, 2)]


@pytest.mark.parametrize("kind", ["mixed", "equal", "rising", "falling"])
def test_treaps_keep_both_orders(kind):
    rng = np.random.default_rng(3)
    term = np.sort(rng.integers(0, 5, 2000))
    impact = {"mixed": rng.integers(1, 9, 2000), "equal": np.full(2000, 7), "rising": np.arange(1, 2001), "falling": np.arange(2000, 0, -1)}[kind]
    parent, left, right = treaps.treaps(term, impact)
    inside = parent >= 0
    assert (impact[parent[inside]] >= impact[inside]).all() and (term[parent[inside]] == term[inside]).all()
    assert (~inside).sum() == len(set(term.tolist()))
    seen = []
    for root in np.flatnonzero(~inside).tolist():  # an inner walk gives the order of the documents
        stack, at, depth = [], root, 0
        while stack or at >= 0:
            while at >= 0:
                stack.append(at)
                at = left[at]
            depth = max(depth, len(stack))
            at = stack.pop()
            seen.append(at)
            at = right[at]
        assert kind != "equal" or depth < 60
    assert seen == list(range(2000))


def test_search_skips_what_cannot_enter(monkeypatch):
    rng = np.random.default_rng(1)
    n = 20_000
    count = np.full(n, 3)
    term = np.concatenate([np.sort(rng.choice(30, 3, replace=False)) for _ in range(n)]).astype(np.int32)
    it = treaps.Shard(rng.integers(20, 200, n), count, term, rng.integers(1, 5, 3 * n), n, 100 * n)
    scored, plain = [], it.scores
    monkeypatch.setattr(it, "scores", lambda docs, c: scored.append(len(docs)) or plain(docs, c))
    weights = np.zeros(30, np.int64)
    weights[[1, 2, 3]] = [3000, 2000, 900]
    docs, scores = it.best({1: 3000, 2: 2000, 3: 900}, weights)
    every = plain(np.arange(n), weights)
    order = np.lexsort((np.arange(n), -every))[:20]
    assert docs.tolist() == order.tolist() and scores.tolist() == every[order].tolist()
    assert sum(scored) < n / 2
