"""Ranked search over inverted treaps: a term's postings as a tree, ordered by document, heaped by impact.

``search`` ranks all documents for each query of a given set.  One pass over the
texts keeps, of each document, the terms that occur in a query; counts of
documents and terms follow from that.  Each task then cuts its documents into
shards (``Params.postings``), sorts a shard by doc_id, and builds one treap a
term.  Nothing is shuffled but counts and the best rows of each task, so a term
that stands in a third of all documents makes no task larger than any other.

A query walks the treaps of its terms together.  An interval of documents knows,
for each term, the treap node of highest impact in it; the weighted sum of these
impacts bounds every score in the interval, and an interval that can't enter the
best k goes.  Otherwise the document of the heaviest node is scored and parts
the interval in two; in either part each term goes down its treap to the first
node that lies inside, which is its highest there.  Intervals of
``Params.leaf`` documents or fewer are scored document by document.  Many
intervals go at once, highest bounds first.  A search of one document in
``Params.probe`` first gives every query a score that its k-th best can't fall
short of.

The query set travels with the tasks; it is cut into blocks of at most
``Params.terms`` different terms (or one query), and each block takes a pass.

Defined results: null and empty texts, and texts without terms, are no documents
and no queries; every row is a document, and every row of the query table a
query, also where ids repeat or are null; equal scores go by ascending doc_id,
null last; a query of whatever length counts whole; an empty table gives an
empty result; other columns are left out whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, release, text_batches

#: Digits, lower-case letters and bytes of non-ASCII letters stay, A-Z are lower-cased, every other byte parts terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MIX = 0x9E3779B1


@dataclass(frozen=True)
class Params:
    k: int = 20
    terms: int = 200_000
    postings: int = 2_000_000
    leaf: int = 32
    batch: int = 256
    probe: int = 16
    merges: int = 64


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TERMS).split()


def treaps(term: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parent, left, right) of postings that come sorted by term and document; -1 for none.

    Higher impacts stand above lower ones, equal ones in a mixed order that keeps
    trees of equal impacts shallow.  A posting's parent is the lower of its nearest
    higher neighbours on either side, which are found by jumps over what is lower.
    """
    n = len(term)
    place = np.arange(n)
    key = impact.astype(np.int64) << 32 | place * _MIX & 0xFFFFFFFF
    key = np.append(key, np.iinfo(np.int64).max)  # place n (also -1) is higher than all
    bound = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if n else place
    sides = []
    for step, edge in ((-1, bound), (1, np.r_[bound[1:], n] - 1 if n else bound)):
        near = np.append(place + step, n)
        near[edge] = n
        low = np.flatnonzero(key[near[:n]] < key[:n])
        while len(low):
            near[low] = near[near[low]]
            low = low[key[near[low]] < key[low]]
        sides.append(near[:n])
    before, after = sides
    parent = np.where(key[before] < key[after], before, after)
    left, right = np.full(n + 1, -1, np.int32), np.full(n + 1, -1, np.int32)
    inner = parent < n
    on_left = inner & (place < parent)
    left[parent[on_left]] = place[on_left]
    on_right = inner & ~on_left
    right[parent[on_right]] = place[on_right]
    return np.where(inner, parent, -1).astype(np.int32), left, right


class Shard:
    """Documents in the order of their ids, as rows of (term, impact) and as one treap a term.

    length: terms of each document; count: how many entries of ``term`` and ``tf`` each has.
    """

    def __init__(self, length: np.ndarray, count: np.ndarray, term: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int, params: Params = Params()):
        self.size, self.params = len(length), params
        m = 75 + (25 * length.astype(np.int64) * n_docs) // max(n_terms, 1)
        tf = tf.astype(np.int64)
        self.end = np.cumsum(count)
        self.start = self.end - count
        self.term, self.impact = term, (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, count))
        by = np.argsort(term, kind="stable")
        terms = term[by]
        self.doc = np.append(np.repeat(np.arange(self.size), count)[by], -1).astype(np.int32)
        self.height = np.append(self.impact[by], 0)
        parent, self.left, self.right = treaps(terms, self.height[:-1])
        roots = np.flatnonzero(parent < 0)
        self.root = dict(zip(terms[roots].tolist(), roots.tolist(), strict=True))

    def scores(self, docs: np.ndarray, coefficient: np.ndarray) -> np.ndarray:
        n = self.end[docs] - self.start[docs]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[docs] - ends + n, n)
        run = np.append(0, np.cumsum(coefficient[self.term[at]] * self.impact[at]))
        return run[ends] - run[ends - n]

    def _down(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each interval (row) and term (column) the highest node inside."""
        node = node.copy()
        flat, rows = node.reshape(-1), np.repeat(np.arange(len(lo)), node.shape[1])
        todo = np.arange(len(flat))
        while len(todo):
            at, row = flat[todo], rows[todo]
            d = self.doc[at]
            low, high = d < lo[row], d >= hi[row]
            out = (at >= 0) & (low | high)
            todo, at, low = todo[out], at[out], low[out]
            flat[todo] = np.where(low, self.right[at], self.left[at])
        return node

    def best(self, query: dict[int, int], coefficient: np.ndarray, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): the best k of at least ``least``, and above 0.

        query: each term's weight; coefficient: the same by term number, 0 elsewhere.
        """
        k, params = self.params.k, self.params
        used = [t for t, c in query.items() if c > 0 and t in self.root]
        found, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not used:
            return found, score
        weight, least = coefficient[np.array(used)], max(least, 1)
        lo, hi = np.zeros(1, np.int64), np.full(1, self.size, np.int64)
        node = np.array([[self.root[t] for t in used]], np.int32)
        bound = (self.height[node] * weight).sum(1)
        while len(lo):
            stay = bound >= least
            if len(found) == k:  # of equal scores the earlier documents stay
                stay &= (bound > score[-1]) | (bound == score[-1]) & (lo < found[-1])
            if not stay.all():
                lo, hi, node, bound = lo[stay], hi[stay], node[stay], bound[stay]
                if not len(lo):
                    break
            if len(lo) > params.batch:
                by = np.argpartition(-bound, params.batch)
                now, wait = by[: params.batch], by[params.batch :]
            else:
                now, wait = np.arange(len(lo)), np.zeros(0, np.int64)
            small = hi[now] - lo[now] <= params.leaf
            leaf, part = now[small], now[~small]
            n = hi[leaf] - lo[leaf]
            ends = np.cumsum(n)
            docs = np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo[leaf] - ends + n, n)
            share = self.height[node[part]] * weight
            at = self.doc[node[part, share.argmax(1)]].astype(np.int64)
            docs = np.append(docs, at)
            s = self.scores(docs, coefficient)
            good = s >= least
            found, score = np.append(found, docs[good]), np.append(score, s[good])
            by = np.lexsort((found, -score))[:k]
            found, score = found[by], score[by]
            if len(found) == k:
                least = max(least, int(score[-1]))
            lo2, hi2 = np.append(lo[part], at + 1), np.append(at, hi[part])
            some = hi2 > lo2
            lo2, hi2 = lo2[some], hi2[some]
            node2 = self._down(np.concatenate([node[part], node[part]])[some], lo2, hi2)
            lo, hi, node = np.append(lo[wait], lo2), np.append(hi[wait], hi2), np.concatenate([node[wait], node2])
            bound = np.append(bound[wait], (self.height[node2] * weight).sum(1))
        return found, score


def _postings(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, term, tf) of every document with a term: all its terms counted, those of the query set listed."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, found, tf, ends = [], [], [], [0]
            for text in b.column(1):
                words = terms_of(text.as_py())
                length.append(len(words))
                own = Counter(t for t in map(terms.get, words) if t is not None)
                found += own.keys()
                tf += own.values()
                ends.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (found, tf)]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(length, pa.int64()), *lists], names=["doc_id", "n", "term", "tf"])
            yield out.filter(pa.array([n > 0 for n in length], pa.bool_()))
        release()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n long, term array<int>, tf array<int>")


def _frequencies(postings: DataFrame, size: int) -> np.ndarray:
    """Of each term of the query set, how many documents hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for term, df in postings.select("term").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).toLocalIterator():
        out[term] = df
    return out


def _found(postings: DataFrame, queries: list[dict[int, int]], size: int, least: list[int], n_docs: int, n_terms: int, params: Params) -> DataFrame:
    """(query, doc_id, score): the best k of each task for each query."""
    kind = postings.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor, parts, held = list(least), [], 0
        best: list[list[tuple[int, object]]] = [[] for _ in queries]
        coefficient = np.zeros(size, np.int64)

        def shard() -> None:
            t = pa.Table.from_batches(parts)
            t = t.sort_by("doc_id").combine_chunks()  # nulls last
            ids, term, tf = t.column("doc_id"), t.column("term").combine_chunks(), t.column("tf").combine_chunks()
            count = np.diff(term.offsets.to_numpy())
            it = Shard(t.column("n").to_numpy(), count, term.flatten().to_numpy(), tf.flatten().to_numpy(), n_docs, n_terms, params)
            for q, query in enumerate(queries):
                used, weights = np.fromiter(query.keys(), np.int64, len(query)), np.fromiter(query.values(), np.int64, len(query))
                coefficient[used] = weights
                docs, scores = it.best(query, coefficient, floor[q])
                coefficient[used] = 0
                if len(docs):
                    best[q] += zip(scores.tolist(), ids.take(pa.array(docs)).to_pylist(), strict=True)
                    best[q].sort(key=lambda x: (-x[0], x[1] is None, 0 if x[1] is None else x[1]))
                    del best[q][params.k :]
                    if len(best[q]) == params.k:
                        floor[q] = max(floor[q], best[q][-1][0])

        for b in batches:
            for at in range(0, b.num_rows, 1000):
                piece = b.slice(at, 1000)
                parts.append(piece)
                held += len(piece.column(2).flatten()) + piece.num_rows
                if held >= params.postings:
                    shard()
                    parts, held = [], 0
        if parts:
            shard()
        parts.clear()
        rows = [(q, i, s) for q, found in enumerate(best) for s, i in found]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        schema = pa.schema([("query", pa.int32()), ("doc_id", b.schema.field(0).type), ("score", pa.int64())]) if rows else None
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        release()

    return postings.mapInArrow(run, f"query int, doc_id {kind}, score long")


def _top(rows: DataFrame, k: int, by: list) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(docs: DataFrame, items: list[tuple[object, dict[bytes, int]]], id_kind: str, params: Params) -> DataFrame:
    """(item_id, rank, doc_id, score) for one block of queries."""
    spark = docs.sparkSession
    names = sorted(set().union(*(words for _, words in items)))
    number = {t: k for k, t in enumerate(names)}
    postings = checkpointed(_postings(docs, number))
    n_docs, n_terms = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = _frequencies(postings, len(names)).tolist()
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for f in df]
    queries = [{number[t]: tf * weight[number[t]] for t, tf in words.items()} for _, words in items]
    some = postings.where(F.size("term") > 0)
    first = some.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(params.probe)) == 0)
    rows = _top(_found(first, queries, len(names), [0] * len(queries), n_docs, n_terms, params), params.k, ["query"])
    least = [0] * len(queries)
    for q, s in rows.where(F.col("rank") == params.k).select("query", "score").collect():  # a row a query
        least[q] = s
    rows = _found(some, queries, len(names), least, n_docs, n_terms, params).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(params.merges)))
    rows = _top(_top(rows, params.k, ["query", "part"]).drop("rank", "part"), params.k, ["query"])
    ids = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(items)], f"query int, item_id {id_kind}")
    return rows.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score")  # as many ids as the block has queries


def search(docs: DataFrame, queries: DataFrame, params: Params = Params()) -> DataFrame:
    """(item_id, rank, doc_id, score): the best ``params.k`` documents for each row of queries (item_id, text)."""
    text_batches(docs.sparkSession)
    id_kind = queries.schema["item_id"].dataType.simpleString()

    @F.pandas_udf("array<binary>")
    def words(texts: pd.Series) -> pd.Series:
        return pd.Series([terms_of(t) for t in texts])

    asked = checkpointed(queries.select("item_id", words(F.col("text").cast("string")).alias("words")).where(F.size("words") > 0))
    blocks: list[list] = [[]]
    out, seen = [], set()

    def flush() -> None:
        if blocks[-1]:
            out.append(_block(docs, blocks[-1], id_kind, params))
        blocks[-1], _ = [], seen.clear()

    for row in asked.toLocalIterator():  # a partition of the query set at a time
        own = Counter(bytes(w) for w in row.words)
        if blocks[-1] and len(seen | own.keys()) > params.terms:
            flush()
        seen.update(own)
        blocks[-1].append((row.item_id, own))
    flush()
    if not out:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"item_id {id_kind}, rank int, doc_id {kind}, score long")
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]
