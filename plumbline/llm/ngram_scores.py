"""Stupid-backoff scores from n-gram counts that are partitioned by hash.

A document's words stand behind ``order - 1`` start symbols.  Its score is the
sum over its words of ln S, where S is the count of the longest n-gram ending at
the word that was counted, over the count of its context (all n-grams that begin
with the same words); each order stepped down costs a factor ``alpha``.  At the
lowest order a word has its count over the number of words, and one that was
never counted counts as once.

Every position gives one entry: the 64-bit hash of its context, the hash of its
word, its document.  Entries go by context to buckets of the hash space (a Spark
shuffle), so a bucket counts both its contexts and its n-grams and joins the
counts back to the entries; a second shuffle, by document, sums them.  Texts that are scored
under their own corpus need no other order, since all their n-grams are counted.
With a corpus of its own, what a bucket doesn't find goes on to the next lower
order.  Entries travel as rows of arrays, many to a row.

Buckets are as many as hold ``bucket_words`` entries each, so a task does not
grow with the corpus.  Contexts too frequent for a bucket are found in a sample,
counted exactly in a pass of their own and broadcast (``heavy_share`` bounds
them to a million or so); their entries are then dealt by n-gram, and those of
n-grams that are still too frequent are answered where they are read.

n-grams are told apart by 96-bit hashes (context and word), single words by 64
bits, rows by a 64-bit hash of doc_id and text.

Defined results: a null or empty text has no words, a score of 0 and a null
mean; words are parted by ASCII white space, with A-Z lower-cased; repeated rows
are counted and scored one by one; texts of any length are read in slices; an
empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, parallelism, release, text_batches

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29), np.uint64(32))
_START = b""
_SLICE = 1 << 20
_KNOWN_WORDS = 1_000_000


@dataclass(frozen=True)
class Params:
    order: int = 3
    alpha: float = 0.4
    bucket_words: int = 2_000_000
    heavy_share: float = 1e-6
    sample_words: int = 5_000_000
    seen: int = 20


def words(text: bytes | str | None) -> Iterator[list[bytes]]:
    """The words of a text, slice by slice."""
    raw = text.encode("utf-8", "replace") if isinstance(text, str) else text or b""
    at = 0
    while at < len(raw):
        end = at + _SLICE
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield raw[at:end].translate(LOWER).split()
        at = end


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = (left * _MIX[0]) ^ right
    x = (x ^ (x >> _MIX[2])) * _MIX[1]
    return x ^ (x >> _MIX[3])


class _Hashes:
    """64-bit word hashes, looked up by word."""

    def __init__(self):
        self._reset()

    def _reset(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.known = np.zeros(0, np.uint64)
        self.number[_START]

    def of(self, texts: list[bytes | None], pad: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all texts' words, each text behind ``pad`` start symbols, and each text's number of words."""
        if len(self.number) > _KNOWN_WORDS:
            self._reset()
        parts, sizes = [], []
        for t in texts:
            parts.append(np.zeros(pad, np.int32))
            ids = [np.fromiter(map(self.number.__getitem__, w), np.int32, len(w)) for w in words(t)]
            sizes.append(sum(map(len, ids)))
            parts += ids
        if len(self.number) > len(self.known):
            new = list(self.number)[len(self.known) :]
            self.known = np.concatenate([self.known, np.array([xxhash.xxh64_intdigest(w) for w in new], np.uint64)])
        return self.known[np.concatenate(parts)] if parts else np.zeros(0, np.uint64), np.array(sizes, np.int64)


@dataclass
class _Entries:
    """Positions of documents: key (the document's), context, word, and the contexts of lower orders, the last of which is the word's own hash."""

    key: np.ndarray
    context: np.ndarray
    word: np.ndarray
    rest: np.ndarray

    def __getitem__(self, rows) -> _Entries:
        return _Entries(self.key[rows], self.context[rows], self.word[rows], self.rest[rows])

    def pair(self) -> np.ndarray:
        return _mixed(self.context, self.word.astype(np.uint64) + np.uint64(1))


def _entries(keys: np.ndarray, texts: list[bytes | None], hashes: _Hashes, order: int, lower: bool) -> _Entries:
    pad = order - 1
    flat, sizes = hashes.of(texts, pad)
    at = np.arange(int(sizes.sum())) + np.repeat(pad * np.arange(1, len(sizes) + 1), sizes)
    grams = [np.zeros(len(flat), np.uint64), flat]  # of no word and of one; an n-gram stands where it ends
    for _ in range(pad - 1):
        grams.append(_mixed(np.r_[np.zeros(1, np.uint64), grams[-1][:-1]], flat))
    ways = [grams[k][at - 1] for k in range(pad, 0, -1)] + [flat[at]] if len(at) else [np.zeros(0, np.uint64)] * order
    rest = np.stack(ways[1:], 1) if lower and order > 1 else np.zeros((len(at), 0), np.uint64)
    return _Entries(np.repeat(keys, sizes), ways[0], flat[at].astype(np.uint32) if order > 1 else np.zeros(len(at), np.uint32), rest)


class _Heavy:
    """Exact counts of the contexts and n-grams that are too frequent for a bucket, in the order of their hashes."""

    def __init__(self, rows: list[tuple[int, int]]):
        self.hashes = np.array([h for h, _ in rows], np.int64).view(np.uint64)
        by = np.argsort(self.hashes)
        self.hashes, self.counts = self.hashes[by], np.array([n for _, n in rows], np.int64)[by]

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """The counts of ``wanted``, zero for those that are not heavy."""
        return _looked_up(self.hashes, self.counts, wanted)


def _looked_up(hashes: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    return np.where(hashes[at] == wanted, counts[at], 0)


_ROW = pa.schema([("bucket", pa.int32()), ("counted", pa.bool_()), ("context", pa.list_(pa.int64())), ("word", pa.list_(pa.int32())), ("rest", pa.list_(pa.int64())), ("doc", pa.list_(pa.int64())), ("size", pa.list_(pa.int32())), ("known", pa.list_(pa.float64()))])
_SHAPE = "bucket int, counted boolean, context array<long>, word array<int>, rest array<long>, doc array<long>, size array<int>, known array<double>"


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _share(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` equal parts of the hash space each hash is in."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint16 if parts <= 65_536 else np.int32)


def _dealt(e: _Entries, buckets: int, heavy: _Heavy, counted: bool, scored: bool) -> Iterator[pa.RecordBatch]:
    """A row of arrays for each bucket; the entries of a document stand together."""
    if not len(e.key):
        return
    by = np.where(heavy(e.context) > 0, e.pair(), e.context)
    bucket = _share(by, buckets)
    order = np.argsort(bucket, kind="stable")
    e, bucket = e[order], bucket[order]
    first = _starts(bucket)
    ends = np.r_[first, len(bucket)]
    runs = _starts(bucket, e.key) if scored else np.zeros(0, np.int64)
    in_row = np.searchsorted(runs, ends)
    n, wide = len(first), e.rest.shape[1]
    columns = [
        pa.array(bucket[first].astype(np.int32)), pa.array(np.full(n, counted)), _lists(e.context.view(np.int64), ends), _lists(e.word.view(np.int32), ends), _lists(np.ascontiguousarray(e.rest).reshape(-1).view(np.int64), ends * wide),
        _lists(e.key[runs], in_row), _lists(np.diff(np.r_[runs, len(bucket)]).astype(np.int32) if scored else np.zeros(0, np.int32), in_row), _lists(np.zeros(0), np.zeros(n + 1, np.int64)),
    ]
    yield pa.RecordBatch.from_arrays(columns, schema=_ROW)


def _answered(keys: np.ndarray, values: np.ndarray, found: np.ndarray, pieces: int) -> Iterator[pa.RecordBatch]:
    """Each document's sum over its entries that are found, and their number: a row of arrays for each piece of the documents."""
    docs, at = np.unique(keys[found], return_inverse=True)
    if not len(docs):
        return
    sums, sizes = np.bincount(at, values[found], len(docs)), np.bincount(at, minlength=len(docs))
    piece = _share(docs.view(np.uint64), pieces)
    order = np.argsort(piece, kind="stable")
    piece = piece[order]
    first = _starts(piece)
    ends, n = np.r_[first, len(piece)], len(first)
    none, empty = np.zeros(n + 1, np.int64), np.zeros(0, np.int64)
    columns = [
        pa.array(piece[first].astype(np.int32)), pa.array(np.zeros(n, bool)), _lists(empty, none), _lists(empty.astype(np.int32), none), _lists(empty, none),
        _lists(docs[order], ends), _lists(sizes[order].astype(np.int32), ends), _lists(sums[order], ends),
    ]
    yield pa.RecordBatch.from_arrays(columns, schema=_ROW)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n_words, log_score) of each document of a piece."""
    got = [tuple(b.column(k).flatten().to_numpy() for k in (5, 6, 7)) for b in batches]
    if got:
        keys, sizes, sums = (np.concatenate(x) for x in zip(*got, strict=True))
        docs, at = np.unique(keys, return_inverse=True)
        columns = [pa.array(docs), pa.array(np.bincount(at, sizes, len(docs)).astype(np.int64)), pa.array(np.bincount(at, sums, len(docs)))]
        yield pa.RecordBatch.from_arrays(columns, ["key", "n_words", "log_score"])
    release()


def _read(batch: pa.RecordBatch) -> Iterator[tuple[bool, _Entries]]:
    """(whether it is counted, entries) of each row that is no answer; key is empty where nothing asks for a score."""
    for i in range(batch.num_rows):
        context, word, rest, doc, size = (batch.column(k)[i].values.to_numpy() for k in range(2, 7))
        n = len(context)
        if n:
            yield batch.column(1)[i].as_py(), _Entries(np.repeat(doc, size), context.view(np.uint64), word.view(np.uint32), rest.view(np.uint64).reshape(n, -1))


def _joined(parts: list[_Entries]) -> _Entries:
    return _Entries(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("key", "context", "word", "rest")))


def _counts(counted: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How often each of ``wanted`` is in ``counted``."""
    if counted is wanted:
        _, at, n = np.unique(wanted, return_inverse=True, return_counts=True)
        return n[at]
    return _looked_up(*np.unique(counted, return_counts=True), wanted)


def _value(e: _Entries, contexts: np.ndarray, pairs: np.ndarray, level: int, total: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """ln S of each entry and whether it is found at this level."""
    if level == 1:
        return np.log(np.maximum(pairs, 1)) - np.log(max(1, total)) + penalty, np.ones(len(pairs), bool)
    found = pairs > 0
    return np.log(np.maximum(pairs, 1)) - np.log(np.maximum(contexts, 1)) + penalty, found


def buckets_for(positions: int, least: int, params: Params) -> int:
    return max(1, least, -(-positions // params.bucket_words))


def _positions(docs: DataFrame) -> int:
    """About as many words as the texts have, from their bytes."""
    return (docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // 6


def _keyed(docs: DataFrame) -> DataFrame:
    key = F.xxhash64(F.isnull("doc_id"), "doc_id", F.isnull("text"), "text")
    return docs.select(key.alias("key"), F.col("text").cast("binary").alias("text"))


def _heavy(corpus: DataFrame, positions: int, buckets: int, level: int, params: Params) -> _Heavy:
    """The contexts and n-grams of ``level`` words that are too frequent for a bucket, with their exact counts."""

    def tally(only: _Heavy | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = _Hashes()
            for b in batches:
                e = _entries(b.column(0).to_numpy(), b.column(1).to_pylist(), hashes, level, False)
                h, n = np.unique(np.concatenate([e.context, e.pair()]) if level > 1 else e.context, return_counts=True)
                if only is not None:
                    some = only(h) > 0
                    h, n = h[some], n[some]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])
            release()

        return run

    limit = max(params.bucket_words // 4, int(positions * params.heavy_share), 1)
    if limit >= positions:
        return _Heavy([])
    share = min(1.0, params.sample_words / positions)
    some = corpus.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    least = max(params.seen, int(share * limit / 2))
    found = some.mapInArrow(tally(None), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()
    if not found:
        return _Heavy([])
    exact = corpus.mapInArrow(tally(_Heavy([(r.hash, 1) for r in found])), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    return _Heavy([(r.hash, r.n) for r in exact.where(F.col("n") >= limit // 2).collect()])


def score(docs: DataFrame, corpus: DataFrame | None = None, params: Params = Params()) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of every row of ``docs``.

    The n-grams are counted in ``corpus`` (doc_id, text), by default in ``docs``.
    """
    spark = docs.sparkSession
    text_batches(spark)
    docs = docs.select("doc_id", "text")
    own = corpus is None
    rows, counted = _keyed(docs), _keyed(docs if own else corpus.select("doc_id", "text"))
    size = _positions(counted)
    buckets = buckets_for(size if own else size + _positions(rows), parallelism(spark), params)
    pieces = max(parallelism(spark), buckets // 16)
    levels = [params.order] if own and params.order > 1 else list(range(params.order, 0, -1))
    total = counted.agg(F.sum(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^ \x09-\x0D]+")).cast("long"))).first()[0] or 0 if levels[-1] == 1 else 0
    heavy = {k: spark.sparkContext.broadcast(_heavy(counted, size, buckets, k, params)) for k in levels}

    def deal(e: _Entries, level: int, count_in: bool, ask: bool) -> Iterator[pa.RecordBatch]:
        """Entries to their buckets; those of heavy n-grams are answered here."""
        known = heavy[level].value
        pairs = known(e.pair() if level > 1 else e.context)
        out = pairs > 0
        if out.any():
            if ask:
                v, found = _value(e[out], known(e.context[out]), pairs[out], level, total, (params.order - level) * np.log(params.alpha))
                yield from _answered(e.key[out], v, found, pieces)
            e = e[~out]
        yield from _dealt(e, buckets, known, count_in, ask)

    def explode(level: int, count_in: bool, ask: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = _Hashes()
            for b in batches:
                e = _entries(b.column(0).to_numpy(), b.column(1).to_pylist(), hashes, level, ask and not own)
                yield from deal(e, level, count_in, ask)
            release()

        return run

    def answer(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Counts a bucket's contexts and n-grams and joins the counts to its entries."""
            asked, counts = [], []

            for b in batches:
                done = b.filter(pc.greater(pc.list_value_length(b.column("known")), 0))
                if done.num_rows:
                    yield done
                for is_counted, e in _read(b):
                    if is_counted:
                        counts.append(e)
                    if len(e.key):
                        asked.append(e)
            if asked:
                e = _joined(asked)
                c = e if own else _joined([_Entries(np.zeros(0, np.int64), x.context, x.word, np.zeros((0, 0), np.uint64)) for x in counts]) if counts else None
                asked.clear()
                counts.clear()
                known = heavy[level].value
                contexts = known(e.context)
                if c is not None:
                    contexts = np.where(contexts > 0, contexts, _counts(c.context, e.context))
                pairs = contexts if level == 1 else np.zeros(len(e.key), np.int64)
                if c is not None and level > 1:
                    mine = e.pair()
                    pairs = _counts(mine if own else c.pair(), mine)
                v, found = _value(e, contexts, pairs, level, total, (params.order - level) * np.log(params.alpha))
                yield from _answered(e.key, v, found, pieces)
                missed = e[~found]
                if len(missed.key):
                    below = level - 1
                    rest = missed.rest
                    word = missed.word if below > 1 else np.zeros(len(missed.key), np.uint32)
                    yield from deal(_Entries(missed.key, rest[:, 0], word, rest[:, 1:]), below, False, True)
            release()

        return run

    sent = rows.mapInArrow(explode(params.order, own, True), _SHAPE)
    for level in levels:
        if not own:
            sent = sent.unionByName(counted.mapInArrow(explode(level, True, False), _SHAPE))
        sent = sent.repartitionById(buckets, F.col("bucket")).mapInArrow(answer(level), _SHAPE)
    sums = sent.repartitionById(pieces, F.col("bucket")).mapInArrow(_added, "key long, n_words long, log_score double")
    # Rows that are alike add up under one key, and each takes its share.
    heads = docs.select("doc_id", F.xxhash64(F.isnull("doc_id"), "doc_id", F.isnull("text"), "text").alias("key"))
    alike = heads.groupBy("key").agg(F.count(F.lit(1)).alias("alike"))
    each = sums.join(alike, "key").select("key", (F.col("n_words") / F.col("alike")).cast("long").alias("n_words"), (F.col("log_score") / F.col("alike")).alias("log_score"))
    scored = heads.join(each, "key", "left").select("doc_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("log_score", F.lit(0.0)).alias("log_score"))
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
