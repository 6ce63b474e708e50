"""SimHash near-duplicates by a segment-popcount embedding and a grid range join.

A fingerprint has 64 bits.  Each half is cut into sixteen segments of two bits,
and the segments' popcounts (0, 1 or 2) embed it in a grid.  The Manhattan
distance of two embeddings never exceeds the Hamming distance of the
fingerprints.  Of two fingerprints within three bits, one half lies within one
bit, so within Manhattan distance one: each fingerprint enters, for either half,
its own cell and the cells one step below.  Two points one step apart then meet
in the lower one's own cell.  Within a cell the Manhattan distance over all 32
segments prunes, and the Hamming distance decides, so no link is missed.

Popcounts are written in unary (0: 00, 1: 01, 2: 11), which makes the Manhattan
distance the popcount of an exclusive or.

Equal fingerprints count once.  A cell of over ``Params.chunk`` entries is cut
into chunks, and pairs of chunks go to tasks of their own, so a task holds two
chunks at most and every pair is still compared.  Tasks give back spanning
forests, never all pairs.

Defined results: null text counts as empty; a text without words has fingerprint
zero and links like any other; fewer words than a shingle make one shingle of
them all; repeated rows share their fingerprint and component; a null doc_id is
never the smallest; an empty table gives an empty result; extra columns are left
out by ``near_duplicates`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, checkpointed, parallelism, release, shielded, sifted, text_batches
from .components import components

_ODD = np.uint64(0x5555555555555555)
_LOW = np.uint64(0xFFFFFFFF)
_ROWS = 65_536


@dataclass(frozen=True)
class Params:
    words: int = 3
    seed: int = 42
    chunk: int = 4_096


MAX_DISTANCE = 3


def fingerprint(text: str | None, params: Params = Params()) -> int:
    """The majority bits of the XXH64 hashes of all shingles, repeats included."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return 0
    k = min(params.words, len(words))
    line = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))  # one past the space
    starts = [0, *ends]
    view, digest, seed = memoryview(line), xxhash.xxh64_intdigest, params.seed
    hashes = np.array([digest(view[a : b - 1], seed) for a, b in zip(starts, ends[k - 1 :], strict=False)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _ROWS):
        ones += np.unpackbits(hashes[i : i + _ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, fp: long) of every row."""
    text_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, params) for t in texts], np.uint64).view(np.int64))
        release()

    return docs.select("doc_id", make(F.col("text")).alias("fp"))


def embed(fps: np.ndarray) -> np.ndarray:
    """The unary popcounts of all 32 two-bit segments, side by side."""
    up = fps >> np.uint64(1)
    return ((fps & up & _ODD) << np.uint64(1)) | ((fps | up) & _ODD)


def cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, row of fps, whether it is the row's own cell) for both halves."""
    code, out = embed(fps), []
    rows = np.arange(len(fps))
    for half in (0, 1):
        part = (code >> np.uint64(32 * half)) & _LOW
        tag = np.uint64(half << 32)
        out.append((part | tag, rows, np.ones(len(fps), bool)))
        for j in range(16):
            high, low = np.uint64(2 << 2 * j), np.uint64(1 << 2 * j)
            full, some = (part & high) != 0, (part & low) != 0
            below = np.where(full, part & ~high, part & ~low)
            out.append(((below | tag)[some], rows[some], np.zeros(some.sum(), bool)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _forest(group: np.ndarray, fps: np.ndarray, own: np.ndarray, max_distance: int) -> tuple[list, list]:
    """Links of a spanning forest of the pairs in the same group; rows come sorted by group."""
    code, parent = embed(fps), {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = up = parent.get(up, up)
            x = up
        return x

    us, vs = [], []
    at, step = np.arange(len(fps) - 1), 1
    while True:
        at = at[at + step < len(fps)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            return us, vs
        for i in range(0, len(at), 1 << 20):
            a = at[i : i + (1 << 20)]
            a = a[own[a] | own[a + step]]
            a = a[np.bitwise_count(code[a] ^ code[a + step]) <= max_distance]
            a = a[np.bitwise_count(fps[a] ^ fps[a + step]) <= max_distance]
            for u, v in zip(fps[a].tolist(), fps[a + step].tolist(), strict=True):
                p, q = root(u), root(v)
                if p != q:
                    parent[p] = q
                    us.append(u)
                    vs.append(v)
        step += 1


def _links(max_distance: int):
    """For mapInArrow over (g, fp, own), sorted by g: whole groups at a time."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def emit(parts: list) -> Iterator[pa.RecordBatch]:
        g, f, o = (np.concatenate(x) for x in zip(*parts, strict=True))
        u, v = _forest(g, f, o, max_distance)
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (u, v)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for b in batches:
            g, f, o = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(g):
                continue
            parts.append((g, f.astype(np.int64).view(np.uint64), o.astype(bool)))
            rows += len(g)
            if rows >= 100_000:
                g, f, o = (np.concatenate(x) for x in zip(*parts, strict=True))
                cut = int(np.searchsorted(g, g[-1]))
                if cut:
                    yield from emit([(g[:cut], f[:cut], o[:cut])])
                parts, rows = [(g[cut:], f[cut:], o[cut:])], len(g) - cut
        if parts:
            yield from emit(parts)
        parts.clear()
        release()

    return run


def links(distinct: DataFrame, params: Params = Params()) -> DataFrame:
    """(u, v): for distinct fingerprints ``fp``, links that connect all pairs within three bits."""
    n = parallelism(distinct.sparkSession)
    schema = pa.schema([("cell", pa.int64()), ("fp", pa.int64()), ("own", pa.bool_())])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy().astype(np.int64).view(np.uint64)
            cell, row, own = cells(fps)
            for i in range(0, len(cell), _ROWS):
                part = slice(i, i + _ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(cell[part].view(np.int64)), pa.array(fps[row[part]].view(np.int64)), pa.array(own[part])], schema=schema)

    rows = distinct.select("fp").mapInArrow(entries, "cell long, fp long, own boolean").repartition(n, "cell")
    full = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > params.chunk)
    found = "u long, v long"
    cold = rows.join(full, "cell", "left_anti").select(F.col("cell").alias("g"), "fp", "own").sortWithinPartitions("g", "fp").mapInArrow(_links(MAX_DISTANCE), found)
    parts = F.ceil(F.col("size") / params.chunk)
    hot = rows.join(full, "cell").withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("fp"), "parts"))
    hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    hot = hot.select(F.xxhash64("cell", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"), "fp", "own")
    hot = hot.repartition(n, "g").sortWithinPartitions("g", "fp").mapInArrow(_links(MAX_DISTANCE), found)
    return cold.unionByName(hot)


def near_duplicates(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``.

    component_id is the smallest doc_id that links of three bits or fewer reach.
    """
    made = checkpointed(fingerprints(docs, params))
    least = made.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(made.select("fp").distinct(), params))
    linked = roots.join(least.withColumnRenamed("fp", "node"), "node")
    top = linked.groupBy("root").agg(F.min("least").alias("top"))
    moved = linked.join(top, "root").select(F.col("node").alias("fp"), "top")
    # A table of its own, so that the join below deals out both sides anew and
    # Spark can split the rows of a fingerprint that very many documents share.
    by_fp = checkpointed(least.join(moved, "fp", "left").select("fp", F.coalesce("top", "least").alias("component_id")))
    return made.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


@dataclass(frozen=True)
class Similar:
    """For links by similarity: the first ``key_bits`` search candidates, all ``bits`` thin them out, texts decide.

    Signatures at a similarity of 0.8 differ in 155 of 1,024 bits, give or take 12.
    """

    words: int = 5
    seed: int = 42
    bits: int = 1024
    key_bits: int = 256
    bands: int = 48
    band_bits: int = 14
    candidate_distance: int = 60
    link_distance: int = 195
    similarity: float = 0.8
    chunk: int = 1024

    def places(self) -> np.ndarray:
        """The bits that each band reads, by a fixed seed."""
        rng = np.random.default_rng(self.seed)
        return np.stack([rng.choice(self.key_bits, self.band_bits, replace=False) for _ in range(self.bands)])


def shingle_hashes(text: str | None, params: Similar = Similar()) -> np.ndarray:
    """The XXH64 hashes of the distinct shingles, rising."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(params.words, len(words))
    line = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends]
    view, digest, seed = memoryview(line), xxhash.xxh64_intdigest, params.seed
    return np.unique(np.array([digest(view[a : b - 1], seed) for a, b in zip(starts, ends[k - 1 :], strict=False)], np.uint64))


def signature(hashes: np.ndarray, params: Similar = Similar()) -> bytes:
    """The majority bits of distinct shingles' hashes, as links go by sets; each hash is stretched to ``bits`` by counted mixing."""
    count = np.arange(1, params.bits // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(params.bits, np.int64)
    for i in range(0, len(hashes), 255):  # so that a byte holds the sum
        x = hashes[i : i + 255, None] + count
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


#: Groups of as many rows at most are compared many at once, in runs of as many rows.
_SMALL, _RUN = 64, 8192


def _tree(group: np.ndarray, node: np.ndarray, keys: np.ndarray, limit: int) -> tuple[list, list]:
    """Links of least distance that connect the pairs within ``limit`` in the same group; rows come sorted by group.

    A pair that fails a later check had no closer way round within its group.
    Small groups go together, a few thousand rows at a time; a larger one goes
    alone, by a way that holds one distance for each of its rows and no pairs.
    """
    us, vs = [], []
    ends = np.r_[np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)] if len(group) else np.zeros(0, np.int64)
    begin = at = 0
    for end in ends.tolist():
        if end - at > _SMALL or end - begin > _RUN:
            _small_trees(group[begin:at], node[begin:at], keys[begin:at], limit, us, vs)
            begin = at
        if end - at > _SMALL:
            _large_tree(node[at:end], keys[at:end], limit, us, vs)
            begin = end
        at = end
    _small_trees(group[begin:at], node[begin:at], keys[begin:at], limit, us, vs)
    return us, vs


def _large_tree(node: np.ndarray, keys: np.ndarray, limit: int, us: list, vs: list) -> None:
    """One group: each step takes the row closest to those taken, or begins a new tree where none is within ``limit``."""
    n, far = len(node), np.iinfo(np.int64).max
    least, by, i = np.full(n, far - 1), np.zeros(n, np.int64), 0
    for _ in range(n - 1):
        least[i] = far
        d = np.bitwise_count(keys ^ keys[i]).sum(1, dtype=np.int64)
        closer = (d < least) & (least != far)
        least[closer], by[closer] = d[closer], i
        i = int(least.argmin())
        if least[i] <= limit:
            us.append(int(node[by[i]]))
            vs.append(int(node[i]))


def _small_trees(group: np.ndarray, node: np.ndarray, keys: np.ndarray, limit: int, us: list, vs: list) -> None:
    found, at, step = [], np.arange(len(node) - 1), 1
    while True:
        at = at[at + step < len(node)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        d = np.bitwise_count(keys[at] ^ keys[at + step]).sum(1, dtype=np.int64)
        near = d <= limit
        found.append(np.stack([d[near], at[near], at[near] + step], 1))
        step += 1
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = up = parent.get(up, up)
            x = up
        return x

    pairs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    for _, i, j in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
        # Trees are kept for each group apart: a node may stand in several.
        p, q = root(i), root(j)
        if p != q:
            parent[p] = q
            us.append(int(node[i]))
            vs.append(int(node[j]))


def similar_links(nodes: DataFrame, params: Similar = Similar()) -> DataFrame:
    """(u, v): candidate links of nodes(node, sig) whose signatures differ in ``link_distance`` bits at most.

    The grid of ``links`` with segments of one bit, whose popcount is the bit
    itself: at the distances of a similarity of 0.8, popcounts of wider segments
    hardly differ from those of unlike texts.  A cell is a band of
    ``band_bits`` sampled segments; within a cell the Manhattan distance over the
    first ``key_bits`` segments bounds that over all from below and sorts the
    pairs into trees of least distance; the distance over all segments decides.
    """
    n = parallelism(nodes.sparkSession)
    schema = pa.schema([("g", pa.int64()), ("node", pa.int64()), ("key", pa.binary())])
    size = params.key_bits // 8

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, weights = params.places(), np.left_shift(1, np.arange(params.band_bits))
        for b in batches:
            key = [s[:size] for s in b.column(1).to_pylist()]
            if not key:
                continue
            bits = np.unpackbits(np.frombuffer(b"".join(key), np.uint8).reshape(-1, size), axis=1, bitorder="little")
            packed, column = pa.array(key, pa.binary()), b.column(0)
            for k, place in enumerate(places):
                g = bits[:, place] @ weights + (k << params.band_bits)
                yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), column, packed], schema=schema)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

        def emit(g: np.ndarray, node: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
            u, v = _tree(g, node, key, params.candidate_distance)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=out)

        parts, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            key = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(-1, size // 8)
            parts.append((b.column(0).to_numpy(), b.column(1).to_numpy(), key))
            rows += b.num_rows
            if rows >= 50_000:
                g, node, key = (np.concatenate(x) for x in zip(*parts, strict=True))
                cut = int(np.searchsorted(g, g[-1]))
                if cut:
                    yield from emit(g[:cut], node[:cut], key[:cut])
                parts, rows = [(g[cut:], node[cut:], key[cut:])], len(g) - cut
        if parts:
            yield from emit(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        parts.clear()
        release()

    rows = nodes.select("node", "sig").mapInArrow(entries, "g long, node long, key binary")
    full = rows.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > params.chunk)
    # There are ``bands`` times 2 ** ``band_bits`` cells, so this table has 786,432 rows at most
    # and is broadcast: entries then know their chunks before they are shuffled, once for all.
    full = checkpointed(full.select("g", F.ceil(F.col("size") / params.chunk).alias("parts")))
    rows = rows.join(F.broadcast(full), "g", "left").withColumn("mine", F.pmod(F.xxhash64("node"), "parts"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
    pair = F.xxhash64("g", F.least("mine", "other"), F.greatest("mine", "other"))
    rows = rows.select(F.when(F.isnull("parts"), F.col("g")).otherwise(pair).alias("g"), "node", "key")
    found = rows.repartition(n, "g").sortWithinPartitions("g", "node").mapInArrow(trees, "u long, v long")
    pairs = found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    both = pairs.join(nodes.select(F.col("node").alias("u"), F.col("sig").alias("su")), "u").join(nodes.select(F.col("node").alias("v"), F.col("sig").alias("sv")), "v")

    @F.pandas_udf("int")
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="int32")
        x, y = (np.frombuffer(b"".join(c), np.uint64).reshape(len(c), params.bits // 64) for c in (a, b))
        return pd.Series(np.bitwise_count(x ^ y).sum(1, dtype=np.int64).astype(np.int32))

    return both.where(apart("su", "sv") <= params.link_distance).select("u", "v")


def jaccard(a: str | None, b: str | None, words: int) -> float:
    """Shared shingles over all shingles, as sets."""

    def shingles(text: str | None) -> set[bytes]:
        w = (text or "").encode("utf-8", "replace").translate(LOWER).split()
        return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def _row_key():
    """A hash of doc_id and text, which names a row also where ids are null or repeat."""
    return F.xxhash64(F.isnull("doc_id"), "doc_id", F.isnull("text"), "text")


def near_links(nodes: DataFrame, params: Params = Params()) -> DataFrame:
    """(u, v): candidate links of nodes(node, fp) whose fingerprints are equal or within three bits.

    The range join of ``links`` over the grid of segment popcounts goes by distinct
    fingerprints; nodes that share one hang on the least of them.
    """
    first = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    equal = nodes.join(first, "fp").where(F.col("node") != F.col("first")).select(F.col("first").alias("u"), F.col("node").alias("v"))
    near = links(first.select("fp"), params).distinct().join(first.toDF("u", "fu"), "u").join(first.toDF("v", "fv"), "v")
    return equal.unionByName(near.select(F.col("fu").alias("u"), F.col("fv").alias("v")))


def _groups(docs: DataFrame, params: Similar, fine: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, node) of every row, and for every node ``top``: (no_id, doc_id, key, fp) of the row that stands for its group, and ``alone``: whether that is the node's only row.

    Candidates come from the popcount grid of the 64-bit fingerprints
    (``near_links``); links at a similarity that leaves more than three bits come
    from longer signatures as well (``similar_links``).  The texts of each
    candidate decide.

    Texts with the same set of shingles make one node, named by a 64-bit hash of
    the set; texts that share no more than their signature meet in all bands and
    take the same check as any others.
    """
    text_batches(docs.sparkSession)

    @F.pandas_udf("sig binary, node long, fp long")
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            hashes = [shingle_hashes(t, params) for t in texts]
            nodes = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in hashes], np.uint64)
            fps = np.array([fingerprint(t, fine) for t in texts], np.uint64)
            yield pd.DataFrame({"sig": [signature(h, params) for h in hashes], "node": nodes.view(np.int64), "fp": fps.view(np.int64)})
        release()

    made = docs.select("doc_id", _row_key().alias("key"), make(F.col("text")).alias("made"))
    made = checkpointed(made.select("doc_id", "key", "made.sig", "made.node", "made.fp"))
    row = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "key", "fp")
    nodes = checkpointed(made.groupBy("node").agg(F.min(row).alias("least"), F.min("sig").alias("sig"), F.count(F.lit(1)).alias("rows")))

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(x, y, params.words) for x, y in zip(a, b, strict=True)], dtype="float64")

    keys = nodes.select("node", "least.key")
    found = near_links(nodes.select("node", "least.fp"), fine).unionByName(similar_links(nodes, params))
    found = found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    pairs = checkpointed(found.join(keys.toDF("u", "ku"), "u").join(keys.toDF("v", "kv"), "v"))
    used = pairs.select(F.explode(F.array("ku", "kv")).alias("key")).distinct()
    texts = sifted(docs.select(_row_key().alias("key"), "text"), used, "key").where("sifted").drop("sifted")
    texts = texts.join(used, "key", "left_semi").dropDuplicates(["key"])
    both = pairs.join(texts.toDF("ku", "tu"), "ku").join(texts.toDF("kv", "tv"), "kv")
    roots = components(both.where(alike("tu", "tv") >= params.similarity).select("u", "v"))
    linked = roots.join(nodes.select("node", "least"), "node")
    top = linked.groupBy("root").agg(F.min("least").alias("top"))
    moved = linked.join(top, "root").select("node", "top")
    by_node = nodes.select("node", "least", "rows").join(moved, "node", "left").withColumn("top", F.coalesce("top", "least"))
    alone = (F.col("rows") == 1) & (F.col("top.key") == F.col("least.key"))
    return made.select("doc_id", "key", "node"), checkpointed(by_node.select("node", "top", alone.alias("alone")))


def similar_documents(docs: DataFrame, params: Similar = Similar()) -> DataFrame:
    """(doc_id, component_id): groups that links of a similarity of 0.8 or more hold together.

    Similarity is that of the sets of shingles (Jaccard), checked on the texts of
    every candidate link.  A group without ids has a null component_id.
    """
    made, by_node = _groups(docs, params)
    return made.join(by_node, "node").select("doc_id", F.col("top.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, params: Similar = Similar()) -> DataFrame:
    """One row of each group of similar documents, that with its smallest doc_id; all columns stay.

    Null ids come last, and rows of one doc_id in the order of a hash of their
    text.  Rows that stay for sure are not shuffled.
    """
    own, back = shielded(docs, ("doc_id", "text"))
    made, by_node = _groups(own, params)
    keep = by_node.select("top.key").distinct()
    doubtful = made.join(by_node.where(~F.col("alone")), "node").select("key").distinct()
    rows = sifted(own.withColumn("key", _row_key()), doubtful, "key")
    first = rows.where("sifted").join(keep, "key", "left_semi").dropDuplicates(["key"])
    return back(rows.where(~F.col("sifted")).unionByName(first))
