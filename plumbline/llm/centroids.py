"""Lloyd's clustering with two trees: a cover tree over vectors, and a tree over the centroids of each round.

Vectors become integers, floor(scale * component).  Each task cuts its vectors
into blocks of ``Params.block`` and builds a cover tree over each: a node's
children stand more than half its reach apart, and each covers what lies within
that half.  Blocks are written once to the shared folder, in tree order, and
every round reads them where they are; nothing but sums moves.

A round walks both trees together.  A pair of nodes gets bounds from the distance
of their centres and their radii; a pair goes if another centroid is surely
closer to the whole vector node.  A vector node with one centroid left gives its
sum and count as a whole; leaf pairs are compared exactly in 64-bit integers, and
the smaller number wins a tie.  Bounds carry a slack that rounding can't reach.

Sums are added up by (centroid, component) in Spark, so a centroid that takes a
third of all vectors costs a task no more than any other; the driver sees k rows
of components in a round.  Trees over centroids and centroids themselves travel
with the tasks; their size, k times the dimension, is bounded by
``Params.most_centroids``.

Defined results: vectors that are null, of another length, or with a null or
non-finite component are left out; fewer kept vectors than ``k`` make as many
centroids as there are; a null id never starts a centroid, equal ids (or hashes)
start in the order of their components; repeated rows count and come out once
each; an empty table gives an empty result; other columns are left out whatever
their names; components beyond 2^27 after scaling are an error, since squared
distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, parallelism, release

_NODE = np.dtype([("centre", "i4"), ("start", "i4"), ("end", "i4"), ("child", "i4"), ("children", "i4"), ("radius", "f8")])
_LIMIT = 1 << 27


@dataclass(frozen=True)
class Params:
    k: int = 40
    rounds: int = 5
    dims: int = 64
    scale: int = 256
    salt: str = "2:"
    block: int = 1024
    leaf: int = 16
    pairs: int = 32_768
    most_centroids: int = 65_536


def cover_tree(points: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, nodes): the points in tree order, and nodes from the root on, whose points are order[start:end].

    ``radius`` is the distance of the farthest point from the centre.  A node of
    ``leaf`` points or fewer, or of equal points, has no children.
    """
    x = points.astype(np.float64)
    order = np.arange(len(x))
    nodes: list[tuple] = []

    def distances(centre: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.square(x[rows] - x[centre]).sum(1))

    if not len(x):
        return order, np.zeros(0, _NODE)
    waiting = [(0, 0, len(x), distances(0, order))]
    nodes.append(())
    at = 0
    while at < len(waiting):
        centre, start, end, d = waiting[at]
        radius, rows, kids = float(d.max()), order[start:end], []
        if end - start > leaf and radius > 0:
            half, left, groups = radius / 2, np.arange(end - start), []
            c = centre
            while True:
                dc = distances(c, rows[left]) if groups else d
                near = dc <= half
                groups.append((c, rows[left[near]], dc[near]))
                left = left[~near]
                if not len(left):
                    break
                c = int(rows[left[0]])
            place = start
            for c, own, dc in groups:
                order[place : place + len(own)] = own
                kids.append((c, place, place + len(own), dc))
                place += len(own)
        nodes[at] = (centre, start, end, len(waiting), len(kids), radius)
        waiting[at] = ()
        waiting += kids
        nodes += [()] * len(kids)
        at += 1
    out = np.array(nodes, _NODE)
    where = np.empty(len(x), np.int64)
    where[order] = np.arange(len(x))
    out["centre"] = where[out["centre"]]
    return order, out


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.square(a - b).sum(1)


def _expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for count[0] places, then start[1] ..."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + count, count)


class Centroids:
    """Centroids under a tree, for one round."""

    def __init__(self, values: np.ndarray, params: Params = Params()):
        self.values, self.params = values, params
        self.order, self.nodes = cover_tree(values, 1)
        self.centre = values[self.order][self.nodes["centre"]].astype(np.float64)

    def _exact(self, points: np.ndarray, row: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, centroid, squared distance): the nearest of the candidates; a row's candidates stand together."""
        rows, best, least = [], [], []
        cuts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        at = 0
        while at < len(cuts):
            upto = max(at + 1, int(np.searchsorted(cuts, cuts[at] + self.params.pairs)))
            a, b = cuts[at], cuts[upto] if upto < len(cuts) else len(row)
            d = np.concatenate([_squared(points[row[i : i + self.params.pairs]], self.values[which[i : i + self.params.pairs]]) for i in range(a, b, self.params.pairs)])
            first = cuts[at:upto] - a
            low = np.minimum.reduceat(d, first)
            number = np.where(d == np.repeat(low, np.diff(np.r_[first, b - a])), which[a:b], len(self.values))
            rows.append(row[cuts[at:upto]])
            best.append(np.minimum.reduceat(number, first))
            least.append(low)
            at = upto
        empty = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) if x else empty for x in (rows, best, least))

    def walk(self, points: np.ndarray, nodes: np.ndarray) -> tuple[tuple, tuple]:
        """((start, end, centroid) of node ranges that go to one centroid as a whole, (row, centroid, squared distance) of the others)."""
        tree, own, centre = self.nodes, nodes, points[nodes["centre"]].astype(np.float64)
        whole, singles = [], []
        q, r = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(q):
            d = np.concatenate([np.sqrt(_squared(centre[q[i : i + self.params.pairs]], self.centre[r[i : i + self.params.pairs]])) for i in range(0, len(q), self.params.pairs)])
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            count = np.diff(np.r_[first, len(q)])
            upper = np.repeat(np.minimum.reduceat(d + own["radius"][q], first), count)
            stay = d - own["radius"][q] - tree["radius"][r] <= upper * (1 + 1e-9) + 1e-6
            q, r = q[stay], r[stay]
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            count = np.diff(np.r_[first, len(q)])
            inner = tree["children"][r] > 0
            several = tree["end"][r] - tree["start"][r]  # equal centroids share a leaf
            open_ = np.maximum.reduceat(inner, first)
            one = ~open_ & (count == 1) & (several[first] == 1)
            w = first[one]
            whole.append((own["start"][q[w]], own["end"][q[w]], self.order[tree["start"][r[w]]]))
            at_leaf = ~open_ & ~one & (own["children"][q[first]] == 0)
            each = np.repeat(at_leaf, count)
            if each.any():
                lq, lr = q[each], r[each]
                k = several[each]
                which, of = self.order[_expand(tree["start"][lr].astype(np.int64), k)], np.repeat(lq, k)
                n = (own["end"] - own["start"])[of]
                row, which = _expand(own["start"][of].astype(np.int64), n), np.repeat(which, n)
                by = np.argsort(row, kind="stable")
                singles.append(self._exact(points, row[by], which[by]))
            # What is left goes on: centroid nodes open first, then vector nodes.
            down = np.repeat(open_, count)
            kids = np.where(inner, tree["children"][r], 1)
            q1, r1 = np.repeat(q[down], kids[down]), _expand(np.where(inner, tree["child"][r], r)[down].astype(np.int64), kids[down])
            split = np.repeat(~open_ & ~one & ~at_leaf, count)
            n = own["children"][q[split]]
            q2, r2 = _expand(own["child"][q[split]].astype(np.int64), n), np.repeat(r[split], n)
            q, r = np.concatenate([q1, q2]), np.concatenate([r1, r2])
            by = np.argsort(q, kind="stable")
            q, r = q[by], r[by]
        empty = (np.zeros(0, np.int64),) * 3
        join = lambda parts: tuple(np.concatenate(x) for x in zip(*(parts or [empty]), strict=True))
        return join(whole), join(singles)

    def sums(self, points: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """For every centroid the sums of its vectors' components, and their count."""
        out = np.zeros((len(self.values), points.shape[1] + 1), np.int64)
        (start, end, number), (row, single, _) = self.walk(points, nodes)
        run = np.zeros((len(points) + 1, points.shape[1]), np.int64)
        np.cumsum(points, axis=0, out=run[1:])
        np.add.at(out, number, np.c_[run[end] - run[start], end - start])
        np.add.at(out, single, np.c_[points[row], np.ones(len(row), np.int64)])
        return out

    def assign(self, points: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of every vector."""
        cluster, distance = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        (start, end, number), (row, single, d) = self.walk(points, nodes)
        rows, which = _expand(start.astype(np.int64), end - start), np.repeat(number, end - start)
        cluster[rows] = which
        distance[rows] = _squared(points[rows], self.values[which])
        cluster[row], distance[row] = single, d
        return cluster, distance


def integers(embedding: str, params: Params = Params()) -> tuple[Column, Column]:
    """(the integer components as doubles, whether the vector is kept)."""
    v = F.col(embedding)
    fit = F.size(v) == params.dims
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.transform(v, lambda x: F.floor(F.lit(float(params.scale)) * x.cast("double")).cast("double")), F.coalesce(fit & good, F.lit(False))


def _blocks(kept: DataFrame, params: Params) -> DataFrame:
    """(ids, points, nodes): trees over blocks of the vectors of each task."""
    kind = kept.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values, size = [], [], 0

        def tree() -> pa.RecordBatch:
            id_, x = pa.concat_arrays(ids), np.concatenate(values)
            rest_ids, rest = id_[params.block :], x[params.block :]
            id_, x = id_[: params.block], x[: params.block]
            if np.abs(x).max() > _LIMIT:
                raise ValueError("a component is beyond 2^27 after scaling: squared distances would leave 64 bits")
            order, nodes = cover_tree(x, params.leaf)
            ids[:], values[:] = [rest_ids], [rest]
            made = [id_.take(pa.array(order))]
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), made[0]), pa.array([x[order].astype(np.int32).tobytes()], pa.binary()), pa.array([nodes.tobytes()], pa.binary())],
                names=["ids", "points", "nodes"],
            )

        for b in batches:
            if not b.num_rows:
                continue
            ids.append(b.column(0))
            values.append(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, params.dims))
            size += b.num_rows
            while size >= params.block:
                yield tree()
                size -= params.block
        if size:
            yield tree()
        release()

    return kept.select("vec_id", "q").mapInArrow(run, f"ids array<{kind}>, points binary, nodes binary")


def _read(b: pa.RecordBatch, k: int, params: Params) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(b.column("points")[k].as_py(), np.int32).reshape(-1, params.dims).astype(np.int64)
    return points, np.frombuffer(b.column("nodes")[k].as_py(), _NODE)


def _sums(blocks: DataFrame, now: np.ndarray, params: Params) -> np.ndarray:
    """Sums of components and counts for each centroid over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        round_, total = Centroids(now, params), np.zeros((len(now), params.dims + 1), np.int64)
        for b in batches:
            for k in range(b.num_rows):
                total += round_.sums(*_read(b, k, params))
        number, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(place), pa.array(total[number, place])], names=["cluster", "place", "total"])

    parts = blocks.select("points", "nodes").mapInArrow(run, "cluster long, place long, total long")
    out = np.zeros((len(now), params.dims + 1), np.int64)
    for cluster, place, total in parts.groupBy("cluster", "place").agg(F.sum("total")).toLocalIterator():
        out[cluster, place] = total
    return out


def cluster(vectors: DataFrame, params: Params = Params(), embedding: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every kept vector, the final centroids), after ``params.rounds`` rounds."""
    if params.k > params.most_centroids:
        raise ValueError(f"{params.k} centroids are over the {params.most_centroids} that travel with a task")
    spark = vectors.sparkSession
    q, good = integers(embedding, params)
    kept = vectors.where(good).select("vec_id", q.alias("q"))
    first = F.sha2(F.concat(F.lit(params.salt), F.col("vec_id").cast("string")), 256)
    start = kept.where(F.col("vec_id").isNotNull()).select("q").orderBy(first, "q").limit(params.k).collect()
    if kept.rdd.getNumPartitions() < parallelism(spark):
        kept = kept.repartition(parallelism(spark))
    blocks = checkpointed(_blocks(kept, params))
    now = np.array([r.q for r in start], np.float64).reshape(-1, params.dims)
    if len(now) and np.abs(now).max() > _LIMIT:
        raise ValueError("a component is beyond 2^27 after scaling: squared distances would leave 64 bits")
    now = now.astype(np.int64)
    for _ in range(params.rounds if len(now) else 0):
        total = _sums(blocks, now, params)
        count = total[:, -1:]
        now = np.where(count > 0, total[:, :-1] // np.maximum(count, 1), now)
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = Centroids(now, params) if len(now) else None
        for b in batches:
            for k in range(b.num_rows if last else 0):
                number, distance = last.assign(*_read(b, k, params))
                yield pa.RecordBatch.from_arrays([b.column("ids")[k].values, pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])
        release()

    return blocks.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"), now


def clustered(vectors: DataFrame, params: Params = Params(), embedding: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    found, centroids = cluster(vectors, params, embedding)
    found = checkpointed(found)
    by = found.groupBy("cluster").agg(F.sum("distance")).collect()  # a row for each centroid
    inertia = sum(r[1] for r in by)
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    about = found.sparkSession.createDataFrame([(r[0], r[1], inertia, digest[r[0]]) for r in by], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
