"""Mesh simplification by quadric error, one spatial tile for a task.

Faces belong to the tile of their centroid.  Vertices that faces of two tiles
share are locked, so tiles fit together again whatever each has collapsed, and a
tile is all that a task holds; tiles with too many faces are halved.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .mesh import with_corners

OUT = "tile string, a long, b long, c long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double"


def _cross(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``np.cross`` of two single vectors, without what it takes to be ready for arrays of them."""
    (a, b, c), (d, e, f) = u.tolist(), v.tolist()
    return np.array([b * f - c * e, c * d - a * f, a * e - b * d])


def decimate(points: dict[int, np.ndarray], faces: list[tuple[int, int, int]], keep: int, locked: set[int]) -> tuple[dict[int, np.ndarray], list[tuple[int, int, int]]]:
    """Collapses the cheapest edges until ``keep`` faces are left or none may go.

    A collapse needs the link condition (the ends share exactly two neighbours,
    or one on the rim), must turn no face over, and keeps locked ends in place.
    """
    points, alive = dict(points), dict(enumerate(faces))
    around: defaultdict[int, set[int]] = defaultdict(set)
    q: defaultdict[int, np.ndarray] = defaultdict(lambda: np.zeros((4, 4)))

    def normal(f: tuple, moved: int | None = None, to: np.ndarray | None = None) -> np.ndarray:
        p = [to if v == moved else points[v] for v in f]
        return _cross(p[1] - p[0], p[2] - p[0])

    for k, f in alive.items():
        n = normal(f)
        area = np.linalg.norm(n)
        plane = np.append(n / area, -(n / area) @ points[f[0]]) if area > 0 else np.zeros(4)
        for v in f:
            around[v].add(k)
            q[v] = q[v] + np.outer(plane, plane) * area / 2

    def neighbours(v: int) -> set[int]:
        return {w for k in around[v] for w in alive[k]} - {v}

    # On the rim an upright plane along each edge keeps the outline from shrinking.
    sides: defaultdict[tuple[int, int], list[int]] = defaultdict(list)
    for k, f in alive.items():
        for e in ((f[0], f[1]), (f[1], f[2]), (f[2], f[0])):
            sides[min(e), max(e)].append(k)
    for (a, b), ks in sides.items():
        if len(ks) == 1:
            along = points[b] - points[a]
            up = _cross(along, normal(alive[ks[0]]))
            if (size := np.linalg.norm(up)) > 0:
                plane = np.append(up / size, -(up / size) @ points[a])
                for v in (a, b):
                    q[v] = q[v] + 10 * np.outer(plane, plane) * (along @ along)

    stamp: defaultdict[int, int] = defaultdict(int)
    heap: list[tuple] = []

    def offer(a: int, b: int) -> None:
        if a in locked and b in locked:
            return
        m = q[a] + q[b]
        if a in locked or b in locked:
            spots = [points[a if a in locked else b]]
        else:
            spots = [points[a], points[b], (points[a] + points[b]) / 2]
            if abs(np.linalg.det(m[:3, :3])) > 1e-12:
                spots.insert(0, np.linalg.solve(m[:3, :3], -m[:3, 3]))
        ends = [np.array([*s.tolist(), 1.0]) for s in spots]
        costs = [float(h @ m @ h) for h in ends]
        i = int(np.argmin(costs))
        heapq.heappush(heap, (costs[i], a, b, stamp[a], stamp[b], tuple(spots[i])))

    for a, b in sorted({tuple(sorted(e)) for f in faces for e in ((f[0], f[1]), (f[1], f[2]), (f[2], f[0]))}):
        offer(a, b)
    while heap and len(alive) > keep:
        _, a, b, sa, sb, spot = heapq.heappop(heap)
        if stamp[a] != sa or stamp[b] != sb or not around[a] or not around[b]:
            continue
        both = around[a] & around[b]
        if not both or len(neighbours(a) & neighbours(b)) != len(both):
            continue
        to = np.array(spot)
        if any((normal(alive[k]) @ normal(alive[k], v, to)) <= 0 for v in (a, b) for k in around[v] - both):
            continue
        stays, goes = (b, a) if b in locked else (a, b)
        points[stays], q[stays] = to, q[a] + q[b]
        for k in both:
            for v in alive.pop(k):
                around[v].discard(k)
        for k in list(around[goes]):
            alive[k] = tuple(stays if v == goes else v for v in alive[k])
            around[stays].add(k)
        around[goes] = set()
        stamp[stays] += 1
        stamp[goes] += 1
        for w in neighbours(stays):
            offer(*sorted((stays, w)))
    used = {v for f in alive.values() for v in f}
    return {v: points[v] for v in used}, list(alive.values())


#: How often a cube may be halved until it holds few enough faces.
SPLITS = 6


def tiles(centres: DataFrame, tile: float, most: int) -> DataFrame:
    """``centres`` (cx, cy, cz, ..) with ``tile``: the largest cube of side ``tile``, or that halved up to ``SPLITS`` times, that holds ``most`` rows or fewer.

    Rows are counted by the finest cubes, and those counts added up for each
    coarser size, so no cube's rows come together before it is chosen.
    """
    fine = tile / (1 << SPLITS)
    df = centres.withColumns({f"_{n}": F.floor(F.col(f"c{n}") / fine).cast("long") for n in "xyz"})
    keys = ["_x", "_y", "_z"]
    cells = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    chosen = F.concat_ws(",", F.lit(SPLITS), *keys)
    for k in reversed(range(SPLITS)):
        up = [F.shiftright(c, SPLITS - k) for c in keys]
        cells = cells.withColumn(f"_s{k}", F.sum("_n").over(Window.partitionBy(*up)))
        chosen = F.when(F.col(f"_s{k}") <= most, F.concat_ws(",", F.lit(k), *up)).otherwise(chosen)
    return df.join(cells.select(*keys, chosen.alias("tile")), keys).drop(*keys)


def simplify(faces: DataFrame, vertices: DataFrame, share: float, tile: float, most: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) with about ``share`` of the faces; ``tile`` is the side of the cubes that tasks hold.

    A cube of over ``most`` faces is halved until its parts hold no more (or
    ``SPLITS`` times), so a dense place costs a task no more than any other.
    """
    got = with_corners(faces, vertices)
    at = {f"c{n}": (F.col(f"pa.{n}") + F.col(f"pb.{n}") + F.col(f"pc.{n}")) / 3 for n in "xyz"}
    got = tiles(got.select("a", "b", "c", "pa", "pb", "pc").withColumns(at), tile, most).drop("cx", "cy", "cz")
    uses = got.select("tile", F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    seams = uses.groupBy("vid").agg((F.count(F.lit(1)) > 1).alias("locked"))
    mine = uses.join(seams, "vid").where("locked").select("tile", "vid").groupBy("tile").agg(F.collect_set("vid").alias("seam"))
    got = got.join(mine, "tile", "left")

    def run(x: pd.DataFrame) -> pd.DataFrame:
        points: dict[int, np.ndarray] = {}
        for n in "abc":
            for v, p in zip(x[n], x[f"p{n}"], strict=True):
                points[int(v)] = np.array([p["x"], p["y"], p["z"]] if isinstance(p, dict) else list(p), float)
        seam = x["seam"].iloc[0]
        new, left = decimate(points, sorted(zip(*(map(int, x[n]) for n in "abc"), strict=True)), int(len(x) * share), set(map(int, seam)) if seam is not None else set())
        rows = [(x["tile"].iloc[0], *f, *(c for v in f for c in map(float, new[v]))) for f in left]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    done = got.select("tile", "a", "b", "c", "pa", "pb", "pc", "seam").groupBy("tile").applyInPandas(run, OUT)
    corner = F.explode(F.array(*(F.struct(F.col(n).alias("vid"), *(F.col(f"{n}{a}").alias(a) for a in "xyz")) for n in "abc")))
    out = done.select(corner.alias("v")).groupBy("v.vid").agg(*(F.min(f"v.{a}").alias(a) for a in "xyz"))
    return out, done.select("a", "b", "c")
