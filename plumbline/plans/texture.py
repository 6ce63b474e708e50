"""Photographs on a mesh as one plan: a view for each triangle, an atlas, painted tiles, strips of the picture.

Views are found through a grid over the triangles' centres: a frame goes to the
cells that its frustum may touch, level by level of a grid that gets finer with
the mesh, a triangle to its own cell, and they meet by an equi-join.  The frustum
test of a cell errs on the side of more, so no view is lost.  Tiles are packed in shelves, largest first, by their size classes: since
sizes and the side are powers of two, a tile's place follows from its number, and
numbers come from a sort over the cluster; the driver sees one count a class.
Painting reads each frame's picture where a run of its triangles is, and a frame
that very many triangles chose is dealt to as many tasks as it takes.

Defined results: a triangle that no frame shows takes the mean of its corners'
colours, or mid-grey; degenerate triangles face nowhere; the first frame wins a
tie; where no depth was measured nothing hides a triangle; pictures that can't be
read leave their triangles to the colours; a mesh without faces has no atlas.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import mesh
from ..operators.lineage import checkpointed
from ..sources.pictures import read_picture

# Nearest depth of a view, least cosine, tolerance of depth (m), texels of margin, texels a tile has besides its edge, largest side and tiles.
NEAREST, FACING, TOLERANCE, GUTTER, MARGIN, MOST_SIDE, LEAST_TILE, MOST_TILE = 0.05, 0.25, 0.08, 1, 3, 4096, 4, 64
STRIP = MOST_TILE
GREY = 128


def corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(fid, pa, pb, pc, centre, normal); the normal is null where the triangle has no area."""
    df = mesh.with_corners(faces.select("fid", "a", "b", "c"), vertices)
    centre = V.scale(V.add(V.add(F.col("pa"), F.col("pb")), F.col("pc")), 1 / 3)
    df = V.fenced(df, {"_n": mesh.face_normal(), "centre": centre})
    size = V.length(F.col("_n"))
    return df.withColumn("normal", F.when(size > 1e-12, V.scale(F.col("_n"), 1 / F.when(size > 1e-12, size)))).select("fid", "pa", "pb", "pc", "centre", "normal")


def _pixel(local: Column, camera: Column) -> tuple[Column, Column]:
    return local["x"] * camera["fx"] / local["z"] + camera["cx"], local["y"] * camera["fy"] / local["z"] + camera["cy"]


#: A side of the box of all triangles is cut into 2 ** _FINEST cells at most; frames of one cell that meet its triangles in one task.
_FINEST, _MET = 16, 8192
_CELL = [f"c{a}" for a in "xyz"]


def _seen_cells(frames: DataFrame, leaves: DataFrame, low: list[float], side: float, level: int) -> DataFrame:
    """frames with the cells of ``leaves`` that their pyramid may touch, found from coarse cells to fine ones, of those that hold triangles."""
    now = frames
    for k in range(min(2, level), level + 1, 2):
        at = [F.shiftright(c, level - k) for c in _CELL]
        cells = leaves.select(*(F.shiftright(a, 2).alias(f"u{c}") for a, c in zip(at, _CELL, strict=True)), *(a.alias(c) for a, c in zip(at, _CELL, strict=True))).distinct()
        if k <= 2:  # 64 cells at most
            now = now.join(F.broadcast(cells.drop(*(f"u{c}" for c in _CELL))))
        else:
            now = now.withColumnsRenamed({c: f"u{c}" for c in _CELL}).join(cells, [f"u{c}" for c in _CELL]).drop(*(f"u{c}" for c in _CELL))
        step = side / 2**k
        d = [F.lit(low[i]) + (F.col(c) + 0.5) * step - F.col(f"t{a}") for i, (c, a) in enumerate(zip(_CELL, "xyz", strict=True))]
        x, y, z = (sum((F.col(f"r{i}{j}") * d[j] for j in range(3)), F.lit(0.0)) for i in range(3))
        reach, cam = step * (math.sqrt(3) / 2 * (1 + 1e-9)) + 1e-9, F.col("camera")

        def within(slope: Column, away: Column, z: Column = z, reach: float = reach) -> Column:
            """On the inner side of a plane through the eye, or no farther from it than a cell reaches."""
            return away + slope * z >= -reach * F.sqrt(slope * slope + 1)

        sides = [within(cam["cx"] / cam["fx"], x), within((cam["width"] - 1 - cam["cx"]) / cam["fx"], -x), within(cam["cy"] / cam["fy"], y), within((cam["height"] - 1 - cam["cy"]) / cam["fy"], -y)]
        good = z >= NEAREST - reach
        for s in sides:
            good &= s
        now = now.where(good)
    return now


def best_views(triangles: DataFrame, frames: DataFrame, depth: DataFrame | None = None, leaf: int = 256) -> DataFrame:
    """(fid, frame, score) of triangles(fid, centre, normal): the frame that shows each best, of those that show it.

    frames(frame: long, pose, camera, depth_camera) are pinholes; depth(frame, px,
    py, d) are measured pixels, in ``depth_camera``.  A frame shows a triangle
    whose centre is inside its picture, faces it by more than a quarter, and isn't
    more than ``TOLERANCE`` behind what was measured there.  The score is the
    square of cosine over distance along the axis.  Cells hold some ``leaf``
    triangles each, however large the mesh is; a cell that very many frames see
    is dealt to as many tasks as it takes.
    """
    usable = frames.where("camera.fx > 0 and camera.fy > 0 and camera.width > 1 and camera.height > 1")
    t = triangles.where("normal is not null").select("fid", *(F.col(f"centre.{a}").alias(f"p{a}") for a in "xyz"), *(F.col(f"normal.{a}").alias(f"n{a}") for a in "xyz"))
    t = checkpointed(t.where(~F.isnan(F.col("px") + F.col("py") + F.col("pz"))))
    box = t.agg(F.count(F.lit(1)), *(F.min(f"p{a}") for a in "xyz"), *(F.max(f"p{a}") for a in "xyz")).first()
    if not box[0]:
        return t.select("fid", F.lit(None).cast("long").alias("frame"), F.lit(None).cast("double").alias("score"))
    low, side = list(box[1:4]), max(1e-9, *(box[4 + i] - box[1 + i] for i in range(3)))
    fine = [F.least(F.floor((F.col(f"p{a}") - low[i]) / side * (1 << _FINEST)), F.lit((1 << _FINEST) - 1)).cast("int") for i, a in enumerate("xyz")]
    # How many cells hold triangles at each level, roughly: it sets the level, which no result depends on.
    levels = range(0, _FINEST + 1, 2)
    used = t.agg(*(F.approx_count_distinct(F.xxhash64(*(F.shiftright(c, _FINEST - k) for c in fine))) for k in levels)).first()
    level = next((k for k, n in zip(levels, used, strict=True) if box[0] <= leaf * n), _FINEST)
    placed = t.withColumns({c: F.shiftright(f, _FINEST - level) for c, f in zip(_CELL, fine, strict=True)})

    # The rows of the turn into the camera, so that pairs need sums of products alone.
    turned = {f"_{a}": V.rotate(V.quat_conjugate(F.col("pose.q")), V.vec(*(float(a == b) for b in "xyz"))) for a in "xyz"}
    eyes = V.fenced(usable, turned).select("frame", *(F.col(f"_{a}.{b}").alias(f"r{i}{j}") for i, b in enumerate("xyz") for j, a in enumerate("xyz")), *(F.col(f"pose.t.{a}").cast("double").alias(f"t{a}") for a in "xyz"), F.struct(*(F.col(f"camera.{n}").alias(n) for n in ("fx", "fy", "cx", "cy", "width", "height"))).alias("camera"), *(["depth_camera"] if depth is not None else []))
    leaves = checkpointed(placed.select(*_CELL).distinct())
    met = checkpointed(_seen_cells(eyes, leaves, low, side, level))
    parts = met.groupBy(*_CELL).agg(F.ceil(F.count(F.lit(1)) / _MET).cast("int").alias("parts"))
    met = met.join(parts, _CELL).withColumn("part", F.pmod(F.xxhash64("frame"), F.col("parts")).cast("int")).drop("parts")
    placed = placed.join(parts, _CELL)

    def shown(some: DataFrame) -> DataFrame:
        """(fid, frame, score, ..) of all views of the triangles ``some``."""
        pairs = some.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(met, [*_CELL, "part"])
        d = [F.col(f"p{a}") - F.col(f"t{a}") for a in "xyz"]
        x, y, z = (sum((F.col(f"r{i}{j}") * d[j] for j in range(3)), F.lit(0.0)) for i in range(3))
        pairs = pairs.where(z > NEAREST)
        u, v = _pixel({"x": x, "y": y, "z": z}, F.col("camera"))
        away = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
        facing = -(F.col("nx") * d[0] + F.col("ny") * d[1] + F.col("nz") * d[2]) / F.when(away > 0, away)
        pairs = pairs.where((u >= 0) & (v >= 0) & (u <= F.col("camera.width") - 1) & (v <= F.col("camera.height") - 1) & (facing > FACING))
        if depth is not None:
            du, dv = _pixel({"x": x, "y": y, "z": z}, F.col("depth_camera"))
            pairs = pairs.withColumns({"px_": V.round_half_up(du).cast("int"), "py_": V.round_half_up(dv).cast("int")})
            measured = depth.select("frame", F.col("px").alias("px_"), F.col("py").alias("py_"), "d")
            pairs = pairs.join(measured, ["frame", "px_", "py_"], "left").where(F.col("d").isNull() | (z <= F.col("d") + TOLERANCE))
        extra = [c for c in ("best",) if c in some.columns]
        return pairs.select("fid", "frame", (facing * facing / (z * z)).alias("score"), *extra)

    if depth is not None:
        best = shown(placed).groupBy("fid").agg(F.max(F.struct("score", (-F.col("frame")).alias("frame"))).alias("best"))
        return best.select("fid", (-F.col("best.frame")).alias("frame"), F.col("best.score").alias("score"))
    # The best score first, a number that tasks fold as they go, then the first frame that reaches it: pairs are never kept.
    best = checkpointed(shown(placed).groupBy("fid").agg(F.max("score").alias("best")))
    return shown(placed.join(best, "fid")).where("score = best").groupBy("fid").agg(F.min("frame").alias("frame"), F.max("score").alias("score"))


@dataclass(frozen=True)
class Atlas:
    """layout(fid, size, x, y, and the corners' u and v) in a square of ``side`` texels, ``texel`` metres each."""

    side: int
    texel: float
    layout: DataFrame


def _tile(edge: Column, texel: float) -> Column:
    across = F.least(F.greatest(F.ceil(edge / texel), F.lit(1)), F.lit(1 << 20)) + MARGIN
    return F.greatest(F.least(F.pow(F.lit(2.0), F.ceil(F.log2(across.cast("double")))), F.lit(float(MOST_TILE))), F.lit(float(LEAST_TILE))).cast("int")


def shelves(counts: dict[int, int], side: int) -> tuple[dict[int, tuple[int, int, int, int, int]], int]:
    """For each size, largest first: (number of the first tile, x and y where it begins, how many finish that shelf, y of the next), and the height.

    counts: tiles by size; sizes and side are powers of two.
    """
    out, x, y, height, before = {}, 0, 0, 0, 0
    for size in sorted(counts, reverse=True):
        n = counts[size]
        first = min(n, (side - x) // size) if height else 0
        top = y + height
        rest = n - first
        rows = -(-rest // (side // size))
        out[size] = (before, x, y, first, top)
        if rest:
            x, y, height = (rest - (rows - 1) * (side // size)) * size, top + (rows - 1) * size, size
        else:
            x += first * size
        before += n
    return out, y + height


def _edges(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(fid, edge): the longest edge of each face."""
    got = mesh.with_corners(faces.select("fid", "a", "b", "c"), vertices)
    edge = F.greatest(V.distance(F.col("pa"), F.col("pb")), V.distance(F.col("pb"), F.col("pc")), V.distance(F.col("pc"), F.col("pa")))
    return checkpointed(got.select("fid", edge.alias("edge")))


def _counts(edges: DataFrame, texel: float) -> dict[int, int]:
    """Tiles by size: a row for each power of two from the least to the largest."""
    return {r.size: r["count"] for r in edges.groupBy(_tile(F.col("edge"), texel).alias("size")).count().collect()}


def layout(faces: DataFrame, vertices: DataFrame, texel: float, side: int) -> DataFrame:
    """(fid, size, x, y, and the corners' u and v) in shelves ``side`` texels wide, however high they get."""
    edges = _edges(faces, vertices)
    return _laid(edges, texel, side, shelves(_counts(edges, texel), side)[0])


def plan(faces: DataFrame, vertices: DataFrame, texel: float = 0.001, most_side: int = MOST_SIDE) -> Atlas | None:
    """The atlas of a mesh; texels grow by doubling until its tiles fit."""
    edges = _edges(faces, vertices)
    texel = max(texel, 1e-5)
    for _ in range(20):
        counts = _counts(edges, texel)
        if not counts:
            return None
        side, area = 64, sum(s * s * n for s, n in counts.items())
        while side * side < area and side < most_side:
            side *= 2
        while side <= most_side:
            places, height = shelves(counts, side)
            if height <= side:
                return Atlas(side, texel, _laid(edges, texel, side, places))
            side *= 2
        texel *= 2
    return None


def _laid(edges: DataFrame, texel: float, side: int, places: dict) -> DataFrame:
    sized = edges.select("fid", _tile(F.col("edge"), texel).alias("size"))
    numbered = mesh.row_numbers(sized, [F.desc("size"), "fid"], "n")
    rows = [(s, *p) for s, p in places.items()]
    table = edges.sparkSession.createDataFrame(rows, "size int, before long, x0 int, y0 int, first int, top int")
    df = numbered.join(F.broadcast(table), "size")  # a row a size
    k = F.col("n") - F.col("before")
    later, across = k - F.col("first"), F.lit(side) / F.col("size")
    x = F.when(later < 0, F.col("x0") + k * F.col("size")).otherwise(later % across * F.col("size")).cast("int")
    y = F.when(later < 0, F.col("y0")).otherwise(F.col("top") + F.floor(later / across) * F.col("size")).cast("int")
    df = df.select("fid", "size", x.alias("x"), y.alias("y"))
    near = [(F.col(c) + GUTTER + 0.5) / side for c in "xy"]
    far = [(F.col(c) + GUTTER + 0.5 + F.col("size") - 2 * GUTTER - 1) / side for c in "xy"]
    return df.select("*", near[0].alias("ua"), near[1].alias("va"), far[0].alias("ub"), near[1].alias("vb"), near[0].alias("uc"), far[1].alias("vc"))


def _bilinear(picture: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Colours at places of a picture, in whole pixels from its first; the rim goes on beyond the edge."""
    h, w = picture.shape[:2]
    x, y = np.clip(u, 0, w - 1), np.clip(v, 0, h - 1)
    x0, y0 = np.minimum(x.astype(int), w - 2 if w > 1 else 0), np.minimum(y.astype(int), h - 2 if h > 1 else 0)
    x1, y1, fx, fy = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1), (x - x0)[..., None], (y - y0)[..., None]
    p = picture.astype(float)
    top, low = p[y0, x0] * (1 - fx) + p[y0, x1] * fx, p[y1, x0] * (1 - fx) + p[y1, x1] * fx
    return np.floor(top * (1 - fy) + low * fy + 0.5).astype(np.uint8)


def tile_points(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The weights of corners b and c at a tile's texels; the margin lies beyond the triangle."""
    span = size - 2 * GUTTER - 1
    at = (np.arange(size) - GUTTER) / span
    return np.meshgrid(at, at)


def paint(chosen: DataFrame, root: str) -> DataFrame:
    """(fid, size, x, y, texels) of chosen(fid, pa, pb, pc, size, x, y, frame, image, pose, camera, r, g, b): tiles of three bytes a texel.

    Rows without a frame, and those whose picture can't be read, are filled with
    r, g and b, or grey.  Rows come in any order: they are dealt out by (frame,
    fid), so a task opens each of its frames once.
    """
    from ..sources.points import filesystem

    spark = chosen.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    point = lambda c: F.array(*(F.col(f"{c}.{a}") for a in "xyz")).alias(c)
    turn = F.flatten(F.array(*(F.array(*row) for row in V.quat_to_rows(V.quat_normalize(V.quat_conjugate(F.col("pose.q")))))))
    lens = F.array(*(F.col(f"camera.{n}").cast("double") for n in ("fx", "fy", "cx", "cy", "width", "height")))
    eye = F.array(*(F.col(f"pose.t.{a}") for a in "xyz"))
    flat = chosen.select("fid", "size", "x", "y", "frame", "image", *(point(c) for c in ("pa", "pb", "pc")), turn.alias("turn"), eye.alias("eye"), lens.alias("lens"), *(F.col(c).cast("double").alias(c) for c in "rgb"))
    dealt = flat.repartitionByRange(parts, F.col("frame").asc_nulls_first(), "fid").sortWithinPartitions(F.col("frame").asc_nulls_first(), "fid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = filesystem(root)
        name, picture = None, None
        for x in batches:
            out = []
            for r in x.itertuples():
                uri = r.image if isinstance(r.image, str) and not pd.isna(r.frame) else None
                if uri != name:
                    name, picture = uri, None
                    if uri:
                        try:
                            with system.open_input_stream(f"{base}/{uri}", compression=None) as f:
                                picture = read_picture(f.read())
                        except (OSError, ValueError):
                            picture = None
                colour = [GREY if pd.isna(c) else int(c) for c in (r.r, r.g, r.b)]
                texels = np.full((r.size, r.size, 3), colour, np.uint8)
                if picture is not None:
                    wb, wc = tile_points(r.size)
                    a, b, c = (np.array(p) for p in (r.pa, r.pb, r.pc))
                    world = a + wb[..., None] * (b - a) + wc[..., None] * (c - a)
                    p = (world - np.array(r.eye)) @ np.array(r.turn).reshape(3, 3).T
                    fx, fy, cx, cy, w, h = r.lens
                    ok = p[..., 2] > 0.01
                    z = np.where(ok, p[..., 2], 1.0)
                    u, v = (p[..., 0] * fx / z + cx) * picture.shape[1] / w, (p[..., 1] * fy / z + cy) * picture.shape[0] / h
                    texels[ok] = _bilinear(picture, u, v)[ok]
                out.append((r.fid, r.size, r.x, r.y, texels.tobytes()))
            yield pd.DataFrame(out, columns=["fid", "size", "x", "y", "texels"])

    return dealt.mapInPandas(run, "fid long, size int, x int, y int, texels binary")


def strips(tiles: DataFrame, side: int) -> DataFrame:
    """(strip, height, rgb): the atlas in rows of ``STRIP`` texels, which no tile crosses; grey where no tile is."""
    height = min(STRIP, side)

    def run(x: pd.DataFrame) -> pd.DataFrame:
        top = int(x["strip"].iloc[0]) * height
        out = np.full((height, side, 3), GREY, np.uint8)
        for r in x.itertuples():
            out[r.y - top : r.y - top + r.size, r.x : r.x + r.size] = np.frombuffer(r.texels, np.uint8).reshape(r.size, r.size, 3)
        return pd.DataFrame([[x["strip"].iloc[0], height, out.tobytes()]], columns=["strip", "height", "rgb"])

    cut = tiles.withColumn("strip", F.floor(F.col("y") / height).cast("int"))
    return cut.groupBy("strip").applyInPandas(run, "strip int, height int, rgb binary")


@dataclass(frozen=True)
class Textured:
    """views(fid, frame, score), the atlas, its tiles and its strips."""

    views: DataFrame
    atlas: Atlas
    tiles: DataFrame
    strips: DataFrame


def texture(faces: DataFrame, vertices: DataFrame, frames: DataFrame, root: str, depth: DataFrame | None = None, texel: float = 0.001, most_side: int = MOST_SIDE) -> Textured | None:
    """Puts the pictures of frames(frame, image, pose, camera, depth_camera) on a mesh.

    vertices(vid, x, y, z[, r, g, b]); see ``best_views`` for frames and depth.
    Pictures lie below ``root``.  A mesh without faces gives None.
    """
    atlas = plan(faces, vertices, texel, most_side)
    if atlas is None:
        return None
    atlas = Atlas(atlas.side, atlas.texel, checkpointed(atlas.layout))
    triangles = checkpointed(corners(faces, vertices))
    views = checkpointed(best_views(triangles, frames, depth))
    chosen = triangles.join(atlas.layout.select("fid", "size", "x", "y"), "fid").join(views.select("fid", "frame"), "fid", "left").join(frames.select("frame", "image", "pose", "camera"), "frame", "left")
    if {"r", "g", "b"} <= set(vertices.columns):
        corner = faces.select("fid", F.explode(F.array("a", "b", "c")).alias("vid")).join(vertices.select("vid", *"rgb"), "vid")
        chosen = chosen.join(corner.groupBy("fid").agg(*(F.floor(F.sum(F.floor(c)) / F.count(c)).alias(c) for c in "rgb")), "fid", "left")
    else:
        chosen = chosen.withColumns({c: F.lit(None).cast("double") for c in "rgb"})
    tiles = checkpointed(paint(chosen, root))
    return Textured(views, atlas, tiles, strips(tiles, atlas.side))
