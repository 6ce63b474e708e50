"""Texture atlases: tile sizes, shelf packing, flat colours and painting."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .mesh import with_corners


def tile_sizes(faces: DataFrame, vertices: DataFrame, texel: float, least: int = 4, most: int = 256) -> DataFrame:
    """(fid, size): the power of two that holds a face's longest edge at a texel size."""
    got = with_corners(faces, vertices)
    edge = F.greatest(V.distance(F.col("pa"), F.col("pb")), V.distance(F.col("pb"), F.col("pc")), V.distance(F.col("pc"), F.col("pa")))
    raw = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(edge / texel, F.lit(1.0)))))
    return got.select("fid", F.least(F.greatest(raw, F.lit(float(least))), F.lit(float(most))).cast("int").alias("size"))


def pack(sizes: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    """Shelves of tiles, largest first: the corner of each tile and the height used.

    Packing is sequential and works on sizes alone, a few bytes for each tile.
    """
    at, x, y, shelf = np.zeros((len(sizes), 2), int), 0, 0, 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        if s > width:
            raise ValueError("a tile is wider than the atlas")
        if x + s > width:
            x, y, shelf = 0, y + shelf, 0
        at[i], x, shelf = (x, y), x + s, max(shelf, s)
    return at, y + shelf


def plan(faces: DataFrame, vertices: DataFrame, texel: float, width: int = 4096, most_faces: int = 200_000) -> tuple[DataFrame, float]:
    """(fid, size, x, y) and the texel size: doubled until the tiles fit a square.

    The sizes of ``most_faces`` faces at most come to the driver; beyond that cut
    the mesh into parts with an atlas of their own.
    """
    spark = faces.sparkSession
    if faces.count() > most_faces:
        raise ValueError(f"over {most_faces} faces: cut the mesh into parts")
    while True:
        rows = sorted(tile_sizes(faces, vertices, texel).collect())
        at, height = pack(np.array([r.size for r in rows], int), width)
        if height <= width or all(r.size <= 4 for r in rows):
            return spark.createDataFrame([(r.fid, r.size, int(x), int(y)) for r, (x, y) in zip(rows, at, strict=True)], "fid long, size int, x int, y int"), texel
        texel *= 2


def flat_colours(faces: DataFrame, colours: DataFrame) -> DataFrame:
    """(fid, r, g, b): the mean of the corners' colours(vid, r, g, b), in whole numbers."""
    corner = faces.select("fid", F.explode(F.array("a", "b", "c")).alias("vid")).join(colours, "vid")
    return corner.groupBy("fid").agg(*(F.floor(F.sum(c) / F.count(F.lit(1))).cast("int").alias(c) for c in "rgb"))


def flat_atlas(count: int) -> tuple[int, np.ndarray]:
    """The side of a square with a texel for each triangle, and the middles of the texels as uv."""
    side = max(1, math.ceil(math.sqrt(count)))
    i = np.arange(count)
    return side, np.stack([(i % side + 0.5) / side, (i // side + 0.5) / side], 1)


def paint(corners: np.ndarray, size: int, sample) -> np.ndarray:
    """The texels of a tile: ``sample`` gives colours of points on the triangle's plane."""
    t = (np.arange(size) + 0.5) / size
    u, v = np.meshgrid(t, t)
    p = corners[0] + u[..., None] * (corners[1] - corners[0]) + v[..., None] * (corners[2] - corners[0])
    return sample(p.reshape(-1, 3)).reshape(size, size, -1)
