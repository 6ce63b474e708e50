"""Isosurfaces by marching tetrahedra, as joins over a table of field samples.

field(x, y, z, v[, r, g, b]): a cube is marched when all of its eight corners are there, so
unobserved space never grows a surface.  A vertex is known by its grid edge,
which welds the mesh without any ordering.  Where the field has colours, a vertex
mixes those of its edge's ends as it mixes their places; of one end alone it takes
that one's, and where neither has one it is white.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The corners of a cube are numbered by x + 2 y + 4 z.
_CORNERS = tuple((k & 1, k >> 1 & 1, k >> 2 & 1) for k in range(8))
NUDGE = 1e-7


def tetrahedra() -> list[tuple[int, ...]]:
    """Six tetrahedra along the diagonal 0-7: one for each order of the axes.

    All share the diagonal, and neighbouring cubes cut their common face alike.
    """
    out = []
    for a, b in product((1, 2, 4), repeat=2):
        if a != b:
            out.append((0, a, a + b, 7))
    return out


def _outward(tet: tuple[int, ...], inside: list[int], corners: list[tuple[int, int]]) -> bool:
    """Whether the triangle of edge middles turns its front away from the inside corners."""
    mid = [[(_CORNERS[a][i] + _CORNERS[b][i]) / 2 for i in range(3)] for a, b in corners]
    u, v = ([mid[k][i] - mid[0][i] for i in range(3)] for k in (1, 2))
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    centre = [sum(_CORNERS[c][i] for c in inside) / len(inside) for i in range(3)]
    return sum(n[i] * (mid[0][i] - centre[i]) for i in range(3)) > 0


def triangle_table() -> list[tuple[int, int, int, int, int, int, int, int, int]]:
    """(tet, mask, tri, and the corner pairs of the triangle's three edges), built from the geometry.

    Bit k of mask is set where the tetrahedron's corner k is below the level.
    One corner alone gives one triangle; two and two give a quadrilateral, cut in two.
    """
    out = []
    for t, tet in enumerate(tetrahedra()):
        for mask in range(1, 15):
            low = [c for k, c in enumerate(tet) if mask >> k & 1]
            high = [c for c in tet if c not in low]
            if len(low) == 2:
                ring = [(low[0], high[0]), (low[0], high[1]), (low[1], high[1]), (low[1], high[0])]
                tris = [[ring[0], ring[1], ring[2]], [ring[0], ring[2], ring[3]]]
            else:
                one, three = (low[0], high) if len(low) == 1 else (high[0], low)
                tris = [[(one, c) for c in three]]
            for k, tri in enumerate(tris):
                if not _outward(tet, low, tri):
                    tri = [tri[0], tri[2], tri[1]]
                out.append((t, mask, k, *(c for e in tri for c in e)))
    return out


def march(field: DataFrame, voxel: float = 1.0, level: float = 0.0, offset: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices(vid, x, y, z[, r, g, b]), faces(a, b, c)) of the level set; vid is the edge's string key.

    Triangles face away from the values below the level.
    """
    spark = field.sparkSession
    shift = voxel * 0.5 if offset is None else offset
    v = F.when(F.abs(F.col("v") - level) < NUDGE, level + NUDGE).otherwise(F.col("v"))
    tints = ["r", "g", "b"] if {"r", "g", "b"} <= set(field.columns) else []
    samples = field.where(F.col("v").isNotNull()).select("x", "y", "z", v.alias("v"), *tints)
    corner = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(dz).alias("dz"), F.lit(k).alias("k")) for k, (dx, dy, dz) in enumerate(_CORNERS))))
    spread = samples.select("x", "y", "z", "v", *tints, corner.alias("c")).select((F.col("x") - F.col("c.dx")).alias("x"), (F.col("y") - F.col("c.dy")).alias("y"), (F.col("z") - F.col("c.dz")).alias("z"), F.col("c.k").alias("k"), "v", *tints)
    low, high = F.min("v") < level, F.max("v") >= level
    corners = F.map_from_entries(F.collect_list(F.struct("k", F.struct("v", *tints))))  # eight at most
    cubes = spread.groupBy("x", "y", "z").agg(corners.alias("at"), F.count(F.lit(1)).alias("n"), low.alias("low"), high.alias("high")).where("n = 8 and low and high")
    tets = F.explode(F.array(*(F.struct(F.lit(t).alias("tet"), *(F.lit(c).alias(f"c{i}") for i, c in enumerate(tet))) for t, tet in enumerate(tetrahedra()))))
    cubes = cubes.select("x", "y", "z", "at", tets.alias("t"))
    mask = sum((F.when(F.col("at")[F.col(f"t.c{i}")]["v"] < level, 1 << i).otherwise(0) for i in range(4)), F.lit(0))
    cubes = cubes.select("x", "y", "z", "at", F.col("t.tet").alias("tet"), mask.alias("mask"))
    table = spark.createDataFrame(triangle_table(), "tet int, mask int, tri int, a0 int, a1 int, b0 int, b1 int, c0 int, c1 int")
    tris = cubes.join(F.broadcast(table), ["tet", "mask"])  # of a fixed 120 rows

    def end(name: str):
        """The edge in the order of its corners, so that its neighbours name it alike."""
        p, q = F.least(f"{name}0", f"{name}1"), F.greatest(f"{name}0", f"{name}1")
        at = lambda c, bit: F.shiftright(c, bit).bitwiseAND(1)
        vp, vq = F.col("at")[p]["v"], F.col("at")[q]["v"]
        gap = vq - vp
        t = F.when(F.abs(gap) < 1e-12, 0.5).otherwise((level - vp) / F.when(F.abs(gap) < 1e-12, 1.0).otherwise(gap))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        grid = [(F.col(n) + at(c, b)) for c in (p, q) for b, n in enumerate("xyz")]
        place = [((F.col(n) + at(p, b) + (at(q, b) - at(p, b)) * t) * voxel + shift).alias(n) for b, n in enumerate("xyz")]
        ends = [(F.col("at")[p][c].cast("double"), F.col("at")[q][c].cast("double")) for c in tints]
        mixed = [F.coalesce(a + (b - a) * t, a, b, F.lit(255.0)).alias(c) for c, (a, b) in zip(tints, ends, strict=True)]
        return F.struct(F.concat_ws(",", *grid).alias("vid"), *place, *mixed)

    got = tris.select(*(end(n).alias(n) for n in "abc"))
    faces = got.select(*(F.col(f"{n}.vid").alias(n) for n in "abc"))
    uses = got.select(F.explode(F.array("a", "b", "c")).alias("v")).select("v.*")
    vertices = uses.groupBy("vid").agg(*(F.min(n).alias(n) for n in ("x", "y", "z", *tints)))
    return vertices, faces
