"""Mesh operators over vertices(vid, x, y, z) and faces(fid, a, b, c)."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

_CORNERS = ("a", "b", "c")


def with_corners(faces: DataFrame, vertices: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Faces with the structs pa, pb and pc of their corners; a join for each corner."""
    point = F.struct(*(F.col(k) for k in ("x", "y", "z", *extra)))
    out = faces
    for c in _CORNERS:
        out = out.join(vertices.select(F.col("vid").alias(c), point.alias(f"p{c}")), c)
    return out


def face_normal() -> Column:
    """The cross product of two sides: twice the area along the normal."""
    return V.cross(V.sub(F.col("pb"), F.col("pa")), V.sub(F.col("pc"), F.col("pa")))


def vertex_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Unit normals per vertex, weighted by area; corners of no area have none."""
    n = with_corners(faces, vertices).select(F.array(*_CORNERS).alias("vs"), face_normal().alias("n"))
    sums = n.select(F.explode("vs").alias("vid"), "n").groupBy("vid").agg(*(F.sum(f"n.{k}").alias(k) for k in "xyz"))
    size = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return sums.select("vid", *(F.when(size > 1e-20, F.col(k) / size).otherwise(F.col(k)).alias(f"n{k}") for k in "xyz"))


def area_and_volume(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    got = with_corners(faces, vertices)
    return got.agg((F.sum(V.length(face_normal())) / 2).alias("area"), (F.sum(V.dot(F.col("pa"), V.cross(F.col("pb"), F.col("pc")))) / 6).alias("volume"))


def edge_use(faces: DataFrame) -> DataFrame:
    """How often each undirected edge is used; a closed mesh uses each twice."""
    sides = F.array(*(F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))))
    return faces.select(F.explode(sides).alias("e")).groupBy("e.u", "e.v").agg(F.count(F.lit(1)).alias("uses"))


def crop(faces: DataFrame, vertices: DataFrame, low: Column, high: Column, erase: bool = False) -> DataFrame:
    """The faces whose centroid lies in the closed box, or the others."""
    got = with_corners(faces, vertices)
    centre = V.scale(V.add(V.add(F.col("pa"), F.col("pb")), F.col("pc")), 1 / 3)
    within = V.inside(centre, low, high)
    return got.where(~within if erase else within).select(*faces.columns)


def compact(faces: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drops vertices without a face and numbers the rest by their first use.

    Numbers come from the places of first uses, sorted over the cluster, so no
    task holds the mesh.
    """
    uses = faces.select("fid", F.posexplode(F.array(*_CORNERS)).alias("corner", "vid"))
    first = uses.groupBy("vid").agg(F.min(F.struct("fid", "corner")).alias("place"))
    numbered = row_numbers(first, ["place"], "new")
    kept = vertices.join(numbered.select("vid", "new"), "vid").drop("vid").withColumnRenamed("new", "vid")
    out = faces
    for c in _CORNERS:
        out = out.join(numbered.select(F.col("vid").alias(c), F.col("new").alias(f"n{c}")), c)
    return kept.select(*vertices.columns), out.select(*[F.col(f"n{c}").alias(c) if c in _CORNERS else F.col(c) for c in faces.columns])


def row_numbers(df: DataFrame, order: list, name: str) -> DataFrame:
    """Numbers from 0 in a total order, without one task for all rows.

    Rows are sorted by range over the partitions and numbered within each; the
    partitions' counts, one row for each, give their offsets.  The sorted rows are
    written once, as a second sort may cut the ranges elsewhere and its counts
    would be those of other partitions.
    """
    from pyspark.sql import Window

    from .lineage import checkpointed

    local = df.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    local = checkpointed(local.withColumn("_n", F.col("_i") - F.shiftleft(F.col("_p").cast("long"), 33)))
    counts = local.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_o", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(before.select("_p", "_o"), "_p").withColumn(name, F.col("_n") + F.col("_o")).drop("_p", "_i", "_n", "_o")


def nearest_vertex(vertices: DataFrame, p: Column) -> DataFrame:
    d = V.distance(F.struct("x", "y", "z"), p)
    return vertices.agg(F.min_by("vid", F.struct(d, F.col("vid"))).alias("vid"), F.min(d).alias("distance"))


_AXES = tuple((a, b, c) for a, b, c in product((-1, 0, 1), repeat=3) if (a, b, c) > (0, 0, 0))


def max_baseline(points: DataFrame, cells: int = 16) -> DataFrame:
    """The largest distance between two of the points(x, y, z).

    The outermost points along thirteen axes give a length that the answer
    reaches.  Points too near the middle for it go; the rest meet by cells a
    ``cells``-th of that length wide (a few thousand at most), and only those of
    cells whose far corners are that far apart are compared.
    """
    along = lambda m: sum((F.col(c) * k for c, k in zip("xyz", m, strict=True) if k), F.lit(0.0))
    ends = [f(F.struct("x", "y", "z"), along(m)) for m in _AXES for f in (F.min_by, F.max_by)]
    few = points.agg(F.array(*ends).alias("ends"), *V.bounds())  # one row
    size = lambda a, b: F.sqrt(sum((F.pow(a[n] - b[n], 2) for n in "xyz"), F.lit(0.0)))
    best = F.array_max(F.transform("ends", lambda a: F.array_max(F.transform("ends", lambda b: size(a, b)))))
    box = few.select(best.alias("known"), *(f"{m}_{n}" for m in ("min", "max") for n in "xyz"))
    p = points.crossJoin(F.broadcast(box)).select("x", "y", "z", "known", *(F.floor((F.col(n) - F.col(f"min_{n}")) * cells / F.when(F.col("known") > 0, F.col("known"))).cast("int").alias(f"c{n}") for n in "xyz"), *(F.greatest(F.col(n) - F.col(f"min_{n}"), F.col(f"max_{n}") - F.col(n)).alias(f"f{n}") for n in "xyz"))
    p = p.where(F.sqrt(F.pow("fx", 2) + F.pow("fy", 2) + F.pow("fz", 2)) >= F.col("known") * (1 - 1e-12)).select("x", "y", "z", "known", F.struct("cx", "cy", "cz").alias("cell")).distinct()
    used = p.select("cell").distinct()
    gap = F.sqrt(sum((F.pow(F.abs(F.col(f"a.c{n}") - F.col(f"b.c{n}")) + 1, 2) for n in "xyz"), F.lit(0.0)))
    pairs = used.toDF("a").crossJoin(F.broadcast(used.toDF("b"))).where((F.col("a") <= F.col("b")) & (gap >= cells * (1 - 1e-9)))  # cells of a grid of bounded size
    one, two = p.select(F.col("cell").alias("a"), F.struct("x", "y", "z").alias("p")), p.select(F.col("cell").alias("b"), F.struct("x", "y", "z").alias("q"))
    far = one.join(pairs, "a").join(two, "b").agg(F.max(size(F.col("p"), F.col("q"))).alias("far"))
    return box.crossJoin(far).select(F.greatest(F.coalesce("known", F.lit(0.0)), F.coalesce("far", F.lit(0.0))).alias("baseline"))  # one row each


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for edges(u, v): the least node that links reach.

    All nodes of a label move together to the least label that any of them
    touches, and then to that label's own label, so rounds grow with the
    logarithm of the longest chain.  Every round is cut by a reliable checkpoint.
    """
    from .lineage import checkpointed

    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = checkpointed(both)
    now = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")).select(F.col("u").alias("node"), "label"))
    for _ in range(rounds):
        near = both.join(now.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        best = now.join(near, "node").groupBy("label").agg(F.least("label", F.min("near")).alias("new"))
        moved = now.join(best, "label").select("node", "label", "new")
        jump = moved.select(F.col("node").alias("new"), F.col("new").alias("up"))
        now2 = checkpointed(moved.join(jump, "new").select("node", "label", F.least("new", "up").alias("new")))
        done = now2.where("label <> new").limit(1).count() == 0
        now = now2.select("node", F.col("new").alias("label"))
        if done:
            return now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def face_labels(faces: DataFrame) -> DataFrame:
    """Faces with the label of their component."""
    edges = faces.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(faces.select(F.col("b").alias("u"), F.col("c").alias("v")))
    return faces.join(connected(edges).withColumnRenamed("node", "a"), "a")


def component_table(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(label, triangles, extent): extent is the diagonal of the component's box."""
    got = face_labels(faces)
    count = got.groupBy("label").agg(F.count(F.lit(1)).alias("triangles"))
    corners = got.select("label", F.explode(F.array(*_CORNERS)).alias("vid")).join(vertices, "vid")
    box = corners.groupBy("label").agg(*V.bounds())
    side = lambda a: F.pow(F.col(f"max_{a}") - F.col(f"min_{a}"), 2)
    return count.join(box, "label").select("label", "triangles", F.sqrt(side("x") + side("y") + side("z")).alias("extent"))


def remove_small(faces: DataFrame, least: int = 32) -> DataFrame:
    got = face_labels(faces)
    big = got.groupBy("label").count().where(F.col("count") >= least).select("label")
    return got.join(big, "label", "left_semi").select(*faces.columns)


def remove_noise(faces: DataFrame, vertices: DataFrame, least: int, extent: float) -> DataFrame:
    """Components with enough triangles or extent; the largest stays whatever it is."""
    table = component_table(faces, vertices)
    top = table.agg(F.max(F.struct("triangles", "extent", "label")).alias("top"))
    keep = table.crossJoin(F.broadcast(top)).where((F.col("triangles") >= least) & (F.col("extent") >= extent) | (F.col("label") == F.col("top.label")))
    return face_labels(faces).join(keep.select("label"), "label", "left_semi").select(*faces.columns)


def keep_largest(faces: DataFrame) -> DataFrame:
    got = face_labels(faces)
    top = got.groupBy("label").count().agg(F.max_by("label", F.struct(F.col("count"), F.col("label"))).alias("label"))
    return got.join(F.broadcast(top), "label", "left_semi").select(*faces.columns)  # one row


def remove_component(faces: DataFrame, seed) -> DataFrame:
    """Without the component of the vertex ``seed``."""
    got = face_labels(faces)
    away = got.where(F.array_contains(F.array(*_CORNERS), F.lit(seed))).select("label").distinct()
    return got.join(away, "label", "left_anti").select(*faces.columns)


def quadrics(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Per vertex the ten sums of its faces' plane quadrics, weighted by area."""
    n = with_corners(faces, vertices).withColumn("n", face_normal()).withColumn("twice", V.length(F.col("n"))).where("twice > 0")
    unit = V.scale(F.col("n"), 1 / F.col("twice"))
    plane = n.select(F.array(*_CORNERS).alias("vs"), (F.col("twice") / 2).alias("area"), unit.alias("u"), (-V.dot(unit, F.col("pa"))).alias("d"))
    at = [F.col("u.x"), F.col("u.y"), F.col("u.z"), F.col("d")]
    terms = {f"q{i}{j}": F.col("area") * at[i] * at[j] for i in range(4) for j in range(i, 4)}
    return plane.select(F.explode("vs").alias("vid"), *(c.alias(k) for k, c in terms.items())).groupBy("vid").agg(*(F.sum(k).alias(k) for k in terms))
