"""Bookkeeping of projects, frames and sightings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def upsert(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """The rows of ``new``, and those of ``old`` whose key ``new`` lacks; also binds a receiver to its profile."""
    return old.join(new.select(by), by, "left_anti").unionByName(new)


def search(projects: DataFrame, words: str, columns: list[str], order: list[Column]) -> DataFrame:
    """Projects in one of whose columns ``words`` occurs, whatever its case; blank words find all."""
    wanted = words.strip().lower()
    found = F.lit(not wanted)
    for c in columns:
        found |= F.coalesce(F.contains(F.lower(F.col(c)), F.lit(wanted)), F.lit(False))
    return projects.where(found).orderBy(*order)


def number_cameras(frames: DataFrame, camera: str, place: str) -> DataFrame:
    """(camera, number, n) of the distinct cameras, numbered by where they first appear, and how many frames use each.

    Cameras of a capture are a handful, so their ranks run in one task.
    """
    d = frames.groupBy(camera).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("n"))
    return d.select(camera, (F.dense_rank().over(Window.orderBy("_first")) - 1).cast("bigint").alias("number"), "n")


def path_length(positions: DataFrame, by: str, order: list[str], p: str = "p") -> DataFrame:
    """(by, path): the summed steps between a capture's positions in order."""
    w = Window.partitionBy(by).orderBy(*order)
    got = positions.withColumn("_before", F.lag(p).over(w))
    step = F.when(F.col("_before").isNotNull(), V.distance(F.col(p), F.col("_before")))
    return got.groupBy(by).agg(F.sum(step).alias("path"))


def role_counts(points: DataFrame, by: Column, role: Column) -> DataFrame:
    """How many control points and checkpoints there are."""
    return points.groupBy(by).agg(F.count_if(role == "gcp").alias("gcp"), F.count_if(role == "checkpoint").alias("checkpoint"))


def skip_reason(has_pose: Column, has_depth: Column, readable: Column) -> Column:
    """Why a frame isn't integrated, by the first thing it lacks."""
    return F.when(~has_pose, "noPose").when(~has_depth, "noDepth").when(~readable, "unreadable").otherwise("integrated")


def skip_counts(frames: DataFrame, reason: Column) -> DataFrame:
    """(reason, n), with the total under a null reason."""
    return frames.select(reason.alias("reason")).rollup("reason").agg(F.count(F.lit(1)).alias("n"))


def sessions(sightings: DataFrame, by: str, time: Column, order: list[str], silence: int) -> DataFrame:
    """Sightings with ``session``, which ends where a device is silent for longer than ``silence``."""
    w = Window.partitionBy(by).orderBy(*order)
    fresh = F.when(time - F.lag(time).over(w) <= silence, 0).otherwise(1)
    return sightings.withColumn("_fresh", fresh).withColumn("session", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def dropped(frames: DataFrame, by: str, index: str) -> DataFrame:
    """(by, dropped): the numbers missing between a capture's first and last frame."""
    return frames.groupBy(by).agg((F.max(index) - F.min(index) + 1 - F.count_distinct(index)).alias("dropped"))


def every_kth(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows, spread evenly over the order; numbering runs over the cluster."""
    from .mesh import row_numbers

    n = rows.count()
    if n <= most:
        return rows
    numbered = row_numbers(rows, order, "_at")
    k = F.expr(f"(_at * {most} + {n - 1}) div {n}")  # the first share that begins at or after this row
    return numbered.where((k * n < (F.col("_at") + 1) * most) & (k < most)).select(*rows.columns)


def depth_at_centre(pixels: DataFrame, by: str = "frame", radius: int = 2, least: int = 5, spread: float = 0.03) -> DataFrame:
    """(frame, depth): the upper median of the sure samples around the middle of pixels(frame, u, v, width, height, depth, confidence).

    Null with fewer than ``least`` samples, or where they lie ``spread`` metres
    apart or more: a corner before something far behind it.
    """
    middle = lambda c, size: F.abs(F.col(c) - F.floor(F.col(size) / 2)) <= radius
    sure = F.col("depth").between(0.1, 8) & (F.col("depth") > 0.1) & (F.col("depth") < 8) & (F.coalesce("confidence", F.lit(2)) >= 2)
    sample = F.when(sure & middle("u", "width") & middle("v", "height"), F.col("depth"))
    got = pixels.where((F.col("width") > 8) & (F.col("height") > 8)).groupBy(by).agg(F.count(sample).alias("n"), V.upper_median(sample).alias("m"), (F.max(sample) - F.min(sample)).alias("s"))
    return got.select(by, F.when((F.col("n") >= least) & (F.col("s") < spread), F.col("m")).alias("depth"))


def visible_in_depth(centres: DataFrame, depth: DataFrame, slack: float = 0.08) -> DataFrame:
    """centres(frame, x, y, z in the camera's frame, fx, fy, cx, cy, width, height) with ``visible``.

    The pixel is looked up in depth(frame, u, v, metres); where nothing was
    measured, or the point has no pixel, nothing speaks against it.
    """
    ok = (F.col("fx") > 0) & (F.col("fy") > 0) & (F.col("z") > 1e-4)
    away = lambda v: F.when(v >= 0, F.floor(v + 0.5)).otherwise(F.ceil(v - 0.5)).cast("int")
    z = F.when(ok, F.col("z"))
    got = centres.withColumn("u", away(F.col("x") * F.col("fx") / z + F.col("cx"))).withColumn("v", away(F.col("y") * F.col("fy") / z + F.col("cy")))
    got = got.join(depth.select("frame", "u", "v", F.col("metres").alias("_seen")), ["frame", "u", "v"], "left")
    hidden = ok & F.col("u").between(0, F.col("width") - 1) & F.col("v").between(0, F.col("height") - 1) & (F.col("_seen") > 0) & (F.col("z") > F.col("_seen") + slack)
    return got.select(*centres.columns, (~F.coalesce(hidden, F.lit(False))).alias("visible"))


def fill_unseen(faces: DataFrame, seen: DataFrame, colours: DataFrame) -> DataFrame:
    """(fid, r, g, b) of the faces that no photo shows: the mean of their corners' colours, rounded down."""
    corners = faces.join(seen.select("fid"), "fid", "left_anti").select("fid", F.explode(F.array("a", "b", "c")).alias("vid"))
    mean = [F.floor(F.sum(c) / F.count(c)).cast("int").alias(c) for c in "rgb"]
    return corners.join(colours.select("vid", *"rgb"), "vid").groupBy("fid").agg(*mean)
