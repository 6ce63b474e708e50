"""Depth fusion: rays become weighted voxel samples, and voxels one aggregation.

The fused volume is a table of voxels(vx, vy, vz, sdf, weight[, r, g, b]).  The
running average of a sequential fuser is a sum over a sum, so frames may arrive
in any order and each task adds up its own rows before the exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import camera as C
from ..functions import vectors as V

KEY = ["vx", "vy", "vz"]
BLOCK = 8


def depth_gate(depth: Column, confidence: Column | None = None, low: float = 0.15, high: float = 5.0, least: int = 1) -> Column:
    """Strictly between the limits, not NaN, and confident enough where confidence is known."""
    out = (depth > low) & (depth < high) & ~F.isnan(depth)
    return out if confidence is None else out & (F.coalesce(confidence, F.lit(least)) >= least)


def ray_samples(pixels: DataFrame, voxel: float, truncation: float | None = None, by_depth: bool = True) -> DataFrame:
    """Voxel samples of pixels(px, py, d, conf, camera, pose[, r, g, b]).

    Steps of half a voxel run from the truncation in front of the surface to
    that behind it.  A voxel that one ray meets twice counts twice.
    """
    trunc = 3 * voxel if truncation is None else truncation
    step = voxel / 2
    colour = {"r", "g", "b"} <= set(pixels.columns)
    df = pixels.where(depth_gate(F.col("d"), F.col("conf")))
    local = C.unproject_pixel(F.col("px") + 0.5, F.col("py") + 0.5, F.col("d"), F.col("camera"))
    # A generator keeps the optimiser from writing the camera model into every later use.
    df = df.select("*", F.inline(F.array(F.struct(local.alias("local")))))
    df = df.withColumn("reach", V.length(F.col("local"))).where("reach >= 1e-9")
    df = df.withColumn("surface", C.camera_to_world(F.col("local"), F.col("pose")))
    df = df.select("*", F.inline(F.array(F.struct(V.sub(F.col("surface"), F.col("pose.t")).alias("toward"))))).withColumn("ray", V.normalize(F.col("toward")))
    weight = (F.least(F.lit(1.0), 1 / (F.col("d") * F.col("d"))) if by_depth else F.lit(1.0)) * F.coalesce((F.col("conf") + 1) / 3.0, F.lit(1.0))
    keep = ["surface", "ray", "reach", "eye", "w", *(["r", "g", "b"] if colour else [])]
    df = df.select(*[F.col("pose.t").alias("eye") if k == "eye" else weight.alias("w") if k == "w" else F.col(k) for k in keep])
    df = df.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(2 * trunc / step)))))
    at = V.add(F.col("surface"), V.scale(F.col("ray"), F.col("s") * step - trunc))
    df = df.withColumns({k: F.floor(at[a] / voxel).cast("int") for k, a in zip(KEY, "xyz", strict=True)})
    centre = V.vec(*((F.col(k) + 0.5) * voxel for k in KEY))
    df = df.withColumn("sdf", F.col("reach") - V.distance(centre, F.col("eye"))).where(F.col("sdf") >= -trunc)
    return df.select(*KEY, V.clamp(F.col("sdf") / trunc, -1.0, 1.0).alias("sdf"), "w", *(["r", "g", "b"] if colour else []))


def fuse(samples: DataFrame) -> DataFrame:
    """Weighted mean per voxel of samples(vx, vy, vz, sdf, w[, r, g, b]).

    Colours are in 0..255 and null where no sample had one.
    """
    mean = lambda c: (F.sum(F.col("w") * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), F.col("w")))).alias(c)
    colours = [mean(c) for c in ("r", "g", "b") if c in samples.columns]
    return samples.where("w > 0").groupBy(*KEY).agg((F.sum(F.col("w") * F.col("sdf")) / F.sum("w")).alias("sdf"), F.sum("w").alias("weight"), *colours)


def integrate(pixels: DataFrame, voxel: float, truncation: float | None = None, by_depth: bool = True) -> DataFrame:
    return fuse(ray_samples(pixels, voxel, truncation, by_depth))


def voxel_bounds(voxels: DataFrame) -> DataFrame:
    """Index range of the blocks that hold voxels; of none, 0..-1."""
    out = []
    for k in KEY:
        block = F.floor(F.col(k) / BLOCK) * BLOCK
        out += [F.coalesce(F.min(block), F.lit(0)).cast("int").alias(f"min_{k}"), F.coalesce(F.max(block) + BLOCK - 1, F.lit(-1)).cast("int").alias(f"max_{k}")]
    return voxels.agg(*out)


def extract_points(voxels: DataFrame, voxel: float, least_weight: float = 0.0) -> DataFrame:
    """Points where the field crosses zero towards +x, +y or +z.

    A self-join on the neighbour's key: one exchange serves both sides, however
    sparse the volume.  Zero counts as the negative side.
    """
    v = voxels.where(F.col("weight") >= least_weight)
    colour = [c for c in ("r", "g", "b") if c in v.columns]
    steps = F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("dz")) for a, b, c in ((1, 0, 0), (0, 1, 0), (0, 0, 1))))
    here = v.select(*KEY, "sdf", *colour, F.explode(steps).alias("d"))
    here = here.select((F.col("vx") + F.col("d.dx")).alias("vx"), (F.col("vy") + F.col("d.dy")).alias("vy"), (F.col("vz") + F.col("d.dz")).alias("vz"), F.col("sdf").alias("s0"), "d", *[F.col(c).alias(c + "0") for c in colour])
    df = here.join(v.select(*KEY, F.col("sdf").alias("s1"), *colour), KEY).where("s0 <> s1 and (s0 > 0) <> (s1 > 0)")
    t = F.col("s0") / (F.col("s0") - F.col("s1"))
    df = df.withColumn("t", t)
    xyz = [((F.col(k) - F.col(f"d.d{a}") + 0.5 + F.col(f"d.d{a}") * F.col("t")) * voxel).alias(a) for k, a in zip(KEY, "xyz", strict=True)]
    return df.select(*xyz, *[V.round_half_up(F.when(F.col("t") < 0.5, F.col(c + "0")).otherwise(F.col(c))).cast("int").alias(c) for c in colour])


def incidence_cosine(pixels: DataFrame, jump: float = 0.05) -> DataFrame:
    """Adds ``incidence``: the cosine between a pixel's ray and its surface.

    pixels: frame, px, py, local (camera space).  The neighbours to the right and
    below give the normal; at edges and jumps in depth the cosine is one.
    """
    from pyspark.sql import Window

    right = F.lead("local").over(Window.partitionBy("frame", "py").orderBy("px"))
    below = F.lead("local").over(Window.partitionBy("frame", "px").orderBy("py"))
    df = pixels.withColumn("right", right).withColumn("below", below)
    n = V.normalize(V.cross(V.sub(F.col("right"), F.col("local")), V.sub(F.col("below"), F.col("local"))))
    broken = F.col("right").isNull() | F.col("below").isNull() | (F.abs(F.col("right.z") - F.col("local.z")) > jump) | (F.abs(F.col("below.z") - F.col("local.z")) > jump)
    cosine = F.abs(V.dot(n, V.normalize(F.col("local"))))
    return df.withColumn("incidence", F.when(broken, F.lit(1.0)).otherwise(cosine)).drop("right", "below")
