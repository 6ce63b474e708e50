"""Image pairs in one call: match, filter by motion, verify by an essential matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import camera as C
from ..operators import matching, sfm
from ..operators.lineage import checkpointed


def match_pairs(features: DataFrame, pairs: DataFrame, cameras: DataFrame, pixels: float = 2.0, ratio: float = 0.75, longest: int = 64, motion: bool = True) -> tuple[DataFrame, DataFrame]:
    """(poses, matches): what ``sfm.verify_pairs`` says of each pair that shares a view, and its matches(pair, a, b, distance, ax, ay, bx, by) that fit.

    features(image, x, y, d0..d3[, kp]) as ``images.extract`` gives them (kp names a
    keypoint within its image),
    pairs(pair, a, b) of image names, cameras(image, camera).  Keypoints meet
    within their pair alone, by tiles; a pair that has fewer than eight matches,
    or no pose that eight of them fit, has no row, as most pairs of a capture do.
    The threshold is ``pixels`` over the mean of the two cameras' focal scales.
    Keypoints without a ray in front of the camera, and images without a camera or
    without features, drop out.
    """
    if "kp" not in features.columns:
        features = features.withColumn("kp", F.monotonically_increasing_id())
    features = checkpointed(features.select("image", "kp", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *matching.WORDS))
    pairs = pairs.select("pair", "a", "b").where("a <> b").distinct()
    side = lambda c: pairs.select("pair", F.col(c).alias("image")).join(features, "image").select("pair", "kp", *matching.WORDS)
    found = matching.mutual(side("a"), side("b"), ratio, longest)
    place = lambda c: features.select(F.col("kp").alias(c), F.col("image").alias(f"{c}_image"), F.col("x").alias(f"{c}_x"), F.col("y").alias(f"{c}_y"))
    met = found.join(pairs.toDF("pair", "a_image", "b_image"), "pair").join(place("a"), ["a_image", "a"]).join(place("b"), ["b_image", "b"]).withColumns({"dx": F.col("b_x") - F.col("a_x"), "dy": F.col("b_y") - F.col("a_y")})
    if motion:
        met = matching.motion_filter(met)
    for c in "ab":
        met = met.join(cameras.select(F.col("image").alias(f"{c}_image"), F.col("camera").alias(f"{c}_camera")), f"{c}_image")
        ray = C.pixel_to_ray(F.col(f"{c}_x"), F.col(f"{c}_y"), F.col(f"{c}_camera"))
        met = met.select("*", F.inline(F.array(F.struct(ray.alias(f"{c}_ray"))))).where(F.col(f"{c}_ray.z") > 1e-9)
        met = met.withColumns({f"{c}x": F.col(f"{c}_ray.x") / F.col(f"{c}_ray.z"), f"{c}y": F.col(f"{c}_ray.y") / F.col(f"{c}_ray.z")})
    scale = (C.focal_scale(F.col("a_camera")) + C.focal_scale(F.col("b_camera"))) / 2
    met = checkpointed(met.select("pair", "a", "b", "distance", "ax", "ay", "bx", "by", (pixels / scale).alias("threshold")))
    poses = checkpointed(sfm.verify_pairs(met, None))
    e = lambda r, c: F.col("e")[3 * r + c]
    p, q = (F.col("ax"), F.col("ay"), F.lit(1.0)), (F.col("bx"), F.col("by"), F.lit(1.0))
    ep = [sum((e(r, c) * p[c] for c in range(3)), F.lit(0.0)) for r in range(3)]
    eq = [sum((e(r, c) * q[r] for r in range(3)), F.lit(0.0)) for c in range(3)]
    off = sum((q[r] * ep[r] for r in range(3)), F.lit(0.0))
    fits = off * off / (ep[0] * ep[0] + ep[1] * ep[1] + eq[0] * eq[0] + eq[1] * eq[1]) < F.col("threshold") * F.col("threshold")
    return poses, met.join(poses.select("pair", "e"), "pair").where(fits).drop("e", "threshold")
