"""Pairs in one call, and PLY files read as clouds and splats."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators import sfm
from plumbline.plans import pairs
from plumbline.sources import clouds, export, points

W = {"fx": 500.0, "fy": 500.0, "cx": 320.0, "cy": 240.0, "width": 640, "height": 480}


def views(n=120, seed=4):
    """Keypoints of one scene from two places, with a view of nothing they know; descriptors are of the points, with bits flipped."""
    rng = np.random.default_rng(seed)
    world = rng.uniform(-1.5, 1.5, (n, 3)) + [0, 0, 6]
    words = rng.integers(-(2**63), 2**63 - 1, (n, 4))
    r, t = sfm.exp_so3(np.array([0.02, 0.12, -0.03])), np.array([-0.7, 0.05, 0.1])
    rows = []
    for image, (turn, move) in {"one": (np.eye(3), np.zeros(3)), "two": (r, t)}.items():
        p = world @ turn.T + move
        for k in range(n):
            xy = p[k, :2] / p[k, 2] * 500 + [320, 240]
            if image == "two" and k < 12:
                xy = xy + rng.uniform(20, 60, 2)  # matches that are wrong
            d = words[k].copy()
            d[0] ^= np.int64(1) << np.int64(rng.integers(60))
            rows.append((image, *map(float, xy), *map(int, d)))
    rows += [("other", *map(float, rng.uniform(0, 400, 2)), *map(int, rng.integers(-(2**63), 2**63 - 1, 4))) for _ in range(n)]
    return rows, r, t


def camera(spark, names):
    from plumbline.functions import camera as C

    parts = [F.lit("pinhole").alias("model")] + [F.lit(v).cast("int" if isinstance(v, int) else "double").alias(k) for k, v in W.items()]
    return spark.createDataFrame([(n,) for n in names], "image string").select("image", F.struct(*parts, *(F.lit(None).cast("double").alias(k) for k in ("k1", "k2", "k3", "k4", "p1", "p2", "hfov", "vfov"))).alias("camera"))


def test_a_pair_that_shares_a_view_has_a_pose(spark):
    rows, r, t = views()
    features = spark.createDataFrame(rows, "image string, x double, y double, d0 long, d1 long, d2 long, d3 long")
    ask = spark.createDataFrame([("p", "one", "two"), ("q", "one", "other"), ("s", "one", "one"), ("n", "one", "nowhere")], "pair string, a string, b string")
    poses, matches = pairs.match_pairs(features, ask, camera(spark, ["one", "two", "other"]), motion=False)
    (got,) = poses.collect()
    assert got.pair == "p" and got.inliers >= 100 and np.allclose(np.array(got.r).reshape(3, 3), r, atol=0.01)
    assert np.allclose(got.t, t / np.linalg.norm(t), atol=0.05)
    kept = matches.collect()
    assert 100 <= len(kept) <= 114 and {m.pair for m in kept} == {"p"}
    own = features.withColumn("kp", F.row_number().over(Window.partitionBy("image").orderBy("x", "y")))  # numbers that repeat from image to image
    again, same = pairs.match_pairs(own, ask, camera(spark, ["one", "two", "other"]), motion=False)
    assert again.first().inliers == got.inliers and sorted((m.ax, m.bx) for m in same.collect()) == sorted((m.ax, m.bx) for m in kept)
    none, _ = pairs.match_pairs(features, ask, camera(spark, ["other"]))
    assert none.count() == 0
    shifted, _ = pairs.match_pairs(features, ask.limit(1), camera(spark, ["one", "two"]), motion=True)
    assert shifted.count() == 1


def test_clouds_in_their_spellings(spark, tmp_path):
    points.register(spark)
    df = spark.range(50).selectExpr("cast(id AS double) AS x", "id / 2D AS y", "-id * 1D AS z", "cast(id AS short) AS diffuse_red", "cast(id + 1 AS short) AS diffuse_green", "cast(id + 2 AS short) AS diffuse_blue", "cast(id AS float) AS scalar_Intensity", "cast(0 AS float) AS nx", "cast(1 AS float) AS ny", "cast(0 AS float) AS nz")
    df.coalesce(1).write.format("ply").option("comment", "some origin 646000 4181000.5 30\nother").mode("append").save(str(tmp_path / "c"))
    got, at = clouds.read_cloud(spark, str(tmp_path / "c"))
    assert at == [646000.0, 4181000.5, 30.0] and got.columns == ["x", "y", "z", "r", "g", "b", "nx", "ny", "nz", "intensity"]
    assert got.count() == 50 and tuple(got.where("x = 7").first()) == (7.0, 3.5, -7.0, 7, 8, 9, 0.0, 1.0, 0.0, 7.0)
    df.select("x", "y", "z", "diffuse_red").coalesce(1).write.format("ply").mode("append").save(str(tmp_path / "plain"))
    got, at = clouds.read_cloud(spark, str(tmp_path / "plain"))
    assert at is None and got.columns == ["x", "y", "z"]
    df.limit(3).coalesce(1).write.format("ply").option("comment", "some origin 1 2 3").mode("append").save(str(tmp_path / "c"))
    with pytest.raises(ValueError, match="origins"):
        clouds.read_cloud(spark, str(tmp_path / "c"))
    df.select("x", "y").write.format("ply").mode("append").save(str(tmp_path / "flat"))
    with pytest.raises(ValueError, match="x, y and z"):
        clouds.read_cloud(spark, str(tmp_path / "flat"))


@pytest.mark.parametrize("degree", [0, 1, 2])
def test_splats_come_back_typed(spark, tmp_path, degree):
    n = 3 * ((degree + 1) ** 2 - 1)
    k = F.col("id").cast("double")
    s = spark.range(30).select(V.vec(k, k + 1, k + 2).alias("position"), V.vec(-k, -k - 1, -k - 2).alias("log_scale"), V.quat(F.lit(0.5), F.lit(-0.5), F.lit(0.25), k).alias("rotation"), (k / 4).alias("logit"), *((k * m).alias(f"sh0_{c}") for m, c in enumerate("rgb", 1)), F.array(*((k + j).cast("double") for j in range(n))).alias("rest"))
    export.export_splats(s, "ply", str(tmp_path), degree)
    got, d = clouds.read_splats(spark, str(tmp_path))
    want = s if degree else s.drop("rest")
    assert d == degree and sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_half_a_degree_is_an_error(spark, tmp_path):
    points.register(spark)
    names = ["x", "y", "z", "f_dc_0", "f_dc_1", "f_dc_2", "f_rest_0", "opacity", *(f"scale_{k}" for k in range(3)), *(f"rot_{k}" for k in range(4))]
    df = spark.range(2).select(*(F.lit(1.0).cast("float").alias(c) for c in names))
    df.write.format("ply").mode("append").save(str(tmp_path / "half"))
    with pytest.raises(ValueError, match="degree"):
        clouds.read_splats(spark, str(tmp_path / "half"))
    df.drop("opacity").write.format("ply").mode("append").save(str(tmp_path / "none"))
    with pytest.raises(ValueError, match="opacity"):
        clouds.read_splats(spark, str(tmp_path / "none"))
