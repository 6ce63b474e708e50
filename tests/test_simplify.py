"""Simplification, atlases and exchange files."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import atlas, mesh, simplify
from plumbline.plans.capture_queries import _grid_mesh
from plumbline.sources import interop


def test_tiles_fit_together(spark):
    v, f = _grid_mesh(spark, 24)
    before = mesh.area_and_volume(f, v).first()
    nv, nf = simplify.simplify(f, v, 0.3, 0.5)
    nv, nf = nv.cache(), nf.withColumn("fid", F.monotonically_increasing_id()).cache()
    after = mesh.area_and_volume(nf, nv).first()
    assert nf.count() < 0.6 * f.count() and abs(after.area - before.area) < 0.2 * before.area
    assert mesh.edge_use(nf).where("uses > 2").count() == 0
    assert simplify.simplify(f, v, 1.0, 0.5)[1].count() == f.count()


def test_decimation_keeps_a_closed_mesh():
    p = {0: (1, 0, 0), 1: (-1, 0, 0), 2: (0, 1, 0), 3: (0, -1, 0), 4: (0, 0, 1), 5: (0, 0, -1)}
    faces = [(0, 2, 4), (2, 1, 4), (1, 3, 4), (3, 0, 4), (2, 0, 5), (1, 2, 5), (3, 1, 5), (0, 3, 5)]
    _, left = simplify.decimate({k: np.array(x, float) for k, x in p.items()}, faces, 4, set())
    sides = [tuple(sorted(e)) for f in left for e in ((f[0], f[1]), (f[1], f[2]), (f[2], f[0]))]
    assert 4 <= len(left) < 8 and all(sides.count(s) == 2 for s in sides)


def test_atlas(spark):
    at, height = atlas.pack(np.array([4, 8, 4, 16, 8]), 16)
    assert height == 28
    boxes = [(x, y, s) for (x, y), s in zip(at, [4, 8, 4, 16, 8], strict=True)]
    assert all(a[0] + a[2] <= b[0] or b[0] + b[2] <= a[0] or a[1] + a[2] <= b[1] or b[1] + b[2] <= a[1] for i, a in enumerate(boxes) for b in boxes[:i])
    v, f = _grid_mesh(spark, 4)
    plan, texel = atlas.plan(f, v, 0.05, 64)
    assert plan.count() == f.count() and texel >= 0.05
    colours = v.select("vid", F.lit(10).alias("r"), (F.col("vid") % 2 * 255).cast("int").alias("g"), F.lit(3).alias("b"))
    assert {r.r for r in atlas.flat_colours(f, colours).collect()} == {10}
    side, uv = atlas.flat_atlas(5)
    assert side == 3 and uv.shape == (5, 2) and uv.max() < 1


def test_exchange_files(spark, tmp_path):
    (tmp_path / "points.json").write_text('{"contractVersion":"1.3.0","setId":"abcdef0123","points":[{"id":"P001","position":[1,2,3]},{"id":"P002"}]}')
    pts = interop.read_points(spark, str(tmp_path / "points.json"))
    assert pts.count() == 2
    links = spark.createDataFrame([("abcdef01", "P001"), ("abcdef01", "P009")], "set_id string, id string")
    assert interop.resolve(links, pts).first().position == [1, 2, 3]
    (tmp_path / "bad.json").write_text('{"contractVersion":"2.0.0","setId":"x","points":[{"id":"P"}]}')
    with pytest.raises(Exception, match="isn't supported"):
        interop.read_points(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "ar-model.json").write_text('{"modelId":"m1","importedAt":"2024"}')
    assert interop.read_bundles(spark, str(tmp_path / "b")).first().id == "m1"
    assert interop.nearest_preset(0.02) == "balanced" and interop.estimate_seconds(10, "fast", True) == pytest.approx(0.8)
    path = interop.save_cached(pts.select("id"), str(tmp_path / "cache"), {"voxel": 0.05})
    assert spark.read.parquet(path).count() == 2 and path == interop.cached_path(str(tmp_path / "cache"), {"voxel": 0.05})
    row = interop.capture_json(spark.createDataFrame([("c", "horn", float("nan"))], "capture_id string, method string, rms double")).first()
    assert row.value == '{"contractVersion":"1.0.0","captureId":"c","method":"horn"}'
