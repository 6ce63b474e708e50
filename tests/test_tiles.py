"""Suppression and simplification by tiles of bounded size against one pass over all."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import matching, simplify
from plumbline.plans.capture_queries import _grid_mesh


def greedy(rows, radius):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[4], r[3], r[2])):
        if all((r[2] - k[2]) ** 2 + (r[3] - k[3]) ** 2 >= radius * radius for k in kept if k[:2] == r[:2]):
            kept.append(r)
    return sorted(kept)


@pytest.mark.parametrize(("radius", "tile", "scores"), [(8.0, 256.0, 1000), (5.0, 20.0, 1000), (9.0, 36.0, 3), (3.0, 12.0, 10**9)])
def test_tiles_keep_what_one_pass_keeps(spark, radius, tile, scores):
    rng = np.random.default_rng(int(radius))
    seen = {(i, lv, int(x), int(y)) for i, lv, x, y in zip(rng.choice(["a", "b"], 900), rng.integers(0, 2, 900).tolist(), rng.integers(-50, 150, 900), rng.integers(0, 90, 900), strict=True)}
    rows = [(i, lv, float(x), float(y), float(rng.integers(0, scores))) for i, lv, x, y in sorted(map(lambda k: (str(k[0]), *k[1:]), seen))]
    df = spark.createDataFrame(rows, "image string, level int, x double, y double, score double").repartition(5)
    got = matching.non_max_suppression(df, radius, tile)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == greedy(rows, radius)


def test_a_falling_line_of_corners_crosses_all_tiles(spark):
    """Each corner waits for the one before it: the worst case for rounds."""
    rows = [("a", 0, float(4 * k), 0.0, float(1000 - k)) for k in range(100)]
    df = spark.createDataFrame(rows, "image string, level int, x double, y double, score double")
    assert sorted(map(tuple, matching.non_max_suppression(df, 6.0, 40.0).collect())) == greedy(rows, 6.0)
    assert matching.non_max_suppression(df.limit(0), 6.0).count() == 0


def test_dense_cubes_are_halved(spark):
    rng = np.random.default_rng(0)
    p = np.concatenate([rng.uniform(-1, 1, (500, 3)), rng.uniform(0.5, 0.51, (500, 3))])
    df = spark.createDataFrame(p.tolist(), "cx double, cy double, cz double")
    got = simplify.tiles(df, 1.0, 60)
    assert got.count() == 1000 and got.columns == ["cx", "cy", "cz", "tile"]
    sizes = {r.tile: r["count"] for r in got.groupBy("tile").count().collect()}
    assert all(n <= 60 or t.startswith(f"{simplify.SPLITS},") for t, n in sizes.items())
    assert any(t.startswith("0,") for t in {r.tile for r in simplify.tiles(df, 1.0, 10**6).collect()})
    for t in sizes:  # a cube holds what lies in it and in no smaller one that was chosen
        k, *c = map(int, t.split(","))
        side = 1.0 / 2**k
        own = got.where(F.col("tile") == t).select("cx", "cy", "cz").collect()
        assert all(c[i] * side <= v < (c[i] + 1) * side for r in own for i, v in enumerate(r))


def test_a_mesh_in_halved_tiles_stays_whole(spark):
    v, f = _grid_mesh(spark, 24)
    nv, nf = simplify.simplify(f, v, 0.4, 2.0, most=150)
    assert nf.count() < 0.75 * f.count()
    edges = nf.select(F.explode(F.array(*(F.array_sort(F.array(a, b)) for a, b in (("a", "b"), ("b", "c"), ("c", "a"))))).alias("e")).groupBy("e").count()
    assert edges.agg(F.max("count")).first()[0] == 2
    box = nv.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    assert np.abs(np.array(box) - (0, 1, 0, 1)).max() < 0.05
