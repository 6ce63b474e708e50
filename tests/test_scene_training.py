"""Training across tasks against the trainer of one array, finite differences and itself in other parts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import scene_training, sfm, training

COLUMNS = training.SPLAT[1:]
F0, SIZE = 30.0, 40


def splats(n, seed=1):
    rng = np.random.default_rng(seed)
    p = np.zeros((n, len(COLUMNS)))
    p[:, :3] = rng.normal(0, [1.0, 1.0, 0.5], (n, 3)) + [0, 0, 4]
    p[:, 3:6] = rng.uniform(-2.6, -1.4, (n, 3))
    p[:, 6:10] = rng.normal(0, 1, (n, 4))
    p[:, 10] = rng.normal(0.5, 1.5, n)
    p[:, 11:] = rng.normal(0, 1, (n, 3))
    return p


def table(spark, p):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "id long, " + ", ".join(f"{c} double" for c in COLUMNS))


def view(angle=0.0, size=SIZE):
    return scene_training.View(sfm.exp_so3(np.array([0.0, angle, 0.0])), np.array([0.3 * angle, 0.0, 0.2]), F0, size)


def targets(spark, images):
    rows = [(k, x, y, *map(float, im[y, x])) for k, im in enumerate(images) for y in range(im.shape[0]) for x in range(im.shape[1])]
    return spark.createDataFrame(rows, "view int, px int, py int, r double, g double, b double")


def image(df, size):
    out = np.zeros((size, size, 3))
    for r in df.collect():
        out[r.py, r.px] = r.r, r.g, r.b
    return out


@pytest.mark.parametrize(("n", "chunk"), [(60, 512), (150, 7)])
def test_rendering_is_that_of_one_array(spark, n, chunk):
    p, v = splats(n), view(0.1)
    p[:3, 2] = -5.0  # behind the camera
    p[3, 10] = -9.0  # too faint
    p[4:60:7] = p[4]  # equal depths
    p[60:, 10] += 6  # dark behind many layers
    got = image(scene_training.render(table(spark, p).repartition(5), v, chunk), SIZE)
    assert np.allclose(got, training.render(p[3:], (v.r, v.t), SIZE, F0)[0], atol=1e-12)


def test_slopes_are_finite_differences_and_those_of_one_array(spark):
    p, v = splats(12, 3), view(0.05, 24)
    goal = training.render(splats(12, 4), (v.r, v.t), 24, F0)[0]
    slopes, loss = scene_training.gradients(table(spark, p), v, targets(spark, [goal]).drop("view"), 5)
    got = {r.id: np.array(r.slope) for r in slopes.collect()}
    want, error = training.gradients(p, (v.r, v.t), goal, F0)
    assert abs(loss - error) < 1e-15 and all(np.allclose(got.get(i, 0), want[i], atol=1e-12) for i in range(12))
    loss_of = lambda q: float(((training.render(q, (v.r, v.t), 24, F0)[0] - goal) ** 2).mean())
    for i, c in ((0, 0), (1, 2), (2, 10), (3, 11), (4, 3), (5, 7)):
        up, down = p.copy(), p.copy()
        up[i, c] += 1e-6
        down[i, c] -= 1e-6
        assert abs((loss_of(up) - loss_of(down)) / 2e-6 - want[i, c]) < 1e-4 * max(1e-3, abs(want[i, c])) + 1e-8


def plain(p, views, goals, rounds, rate, shapes):
    m, s, losses = np.zeros_like(p), np.zeros_like(p), []
    moves = np.ones(p.shape[1], bool)
    moves[3:10] = shapes
    for k in range(rounds):
        v = views[k % len(views)]
        g, loss = training.gradients(p, (v.r, v.t), goals[k % len(views)], v.f)
        losses.append(loss)
        g = g * moves
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9 ** (k + 1))) / (np.sqrt(s / (1 - 0.999 ** (k + 1))) + 1e-15)
    return p, losses


@pytest.mark.parametrize(("chunk", "parts", "shapes"), [(512, 1, False), (4, 6, True)])
def test_a_scene_in_parts_trains_as_one(spark, chunk, parts, shapes):
    views = [view(-0.1), view(0.15)]
    goals = [training.render(splats(25, 9), (v.r, v.t), SIZE, F0)[0] for v in views]
    p = splats(25, 8)
    want, losses = plain(p, views, goals, 4, 0.02, shapes)
    got, had = scene_training.train(table(spark, p).repartition(parts), views, targets(spark, goals), 4, 0.02, shapes, chunk)
    assert np.allclose(had, losses, rtol=1e-9) and had[2] < had[0] and had[3] < had[1]
    assert np.allclose(np.array([r[1:] for r in got.orderBy("id").collect()]), want, atol=1e-7)


def test_a_hot_tile_is_spread(spark):
    """All splats in one tile: more than one task cuts them into chunks."""
    p = splats(400, 5)
    p[:, :2] *= 0.02
    chunks = scene_training._chunks(scene_training._state(table(spark, p)), view(0, 16), 50)
    assert chunks.groupBy("tile").agg(F.countDistinct(F.shiftright("chunk", 40)).alias("n")).first().n > 2
    assert sum(len(r.ids) // 8 for r in chunks.collect()) == 400


def test_empty_scene_and_partial_targets(spark):
    v = view(0, 24)
    none = table(spark, splats(1)).limit(0)
    assert scene_training.render(none, v).count() == 0
    goal = targets(spark, [np.ones((24, 24, 3))])
    got, losses = scene_training.train(none, [v], goal, 1)
    assert got.count() == 0 and losses == [1.0]
    some = goal.where("px < 3 and py < 3")
    _, loss = scene_training.gradients(none, v, some.drop("view"))
    assert loss == 1.0
