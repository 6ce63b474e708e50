"""FBX files and splat training."""

from __future__ import annotations

import numpy as np
import pytest

from plumbline.operators import training
from plumbline.sources import fbx


def test_fbx_round_trip(spark):
    rng = np.random.default_rng(0)
    p, t = rng.random((50, 3)), rng.integers(0, 50, (80, 3))
    data = fbx.write_mesh(p, t, normals=p, uvs=p[:, :2])
    got = fbx.read_mesh(data)
    assert np.allclose(got["positions"], p) and np.array_equal(got["triangles"], t)
    nodes = fbx.parse(data)
    assert fbx.find(nodes, "MappingInformationType").properties == ["ByVertice"] and fbx.find(nodes, "nothing") is None
    rows = fbx.records(spark.createDataFrame([("m.fbx", bytearray(data))], "path string, content binary"))
    assert rows.where("name = 'Vertices'").first().properties == ["float64[150]"]
    with pytest.raises(ValueError):
        fbx.parse(b"no")
    quad = fbx.Node("Geometry", [1], [fbx.Node("Vertices", [np.zeros(12)]), fbx.Node("PolygonVertexIndex", [np.array([0, 1, 2, ~3], "<i4")])])
    assert fbx.read_mesh(fbx.serialise([quad]))["triangles"].tolist() == [[0, 1, 2], [0, 2, 3]]


def _scene(n=4):
    rng = np.random.default_rng(1)
    p = np.zeros((n, 14))
    p[:, :3] = rng.uniform(-0.4, 0.4, (n, 3)) + [0, 0, 2]
    p[:, 3:6], p[:, 9], p[:, 10], p[:, 11:14] = np.log(0.15), 1.0, rng.uniform(-0.5, 0.5, n), rng.uniform(-0.5, 0.5, (n, 3))
    return p, (np.eye(3), np.zeros(3))


def test_gradients_are_central_differences():
    p, _ = _scene()
    rng = np.random.default_rng(2)
    p[:, 3:6] += rng.normal(0, 0.3, (len(p), 3))
    p[:, 6:10] = rng.normal(0, 1, (len(p), 4))
    pose = (np.array([[np.cos(0.3), 0, np.sin(0.3)], [0, 1, 0], [-np.sin(0.3), 0, np.cos(0.3)]]), np.array([-0.5, 0.1, 0.4]))
    target = rng.random((16, 16, 3))
    g, _ = training.gradients(p, pose, target, 14.0)
    loss = lambda q: float(((training.render(q, pose, 16, 14.0)[0] - target) ** 2).mean())
    for c in range(14):
        assert np.abs(g[:, c]).max() > 1e-6  # no column is left out
        for i in range(len(p)):
            q, h = p.copy(), 1e-6
            q[i, c] += h
            up = loss(q)
            q[i, c] -= 2 * h
            assert abs((up - loss(q)) / (2 * h) - g[i, c]) < 1e-8 + 1e-4 * abs(g[i, c])


def test_training_lowers_the_loss(spark):
    p, pose = _scene()
    target = training.render(p, pose, 16, 14.0)[0]
    start = p.copy()
    start[:, 11:14] += 0.4
    start[:, 0] += 0.05
    rows = [("a", i, *map(float, r)) for i, r in enumerate(start)]
    df = spark.createDataFrame(rows, "part string, id long, " + ", ".join(f"{c} double" for c in training.SPLAT[1:]))
    losses = training.train(df, [(pose, target)], 14.0, 60).first().losses
    assert losses[-1] < 0.2 * losses[0]
    start[:, 3:6] += 0.3
    df = spark.createDataFrame([("a", i, *map(float, r)) for i, r in enumerate(start)], df.schema)
    moved = training.train(df, [(pose, target)], 14.0, 60, shapes=True).orderBy("id").collect()
    assert moved[0].losses[-1] < 0.2 * moved[0].losses[0] and all(r.lx != s for r, s in zip(moved, start[:, 3], strict=True))
    still = training.train(df, [(pose, target)], 14.0, 3).orderBy("id").collect()
    assert all(r.lx == s for r, s in zip(still, start[:, 3], strict=True))
