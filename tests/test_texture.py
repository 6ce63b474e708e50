"""Texturing against brute force: views, packing, texels and the assembled atlas."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.plans import texture
from plumbline.sources import scans

CAMERA = {"fx": 60.0, "fy": 55.0, "cx": 40.0, "cy": 30.0, "width": 80, "height": 60}
DEPTH = {"fx": 15.0, "fy": 13.75, "cx": 10.0, "cy": 7.5, "width": 20, "height": 15}


def quaternion(axis, angle):
    return np.r_[np.sin(angle / 2) * np.array(axis) / np.linalg.norm(axis), np.cos(angle / 2)]


def rotation(q):
    x, y, z, w = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def scene(spark, n=300, frames=25, seed=3, root=None):
    rng = np.random.default_rng(seed)
    centre = rng.uniform(-2, 2, (n, 3))
    points = (centre[:, None] + rng.normal(0, 0.06, (n, 3, 3))).reshape(-1, 3)
    points[3:6] = points[3]  # no area
    colours = rng.integers(0, 256, (len(points), 3))
    vertices = spark.createDataFrame([(i, *map(float, p), *map(int, c)) for i, (p, c) in enumerate(zip(points, colours, strict=True))], "vid long, x double, y double, z double, r int, g int, b int")
    faces = spark.createDataFrame([(i, 3 * i, 3 * i + 1, 3 * i + 2) for i in range(n)], "fid long, a long, b long, c long")
    poses = []
    for k in range(frames):
        q = quaternion(rng.normal(0, 1, 3), rng.uniform(0, 3))
        poses.append((k, rng.uniform(-3, 3, 3), q))
    poses[7] = (7, *poses[6][1:])  # a tie
    rows = []
    for k, t, q in poses:
        image = f"{k}.png"
        if root is not None and k != 5:
            (root / image).write_bytes(scans.png(rng.integers(0, 256, (30, 40, 3))))
        rows.append((k, image, *map(float, t), *map(float, q)))
    f = spark.createDataFrame(rows, "frame long, image string, tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    camera = lambda c: F.struct(*(F.lit(v).cast("int" if isinstance(v, int) else "double").alias(k) for k, v in c.items()))
    pose = F.struct(V.vec(F.col("tx"), F.col("ty"), F.col("tz")).alias("t"), V.quat(F.col("qx"), F.col("qy"), F.col("qz"), F.col("qw")).alias("q"))
    frames_ = f.select("frame", "image", pose.alias("pose"), camera(CAMERA).alias("camera"), camera(DEPTH).alias("depth_camera"))
    return points.reshape(-1, 3, 3), colours.reshape(-1, 3, 3), poses, faces, vertices, frames_


def best(points, poses, depth=None):
    out = {}
    for i, tri in enumerate(points):
        n = np.cross(tri[1] - tri[0], tri[2] - tri[0])
        if np.linalg.norm(n) <= 1e-12:
            continue
        n, c = n / np.linalg.norm(n), tri.mean(0)
        for k, t, q in poses:
            p = rotation(q).T @ (c - t)
            if p[2] <= 0.05:
                continue
            u, v = p[0] * CAMERA["fx"] / p[2] + CAMERA["cx"], p[1] * CAMERA["fy"] / p[2] + CAMERA["cy"]
            facing = n @ (t - c) / np.linalg.norm(t - c)
            if not (0 <= u <= 79 and 0 <= v <= 59 and facing > 0.25):
                continue
            du, dv = (int(np.floor(p[a] * DEPTH[f] / p[2] + DEPTH[m] + 0.5)) for a, f, m in ((0, "fx", "cx"), (1, "fy", "cy")))
            if depth and p[2] > depth.get((k, du, dv), np.inf) + 0.08:
                continue
            s = facing**2 / p[2] ** 2
            if s > out.get(i, (0,))[0]:
                out[i] = (s, k)
    return out


@pytest.mark.parametrize("cells", [1, 5, 12])
def test_no_view_is_lost(spark, cells):
    points, _, poses, faces, vertices, frames = scene(spark)
    rng = np.random.default_rng(1)
    depth = {(k, x, y): float(rng.uniform(0.5, 4)) for k in range(25) for x in range(20) for y in range(15) if rng.random() < 0.7}
    table = spark.createDataFrame([(*k, d) for k, d in depth.items()], "frame long, px int, py int, d double")
    tri = texture.corners(faces, vertices)
    for given, had in ((None, None), (table, depth)):
        got = {r.fid: (r.frame, r.score) for r in texture.best_views(tri, frames, given, cells).collect()}
        want = best(points, poses, had)
        assert len(want) > 30 and {i: k for i, (_, k) in want.items()} == {i: k for i, (k, _) in got.items()}
        assert all(np.isclose(got[i][1], s) for i, (s, _) in want.items())


def shelf(sizes, side):
    out, x, y, row = {}, 0, 0, 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if x + sizes[i] > side:
            x, y, row = 0, y + row, 0
        out[i] = (x, y)
        x, row = x + sizes[i], max(row, sizes[i])
    return out, y + row


def test_shelves_are_those_of_one_tile_after_the_other():
    rng = np.random.default_rng(0)
    for _ in range(300):
        sizes = rng.choice([4, 8, 16, 32, 64], rng.integers(1, 200), p=rng.dirichlet(np.ones(5))).tolist()
        side = int(rng.choice([64, 128, 256]))
        want, height = shelf(sizes, side)
        places, high = texture.shelves({s: sizes.count(s) for s in set(sizes)}, side)
        assert high == height
        for n, i in enumerate(sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))):
            before, x0, y0, first, top = places[sizes[i]]
            k = n - before
            at = (x0 + k * sizes[i], y0) if k < first else ((k - first) % (side // sizes[i]) * sizes[i], top + (k - first) // (side // sizes[i]) * sizes[i])
            assert at == want[i]


def test_texels_and_atlas(spark, tmp_path):
    points, colours, poses, faces, vertices, frames = scene(spark, 200, 12, 5, tmp_path)
    got = texture.texture(faces, vertices, frames, str(tmp_path), texel=0.02)
    tiles = {r.fid: r for r in got.tiles.collect()}
    views = best(points, poses)
    layout, _ = shelf([tiles[i].size for i in range(200)], got.atlas.side)
    picture = np.full((got.atlas.side, got.atlas.side, 3), 128, np.uint8)
    painted = 0
    for i, tri in enumerate(points):
        t = tiles[i]
        assert (t.x, t.y) == layout[i]
        edge = max(np.linalg.norm(tri[a] - tri[b]) for a, b in ((0, 1), (1, 2), (2, 0)))
        assert t.size == min(64, max(4, 2 ** int(np.ceil(np.log2(max(1, np.ceil(edge / got.atlas.texel)) + 3)))))
        own = np.frombuffer(t.texels, np.uint8).reshape(t.size, t.size, 3)
        picture[t.y : t.y + t.size, t.x : t.x + t.size] = own
        frame = views.get(i, (0, None))[1]
        if frame is None or frame == 5:  # unseen, or its picture is missing
            assert (own == colours[i].sum(0) // 3).all()
            continue
        painted += 1
        image = scans_png(tmp_path / f"{frame}.png")
        _, eye, q = poses[frame]
        for ty, tx in ((0, 0), (1, 1), (t.size - 1, 0), (t.size // 2, t.size // 2)):
            w = tri[0] + (tx - 1) / (t.size - 3) * (tri[1] - tri[0]) + (ty - 1) / (t.size - 3) * (tri[2] - tri[0])
            p = rotation(q).T @ (w - eye)
            x = min(max((p[0] * CAMERA["fx"] / p[2] + CAMERA["cx"]) / 2, 0), 39)
            y = min(max((p[1] * CAMERA["fy"] / p[2] + CAMERA["cy"]) / 2, 0), 29)
            x0, y0 = min(int(x), 38), min(int(y), 28)
            mix = sum(image[y0 + b, x0 + a] * (x - x0 if a else 1 - x + x0) * (y - y0 if b else 1 - y + y0) for a in (0, 1) for b in (0, 1))
            assert np.abs(own[ty, tx] - np.floor(mix + 0.5)).max() <= 1
    assert painted > 20
    whole = picture.copy()
    for s in got.strips.collect():
        part = np.frombuffer(s.rgb, np.uint8).reshape(s.height, got.atlas.side, 3)
        assert np.array_equal(part, picture[s.strip * s.height : (s.strip + 1) * s.height])
        whole[s.strip * s.height : (s.strip + 1) * s.height] = 128
    assert (whole == 128).all()


def scans_png(path):
    from plumbline.sources import pictures

    return pictures.read_picture(path.read_bytes()).astype(float)


def test_coarser_texels_and_no_faces(spark, tmp_path):
    _, _, _, faces, vertices, frames = scene(spark, 120, 9)
    got = texture.plan(faces, vertices, 0.0001, 256)
    assert got.side <= 256 and got.texel > 0.0001
    assert got.layout.agg(F.max(F.col("y") + F.col("size"))).first()[0] <= 256
    assert texture.texture(faces.limit(0), vertices, frames, str(tmp_path)) is None
    assert texture.best_views(texture.corners(faces.limit(0), vertices), frames).count() == 0
