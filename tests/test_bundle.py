"""A capture bundle of a cube, from files to points, mesh and exports."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import mesh
from plumbline.plans import reconstruct as R
from plumbline.sources import export, pictures, points, scans

W, H, FOCAL = 64, 48, 50.0
CAMERA = {"model": "pinhole", "width": W, "height": H, "fx": FOCAL, "fy": FOCAL, "cx": 31.5, "cy": 23.5}


def turn(axis, angle):
    return [*(np.sin(angle / 2) * np.array(axis)).tolist(), float(np.cos(angle / 2))]


VIEWS = [
    ([0, 0, -2], turn([0, 1, 0], 0)), ([0, 0, 2], turn([0, 1, 0], np.pi)), ([-2, 0, 0], turn([0, 1, 0], np.pi / 2)),
    ([2, 0, 0], turn([0, 1, 0], -np.pi / 2)), ([0, -2, 0], turn([1, 0, 0], -np.pi / 2)), ([0, 2, 0], turn([1, 0, 0], np.pi / 2)),
]


def rotated(q, v):
    u, w = np.array(q[:3]), q[3]
    return v + 2 * np.cross(u, np.cross(u, v) + w * v)


def cube_depth(t, q):
    """Axial depth of a cube of one metre about the origin; 0 where a ray misses it."""
    x, y = np.meshgrid(np.arange(W) + 0.5, np.arange(H) + 0.5)
    ray = np.stack([(x - CAMERA["cx"]) / FOCAL, (y - CAMERA["cy"]) / FOCAL, np.ones_like(x)], -1)
    d = rotated(q, ray)
    with np.errstate(divide="ignore"):
        a, b = (-0.5 - np.array(t)) / d, (0.5 - np.array(t)) / d
    near, far = np.minimum(a, b).max(-1), np.maximum(a, b).min(-1)
    return np.where((near <= far) & (near > 0), near, 0.0)


@pytest.fixture
def bundle(tmp_path):
    def make(pose_every=1, depth=True, own_camera=True, images=None):
        root = tmp_path / "cube"
        for d in ("depth", "conf"):
            (root / d).mkdir(parents=True)
        lines = []
        for k, (t, q) in enumerate(VIEWS):
            f = {"id": f"{k:06}", "t": k * 0.5, "camera": 0, "poseSource": "vio" if k % pose_every == 0 else "none"}
            if k % pose_every == 0:
                f["pose"] = {"t": t, "q": q}
            if depth:
                (root / f"depth/{k}.bin").write_bytes(np.round(cube_depth(t, q) * 1000).astype("<u2").tobytes())
                (root / f"conf/{k}.bin").write_bytes(bytes([2]) * (W * H))
                f["depth"] = {"uri": f"depth/{k}.bin", "width": W, "height": H, "encoding": "uint16-mm", "confidenceUri": f"conf/{k}.bin"}
                if own_camera:
                    f["depth"]["camera"] = CAMERA
            if images:
                (root / "images").mkdir(exist_ok=True)
                (root / f"images/{k}.png").write_bytes(images(t, q))
                f["image"] = f"images/{k}.png"
            lines.append(json.dumps(f))
        (root / "frames.jsonl").write_text("\n".join(lines) + "\n")
        (root / "manifest.json").write_text(json.dumps({"formatVersion": 1, "name": "cube", "cameras": [CAMERA], "frameCount": 6}))
        return root

    return make


def test_cube_from_files_to_exports(spark, bundle, tmp_path):
    got = R.reconstruct(spark, str(bundle()), "balanced")
    assert got.counts == {"fused": 6, "no_pose": 0, "no_depth": 0, "unreadable": 0} and got.voxel == 0.025
    cloud = got.points.cache()
    assert cloud.count() > 500
    v, f = got.vertices.cache(), got.faces.cache()
    assert f.count() > 300 and f.select("fid").distinct().count() == f.count()
    p = v.toPandas()
    assert sorted(p["vid"]) == list(range(len(p)))
    size = p[["x", "y", "z"]].to_numpy()
    assert 0.9 < size.max() - size.min() < 1.4
    normal = p[["nx", "ny", "nz"]].to_numpy()
    assert np.allclose(np.linalg.norm(normal, axis=1), 1) and (normal * size).sum(1).mean() > 0
    assert mesh.component_table(f, v).agg(F.min("triangles")).first()[0] >= 32
    for kind in ("ply", "las", "obj"):
        export.export_points(cloud, kind, str(tmp_path / kind))
    points.register(spark)
    for kind in ("ply", "las"):
        assert spark.read.format(kind).load(str(tmp_path / kind)).count() == cloud.count()
    assert spark.read.text(str(tmp_path / "obj")).count() == cloud.count()
    export.export_mesh(v.withColumn("part", F.lit("0")), f.withColumn("part", F.lit("0")), "glb", str(tmp_path / "glb"))
    assert (tmp_path / "glb/mesh-0.glb").read_bytes()[:4] == b"glTF"


SIX = {(0, -1): (250, 10, 20), (0, 1): (20, 240, 30), (1, -1): (30, 40, 230), (1, 1): (220, 230, 40), (2, -1): (200, 50, 210), (2, 1): (60, 220, 225)}


def cube_picture(scale):
    """A picture of the cube in its six colours, of ``scale`` times the camera's size."""

    def draw(t, q):
        x, y = np.meshgrid((np.arange(W * scale) + 0.5) / scale, (np.arange(H * scale) + 0.5) / scale)
        ray = rotated(q, np.stack([(x - CAMERA["cx"]) / FOCAL, (y - CAMERA["cy"]) / FOCAL, np.ones_like(x)], -1))
        with np.errstate(divide="ignore", invalid="ignore"):
            a, b = (-0.5 - np.array(t)) / ray, (0.5 - np.array(t)) / ray
        near = np.minimum(a, b)
        at, axis = near.max(-1), near.argmax(-1)
        hit = (at <= np.maximum(a, b).min(-1)) & (at > 0)
        out = np.zeros((*at.shape, 3), np.uint8)
        for (k, side), colour in SIX.items():
            out[hit & (axis == k) & (np.sign(np.take_along_axis(-ray, axis[..., None], -1)[..., 0]) == side)] = colour
        return scans.png(out)

    return draw


def test_a_cube_of_six_colours_comes_out_with_six(spark, bundle):
    got = R.reconstruct(spark, str(bundle(images=cube_picture(3))), "balanced")
    for df in (got.points, got.vertices):
        p = df.toPandas()
        assert p[["r", "g", "b"]].notna().all(axis=None)
        xyz, rgb = p[["x", "y", "z"]].to_numpy(), p[["r", "g", "b"]].to_numpy(float)
        for (axis, side), colour in SIX.items():
            others = [k for k in range(3) if k != axis]
            own = (np.abs(xyz[:, axis] - 0.5 * side) < 0.05) & (np.abs(xyz[:, others]) < 0.3).all(1)
            assert own.sum() > 50 and (np.abs(rgb[own] - colour).max(1) <= 1).all()


def test_pictures_that_are_missing_or_broken_leave_no_colour(spark, bundle):
    root = bundle(images=cube_picture(1))
    (root / "images/0.png").unlink()
    (root / "images/1.png").write_bytes(b"\x89PNG\r\n\x1a\nxx")
    got = R.reconstruct(spark, str(root), "fast", surfaces=False)
    assert got.counts["fused"] == 6
    p = got.points.toPandas()
    front = (np.abs(p["z"] + 0.5) < 0.05) & (p[["x", "y"]].abs() < 0.3).all(axis=1)
    left = (np.abs(p["x"] + 0.5) < 0.05) & (p[["y", "z"]].abs() < 0.3).all(axis=1)
    assert front.sum() and left.sum() and p[front]["r"].isna().all() and (p[left]["r"] == 250).all()
    assert "r" not in R.reconstruct(spark, str(root), "fast", surfaces=False, colour=False).points.columns


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
@pytest.mark.parametrize(("colour", "step"), [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png_filters(kind, colour, step):
    rng = np.random.default_rng(kind)
    want = rng.integers(0, 256, (9, 7, step)).astype(int)
    raw = []
    for y in range(9):
        line = [kind]
        for x in range(7):
            for c in range(step):
                a, b, d = (int(want[v, u, c]) if v >= 0 and u >= 0 else 0 for v, u in ((y, x - 1), (y - 1, x), (y - 1, x - 1)))
                near = sorted([(abs(a + b - d - a), 0, a), (abs(a + b - d - b), 1, b), (abs(a + b - d - d), 2, d)])[0][2]
                line.append((int(want[y, x, c]) - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        raw.append(bytes(line))
    piece = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = b"\x89PNG\r\n\x1a\n" + piece(b"IHDR", struct.pack(">IIBBBBB", 7, 9, 8, colour, 0, 0, 0)) + piece(b"IDAT", zlib.compress(b"".join(raw))) + piece(b"IEND", b"")
    got = pictures.read_picture(data)
    assert np.array_equal(got, want[..., :3] if step > 2 else np.repeat(want[..., :1], 3, 2))
    with pytest.raises(ValueError):
        pictures.read_picture(data[: len(data) // 2])


def test_ppm():
    assert pictures.read_picture(b"P6 # note\n2 1\n255\n" + bytes(range(6))).tolist() == [[[0, 1, 2], [3, 4, 5]]]
    with pytest.raises(ValueError):
        pictures.read_picture(b"P6 2 1 255\n123")


def test_frames_left_out_are_counted(spark, bundle):
    root = bundle(pose_every=3, own_camera=False)
    got = R.reconstruct(spark, str(root), "fast", surfaces=False)
    assert got.counts == {"fused": 2, "no_pose": 4, "no_depth": 0, "unreadable": 0} and got.faces is None
    assert got.points.count() > 0


def test_unreadable_rasters_cost_their_frames_alone(spark, bundle):
    root = bundle()
    (root / "depth/1.bin").unlink()
    (root / "depth/2.bin").write_bytes(b"\0" * 10)
    (root / "conf/3.bin").unlink()
    got = R.reconstruct(spark, str(root), "fast", surfaces=False)
    assert got.counts == {"fused": 3, "no_pose": 0, "no_depth": 0, "unreadable": 3}


def test_confidence_gate(spark, bundle):
    root = bundle()
    assert R.reconstruct(spark, str(root), "fast", surfaces=False, min_confidence=2).points.count() > 0
    assert R.reconstruct(spark, str(root), "fast", surfaces=False, min_confidence=3).points.count() == 0


def test_no_depth_is_explained(spark, bundle):
    with pytest.raises(R.NothingFused, match="No frames could be fused") as e:
        R.reconstruct(spark, str(bundle(depth=False)), "fast")
    assert e.value.counts["no_depth"] == 6 and "no depth" in e.value.hint


def test_a_line_cut_short_costs_one_frame(spark, bundle):
    root = bundle()
    lines = (root / "frames.jsonl").read_text()
    (root / "frames.jsonl").write_text(lines[:-40])
    assert sum(R.reconstruct(spark, str(root), "fast", surfaces=False).counts.values()) == 5
