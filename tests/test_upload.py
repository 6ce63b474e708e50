"""Packages read back against a brute-force placement; part files bounded in memory."""

from __future__ import annotations

import json
import os
import subprocess
import sys

import numpy as np
import pytest

from plumbline.sources import points, upload


def mesh(spark, n=40, seed=1):
    rng = np.random.default_rng(seed)
    p, m = rng.normal(0, 3, (n, 3)), rng.normal(0, 1, (n, 3))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    f = np.array([rng.choice(n, 3, replace=False) for _ in range(75)])
    v = spark.createDataFrame([(i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(p, m, strict=True))], "vid long, x double, y double, z double, nx double, ny double, nz double")
    return p, m, f, v, spark.createDataFrame([(i, *map(int, t)) for i, t in enumerate(f)], "fid long, a long, b long, c long")


def turn(q):
    x, y, z, w = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


SOLUTION = {"rotation": [0.1, -0.3, 0.2, np.sqrt(1 - 0.14)], "translation": [5.0, -2.0, 1.5], "scale": 1.02, "rmsError": 0.004, "maxError": float("inf"), "accuracyGrade": "layout", "outlierPointIds": ["p9"]}
INFO = {"captureId": "c1", "capturedUtc": "2024-01-01T00:00:00Z", "pointSetId": "s", "device": {"model": "x", "hasLidar": True}}


def back(spark, root):
    record, corners = upload.read_package(spark, root)
    rows = sorted(tuple(r) for r in corners.collect())
    return record, np.array([r[3:6] for r in rows]).reshape(-1, 3, 3), np.array([r[6:] for r in rows], float).reshape(-1, 3, 3)


@pytest.mark.parametrize("placed", [True, False])
def test_a_package_is_the_mesh_in_its_frame(spark, tmp_path, placed):
    p, m, f, v, faces = mesh(spark)
    seen = spark.createDataFrame([("b", 1.0, 2.0, 3.0, 0.01), ("a", 1.0, 2.0, float("nan"), None)], "pointId string, x double, y double, z double, sigma double")
    record = upload.package(v, faces, str(tmp_path), INFO, seen, SOLUTION, [100.0, 200.0, 300.0], has_points=placed, most_faces=20)
    got, xyz, normal = back(spark, str(tmp_path))
    assert got == record and list(got)[0] == "contractVersion" and len(got["geometry"]["files"]) == 4
    r = turn(SOLUTION["rotation"])
    want = 1.02 * p @ r.T + SOLUTION["translation"] + [100, 200, 300] if placed else p
    assert got["geometry"]["frame"] == ("model" if placed else "capture")
    assert np.allclose(xyz, want[f], atol=1e-6) and np.allclose(normal, (m @ r.T if placed else m)[f], atol=1e-6)
    assert got["correspondences"] == [{"pointId": "a", "observed": [1.0, 2.0, 0.0]}, {"pointId": "b", "observed": [1.0, 2.0, 3.0], "sigma": 0.01}]
    assert got["solution"]["maxError"] == 0.0 and got["geometry"]["bytes"] == sum(x["bytes"] for x in got["geometry"]["files"])


def test_a_package_counts_once_its_record_is_written(spark, tmp_path):
    p, _, f, v, faces = mesh(spark)
    upload.package(v.drop("nx", "ny", "nz"), faces, str(tmp_path), INFO)
    (tmp_path / "geometry-lost").mkdir()
    (tmp_path / "geometry-lost/00000.obj").write_text("v 0 0 0\n")
    with pytest.raises(ValueError, match="no faces"):
        upload.package(v, faces.limit(0), str(tmp_path), INFO)
    _, xyz, normal = back(spark, str(tmp_path))
    assert np.allclose(xyz, p[f], atol=1e-6) and np.isnan(normal).all()
    upload.package(v, faces.where("fid < 5"), str(tmp_path), INFO)
    record, xyz, _ = back(spark, str(tmp_path))
    assert len(xyz) == 5 and "solution" not in record and len([d for d in os.listdir(tmp_path) if d.startswith("geometry")]) == 2
    part = tmp_path / record["geometry"]["files"][0]["name"]
    part.write_bytes(part.read_bytes()[:-5])
    with pytest.raises(Exception, match="digest"):
        back(spark, str(tmp_path))
    (tmp_path / "capture.json").write_text(json.dumps({"contractVersion": "2.0.0"}))
    with pytest.raises(ValueError, match="version"):
        upload.read_package(spark, str(tmp_path))


@pytest.mark.parametrize("kind", ["ply", "las"])
def test_files_are_cut_by_size(spark, tmp_path, kind):
    points.register(spark)
    df = spark.range(60_000).selectExpr("id / 7 AS x", "id % 1000 / 3D AS y", "cast(id AS double) AS z").coalesce(1)
    df.write.format(kind).option("fileBytes", 400_000).mode("append").save(str(tmp_path / "cut"))
    assert len([n for n in os.listdir(tmp_path / "cut") if n.endswith(kind)]) >= 3
    got = spark.read.format(kind).load(str(tmp_path / "cut"))
    assert got.count() == 60_000 and abs(got.agg({"z": "sum"}).first()[0] - sum(range(60_000))) < 60


def test_a_large_partition_is_written_in_little_memory(tmp_path):
    """Two gigabytes go through one writer's task."""
    code = f"""
import resource
import numpy as np, pyarrow as pa
from plumbline.sources import points
batch = pa.RecordBatch.from_arrays([pa.array(np.random.default_rng(0).normal(0, 9, 100_000)) for _ in range(3)], ["x", "y", "z"])
class Nowhere:
    def open_output_stream(self, name, compression): return self
    def create_dir(self, path, recursive): pass
    def __enter__(self): return self
    def __exit__(self, *x): pass
    def write(self, data): self.n = getattr(self, "n", 0) + len(data)
there = Nowhere()
points.filesystem = lambda path: (there, "x")
done = points.PlyWriter({{"path": "x"}}).write(batch for _ in range(850))
print(len(done.names), there.n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ).stdout.split()
    assert int(said[0]) > 10 and int(said[1]) > 2 * 10**9 and int(said[2]) < 1000
