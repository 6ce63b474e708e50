"""Exports, records, placement and the scaled joins against brute force."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators import matching, mesh, records, registration
from plumbline.sources import export, fbx, interop, points, scans


def _cloud(spark, n=200):
    rng = random.Random(1)
    rows = [(k % 2, rng.uniform(-5, 5), rng.uniform(-5, 5), rng.uniform(0, 3), k % 256, 10, 255 - k % 256) for k in range(n)]
    return spark.createDataFrame(rows, "part int, x double, y double, z double, red int, green int, blue int"), sorted(r[1:4] for r in rows)


@pytest.mark.parametrize("kind", ["ply", "las", "obj", "e57"])
def test_points_come_back(spark, tmp_path, kind):
    cloud, want = _cloud(spark)
    path = str(tmp_path / "out")
    export.export_points(cloud, kind, path)
    if kind in ("ply", "las"):
        got = [(r.x, r.y, r.z) for r in spark.read.format(kind).load(path).collect()]
    elif kind == "obj":
        got = [tuple(map(float, r.value.split()[1:])) for r in spark.read.text(path).collect()]
    else:
        got = [tuple(p) for f in (tmp_path / "out").glob("*.e57") for p in scans.read_e57(f.read_bytes())["positions"]]
    apart = np.linalg.norm(np.array(got)[:, None] - np.array(want)[None], axis=2)
    assert len(got) == len(want) and sorted(apart.argmin(1)) == list(range(len(want))) and apart.min(1).max() < 0.001
    with pytest.raises(ValueError, match="no point format"):
        export.export_points(cloud, "xyz", path)


@pytest.mark.parametrize("kind", ["ply", "obj", "glb", "fbx"])
def test_meshes_come_back(spark, tmp_path, kind):
    v = spark.createDataFrame([(p, 10 * k, float(k % 2 + p), float(k // 2), 0.5) for p in (0, 1) for k in range(4)], "part int, vid long, x double, y double, z double")
    f = spark.createDataFrame([(p, k, *c) for p in (0, 1) for k, c in enumerate([(0, 10, 20), (10, 30, 20)])], "part int, fid long, a long, b long, c long")
    export.export_mesh(v, f, kind, str(tmp_path))
    files = sorted(tmp_path.glob(f"*.{kind}"))
    assert len(files) == 2
    data = files[1].read_bytes()
    if kind == "ply":
        points.register(spark)
        got = spark.read.format("ply").load(str(files[1])).select("x", "y", "z").collect()
        assert [tuple(r) for r in got] == [(1.0, 0.0, 0.5), (2.0, 0.0, 0.5), (1.0, 1.0, 0.5), (2.0, 1.0, 0.5)]
        return
    m = {"obj": lambda d: points.obj_mesh(d.decode()), "glb": lambda d: {k.replace("position", "positions"): x for k, x in points.read_glb(d).items()}, "fbx": fbx.read_mesh}[kind](data)
    assert np.allclose(m["positions"], [(1, 0, 0.5), (2, 0, 0.5), (1, 1, 0.5), (2, 1, 0.5)]) and np.array_equal(np.array(m["triangles"]).reshape(-1, 3), [(0, 1, 2), (1, 3, 2)])


def test_splats_come_back(spark, tmp_path):
    rest = [float(k) for k in range(9)]
    s = spark.createDataFrame([(0, 1.0, 2.0, 3.0, rest)], "part int, x double, y double, z double, rest array<double>")
    s = s.select("part", V.vec(F.col("x"), F.col("y"), F.col("z")).alias("position"), V.vec(0, 0.5, -1).alias("log_scale"), V.quat(0.1, 0.2, 0.3, 0.9).alias("rotation"), F.lit(0.0).alias("logit"), *(F.lit(0.1 * k).alias(f"sh0_{c}") for k, c in enumerate("rgb")), "rest")
    export.export_splats(s, "ply", str(tmp_path / "p"), 1)
    got = spark.read.format("ply").load(str(tmp_path / "p")).first().asDict()
    assert list(got)[:9] == ["x", "y", "z", "nx", "ny", "nz", "f_dc_0", "f_dc_1", "f_dc_2"] and list(got)[-4:] == ["rot_0", "rot_1", "rot_2", "rot_3"]
    assert [got[f"f_rest_{k}"] for k in range(9)] == [0, 3, 6, 1, 4, 7, 2, 5, 8] and got["nx"] == 0 and got["rot_0"] == pytest.approx(0.9) and got["scale_1"] == 0.5
    export.export_splats(s, "glb", str(tmp_path / "g"), 1)
    doc, blob = points.parse_glb(next((tmp_path / "g").glob("*.glb")).read_bytes())
    at = doc["meshes"][0]["primitives"][0]["attributes"]
    read = lambda n: points.glb_accessor(doc, blob, at[f"KHR_gaussian_splatting:{n}"])[0].tolist()
    assert read("SCALE") == pytest.approx([1, math.exp(0.5), math.exp(-1)]) and read("OPACITY") == [0.5] and read("SH_DEGREE_1_COEF_1") == [3, 4, 5]
    assert doc["extensionsRequired"] == ["KHR_gaussian_splatting"]


@pytest.mark.parametrize("tile", [3, 4_096])
def test_tiles_find_the_two_nearest(spark, tile):
    rng = random.Random(2)
    rows = lambda n: [(p, k, *(rng.choice([rng.getrandbits(63), 5, 7]) for _ in range(4))) for p in ("a", "b") for k in range(n)] + [("only" + str(n), 0, 1, 2, 3, 4)]
    a, b = rows(13), rows(8)
    kind = "pair string, kp int, d0 long, d1 long, d2 long, d3 long"
    d = lambda x, y: sum((m ^ n).bit_count() for m, n in zip(x[2:], y[2:], strict=True))

    def brute(xs, ys):
        out = {}
        for x in xs:
            near = sorted((d(x, y), y[1]) for y in ys if y[0] == x[0])
            if len(near) > 1 and near[0][0] < 0.95 * near[1][0]:
                out[x[0], x[1]] = (near[0][1], near[0][0])
        return out

    one, two = spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)
    forth, back = brute(a, b), brute(b, a)
    assert {(r.pair, r.a): (r.b, r.distance) for r in matching.nearest_two(one, two, 0.95, tile=tile).collect()} == forth
    want = sorted((p, k, o) for (p, k), (o, _) in forth.items() if back.get((p, o), (None,))[0] == k)
    assert sorted((r.pair, r.a, r.b) for r in matching.mutual(one, two, 0.95, tile=tile).collect()) == want
    assert matching.mutual(one.limit(0), two).count() == 0


def test_leave_one_out_is_a_refit():
    rng = np.random.default_rng(3)
    p = rng.normal(size=(9, 3)) * 20 + [5000, 3000, 100]
    r, t, _ = registration.horn(rng.normal(size=(4, 3)), rng.normal(size=(4, 3)), np.ones(4))
    q = p @ r.T + t + rng.normal(size=p.shape) * 0.01
    q[4] += 3
    w = rng.uniform(0.5, 2, 9)
    for scale in (False, True):
        got = registration._rms_without(p, q, w, scale)
        for i in range(9):
            rest = np.arange(9) != i
            e = registration._errors(p[rest], q[rest], *registration.horn(p[rest], q[rest], w[rest], scale))
            assert got[i] == pytest.approx(np.sqrt((e**2).mean()), rel=1e-6, abs=1e-9)
    line = np.c_[np.arange(5.0), np.zeros(5), np.zeros(5)]
    line[4] = (0, 1, 0)
    assert np.isnan(registration._rms_without(line, line, np.ones(5), False)[4])


@pytest.mark.parametrize("shape", ["ball", "box", "line", "one"])
def test_baseline_against_brute_force(spark, shape):
    rng = np.random.default_rng(4)
    p = rng.normal(size=(300, 3))
    p = {"ball": p / np.linalg.norm(p, axis=1)[:, None], "box": rng.random((300, 3)) * [9, 1, 1], "line": np.c_[rng.random(300), np.zeros((300, 2))], "one": np.ones((3, 3))}[shape]
    got = mesh.max_baseline(spark.createDataFrame(p.tolist(), "x double, y double, z double")).first().baseline
    assert got == pytest.approx(max(np.linalg.norm(a - b) for a in p for b in p), abs=1e-9)


def test_best_frame_in_blocks(spark):
    rng = random.Random(5)
    t = spark.createDataFrame([(k, rng.random(), rng.random()) for k in range(20)], "tri int, x double, y double").select("tri", V.vec(F.col("x"), F.col("y"), 0).alias("centre"), V.vec(0, 0, 1).alias("normal"))
    f = spark.createDataFrame([(k, rng.random() * 4, rng.random() * 4, 1 + rng.random()) for k in range(30)], "frame int, x double, y double, z double").select("frame", V.vec(F.col("x"), F.col("y"), F.col("z")).alias("eye"))
    whole, cut = (sorted(map(tuple, matching.best_frame(t, f, block=b).collect())) for b in (5_000, 4))
    assert whole and [x[:2] for x in whole] == [x[:2] for x in cut]


def test_records_take_odd_rows(spark):
    none = spark.createDataFrame([], "id long, name string")
    some = spark.createDataFrame([(1, "A site"), (2, None)], "id long, name string")
    assert records.upsert(none, some, "id").count() == 2 and records.upsert(some, none, "id").count() == 2
    assert [r.id for r in records.search(some, "  SITE", ["name"], [F.asc("id")]).collect()] == [1] and records.search(some, " ", ["name"], [F.asc("id")]).count() == 2
    assert records.every_kth(some, ["id"], 5).count() == 2
    many = spark.range(103)
    assert sorted(r.id for r in records.every_kth(many, ["id"], 10).collect()) == [int(k * 10.3) for k in range(10)]
    assert [interop.nearest_cleanup(F.lit(v)) is not None for v in (0.1,)] == [True]
    row = spark.range(1).select(*(interop.nearest_cleanup(F.lit(v).cast("double")).alias(f"c{k}") for k, v in enumerate((None, 0.2, 0.07)))).first()
    assert tuple(row) == ("none", "standard", "aggressive")
    assert json.loads(json.dumps(records.skip_counts.__doc__))
