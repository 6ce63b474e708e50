"""Invariants of the capture operators, and queries against their SQL."""

from __future__ import annotations

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import camera as C
from plumbline.functions import geodesy as G
from plumbline.functions import text as T
from plumbline.functions import vectors as V
from plumbline.operators import fusion, matching, mesh, registration, splats, surface
from plumbline.plans import catalog
from plumbline.sources import points as P
from plumbline.sources import survey as S
from plumbline.streaming import keyframes, receivers

DATA = "/root/testdata/sf0.001"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("zone", G.ZONES, ids=lambda z: z.code)
def test_zone_maps_its_origin_and_back(spark, zone):
    r = one(spark, G.project(F.lit(zone.lat0), F.lit(zone.lon0), zone).alias("p"))
    assert abs(r.p.easting - zone.false_easting) < 1e-6 and abs(r.p.northing - zone.false_northing) < 1e-4
    lat, lon = zone.lat0 + 0.7, zone.lon0 + 0.9
    g = G.project(F.lit(lat), F.lit(lon), zone)
    b = one(spark, G.unproject(g["easting"], g["northing"], zone).alias("b")).b
    assert abs(b.lat - lat) < 1e-8 and abs(b.lon - lon) < 1e-8
    if zone.kind == "lcc":
        assert abs(one(spark, G.grid_scale(F.lit(zone.sp1), F.lit(zone.lon0), zone).alias("k")).k - 1) < 1e-6


def test_ecef_round_trip_and_poles(spark):
    rows = [(29.4, -98.5, 173.2), (89.999, 10.0, 5.0), (-45.0, 179.9, -30.0), (0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "lat double, lon double, h double").withColumn("g", G.ecef_to_geodetic(G.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.col("h"))))
    for r in df.collect():
        assert abs(r.g.lat - r.lat) < 1e-9 and abs(r.g.lon - r.lon) < 1e-9 and abs(r.g.height - r.h) < 1e-5
    pole = one(spark, G.ecef_to_geodetic(V.vec(0, 0, -6356752.314245179)).alias("g")).g
    assert pole.lat == -90 and abs(pole.height) < 1e-6


def test_units_and_bands(spark):
    r = one(spark, G.float32_ulp(F.lit(13123333.0)).alias("a"), G.float32_ulp(F.lit(0.0)).alias("b"), G.float32_ulp(F.lit(float("inf"))).alias("c"), *(G.accuracy_band(F.lit(v)).alias(f"d{k}") for k, v in enumerate((0.003, 0.0031, float("nan"), -1.0, 0.3))))
    assert r.a == 1.0 and r.b == 2.0**-149 and math.isinf(r.c)
    assert [r[f"d{k}"] for k in range(5)] == ["layout", "penetrations", "unusable", "unusable", "unusable"]
    assert G.lookup_zone("tx83-sc").unit == "metre"
    with pytest.raises(ValueError):
        G.lookup_zone("nowhere")


def test_vectors_and_matrices(spark):
    df = spark.createDataFrame([(0.2, 1.0, 0.1, 0.4)], "x double, y double, z double, angle double")
    df = df.withColumn("axis", V.vec(F.col("x"), F.col("y"), F.col("z"))).withColumn("v", V.vec(F.col("x") + 0.1, F.col("y") - 1.5, F.col("z") + 1.9))
    steps = {
        "q": lambda: V.quat_from_axis_angle(F.col("axis"), F.col("angle")),
        "m": lambda: V.compose(V.vec(1, 2, 3), F.col("q")),
        "inv": lambda: V.invert(F.col("m")),
        "rigid": lambda: V.invert_rigid(F.col("m")),
        "a": lambda: V.transform_point(F.col("m"), F.col("v")),
        "b": lambda: V.add(V.rotate(F.col("q"), F.col("v")), V.vec(1, 2, 3)),
        "i": lambda: V.matrix_multiply(F.col("m"), F.col("inv")),
        "j": lambda: V.matrix_multiply(F.col("m"), F.col("rigid")),
        "p": lambda: V.matrix_pose(F.col("m")),
        "d": lambda: V.determinant(F.col("m")),
        "minus": lambda: V.negate(F.col("axis")),
        "arc": lambda: V.shortest_arc(F.col("axis"), F.col("minus")),
        "turned": lambda: V.rotate(F.col("arc"), F.col("axis")),
        "one": lambda: V.quat_identity(),
        "e": lambda: V.slerp(F.col("one"), F.col("q"), F.col("angle") / 0.4),
    }
    for name, make in steps.items():
        df = df.withColumn(name, make())
        if name in ("q", "m", "inv", "rigid", "arc"):
            df = spark.createDataFrame(df.collect(), df.schema)
    r = df.first()
    assert np.allclose(r.a, r.b) and np.allclose(r.i, np.eye(4).ravel()) and np.allclose(r.j, np.eye(4).ravel())
    assert np.allclose(r.p.q, r.q) and abs(r.d - 1) < 1e-12 and np.allclose(r.turned, r.minus) and np.allclose(r.e, r.q)


def test_rounding_and_medians(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    r = df.agg(V.upper_median(F.col("v")).alias("u"), V.mean_median(F.col("v")).alias("m")).first()
    assert (r.u, r.m) == (3.0, 2.5)
    assert one(spark, V.round_half_up(F.lit(-2.5)).alias("r")).r == -2


CAMERA = dict(model="pinhole", width=1920, height=1440, fx=1500.0, fy=1500.0, cx=960.0, cy=720.0, k1=-0.28, k2=0.07, k3=0.0, k4=0.0, p1=1e-3, p2=-5e-4, hfov=2 * math.pi, vfov=math.pi)


@pytest.mark.parametrize("model", ["pinhole", "fisheye", "equirect"])
def test_camera_round_trip(spark, model):
    cam = {**CAMERA, "model": model, **({"k1": 0.01, "k2": -0.002} if model == "fisheye" else {})}
    c = F.from_json(F.lit(__import__("json").dumps(cam)), C.SCHEMA)
    p = V.vec(0.4, -0.2, 1.5)
    df = spark.range(1).select(c.alias("c"), p.alias("p")).withColumn("u", C.project_point(F.col("p"), F.col("c")))
    df = df.withColumn("d", C.depth_for_model(F.col("p"), F.col("c"))).withColumn("b", C.unproject_pixel(F.col("u.x"), F.col("u.y"), F.col("d"), F.col("c")))
    r = df.first()
    assert r.u.visible and np.allclose(r.b, r.p, atol=1e-9)


def test_sphere_surface_is_closed(spark):
    n, radius = 24, 0.31
    g = np.arange(n)
    x, y, z = (a.ravel() for a in np.meshgrid(g, g, g, indexing="ij"))
    centre = n / 2 + 0.137
    v = np.sqrt((x + 0.5 - centre) ** 2 + (y + 0.5 - centre) ** 2 + (z + 0.5 - centre) ** 2) / n - radius
    field = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "z": z, "v": v}))
    vertices, faces = surface.march(field, 1 / n)
    vertices, faces = vertices.cache(), faces.withColumn("fid", F.monotonically_increasing_id()).cache()
    assert mesh.edge_use(faces).where("uses <> 2").count() == 0
    r = mesh.area_and_volume(faces, vertices).first()
    assert abs(r.volume - 4 / 3 * math.pi * radius**3) < 0.02 * r.volume and abs(r.area - 4 * math.pi * radius**2) < 0.03 * r.area
    kept, small = mesh.compact(faces.where("fid % 5 = 0"), vertices)
    assert kept.agg(F.max("vid")).first()[0] == kept.count() - 1 and small.count() == faces.where("fid % 5 = 0").count()
    assert surface.march(field.where("x <> 12"), 1 / n)[1].count() < faces.count()


def test_fusion_of_a_plane(spark):
    px, py = np.meshgrid(np.arange(20), np.arange(20))
    df = pd.DataFrame({"px": px.ravel(), "py": py.ravel(), "d": 1.5, "conf": 2})
    df.loc[0, "d"], df.loc[1, "conf"] = float("nan"), 0
    cam = {**CAMERA, "width": 20, "height": 20, "fx": 30.0, "fy": 30.0, "cx": 10.0, "cy": 10.0, "k1": 0.0, "k2": 0.0, "p1": 0.0, "p2": 0.0}
    c = F.from_json(F.lit(__import__("json").dumps(cam)), C.SCHEMA)
    pixels = spark.createDataFrame(df).withColumn("camera", c).withColumn("pose", F.struct(V.vec(0, 0, 0).alias("t"), V.quat_identity().alias("q")))
    voxels = fusion.integrate(pixels, 0.02, 0.06)
    points = fusion.extract_points(voxels, 0.02).toPandas()
    assert len(points) > 100 and (points.z - 1.5).abs().max() < 0.02
    assert fusion.fuse(fusion.ray_samples(pixels.where("d > 9"), 0.02)).count() == 0


def _pairs(spark, move=None):
    p = np.array([[0, 0, 0], [10, 0, 0], [0, 12, 0], [0, 0, 4], [10, 12, 4], [5, 6, 2]], float)
    k = np.array([0.2, 1, 0.1]) / np.linalg.norm([0.2, 1, 0.1])
    cross = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    r = np.eye(3) + math.sin(0.4) * cross + (1 - math.cos(0.4)) * cross @ cross
    q = p @ r.T + [12.5, -3.25, 7]
    if move is not None:
        q[3] += move
    return spark.createDataFrame([("g", str(i), *map(float, a), *map(float, b), 0.01) for i, (a, b) in enumerate(zip(p, q, strict=True))], "group string, id string, px double, py double, pz double, qx double, qy double, qz double, sigma double"), r


def test_registration_recovers_and_finds_the_blunder(spark):
    good, r = _pairs(spark)
    s = registration.solve_rigid(good).first()
    assert np.allclose([[s[f"r{i}{j}"] for j in range(3)] for i in range(3)], r, atol=1e-9) and s.rms < 1e-9 and abs(s.ty + 3.25) < 1e-9
    bad, _ = _pairs(spark, [0.0, 0.3, 0.0])
    assert registration.find_outliers(bad).first().id == "3"
    assert registration.solve_rigid(good.where("id < 2")).count() == 0
    assert registration.solve_best(good.where("id < 2")).first().method == "gravity"


def test_components_and_cleaning(spark):
    faces = spark.createDataFrame([(i, i, i + 1, i + 2) for i in range(40)] + [(100, 500, 501, 502)], "fid long, a long, b long, c long")
    vertices = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in [*range(42), 500, 501, 502]], "vid long, x double, y double, z double")
    assert sorted(tuple(r) for r in mesh.component_table(faces, vertices).select("label", "triangles").collect()) == [(0, 40), (500, 1)]
    assert mesh.remove_small(faces, 2).count() == 40 and mesh.keep_largest(faces).count() == 40 and mesh.remove_component(faces, 5).count() == 1
    assert mesh.remove_noise(faces, vertices, 1000, 1e9).count() == 40
    low, high = V.vec(-1, -1, -1), V.vec(20, 1, 1)
    assert mesh.crop(faces, vertices, low, high).count() + mesh.crop(faces, vertices, low, high, erase=True).count() == 41


def test_nmea(spark):
    body = "GPGGA,143042.00,2925.4460,N,09829.6160,W,4,18,0.7,198.5,M,-25.3,M,1.0,0123"
    line = f"${body}*{__import__('functools').reduce(lambda a, c: a ^ ord(c), body, 0):02X}"
    df = spark.createDataFrame([(line,), (line[:-2] + "00",), (line[:-2] + "ZZ",), ("noise",), (None,)], "line string").withColumn("s", T.nmea(F.col("line")))
    rows = df.withColumn("g", T.gga(F.col("s"))).collect()
    assert [r.s.valid if r.s else None for r in rows] == [True, False, False, None, None]
    g = rows[0].g
    assert abs(g.lat - 29.4241) < 1e-4 and abs(g.lon + 98.4936) < 1e-4 and abs(g.height - 173.2) < 1e-9 and g.quality == 4
    gst = "GPGST,143042.10,1,,,,0.010,0.012,0.020"
    second = f"${gst}*{__import__('functools').reduce(lambda a, c: a ^ ord(c), gst, 0):02X}"
    fix = receivers.assemble(spark.createDataFrame([("d", line), ("d", second)], "device string, line string")).first()
    assert abs(fix.h_accuracy - math.hypot(0.010, 0.012)) < 1e-12 and fix.since == 0
    assert receivers.split_lines(b"ab", b"c\r\nx\x00y\nrest") == (["abc", "xy"], b"rest")


def test_links_paths_endpoints(spark):
    rows = [("host:2101", "host", 2101), ("ntrip://h.example/x", "h.example", 2101), ("[fe80::1]:99", "fe80::1", 99), ("a:99999", None, None)]
    for raw, host, port in rows:
        e = one(spark, T.endpoint(F.lit(raw)).alias("e")).e
        assert (e.host, e.port) == (host, port) if host else e is None
    safe = [one(spark, T.path_is_safe(F.lit(p)).alias("s")).s for p in ("a/b.txt", "../x", "a\\b", "c:d", "", "/x", "x" * 256)]
    assert safe == [True, False, False, False, False, False, False]
    assert one(spark, T.endpoint_from_hex(F.lit("c0a80001083d")).alias("e")).e == ("192.168.0.1", 2109)
    assert one(spark, T.xml_escape(F.lit("<a&'\">")).alias("x")).x == "&lt;a&amp;&apos;&quot;&gt;"


def test_ply_las_round_trips(spark, tmp_path):
    P.register(spark)
    i = np.arange(5000)
    df = pd.DataFrame({"x": 646000 + i / 1000, "y": 4181000 + 10 * np.sin(i), "z": 30 + (i % 17) / 2})
    df["red"], df["green"], df["blue"] = ((i * k % 256).astype("int16") for k in (1, 2, 3))
    s = spark.createDataFrame(df).repartition(3)
    s.write.format("ply").mode("append").option("comment", "a\nend_header").save(str(tmp_path / "ply"))
    back = spark.read.format("ply").load(str(tmp_path / "ply")).toPandas().sort_values("x").reset_index(drop=True)
    assert np.array_equal(back.y, df.y) and (back.red == df.red).all()
    (s.withColumnsRenamed({"red": "r", "green": "g", "blue": "b"}).withColumn("intensity", F.lit(0.5).cast("float")).write.format("las").mode("append").option("wkt", "LOCAL").save(str(tmp_path / "las")))
    las = spark.read.format("las").load(str(tmp_path / "las")).toPandas().sort_values("x", kind="stable").reset_index(drop=True)
    assert len(las) == 5000 and np.abs(las.x - df.x).max() <= 0.00051 and np.abs(las.z - df.z).max() <= 0.00051 and sorted(las.r) == sorted(df.red)
    with pytest.raises(Exception, match="LAS integers"):
        spark.createDataFrame([(0.0, 0.0, 0.0), (1e10, 0.0, 0.0)], "x double, y double, z double").coalesce(1).write.format("las").mode("append").save(str(tmp_path / "far"))


def test_ply_ascii_lists_and_truncation(spark, tmp_path):
    P.register(spark)
    (tmp_path / "m.ply").write_text("ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0\n1 0\n0 1\n3 0 1 2\n")
    assert spark.read.format("ply").option("element", "face").load(str(tmp_path / "m.ply")).first()[0] == [0, 1, 2]
    (tmp_path / "t.ply").write_bytes(b"ply\nformat binary_little_endian 1.0\nelement vertex 9\nproperty double x\nend_header\n" + bytes(16))
    with pytest.raises(Exception, match="ends within"):
        spark.read.format("ply").load(str(tmp_path / "t.ply")).count()


def test_obj_and_glb():
    t = "v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nvt 0 0.25\nf 1/1 2/1 3/1 -1/1\n"
    m = P.obj_mesh(t)
    assert m["triangles"].tolist() == [[0, 1, 2], [0, 2, 3]] and m["uvs"][0].tolist() == [0, 0.75]
    again = P.obj_mesh(P.write_obj(m["positions"], m["triangles"], m["uvs"]))
    assert np.allclose(again["positions"], m["positions"]) and np.allclose(again["uvs"], m["uvs"])
    g = P.read_glb(P.write_glb(m["positions"], m["triangles"]))
    assert np.allclose(g["position"], m["positions"]) and (g["triangles"] == m["triangles"]).all()


def test_bundle_with_a_cut_tail(spark, tmp_path):
    (tmp_path / "manifest.json").write_text('{"formatVersion": 1, "name": "n", "frameCount": 9, "cameras": [{"model": "pinhole", "fx": 50.0}]}')
    (tmp_path / "frames.jsonl").write_text('{"id":"a","t":0.1,"camera":0,"pose":{"t":[0,0,0],"q":[0,0,0,1]},"poseSource":"slam"}\n\n{"id":"b","t":0.2,"camera":0,"poseSource":"none"}\n{"id":"c","t":0.')
    b = S.read_bundle(spark, str(tmp_path))
    assert b["captures"].first().frameCount == 2 and S.posed(b["frames"]).count() == 1
    assert S.frame_cameras(b["frames"], b["captures"]).where("intrinsics.fx = 50").count() == 2
    assert S.lost_lines(spark, str(tmp_path / "frames.jsonl"), S.FRAME) == 1
    raster = np.array([0, 1500, 65535], "<u2").tobytes()
    d = S.decode_depth(spark.createDataFrame([("f", 3, 1, "uint16-mm", bytearray(raster), None)], "frame string, width int, height int, encoding string, content binary, confidence binary")).collect()
    assert [(r.px, r.d) for r in d] == [(1, 1.5), (2, 65.535)]


def test_colmap(spark, tmp_path):
    (tmp_path / "cameras.txt").write_text("# c\n1 PINHOLE 640 480 500 501 320 240\n2 WEIRD 1 1 1\n")
    (tmp_path / "images.txt").write_text("# i\n1 0.70710678 0 0.70710678 0 0 0 10 1 a.jpg\n1.0 2.0 -1\n2 1 0 0 0 0 0 0 2 b.jpg\n\n")
    frames, warnings = S.import_colmap(spark, str(tmp_path / "cameras.txt"), str(tmp_path / "images.txt"))
    r = frames.first()
    assert np.allclose(r.t, [10, 0, 0], atol=1e-6) and r.fy == 501 and warnings.first().name == "b.jpg"


def test_splats(spark):
    r = one(spark, splats.to_coefficient_major(splats.to_channel_major(F.array(*(F.lit(float(k)) for k in range(9))), 3), 3).alias("a"), splats.to_channel_major(F.array(*(F.lit(float(k)) for k in range(9))), 3).alias("b"), splats.sigmoid(splats.logit(F.lit(0.3))).alias("s"))
    assert r.a == [float(k) for k in range(9)] and r.b == [0, 3, 6, 1, 4, 7, 2, 5, 8] and abs(r.s - 0.3) < 1e-12
    layers = spark.createDataFrame([(0, 1.0, 0.5, 1.0), (0, 2.0, 0.5, 1.0), (0, 3.0, 0.001, 9.0)], "p int, z double, a double, c double")
    c = splats.composite(layers, ["p"], "z", "a", ["c"]).first()
    assert abs(c.c - 0.75) < 1e-12 and abs(c.transmittance - 0.25) < 1e-12


def test_keyframes_batch_equals_stream(spark, tmp_path):
    rows = [("a", float(t), float(t), 0.0, 0.0) for t in range(7)]
    df = spark.createDataFrame(rows, "capture string, t double, x double, y double, z double")
    assert sorted(r.t for r in keyframes.keep_moved(df, 2.0).collect()) == [0, 2, 4, 6]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = keyframes.keep_moved_stream(stream, 2.0).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.t for r in spark.table("kept").collect()) == [0, 2, 4, 6]


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_against_sql(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    import duckdb

    got = catalog.queries()[name](spark, DATA)
    sql = catalog.oracle_sql().get(name)
    rows = got.collect()
    if not sql:
        assert rows is not None
        return
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in rows))) == sorted(map(repr, want.fetchall()))
