"""Archives, image metadata, receiver streams and the smaller operators."""

from __future__ import annotations

import io
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions import vectors as V
from plumbline.operators import fusion, matching, splats
from plumbline.sources import survey as S
from plumbline.streaming import receivers


def test_zip_entries(spark):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("cap/manifest.json", "{}")
        z.writestr("cap/depth/0.bin", b"\1\2")
    rows = S.zip_entries(spark.createDataFrame([("a.zip", bytearray(b.getvalue()))], "path string, content binary")).collect()
    assert {(r.name, bytes(r.content)) for r in rows} == {("manifest.json", b"{}"), ("depth/0.bin", b"\1\2")}
    lz = io.BytesIO()
    with zipfile.ZipFile(lz, "w", zipfile.ZIP_BZIP2) as z:
        z.writestr("x", "y")
    with pytest.raises(Exception, match="isn't read"):
        S.zip_entries(spark.createDataFrame([("a.zip", bytearray(lz.getvalue()))], "path string, content binary")).collect()


def jpeg(lat, lon, order="<", xmp=None, alt=(100, 1), below=False):
    """A JPEG head with GPS in either byte order."""
    pack = lambda f, *v: struct.pack(order + f, *v)
    rational = lambda v: b"".join(pack("II", *p) for p in v)
    dms = lambda v: [(int(abs(v)), 1), (int(abs(v) * 60 % 60), 1), (round(abs(v) * 3600 % 60 * 10000), 10000)]
    entry = lambda tag, kind, n, v: pack("HHI", tag, kind, n) + v.ljust(4, b"\0")
    head = (b"II" if order == "<" else b"MM") + pack("HI", 42, 8)
    gps_at, data_at = 8 + 2 + 12 * 2 + 4, 8 + 2 + 12 * 2 + 4 + 2 + 12 * 6 + 4
    make = b"DJI\0"
    ifd = pack("H", 2) + entry(0x010F, 2, 4, make) + entry(0x8825, 4, 1, pack("I", gps_at)) + pack("I", 0)
    gps = pack("H", 6) + entry(1, 2, 2, b"N\0" if lat >= 0 else b"S\0") + entry(2, 5, 3, pack("I", data_at)) + entry(3, 2, 2, b"E\0" if lon >= 0 else b"W\0") + entry(4, 5, 3, pack("I", data_at + 24)) + entry(5, 1, 1, bytes([below])) + entry(6, 5, 1, pack("I", data_at + 48)) + pack("I", 0)
    tiff = head + ifd + gps + rational(dms(lat)) + rational(dms(lon)) + rational([alt])
    out = b"\xff\xd8" + b"\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff
    if xmp:
        body = b"http://ns.adobe.com/xap/1.0/\0" + xmp.encode()
        out += b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body
    return out + b"\xff\xda\0\2"


@pytest.mark.parametrize("order", ["<", ">"])
def test_drone_images(spark, order):
    xmp = '<x drone-dji:GimbalYawDegree="+90.0" drone-dji:GimbalPitchDegree="-90" drone-dji:GimbalRollDegree="0" drone-dji:RtkFlag="50" drone-dji:AbsoluteAltitude="+120.5"/>'
    files = spark.createDataFrame([(f"{k}.jpg", bytearray(jpeg(29.4 + k / 1000, -98.5, order, xmp if k else None))) for k in range(3)], "path string, content binary")
    meta = S.image_metadata(files)
    r = {x.path: x for x in meta.collect()}
    assert r["0.jpg"].make == "DJI" and abs(r["1.jpg"].lat - 29.401) < 1e-6 and r["1.jpg"].lon < 0 and r["0.jpg"].altitude == 100 and r["0.jpg"].xmp is None
    got = {x.path: x for x in S.drone_frames(meta).collect()}
    assert np.allclose(got["0.jpg"].t, 0, atol=1e-6) and abs(got["1.jpg"].t.y - 111) < 1 and abs(got["1.jpg"].t.z - 20.5) < 0.1
    assert got["0.jpg"].weight == 0.2 and got["1.jpg"].weight == 0.6 and got["0.jpg"].q is None
    assert S.jpeg_metadata(jpeg(1, 1, below=True))["altitude"] == -100 and S.jpeg_metadata(b"no") == {}


def test_gimbal_looks_down(spark):
    r = spark.range(1).select(V.rotate(T.gimbal_rotation(F.lit(90.0), F.lit(-90.0), F.lit(0.0)), V.vec(0, 0, 1)).alias("d"), V.rotate(T.gimbal_rotation(F.lit(90.0), F.lit(0.0), F.lit(0.0)), V.vec(0, 0, 1)).alias("e")).first()
    assert np.allclose(r.d, [0, 0, -1], atol=1e-9) and np.allclose(r.e, [1, 0, 0], atol=1e-9)


def test_streams(spark, tmp_path):
    chunks = spark.createDataFrame([("d", 0, bytearray(b"$AB")), ("d", 1, bytearray(b"C*00\r\nx"))], "device string, seq long, data binary")
    chunks.coalesce(1).write.parquet(str(tmp_path / "c"))
    q = receivers.lines(spark.readStream.schema(chunks.schema).parquet(str(tmp_path / "c"))).writeStream.format("memory").queryName("lines").option("checkpointLocation", str(tmp_path / "k1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.line for r in spark.table("lines").collect()] == ["$ABC*00"]
    a = spark.sql("SELECT 'd' device, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) ts, id FROM range(5)")
    b = spark.sql("SELECT 'd' device, timestamp'2024-01-01 00:00:00.1' + make_interval(0,0,0,0,0,0,id) ts, id * 1.0D acc FROM range(4)")
    a.write.parquet(str(tmp_path / "a"))
    b.write.parquet(str(tmp_path / "b"))
    got = receivers.assemble_stream(spark.readStream.schema(a.schema).parquet(str(tmp_path / "a")), spark.readStream.schema(b.schema).parquet(str(tmp_path / "b")))
    q = got.writeStream.format("memory").queryName("fixes").option("checkpointLocation", str(tmp_path / "k2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.id, r.acc) for r in spark.table("fixes").collect() if r.acc is not None} == {(k, float(k)) for k in range(4)}


def test_receivers(spark):
    s = spark.createDataFrame([("1", "Emlid RS2", True, 1.0, -50), ("1", "", False, 5.0, -60), ("2", "lamp", False, 5.0, -10), ("3", None, True, 0.0, -5)], "id string, name string, serial boolean, seen double, signal int")
    m = receivers.merge_sightings(s)
    one = m.where("id = '1'").first()
    assert one.name == "Emlid RS2" and one.serial and one.seen == 5.0 and one.signal == -60
    assert {r.id for r in receivers.unexpired(m, 13.0).collect()} == {"1", "2"}
    assert [r.id for r in receivers.visible(m).collect()] == ["1", "3"]


def test_mounts_and_control(spark):
    t = spark.createDataFrame([("CAS;x",), ("STR;AUSTIN;Austin;RTCM 3;;;GPS;NET;USA;30.2;-97.7;;;;;B",), ("STR;BARE",), ("STR;HOUSTON;H;;;;;;USA;29.7;-95.4;;;;;N",), ("ENDSOURCETABLE",)], "value string")
    got = S.order_mounts(S.parse_ntrip(t), 29.8, -95.5).collect()
    assert [r.mount for r in got] == ["HOUSTON", "AUSTIN", "BARE"] and [r.needs_auth for r in got] == [False, True, False]
    c = S.parse_pnezd(spark.createDataFrame([("Point,N,E,Z,D",), ("1,100,200,5,CHK 1",), ("2,1,2",), ("3,7,8,9",)], "value string")).collect()
    assert [(r.id, r.easting, r.northing, r.role) for r in c] == [("1", 200, 100, "checkpoint"), ("3", 8, 7, "gcp")]


def test_joins_in_time(spark):
    left = spark.createDataFrame([("a", 1.0), ("a", 2.5), ("a", 9.0)], "k string, t double")
    right = spark.createDataFrame([("a", 1.0, 10.0), ("a", 3.0, 30.0)], "k string, t double, v double")
    assert [r.v for r in matching.as_of(left, right, "k", "t", ["v"]).orderBy("t").collect()] == [10, 10, 30]
    assert [r.v for r in matching.as_of(left, right, "k", "t", ["v"], 2.0).orderBy("t").collect()] == [10, 10, None]
    assert [r.v for r in matching.interpolate(left, right, "k", "t", "v").orderBy("t").collect()] == [10, 25, None]


def test_best_frame_and_incidence(spark):
    tri = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "tri int, x double, y double, z double").select("tri", V.vec(F.col("x"), F.col("y"), F.col("z")).alias("centre"), V.vec(0, 0, 1).alias("normal"))
    frames = spark.createDataFrame([(0, 0.0, 3.0), (1, 0.0, 2.0), (2, 0.0, 2.0), (3, 0.0, -1.0)], "frame int, x double, z double").select("frame", V.vec(F.col("x"), 0, F.col("z")).alias("eye"))
    assert matching.best_frame(tri, frames).first().frame == 1
    px = spark.range(9).select(F.lit("f").alias("frame"), (F.col("id") % 3).alias("px"), F.floor(F.col("id") / 3).alias("py")).withColumn("local", V.vec(F.col("px") * 0.01, F.col("py") * 0.01, 2.0))
    got = fusion.incidence_cosine(px).orderBy("py", "px").collect()
    assert got[0].incidence == pytest.approx(1.0) and got[8].incidence == 1.0


def test_splat_scene(spark):
    pts = spark.createDataFrame([(k, 0.05 * k, 0.0, 2.0, 0.5, 0.2, 0.9) for k in range(1, 8)], "id long, x double, y double, z double, r double, g double, b double")
    s = splats.from_points(pts, 0.1).cache()
    assert s.count() == 7
    pose = F.struct(V.vec(0, 0, 0).alias("t"), V.quat_identity().alias("q"))
    seen = splats.project(s, pose, 50, 50, 16, 16, 32, 32)
    image = splats.rasterize(seen.withColumn("opacity", F.lit(0.8)).withColumns({c: F.lit(v) for c, v in (("r", 0.5), ("g", 0.2), ("b", 0.9))}), 32, 32)
    assert seen.count() == 7 and image.count() > 10 and image.agg(F.max("r")).first()[0] <= 0.5 + 1e-9
    grown = splats.densify(s.withColumn("gradient", F.lit(1.0)), size=0.01)
    assert grown.count() == 14 and grown.select("id").distinct().count() == 14
    step = splats.adam(spark.createDataFrame([(1.0, 0.5, 0.0, 0.0)], "p double, g double, m double, v double"), "p", "g", "m", "v", 1, 0.1).first()
    assert step.p == pytest.approx(0.9)


def test_links(spark):
    rows = {"cap://p/abcdef01/P001": ("point", "abcdef01", "P001"), "cap://m/b7": ("model", "b7", None), "cap://p/xyz/P1": None, "other://m/b": None}
    for raw, want in rows.items():
        got = spark.range(1).select(T.link(F.lit(raw), "cap").alias("v")).first().v
        assert (tuple(got) if got else None) == want


def test_photo_folder(spark):
    rows = [("c.jpg", "X", 4000, 3000, 4.0, None), ("a.jpg", "X", 4000, 3000, 4.0, None), ("b.jpg", "Y", None, 3000, None, None), ("d.jpg", "X", 4000, 3000, 4.0, 28.0), ("e.jpg", None, 100, 50, None, None), ("f.jpg", None, 100, 50, None, None)]
    m = spark.createDataFrame(rows, "path string, model string, width int, height int, focal_mm double, focal35_mm double")
    m = m.withColumns({"exposure": F.lit(0.01), "iso": F.lit(100), "plane_resolution": F.lit(None).cast("double"), "plane_unit": F.lit(None).cast("int")})
    frames, cameras, warnings = S.photo_frames(m)
    assert [(r.id, r.t, r.image, r.camera, r.poseSource, r.iso) for r in frames.orderBy("id").collect()] == [
        ("000000", 0.0, "a.jpg", 0, "none", 100.0), ("000002", 2.0, "c.jpg", 0, "none", 100.0), ("000003", 3.0, "d.jpg", 1, "none", 100.0), ("000004", 4.0, "e.jpg", 2, "none", 100.0), ("000005", 5.0, "f.jpg", 2, "none", 100.0)]
    got = {r.camera: r for r in cameras.collect()}
    assert got[0].guessed and got[0].fx == 3400 and (got[0].cx, got[0].cy) == (1999.5, 1499.5) and got[2].fx == 85
    assert not got[1].guessed and abs(got[1].fx - 4000 * 28 / 36) < 1e-6
    assert [tuple(r) for r in warnings.collect()] == [("b.jpg", "no dimensions")]
