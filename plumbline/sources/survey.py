"""Survey and capture text: control lists, caster tables, COLMAP, bundles, JPEG metadata."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import camera as C
from ..functions import text as T

FRAME = f"id string, t double, image string, camera int, pose struct<t:array<double>,q:array<double>>, poseSource string, poseWeight double, depth struct<uri:string,width:int,height:int,encoding:string,confidenceUri:string,minRange:double,maxRange:double,camera:{C.SCHEMA}>, exposure double, iso double, blur double, gnss struct<t:double,lat:double,lon:double,height:double,quality:int>"
GNSS = "t double, lat double, lon double, height double, orthometricHeight double, geoidSeparation double, quality int, satellites int, hdop double, hAccuracy double, vAccuracy double, leverArm array<double>"
IMU = "t double, gyro array<double>, accel array<double>, mag array<double>"
CONTROL = "id string, project array<double>, observed array<double>, role string, description string, sigma double"
MANIFEST = f"formatVersion int, name string, startedAt string, frameCount long, notes string, cameras array<{C.SCHEMA}>, crs struct<code:string,name:string,unit:string,metresPerUnit:double,origin:array<double>>"


def parse_pnezd(lines: DataFrame, column: str = "value") -> DataFrame:
    """(id, easting, northing, elevation, role, description) of point, northing, easting, elevation, description.

    Headers, short rows and rows without numbers go.
    """
    p = F.split(F.col(column), ",")
    at = lambda k: F.trim(F.get(p, F.lit(k)))
    note = F.coalesce(at(4), F.lit(""))
    check = F.upper(F.get(F.split(note, r"[\s_-]+"), F.lit(0))).isin("CHK", "CHECK", "CP")
    got = lines.select(at(0).alias("id"), T.number(at(2)).alias("easting"), T.number(at(1)).alias("northing"), T.number(at(3)).alias("elevation"), F.when(check, "checkpoint").otherwise("gcp").alias("role"), note.alias("description"))
    return got.where("id <> '' and easting is not null and northing is not null and elevation is not null")


def parse_ntrip(lines: DataFrame, column: str = "value") -> DataFrame:
    """Streams of a caster's table; every field beyond the mount point may be missing."""
    p = F.split(F.col(column), ";")
    at = lambda k: F.nullif(F.trim(F.get(p, F.lit(k))), F.lit(""))
    auth = F.coalesce(~F.upper(at(15)).isin("N"), F.lit(False))
    return lines.where(F.col(column).startswith("STR;")).select(at(1).alias("mount"), at(2).alias("identifier"), at(3).alias("format"), at(6).alias("systems"), at(8).alias("country"), T.number(at(9)).alias("lat"), T.number(at(10)).alias("lon"), auth.alias("needs_auth")).where("mount is not null")


def order_mounts(mounts: DataFrame, lat: float, lon: float) -> DataFrame:
    from ..functions.geodesy import haversine

    d = haversine(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon))
    return mounts.withColumn("distance", d).orderBy(F.asc_nulls_last("distance"), "mount")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Good rows only: a line cut short costs itself alone."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def lost_lines(spark: SparkSession, path: str, schema: str) -> int:
    """Lines that are no rows of the schema."""
    lines = spark.read.schema(schema + ", _corrupt_record string").json(path).cache()  # Spark doesn't answer for that column alone
    try:
        return lines.where("_corrupt_record is not null").count()
    finally:
        lines.unpersist()


def read_bundle(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of a capture bundle.  frameCount is what the frames are, not what the manifest says."""
    manifest = spark.read.schema(MANIFEST).option("multiLine", True).json(f"{root}/manifest.json")
    frames = read_jsonl(spark, f"{root}/frames.jsonl", FRAME)
    count = frames.agg(F.count(F.lit(1)).alias("frames"))
    out = {"captures": manifest.drop("frameCount").crossJoin(F.broadcast(count)).withColumnRenamed("frames", "frameCount"), "frames": frames}
    from .points import filesystem

    system, base = filesystem(root)
    for name, schema, kind in (("gnss", GNSS, "gnss.jsonl"), ("imu", IMU, "imu.jsonl"), ("control", CONTROL, "control.json")):
        if system.get_file_info(f"{base}/{kind}").is_file:
            out[name] = read_jsonl(spark, f"{root}/{kind}", schema) if kind.endswith("l") else spark.read.schema(schema).option("multiLine", True).json(f"{root}/{kind}")
    return out


def posed(frames: DataFrame) -> DataFrame:
    """Frames with a pose, unless its source is given as none."""
    return frames.where("pose is not null and not (poseSource <=> 'none')")


def with_depth(frames: DataFrame) -> DataFrame:
    return frames.where("depth is not null")


def frame_cameras(frames: DataFrame, captures: DataFrame) -> DataFrame:
    """Frames with the camera that their number points at."""
    cameras = captures.select(F.posexplode("cameras").alias("camera", "intrinsics"))
    return frames.join(F.broadcast(cameras), "camera", "left")  # a handful of cameras for a capture


# How depth rasters are encoded, and what makes metres of them.
_DEPTH = {"uint16-mm": ("<u2", 1e-3), "float32-m": ("<f4", 1.0)}


def _measured(content: bytes, width: int, height: int, encoding: str) -> tuple[np.ndarray, np.ndarray]:
    """The places of a raster's measured pixels and their depth in metres; zero is no measurement."""
    kind, metres = _DEPTH[encoding]
    raw = np.frombuffer(content, kind, min(width * height, len(content) // np.dtype(kind).itemsize))
    if len(raw) < width * height:
        raise ValueError("ends early")
    d = raw.astype(float) * metres
    at = np.flatnonzero(d > 0)
    return at, d[at]


def decode_depth(rasters: DataFrame) -> DataFrame:
    """(frame, px, py, d, conf) of rasters(frame, width, height, encoding, content, confidence): unmeasured pixels go.

    uint16-mm is little endian millimetres, float32-m metres.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for r in x.itertuples():
                try:
                    at, d = _measured(r.content, r.width, r.height, r.encoding)
                except ValueError as e:
                    raise ValueError(f"depth of frame {r.frame} {e}") from e
                conf = np.frombuffer(r.confidence, np.uint8)[at].astype(int) if r.confidence is not None else pd.array([None] * len(at), "Int32")
                yield pd.DataFrame({"frame": r.frame, "px": at % r.width, "py": at // r.width, "d": d, "conf": conf})

    return rasters.mapInPandas(run, "frame string, px int, py int, d double, conf int")


def sound_rasters(frames: DataFrame, root: str) -> DataFrame:
    """Adds ``sound``: whether the rasters of a frame's ``depth`` are there, long enough and of a known encoding.

    Files are asked for their size only.
    """
    from .points import filesystem

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(root)
        for b in batches:
            depth = b.column("depth").to_pylist()
            need = []
            for k, d in enumerate(depth):
                if d and d["encoding"] in _DEPTH and d["uri"]:
                    pixels = d["width"] * d["height"]
                    need.append((k, d["uri"], pixels * np.dtype(_DEPTH[d["encoding"]][0]).itemsize))
                    if d["confidenceUri"]:
                        need.append((k, d["confidenceUri"], pixels))
            sound = np.zeros(len(depth), bool)
            sound[[k for k, _, _ in need]] = True
            infos = system.get_file_info([f"{base}/{uri}" for _, uri, _ in need]) if need else []
            for (k, _, size), info in zip(need, infos, strict=True):
                sound[k] &= info.is_file and info.size >= size
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sound)], [*b.schema.names, "sound"])

    return frames.mapInArrow(run, _with(frames, "sound boolean"))


def _with(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), more])


def depth_pixels(frames: DataFrame, root: str) -> DataFrame:
    """The frames' own columns without ``depth``, and px, py, d and conf of every measured pixel.

    A task reads the rasters of its frames one by one; each goes on as one row
    of arrays, so poses and cameras are sent once a frame and not once a pixel.
    """
    from .points import filesystem

    own = frames.select("*", F.col("depth").alias("raster")).drop("depth")
    keep = [c for c in own.columns if c != "raster"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(root)

        def read(uri: str) -> bytes:
            with system.open_input_stream(f"{base}/{uri}", compression=None) as f:
                return f.read()

        for b in batches:
            for k, d in enumerate(b.column("raster").to_pylist()):
                at, depth = _measured(read(d["uri"]), d["width"], d["height"], d["encoding"])
                conf = pa.array(np.frombuffer(read(d["confidenceUri"]), np.uint8)[at].astype(np.int32)) if d["confidenceUri"] else pa.nulls(len(at), pa.int32())
                ends = pa.array([0, len(at)], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array((at % d["width"]).astype(np.int32)), pa.array((at // d["width"]).astype(np.int32)), pa.array(depth), conf)]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(k, 1) for c in keep), *lists], [*keep, "px", "py", "d", "conf"])

    got = own.mapInArrow(run, _with(own.drop("raster"), "px array<int>, py array<int>, d array<double>, conf array<int>"))
    return got.select(*keep, F.inline(F.arrays_zip("px", "py", "d", "conf")))


def encode_depth(depth: Column) -> Column:
    """Metres to millimetres of sixteen bits; what doesn't fit is 0, no measurement."""
    good = (depth > 0) & (depth < 65.5) & ~F.isnan(depth)
    return F.when(good, F.floor(depth * 1000).cast("int")).otherwise(0)


def zip_entries(files: DataFrame) -> DataFrame:
    """(path, name, content) of archives(path, content); a single leading folder is taken off names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for path, data in zip(x["path"], x["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    names = [i for i in z.infolist() if not i.is_dir()]
                    bad = [i.filename for i in names if i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED)]
                    if bad:
                        raise ValueError(f"compression of {bad[0]} in {path} isn't read")
                    tops = {i.filename.split("/", 1)[0] for i in names if "/" in i.filename}
                    strip = len(tops) == 1 and all("/" in i.filename for i in names)
                    for i in names:
                        yield pd.DataFrame([[path, i.filename.split("/", 1)[1] if strip else i.filename, z.read(i)]], columns=["path", "name", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, name string, content binary")


# COLMAP camera models and the names of their parameters.
COLMAP_MODELS = {"SIMPLE_PINHOLE": "f cx cy", "PINHOLE": "fx fy cx cy", "SIMPLE_RADIAL": "f cx cy k1", "RADIAL": "f cx cy k1 k2", "OPENCV": "fx fy cx cy k1 k2 p1 p2", "OPENCV_FISHEYE": "fx fy cx cy k1 k2 k3 k4"}


def colmap_cameras(lines: DataFrame) -> DataFrame:
    """(camera, model, width, height, fx ..); models that aren't known have a null model."""
    p = F.split(F.trim("value"), r"\s+")
    at = lambda k: F.get(p, F.lit(k))
    kind = at(1)
    columns = {}
    for want in ("fx", "fy", "cx", "cy", "k1", "k2", "k3", "k4", "p1", "p2"):
        c = F.lit(None).cast("double")
        for model, names in COLMAP_MODELS.items():
            names = names.split()
            source = want if want in names else "f" if want in ("fx", "fy") and "f" in names else None
            if source:
                c = F.when(kind == model, T.number(at(4 + names.index(source)))).otherwise(c)
        columns[want] = c
    known = F.when(kind == "OPENCV_FISHEYE", "fisheye").when(kind.isin(*COLMAP_MODELS), "pinhole")
    rows = lines.where("trim(value) <> '' and not startswith(trim(value), '#')")
    return rows.select(at(0).cast("int").alias("camera"), known.alias("model"), at(2).cast("int").alias("width"), at(3).cast("int").alias("height"), *(c.alias(n) for n, c in columns.items()))


def colmap_images(lines: DataFrame) -> DataFrame:
    """(image, name, camera, t, q): camera-to-world poses of the world-to-camera lines.

    Only the lines of an image's own have ten fields of that shape; the others
    hold its points.
    """
    from ..functions import vectors as V

    p = F.split(F.trim("value"), r"\s+")
    n = lambda k: F.get(p, F.lit(k)).try_cast("double")
    rows = lines.where(F.col("value").rlike(r"^\s*\d+(\s+[-+0-9.eE]+){7}\s+\d+\s+\S*[A-Za-z_./]\S*\s*$"))
    q = V.quat_normalize(V.quat_conjugate(V.quat(n(2), n(3), n(4), n(1))))
    t = V.negate(V.rotate(q, V.vec(n(5), n(6), n(7))))
    return rows.select(F.get(p, F.lit(0)).cast("int").alias("image"), F.get(p, F.lit(9)).alias("name"), F.get(p, F.lit(8)).cast("int").alias("camera"), t.alias("t"), q.alias("q"))


def import_colmap(spark: SparkSession, cameras: str, images: str) -> tuple[DataFrame, DataFrame]:
    """(frames, warnings): images whose camera is missing or of an unknown model go to the warnings."""
    cams = colmap_cameras(spark.read.text(cameras))
    imgs = colmap_images(spark.read.text(images))
    good = cams.where("model is not null")
    return imgs.join(good, "camera"), imgs.join(good, "camera", "left_anti").select("image", "name", "camera")


def export_colmap(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(camera lines, image lines) of posed frames(id, name, camera, model, width .., t, q)."""
    from ..functions import vectors as V

    ok = frames.where("t is not null and q is not null and model in ('pinhole', 'fisheye')")
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("string")
    kind = F.when(F.col("model") == "fisheye", "OPENCV_FISHEYE").otherwise("OPENCV")
    tail = F.when(F.col("model") == "fisheye", F.concat_ws(" ", *map(number, ("k1", "k2", "k3", "k4")))).otherwise(F.concat_ws(" ", *map(number, ("k1", "k2", "p1", "p2"))))
    cams = ok.select(F.concat_ws(" ", "camera", kind, "width", "height", *map(number, ("fx", "fy", "cx", "cy")), tail).alias("value")).distinct()
    inv = V.quat_conjugate(F.col("q"))
    w = ok.withColumn("_q", inv).withColumn("_t", V.negate(V.rotate(F.col("_q"), F.col("t"))))
    lines = w.select(F.concat_ws(" ", "id", *(F.col(f"_q.{a}").cast("string") for a in "wxyz"), *(F.col(f"_t.{a}").cast("string") for a in "xyz"), "camera", "name").alias("value"))
    return cams, lines


# Sizes of TIFF types, and the tags that are read.
_TIFF = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d")}
EXIF = "make string, model string, width int, height int, taken string, focal_mm double, focal35_mm double, lat double, lon double, altitude double, xmp string, exposure double, iso int, plane_resolution double, plane_unit int"


def _ifd(data: bytes, order: str, at: int) -> dict[int, object]:
    out = {}
    (n,) = struct.unpack_from(order + "H", data, at)
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in _TIFF:
            continue
        size, code = _TIFF[kind]
        place = at + 2 + 12 * k + 8
        if size * count > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        if kind == 2:
            out[tag] = data[place : place + count].split(b"\0")[0].decode("latin-1").strip()
        elif kind in (5, 10):
            v = struct.unpack_from(order + code[0] * 2 * count, data, place)
            out[tag] = [a / b if b else 0.0 for a, b in zip(v[::2], v[1::2], strict=True)]
        else:
            out[tag] = list(struct.unpack_from(order + code[0] * count, data, place))
    return out


def jpeg_metadata(data: bytes) -> dict:
    """EXIF and XMP of a JPEG; one that is broken doesn't lose the other."""
    out: dict = {}
    at, xmp, exif = 2, "", None
    if data[:2] != b"\xff\xd8":
        return out
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if data[at + 1] == 0xE1 and body.startswith(b"Exif\0\0"):
            exif = body[6:]
        elif data[at + 1] == 0xE1 and body.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
            xmp += body.split(b"\0", 1)[1].decode("utf-8", "replace")
        elif data[at + 1] == 0xE1 and body.startswith(b"http://ns.adobe.com/xmp/extension/\0"):
            xmp += body.split(b"\0", 1)[1][40:].decode("utf-8", "replace")
        at += 2 + size
    out["xmp"] = xmp or None
    if exif:
        try:
            order = "<" if exif[:2] == b"II" else ">"
            top = _ifd(exif, order, struct.unpack_from(order + "I", exif, 4)[0])
            sub = _ifd(exif, order, top[0x8769][0]) if 0x8769 in top else {}
            gps = _ifd(exif, order, top[0x8825][0]) if 0x8825 in top else {}
            first = lambda d, t: d[t][0] if d.get(t) else None
            out |= {"make": top.get(0x010F), "model": top.get(0x0110), "width": first(sub, 0xA002), "height": first(sub, 0xA003), "focal_mm": first(sub, 0x920A), "focal35_mm": first(sub, 0xA405)}
            out |= {"exposure": first(sub, 0x829A), "iso": first(sub, 0x8827), "plane_resolution": first(sub, 0xA20E), "plane_unit": first(sub, 0xA210)}
            when = re.match(r"(\d{4}):(\d\d):(\d\d) (\d\d:\d\d:\d\d)", sub.get(0x9003) or top.get(0x0132) or "")
            out["taken"] = f"{when[1]}-{when[2]}-{when[3]}T{when[4]}" if when else None
            dms = lambda v: sum(x / 60**k for k, x in enumerate(v))
            if 2 in gps and 4 in gps:
                out["lat"] = dms(gps[2]) * (-1 if gps.get(1) == "S" else 1)
                out["lon"] = dms(gps[4]) * (-1 if gps.get(3) == "W" else 1)
            if 6 in gps:
                out["altitude"] = gps[6][0] * (-1 if gps.get(5) in ([1], "\x01") else 1)
        except (struct.error, KeyError, IndexError, TypeError):
            pass
    return out


def image_metadata(files: DataFrame) -> DataFrame:
    """files(path, content) with the columns of ``EXIF``."""
    names = [c.split()[0] for c in EXIF.split(", ")]

    @F.pandas_udf(EXIF)
    def run(content: pd.Series) -> pd.DataFrame:
        got = pd.DataFrame([jpeg_metadata(c) for c in content], columns=names).astype(object)
        return got.where(got.notna(), None)

    return files.select("path", run("content").alias("m")).select("path", "m.*")


def drone_frames(metadata: DataFrame) -> DataFrame:
    """Frames of geotagged images: local east-north-up positions from the first, gimbal rotations, weights by fix.

    The first image in the order of its time and path is the origin.
    """
    from ..functions import geodesy as G

    m = metadata.where("lat is not null and lon is not null").withColumn("a", T.drone_attitude(F.coalesce("xmp", F.lit(""))))
    m = m.withColumn("h", F.coalesce("a.absolute_altitude", "altitude", F.lit(0.0)))
    origin = m.agg(F.min_by(F.struct("lat", "lon", "h"), F.struct(F.coalesce("taken", F.lit("")), "path")).alias("o"))
    got = m.crossJoin(F.broadcast(origin))  # one row
    enu = G.geodetic_to_enu(F.col("lat"), F.col("lon"), F.col("h"), F.col("o.lat"), F.col("o.lon"), F.col("o.h"))
    angle = lambda n: F.coalesce(F.col(f"a.{n}"), F.lit(0.0))
    q = F.when(F.col("a.gimbal_yaw").isNotNull(), T.gimbal_rotation(angle("gimbal_yaw"), angle("gimbal_pitch"), angle("gimbal_roll")))
    return got.select("path", "taken", enu.alias("t"), q.alias("q"), F.when(F.col("a.rtk"), 0.6).otherwise(0.2).alias("weight"))


def photo_frames(metadata: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, cameras, warnings) of image_metadata: a folder of photographs without poses.

    Frames are numbered in the order of their paths, which is their time too.
    Photographs of the same model, size and focal length share a camera; a focal
    length that isn't known is taken as 0.85 widths, and marked in ``guessed``.
    An image without dimensions goes to the warnings and keeps its number.
    """
    from ..operators.mesh import row_numbers

    width = F.col("width")
    sensor = C.sensor_width(F.col("plane_resolution"), F.col("plane_unit"), width, F.col("focal_mm"), F.col("focal35_mm"), F.coalesce("model", F.lit("")))
    m = row_numbers(metadata, ["path"], "number").withColumn("focal", C.focal_pixels(width, F.col("focal_mm"), sensor, F.col("focal35_mm")))
    sized = F.coalesce((width > 0) & (F.col("height") > 0), F.lit(False))
    key = ["model", "width", "height", "focal"]
    kinds = row_numbers(m.where(sized).groupBy(*key).agg(F.min("number").alias("first")), ["first"], "camera")
    same = F.lit(True)
    for c in key:
        same &= F.col(f"m.{c}").eqNullSafe(F.col(f"k.{c}"))
    frames = m.where(sized).alias("m").join(kinds.alias("k"), same)
    frames = frames.select(F.lpad(F.col("number").cast("string"), 6, "0").alias("id"), F.col("number").cast("double").alias("t"), F.col("path").alias("image"), F.col("camera").cast("int").alias("camera"), F.lit("none").alias("poseSource"), "exposure", F.col("iso").cast("double").alias("iso"))
    f = F.coalesce("focal", width * 0.85)
    cameras = kinds.select(F.col("camera").cast("int").alias("camera"), F.lit("pinhole").alias("model"), "width", "height", f.alias("fx"), f.alias("fy"), ((width - 1) / 2).alias("cx"), ((F.col("height") - 1) / 2).alias("cy"), F.isnull("focal").alias("guessed"))
    return frames, cameras, m.where(~sized).select("path", F.lit("no dimensions").alias("reason"))


def cube_faces(panoramas: DataFrame) -> DataFrame:
    """Six frames for each panorama, each looking along one axis."""
    faces = [("front", 0.0, 0.0), ("right", 90.0, 0.0), ("back", 180.0, 0.0), ("left", -90.0, 0.0), ("up", 0.0, 90.0), ("down", 0.0, -90.0)]
    dim = panoramas.sparkSession.createDataFrame(faces, "face string, yaw double, pitch double")
    return panoramas.crossJoin(F.broadcast(dim))  # six rows


def warn_aspect(panoramas: DataFrame) -> DataFrame:
    return panoramas.where("abs(width / (2.0 * height) - 1) > 0.01").select("path", "width", "height")


def recover_capture(frames: DataFrame) -> DataFrame:
    """What a lost manifest held, from the frames that are left."""
    return frames.agg(F.count(F.lit(1)).alias("frameCount"), (F.coalesce(F.max("camera"), F.lit(-1)) + 1).alias("cameras"), F.min("t").alias("first"), F.max("t").alias("last"))
