"""Camera models as Column expressions: pinhole with distortion, fisheye, equirect.

A camera is a struct with model, width, height, fx, fy, cx, cy, k1..k4, p1, p2,
hfov and vfov (radians).  Camera space has x right, y down and z forward.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectors as V

SCHEMA = "struct<model:string,width:int,height:int,fx:double,fy:double,cx:double,cy:double,k1:double,k2:double,k3:double,k4:double,p1:double,p2:double,hfov:double,vfov:double>"


def _or_zero(camera: Column, name: str) -> Column:
    return F.coalesce(camera[name], F.lit(0.0))


def distort(x: Column, y: Column, camera: Column) -> tuple[Column, Column]:
    """Brown-Conrady, forward, on normalised coordinates."""
    k1, k2, k3, p1, p2 = (_or_zero(camera, n) for n in ("k1", "k2", "k3", "p1", "p2"))
    r2 = x * x + y * y
    radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
    return x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y


def undistort(x: Column, y: Column, camera: Column, steps: int = 20) -> Column:
    """struct(x, y): fixed-point inversion of ``distort``."""
    k1, k2, k3, p1, p2 = (_or_zero(camera, n) for n in ("k1", "k2", "k3", "p1", "p2"))

    def again(s: Column, _: Column) -> Column:
        r2 = s["x"] * s["x"] + s["y"] * s["y"]
        radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
        dx = 2 * p1 * s["x"] * s["y"] + p2 * (r2 + 2 * s["x"] * s["x"])
        dy = p1 * (r2 + 2 * s["y"] * s["y"]) + 2 * p2 * s["x"] * s["y"]
        return F.struct(((x - dx) / radial).alias("x"), ((y - dy) / radial).alias("y"))

    start = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    plain = (k1 == 0) & (k2 == 0) & (k3 == 0) & (p1 == 0) & (p2 == 0)
    return F.when(plain, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, again))


def project_point(p: Column, camera: Column) -> Column:
    """struct(x, y, visible) of a point in camera space."""
    x, y, z = V.parts(p)
    front = z > 1e-9
    safe = F.when(front, z)
    dx, dy = distort(x / safe, y / safe, camera)
    r = F.hypot(x, y)
    theta = F.atan2(r, z)
    t2 = theta * theta
    k = [_or_zero(camera, n) for n in ("k1", "k2", "k3", "k4")]
    bent = theta * (1 + t2 * (k[0] + t2 * (k[1] + t2 * (k[2] + t2 * k[3]))))
    ratio = F.when(r > 1e-12, bent / F.when(r > 1e-12, r)).otherwise(0.0)
    n = V.length(p)
    lon, lat = F.atan2(x, z), F.asin(V.clamp(y / F.when(n > 0, n), -1.0, 1.0))
    hfov, vfov = F.coalesce(camera["hfov"], F.lit(2 * math.pi)), F.coalesce(camera["vfov"], F.lit(math.pi))
    model = camera["model"]
    u = F.when(model == "fisheye", camera["fx"] * x * ratio + camera["cx"]).when(model == "equirect", (lon / hfov + 0.5) * camera["width"]).otherwise(camera["fx"] * dx + camera["cx"])
    v = F.when(model == "fisheye", camera["fy"] * y * ratio + camera["cy"]).when(model == "equirect", (lat / vfov + 0.5) * camera["height"]).otherwise(camera["fy"] * dy + camera["cy"])
    seen = F.when(model == "pinhole", front).when(model == "equirect", n > 1e-9).otherwise(n > 1e-9)
    seen &= (u >= 0) & (u < camera["width"]) & (v >= 0) & (v < camera["height"])
    return F.struct(u.alias("x"), v.alias("y"), F.coalesce(seen, F.lit(False)).alias("visible"))


def pixel_to_ray(x: Column, y: Column, camera: Column) -> Column:
    """The unit ray of a pixel in camera space."""
    n = undistort((x - camera["cx"]) / camera["fx"], (y - camera["cy"]) / camera["fy"], camera)
    pinhole = V.once(n, lambda m: V.normalize(V.vec(m["x"], m["y"], 1.0)))
    mx, my = (x - camera["cx"]) / camera["fx"], (y - camera["cy"]) / camera["fy"]
    rd = F.hypot(mx, my)
    k = [_or_zero(camera, n) for n in ("k1", "k2", "k3", "k4")]

    def newton(t: Column, _: Column) -> Column:
        t2 = t * t
        value = t * (1 + t2 * (k[0] + t2 * (k[1] + t2 * (k[2] + t2 * k[3])))) - rd
        slope = 1 + t2 * (3 * k[0] + t2 * (5 * k[1] + t2 * (7 * k[2] + t2 * 9 * k[3])))
        return t - value / F.when(F.abs(slope) > 1e-12, slope).otherwise(1.0)

    theta = F.aggregate(F.sequence(F.lit(1), F.lit(20)), rd, newton)

    def bent(t: Column) -> Column:
        side = F.when(rd > 1e-12, F.sin(t) / F.when(rd > 1e-12, rd)).otherwise(0.0)
        return V.vec(mx * side, my * side, F.cos(t))

    fisheye = V.once(theta, bent)
    lon = (x / camera["width"] - 0.5) * F.coalesce(camera["hfov"], F.lit(2 * math.pi))
    lat = (y / camera["height"] - 0.5) * F.coalesce(camera["vfov"], F.lit(math.pi))
    equirect = V.vec(F.sin(lon) * F.cos(lat), F.sin(lat), F.cos(lon) * F.cos(lat))
    return F.when(camera["model"] == "fisheye", fisheye).when(camera["model"] == "equirect", equirect).otherwise(pinhole)


def unproject_pixel(x: Column, y: Column, depth: Column, camera: Column) -> Column:
    """Depth runs along the axis for a pinhole, and along the ray otherwise."""
    return V.once(pixel_to_ray(x, y, camera), lambda ray: V.scale(ray, F.when(camera["model"] == "pinhole", depth / ray["z"]).otherwise(depth)))


def depth_for_model(p: Column, camera: Column) -> Column:
    return F.when(camera["model"] == "pinhole", p["z"]).otherwise(V.length(p))


def world_to_camera(p: Column, pose: Column) -> Column:
    return V.rotate(V.quat_conjugate(pose["q"]), V.sub(p, pose["t"]))


def camera_to_world(p: Column, pose: Column) -> Column:
    return V.add(V.rotate(pose["q"], p), pose["t"])


def project_world(p: Column, pose: Column, camera: Column) -> Column:
    return project_point(world_to_camera(p, pose), camera)


def unproject_world(x: Column, y: Column, depth: Column, pose: Column, camera: Column) -> Column:
    return camera_to_world(unproject_pixel(x, y, depth, camera), pose)


def is_visible(p: Column, pose: Column, camera: Column) -> Column:
    return project_world(p, pose, camera)["visible"]


def field_of_view(camera: Column) -> Column:
    """struct(horizontal, vertical), radians."""
    wide = F.when(camera["model"] == "equirect", F.coalesce(camera["hfov"], F.lit(2 * math.pi))).when(camera["model"] == "fisheye", camera["width"] / camera["fx"]).otherwise(2 * F.atan(camera["width"] / (2 * camera["fx"])))
    high = F.when(camera["model"] == "equirect", F.coalesce(camera["vfov"], F.lit(math.pi))).when(camera["model"] == "fisheye", camera["height"] / camera["fy"]).otherwise(2 * F.atan(camera["height"] / (2 * camera["fy"])))
    return F.struct(wide.alias("horizontal"), high.alias("vertical"))


def resize(camera: Column, width: int, height: int) -> Column:
    """The camera of a resized image; the principal point keeps its place between pixel centres."""
    sx, sy = F.lit(float(width)) / camera["width"], F.lit(float(height)) / camera["height"]
    return camera.withField("width", F.lit(width)).withField("height", F.lit(height)).withField("fx", camera["fx"] * sx).withField("fy", camera["fy"] * sy).withField("cx", (camera["cx"] + 0.5) * sx - 0.5).withField("cy", (camera["cy"] + 0.5) * sy - 0.5)


def focal_scale(camera: Column) -> Column:
    return F.when(camera["model"] == "equirect", camera["width"] / (2 * math.pi)).otherwise((camera["fx"] + camera["fy"]) / 2)


def focal_pixels(width: Column, focal_mm: Column, sensor_mm: Column, focal35_mm: Column) -> Column:
    """Focal length in pixels, or null: it is never guessed."""
    given = F.when((focal_mm > 0) & (sensor_mm > 0), focal_mm / F.when(sensor_mm > 0, sensor_mm) * width)
    return F.coalesce(given, F.when(focal35_mm > 0, focal35_mm / 36.0 * width))


def gray(r: Column, g: Column, b: Column) -> Column:
    """BT.601 luma as an integer."""
    return F.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5).cast("int")


# Sensor widths (mm) by what a camera's model name contains, in order of trial.
SENSOR_WIDTHS = (("FC220", 6.16), ("FC330", 6.17), ("FC6310", 13.2), ("FC6360", 13.2), ("FC3170", 6.16), ("FC3411", 17.3), ("FC7303", 6.4), ("L1D-20C", 13.2), ("M3M", 17.3), ("M3E", 17.3), ("ZENMUSE P1", 35.9), ("ZENMUSE L2", 17.3))


def sensor_width(resolution: Column, unit: Column, image_width: Column, focal_mm: Column, focal35_mm: Column, model: Column) -> Column:
    """Sensor width (mm) from the focal plane's resolution, else the crop factor, else the model's name; else null."""
    scale = F.when(unit == 3, 10.0).when(unit == 4, 1.0).otherwise(25.4)
    by_plane = image_width / F.when(resolution > 0, resolution) * scale
    crop = F.when(focal35_mm > 0, focal35_mm) / F.when(focal_mm != 0, focal_mm)
    by_name = F.lit(None).cast("double")
    for part, width in reversed(SENSOR_WIDTHS):
        by_name = F.when(F.contains(F.upper(model), F.lit(part)), F.lit(width)).otherwise(by_name)
    return F.coalesce(F.when((by_plane > 1) & (by_plane < 100), by_plane), F.when((crop > 0.5) & (crop < 20), 36 / crop), by_name)
