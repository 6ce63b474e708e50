"""Exports of point clouds, meshes and splats by format name.

PLY and LAS go through the data sources, a file for each task.  Formats whose
files have an index or a tree (E57, OBJ, GLB, FBX) are encoded by ``part``, a
column that says which rows make a file; a part is one task, so parts bound what
a task holds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.splats import sh_rest
from . import fbx, points, scans

FILES = "name string, content binary"


def save(files: DataFrame, path: str) -> None:
    """Writes files(name, content) into a folder, each in the task that has it."""
    system, root = points.filesystem(path)
    system.create_dir(root, recursive=True)

    def put(rows) -> None:
        system, root = points.filesystem(path)
        for r in rows:
            with system.open_output_stream(f"{root}/{r.name}", compression=None) as f:
                f.write(bytes(r.content))

    files.foreachPartition(put)


def _by_part(df: DataFrame, encode, suffix: str, name: str) -> DataFrame:
    def run(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"name": [f"{name}-{x['part'].iloc[0]}{suffix}"], "content": [encode(x)]})

    return df.groupBy("part").applyInPandas(run, FILES)


def _positions(x: pd.DataFrame) -> np.ndarray:
    return x[["x", "y", "z"]].to_numpy(float)


def export_points(cloud: DataFrame, kind: str, path: str, single: bool = False, name: str = "points") -> None:
    """cloud(x, y, z, optional red, green, blue; part for e57): kind is ply, las, e57 or obj."""
    points.register(cloud.sparkSession)
    colours = [c for c in ("red", "green", "blue") if c in cloud.columns]
    if kind == "ply":
        size = "float" if single else "double"
        cloud.select(*(F.col(c).cast(size).alias(c) for c in "xyz"), *(F.col(c).cast("short").alias(c) for c in colours)).write.format("ply").mode("append").save(path)
    elif kind == "las":
        cloud.select(*"xyz", *(F.col(c).alias(c[0]) for c in colours)).write.format("las").mode("append").save(path)
    elif kind == "obj":
        number = lambda c: F.format_string("%.6f", F.col(c).cast("double"))
        cloud.select(F.concat_ws(" ", F.lit("v"), *map(number, "xyz")).alias("value")).write.mode("append").text(path)
    elif kind == "e57":
        def encode(x: pd.DataFrame) -> bytes:
            scan = {"name": name, "positions": _positions(x)}
            if colours:
                scan["colors"] = x[colours].to_numpy(np.uint8)
            return scans.write_e57([scan], single=single)

        save(_by_part(cloud, encode, ".e57", name), path)
    else:
        raise ValueError(f"no point format {kind!r}: ply, las, e57 or obj")


def export_mesh(vertices: DataFrame, faces: DataFrame, kind: str, path: str, name: str = "mesh") -> None:
    """vertices(part, vid, x, y, z) and faces(part, fid, a, b, c): kind is ply, obj, glb or fbx; a file for each part."""

    def ply(p: np.ndarray, t: np.ndarray) -> bytes:
        head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(p)}\nproperty double x\nproperty double y\nproperty double z\nelement face {len(t)}\nproperty list uchar int vertex_indices\nend_header\n"
        rows = np.empty(len(t), np.dtype([("n", "u1"), ("t", "<i4", 3)]))
        rows["n"], rows["t"] = 3, t
        return head.encode() + p.astype("<f8").tobytes() + rows.tobytes()

    encoders = {"ply": ply, "obj": lambda p, t: points.write_obj(p, t).encode(), "glb": points.write_glb, "fbx": fbx.write_mesh}
    if kind not in encoders:
        raise ValueError(f"no mesh format {kind!r}: {', '.join(encoders)}")

    def run(v: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        v, f = v.sort_values("vid"), f.sort_values("f_fid")
        at = np.searchsorted(v["vid"].to_numpy(), f[["f_a", "f_b", "f_c"]].to_numpy().ravel()).reshape(-1, 3)
        return pd.DataFrame({"name": [f"{name}-{v['part'].iloc[0]}.{kind}"], "content": [encoders[kind](_positions(v), at)]}) if len(v) else pd.DataFrame({"name": [], "content": []})

    right = faces.select("part", "fid", "a", "b", "c").toDF("f_part", "f_fid", "f_a", "f_b", "f_c")
    save(vertices.groupBy("part").cogroup(right.groupBy("f_part")).applyInPandas(run, FILES), path)


def splat_columns(splats: DataFrame, degree: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of a splat PLY, in its order: normals of zero, higher bands channel by channel, the rotation's w first.

    splats: position, log_scale, rotation, logit, sh0_r, sh0_g, sh0_b and, above
    degree 0, ``rest``, coefficient by coefficient.
    """
    real = lambda c: c.cast("float")
    n = sh_rest(degree)
    cols = [real(F.col(f"position.{a}")).alias(a) for a in "xyz"] + [real(F.lit(0.0)).alias(f"n{a}") for a in "xyz"]
    cols += [real(F.col(f"sh0_{c}")).alias(f"f_dc_{k}") for k, c in enumerate("rgb")]
    cols += [real(F.get("rest", F.lit(3 * k + c))).alias(f"f_rest_{c * n + k}") for c in range(3) for k in range(n)]
    cols += [real(F.col("logit")).alias("opacity")] + [real(F.col(f"log_scale.{a}")).alias(f"scale_{k}") for k, a in enumerate("xyz")]
    return splats.select(*keep, *cols, *(real(F.col(f"rotation.{a}")).alias(f"rot_{k}") for k, a in enumerate("wxyz")))


def export_splats(splats: DataFrame, kind: str, path: str, degree: int = 0, name: str = "splats") -> None:
    """kind is ply, or glb (a file for each ``part``, with scales and opacities as they are drawn)."""
    if kind == "ply":
        points.register(splats.sparkSession)
        splat_columns(splats, degree).write.format("ply").mode("append").save(path)
        return
    if kind != "glb":
        raise ValueError(f"no splat format {kind!r}: ply or glb")
    n = sh_rest(degree)
    flat = splats.select("part", *(F.col(f"position.{a}").alias(a) for a in "xyz"), *(F.exp(F.col(f"log_scale.{a}")).alias(f"s{a}") for a in "xyz"), *(F.col(f"rotation.{a}").alias(f"q{a}") for a in "xyzw"), (1 / (1 + F.exp(-F.col("logit")))).alias("o"), *(F.col(f"sh0_{c}").alias(f"c0{c}") for c in "rgb"), *(F.get("rest", F.lit(k)).alias(f"h{k}") for k in range(3 * n)))

    def encode(x: pd.DataFrame) -> bytes:
        b, used = points.GlbBuilder(), "KHR_gaussian_splatting"
        put = lambda kind, *names, bounds=False: b.accessor(x[list(names)].to_numpy("<f4"), kind, 34962, bounds)
        at = {"POSITION": put("VEC3", "x", "y", "z", bounds=True), f"{used}:ROTATION": put("VEC4", "qx", "qy", "qz", "qw"), f"{used}:SCALE": put("VEC3", "sx", "sy", "sz"), f"{used}:OPACITY": put("SCALAR", "o")}
        at[f"{used}:SH_DEGREE_0_COEF_0"] = put("VEC3", "c0r", "c0g", "c0b")
        bands = [(d, i) for d in range(1, degree + 1) for i in range(2 * d + 1)]
        at |= {f"{used}:SH_DEGREE_{d}_COEF_{i}": put("VEC3", *(f"h{3 * k + c}" for c in range(3))) for k, (d, i) in enumerate(bands)}
        primitive = {"mode": 0, "attributes": at, "extensions": {used: {"kernel": "ellipse", "colorSpace": "srgb_rec709_display"}}}
        return b.finish({"extensionsUsed": [used], "extensionsRequired": [used], "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}], "meshes": [{"primitives": [primitive]}]})

    save(_by_part(flat, encode, ".glb", name), path)
