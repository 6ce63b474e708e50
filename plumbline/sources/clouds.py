"""PLY files as what they hold: point clouds and splats, with the spellings that are about."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import splats
from . import points

# Spellings of a cloud's properties, in order of trial.
SPELLINGS = {"r": ("red", "r", "diffuse_red"), "g": ("green", "g", "diffuse_green"), "b": ("blue", "b", "diffuse_blue"), "intensity": ("intensity", "scalar_Intensity", "reflectance")}


def origin(path: str) -> list[float] | None:
    """What the files' comments say was taken off their coordinates (a word, ``origin`` and three numbers); files that differ are an error."""
    reader = points.PlyReader({"path": path})
    found = set()
    for name in points.files(path, ".ply"):
        own = None
        for c in reader.header(name).comments:
            if m := re.fullmatch(r"\S+ origin (\S+) (\S+) (\S+)", c):
                own = tuple(map(float, m.groups()))
        found.add(own)
    if len(found) > 1:
        raise ValueError("the files have different origins; read them one by one")
    return list(found.pop()) if found and None not in found else None


def _read(spark: SparkSession, path: str) -> DataFrame:
    points.register(spark)
    return spark.read.format("ply").load(path)


def read_cloud(spark: SparkSession, path: str) -> tuple[DataFrame, list[float] | None]:
    """((x, y, z[, r, g, b][, nx, ny, nz][, intensity]), origin) of PLY point clouds.

    Colours are there if all three are, as whole numbers; normals likewise.
    Coordinates stay as they are: add the origin for those of the world.
    """
    df = _read(spark, path)
    have = set(df.columns)
    if not {"x", "y", "z"} <= have:
        raise ValueError("the vertex element has no x, y and z")
    of = {k: next((n for n in names if n in have), None) for k, names in SPELLINGS.items()}
    out = [F.col(c).cast("double").alias(c) for c in "xyz"]
    if all(of[c] for c in "rgb"):
        out += [F.col(of[c]).cast("int").alias(c) for c in "rgb"]
    if {"nx", "ny", "nz"} <= have:
        out += [F.col(c).cast("float").alias(c) for c in ("nx", "ny", "nz")]
    if of["intensity"]:
        out.append(F.col(of["intensity"]).cast("float").alias("intensity"))
    return df.select(*out), origin(path)


def read_splats(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """((position, log_scale, rotation, logit, sh0_r, sh0_g, sh0_b[, rest]), degree) of PLY splats.

    The degree follows from the number of higher coefficients, which lie channel
    by channel in the file and coefficient by coefficient in ``rest``; the file's
    rotations have w first.
    """
    df = _read(spark, path)
    need = ["x", "y", "z", *(f"f_dc_{k}" for k in range(3)), "opacity", *(f"scale_{k}" for k in range(3)), *(f"rot_{k}" for k in range(4))]
    if missing := [n for n in need if n not in df.columns]:
        raise ValueError(f"no splats: property {missing[0]} is missing")
    count = 0
    while f"f_rest_{count}" in df.columns:
        count += 1
    degree = next((d for d in range(4) if 3 * splats.sh_rest(d) == count), None)
    if degree is None:
        raise ValueError(f"{count} higher coefficients are no whole degree")
    real = lambda n: F.col(n).cast("double")
    out = [V.vec(*map(real, "xyz")).alias("position"), V.vec(*(real(f"scale_{k}") for k in range(3))).alias("log_scale"), V.quat(*(real(f"rot_{k}") for k in (1, 2, 3, 0))).alias("rotation"), real("opacity").alias("logit")]
    out += [real(f"f_dc_{k}").alias(f"sh0_{c}") for k, c in enumerate("rgb")]
    if degree:
        rest = F.array(*(real(f"f_rest_{k}") for k in range(count)))
        out.append(splats.to_coefficient_major(rest, count // 3).alias("rest"))
    return df.select(*out), degree
