"""A processed capture as a package for the workstation: geometry parts and a record that lists them.

With a solution and a point set the mesh is placed before it is written: each
vertex goes through scale, turn and move and then the set's offset, each normal
through the turn alone, and the record says that the frame is the model's.
Without, the mesh stays in the capture's frame, and whoever reads it applies the
solution; doing both would apply it twice.

Geometry is cut into OBJ files of ``most_faces`` triangles, each with vertices of its
own, encoded and written by the tasks that hold them.  The record (capture.json)
is written last and lists the files with their sizes and digests: what it does
not list does not count, so a package that failed half way leaves the one before
it in place.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import mesh
from ..operators.lineage import checkpointed

RECORD, VERSION = "capture.json", "1.0.0"
_PART = "name string, bytes long, sha256 string, vertices long, faces long"


def bake(vertices: DataFrame, solution: dict, offset: list[float] | None = None) -> DataFrame:
    """vertices(x, y, z[, nx, ny, nz], ..) in the model's world: solution has rotation (x, y, z, w), translation and scale."""
    turn, move, shift = V.quat(*(F.lit(float(c)) for c in solution["rotation"])), solution["translation"], offset or [0.0, 0.0, 0.0]
    turned = V.scale(V.rotate(turn, V.vec(F.col("x"), F.col("y"), F.col("z"))), float(solution.get("scale", 1.0)))
    df = V.fenced(vertices, {"_p": turned})
    out = df.withColumns({a: F.col(f"_p.{a}") + float(move[k]) + float(shift[k]) for k, a in enumerate("xyz")}).drop("_p")
    if "nx" not in vertices.columns:
        return out
    out = V.fenced(out, {"_n": V.rotate(turn, V.vec(F.col("nx"), F.col("ny"), F.col("nz")))})
    return out.withColumns({f"n{a}": F.col(f"_n.{a}") for a in "xyz"}).drop("_n")


def encode_obj(x: pd.DataFrame, normals: bool, colours: bool) -> tuple[bytes, int]:
    """An OBJ of triangles with corners a, b, c and their structs pa, pb, pc; its vertices are numbered from 1 by id."""
    corner = pd.concat([pd.DataFrame({"vid": x[c], "p": x[f"p{c}"]}) for c in "abc"]).drop_duplicates("vid").sort_values("vid")
    number = pd.Series(np.arange(1, len(corner) + 1), corner["vid"].to_numpy())
    get = (lambda p, n: p[n]) if isinstance(corner["p"].iloc[0], dict) else (lambda p, n: getattr(p, n))
    lines = []
    for p in corner["p"]:
        tint = "".join(f" {255 if pd.isna(get(p, n)) else get(p, n) / 255:.6f}" for n in "rgb") if colours else ""
        lines.append("v " + " ".join(f"{get(p, n):.6f}" for n in "xyz") + tint)
    if normals:
        lines += ["vn " + " ".join(f"{get(p, n):.6f}" for n in ("nx", "ny", "nz")) for p in corner["p"]]
    name = (lambda i: f"{i}//{i}") if normals else str
    lines += ["f " + " ".join(name(number[v]) for v in f) for f in zip(x["a"], x["b"], x["c"], strict=True)]
    return ("\n".join(lines) + "\n").encode(), len(corner)


def package(vertices: DataFrame, faces: DataFrame, root: str, info: dict, correspondences: DataFrame | None = None, solution: dict | None = None, offset: list[float] | None = None, has_points: bool = False, most_faces: int = 200_000) -> dict:
    """Writes the package below ``root`` and gives its record.

    vertices(vid, x, y, z[, nx, ny, nz][, r, g, b]), faces(fid, a, b, c); info has
    captureId, capturedUtc, pointSetId and device; correspondences(pointId, x, y,
    z, sigma) are what one crew has measured; solution has rotation, translation,
    scale, rmsError, maxError, accuracyGrade and outlierPointIds.  ``has_points``:
    whether a point set fixes the model's frame; only then is the solution baked in.
    """
    from .points import filesystem

    system, base = filesystem(root.rstrip("/"))
    system.create_dir(base, recursive=True)
    placed = solution is not None and has_points
    made = bake(vertices, solution, offset) if placed else vertices
    normals, colours = {"nx", "ny", "nz"} <= set(made.columns), {"r", "g", "b"} <= set(made.columns)
    extra = tuple([f"n{a}" for a in "xyz"] * normals + list("rgb") * colours)
    numbered = mesh.row_numbers(checkpointed(faces.select("fid", "a", "b", "c")), ["fid"], "n")
    cut = mesh.with_corners(numbered.withColumn("part", F.floor(F.col("n") / most_faces).cast("int")), made, extra)
    folder = f"geometry-{uuid.uuid4().hex}"
    system.create_dir(f"{base}/{folder}", recursive=True)

    def write(x: pd.DataFrame) -> pd.DataFrame:
        data, n = encode_obj(x.sort_values("n"), normals, colours)
        name, (out, there) = f"{folder}/{x['part'].iloc[0]:05}.obj", filesystem(root.rstrip("/"))
        with out.open_output_stream(f"{there}/{name}", compression=None) as f:
            f.write(data)
        return pd.DataFrame([[name, len(data), hashlib.sha256(data).hexdigest(), n, len(x)]], columns=["name", "bytes", "sha256", "vertices", "faces"])

    parts = [r.asDict() for r in checkpointed(cut.groupBy("part").applyInPandas(write, _PART)).orderBy("name").toLocalIterator()]  # a row for each ``most_faces`` faces
    if not parts:
        system.delete_dir(f"{base}/{folder}")
        raise ValueError("the mesh has no faces, so there is nothing to place")
    number = lambda v: float(v) if v is not None and math.isfinite(v) else 0.0
    record = {"contractVersion": VERSION, **{k: info.get(k) for k in ("captureId", "capturedUtc", "pointSetId", "device")}, "correspondences": []}
    for r in correspondences.orderBy("pointId").collect() if correspondences is not None else ():
        record["correspondences"].append({"pointId": r.pointId, "observed": [number(r.x), number(r.y), number(r.z)]} | ({"sigma": number(r.sigma)} if r.sigma is not None else {}))
    if solution is not None:
        record["solution"] = {"rotation": [number(c) for c in solution["rotation"]], "translation": [number(c) for c in solution["translation"]], "scale": number(solution.get("scale", 1.0))} | {k: number(solution.get(k)) for k in ("rmsError", "maxError")} | {k: solution.get(k) for k in ("accuracyGrade", "outlierPointIds")}
    record["geometry"] = {"frame": "model" if placed else "capture", "bytes": sum(p["bytes"] for p in parts), "files": parts}
    before = _record(system, base)
    with system.open_output_stream(f"{base}/{RECORD}.new", compression=None) as f:
        f.write(json.dumps(record, indent=1).encode())
    system.move(f"{base}/{RECORD}.new", f"{base}/{RECORD}")  # from here on this package counts
    for old in {p["name"].split("/")[0] for p in (before or {}).get("geometry", {}).get("files", [])}:
        system.delete_dir(f"{base}/{old}")
    return record


def _record(system, base: str) -> dict | None:
    if not system.get_file_info(f"{base}/{RECORD}").is_file:
        return None
    with system.open_input_stream(f"{base}/{RECORD}", compression=None) as f:
        return json.loads(f.read())


def read_package(spark: SparkSession, root: str) -> tuple[dict, DataFrame]:
    """(record, corners(file, face, corner, x, y, z, nx, ny, nz)) of the listed files; one that doesn't fit its digest is an error."""
    from .points import filesystem

    system, base = filesystem(root.rstrip("/"))
    record = _record(system, base)
    if record is None:
        raise ValueError(f"no package at {root}")
    if record["contractVersion"].split(".")[0] != VERSION.split(".")[0]:
        raise ValueError(f"contract version isn't supported: {record['contractVersion']}")
    listed = spark.createDataFrame([(p["name"], p["sha256"]) for p in record["geometry"]["files"]], "name string, sha256 string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, there = filesystem(root.rstrip("/"))
        for x in batches:
            for name, digest in zip(x["name"], x["sha256"], strict=True):
                with out.open_input_stream(f"{there}/{name}", compression=None) as f:
                    data = f.read()
                if hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError(f"{name} does not fit its digest")
                rows = [line.split() for line in data.decode().splitlines()]
                v = np.array([r[1:4] for r in rows if r[0] == "v"], float)
                n = np.array([r[1:4] for r in rows if r[0] == "vn"], float)
                f_ = np.array([[c.split("/")[0] for c in r[1:4]] for r in rows if r[0] == "f"], int).ravel() - 1
                n = n[f_] if len(n) else np.full((len(f_), 3), np.nan)
                k = np.arange(len(f_))
                yield pd.DataFrame({"file": name, "face": k // 3, "corner": k % 3} | dict(zip(("x", "y", "z"), v[f_].T, strict=True)) | dict(zip(("nx", "ny", "nz"), n.T, strict=True)))

    return record, listed.repartition(max(1, len(record["geometry"]["files"]))).mapInPandas(run, "file string, face int, corner int, x double, y double, z double, nx double, ny double, nz double")
