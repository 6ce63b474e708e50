"""Point and mesh formats as Python data sources: PLY, LAS, OBJ, GLB and E57.

Bodies of fixed stride are read in byte ranges, so a file of any size is shared
out over the tasks; writers put out part files that are valid on their own.
Paths go through pyarrow's file systems, so any of its URIs will do.
"""

from __future__ import annotations

import json
import posixpath
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

RANGE = 16 << 20


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path) else (fs.LocalFileSystem(), path)


def files(path: str, suffix: str) -> list[str]:
    system, root = filesystem(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.Directory:
        return sorted(i.path for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and i.path.lower().endswith(suffix))
    return [root]


@dataclass
class Range(InputPartition):
    path: str
    first: int
    count: int
    extra: dict = field(default_factory=dict)


# PLY scalar names and their numpy types.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
_SPARK = {"i1": "smallint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "bigint", "f4": "float", "f8": "double"}
_ARROW = {"smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}


@dataclass
class PlyHeader:
    format: str
    comments: list[str]
    elements: list[tuple[str, int, list[tuple]]]
    size: int


def ply_header(data: bytes) -> PlyHeader:
    """Unknown keywords are passed over; a missing format is an error."""
    end = re.search(rb"(?m)^end_header\r?\n", data)
    if not data.startswith(b"ply") or not end:
        raise ValueError("not a PLY file")
    form, comments, elements = None, [], []
    for line in data[: end.start()].decode("latin-1").splitlines()[1:]:
        word = line.split()
        if not word:
            continue
        if word[0] == "format":
            form = word[1]
        elif word[0] in ("comment", "obj_info"):
            comments.append(line.split(None, 1)[1] if len(word) > 1 else "")
        elif word[0] == "element":
            elements.append((word[1], int(word[2]), []))
        elif word[0] == "property":
            elements[-1][2].append(("list", PLY_TYPES[word[2]], PLY_TYPES[word[3]], word[4]) if word[1] == "list" else ("scalar", PLY_TYPES[word[1]], word[2]))
    if form not in ("ascii", "binary_little_endian", "binary_big_endian"):
        raise ValueError(f"PLY format {form!r}")
    return PlyHeader(form, comments, elements, end.end())


def _columns(properties: list[tuple]) -> list[tuple[str, str]]:
    return [(p[-1], f"array<{_SPARK[p[2]]}>" if p[0] == "list" else _SPARK[p[1]]) for p in properties]


def _arrow(kind: str) -> pa.DataType:
    return pa.list_(_ARROW[kind[6:-1]]) if kind.startswith("array<") else _ARROW[kind]


class PlyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.element = options["path"], options.get("element", "vertex")

    def header(self, path: str) -> PlyHeader:
        system, _ = filesystem(self.path)
        with system.open_input_file(path) as f:
            return ply_header(f.read_at(min(f.size(), 1 << 20), 0))

    def columns(self) -> list[tuple[str, str]]:
        head = self.header(files(self.path, ".ply")[0])
        return next(_columns(p) for n, _, p in head.elements if n == self.element)

    def partitions(self) -> list[Range]:
        out = []
        for path in files(self.path, ".ply"):
            head, at, fixed = self.header(path), 0, True
            at = head.size
            for name, count, props in head.elements:
                stride = sum(np.dtype(p[1]).itemsize for p in props if p[0] == "scalar")
                plain = all(p[0] == "scalar" for p in props)
                if name == self.element:
                    if head.format != "ascii" and fixed and plain and stride:
                        step = max(1, RANGE // stride)
                        out += [Range(path, i, min(step, count - i), {"at": at, "stride": stride}) for i in range(0, count, step)]
                    else:
                        out.append(Range(path, 0, count))
                    break
                fixed &= plain
                at += stride * count
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        system, _ = filesystem(self.path)
        head = self.header(part.path)
        props = next(p for n, _, p in head.elements if n == self.element)
        kinds = _columns(props)
        schema = pa.schema([(n, _arrow(k)) for n, k in kinds])
        with system.open_input_file(part.path) as f:
            if part.extra:
                dtype = np.dtype([(p[2], ("<" if "little" in head.format else ">") + p[1]) for p in props])
                data = f.read_at(part.count * dtype.itemsize, part.extra["at"] + part.first * dtype.itemsize)
                if len(data) < part.count * dtype.itemsize:
                    raise ValueError(f"{part.path} ends within its {self.element} body")
                rows = np.frombuffer(data, dtype)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[n]).astype(np.dtype(t.to_pandas_dtype())), t) for n, t in zip(schema.names, schema.types, strict=True)], schema=schema)
                return
            body = f.read_at(f.size() - head.size, head.size)
        rows = _ply_rows(head, body, self.element)
        for i in range(0, len(rows), 50_000):
            cols = list(zip(*rows[i : i + 50_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


def _ply_rows(head: PlyHeader, body: bytes, want: str) -> list[tuple]:
    out = []
    if head.format == "ascii":
        tokens, at = body.split(), 0
        for name, count, props in head.elements:
            for _ in range(count):
                row = []
                for p in props:
                    if p[0] == "list":
                        n = int(tokens[at])
                        values, at = tokens[at + 1 : at + 1 + n], at + 1 + n
                        if len(values) < n:
                            raise ValueError("PLY body ends early")
                        row.append([float(v) if p[2][0] == "f" else int(float(v)) for v in values])
                    else:
                        if at >= len(tokens):
                            raise ValueError("PLY body ends early")
                        row.append(float(tokens[at]) if p[1][0] == "f" else int(float(tokens[at])))
                        at += 1
                if name == want:
                    out.append(tuple(row))
        return out
    order, at = "<" if "little" in head.format else ">", 0
    code = {"i1": "b", "u1": "B", "i2": "h", "u2": "H", "i4": "i", "u4": "I", "f4": "f", "f8": "d"}
    try:
        for name, count, props in head.elements:
            for _ in range(count):
                row = []
                for p in props:
                    if p[0] == "list":
                        (n,) = struct.unpack_from(order + code[p[1]], body, at)
                        at += struct.calcsize(code[p[1]])
                        row.append(list(struct.unpack_from(f"{order}{n}{code[p[2]]}", body, at)))
                        at += n * struct.calcsize(code[p[2]])
                    else:
                        row.append(struct.unpack_from(order + code[p[1]], body, at)[0])
                        at += struct.calcsize(code[p[1]])
                if name == want:
                    out.append(tuple(row))
    except struct.error as e:
        raise ValueError("PLY body ends early") from e
    return out


@dataclass
class Written(WriterCommitMessage):
    names: list


#: Bytes of rows that a part file takes before the next one begins.
FILE_BYTES = 128 << 20


class _PartWriter(DataSourceArrowWriter):
    """Each task writes whole files under names of its own; abort takes them away.

    A file holds about ``fileBytes`` of rows, so a task holds that much however
    large its partition is.
    """

    suffix = ""

    def __init__(self, options: dict):
        self.path, self.options = options["path"], options
        self.bytes = int(options.get("filebytes", options.get("fileBytes", FILE_BYTES)))
        system, root = filesystem(self.path)
        system.create_dir(root, recursive=True)

    def encode(self, table: pa.Table) -> bytes:
        raise NotImplementedError

    def write(self, iterator) -> Written:
        system, root = filesystem(self.path)
        names, batches, size = [], [], 0

        def put() -> None:
            names.append(f"part-{uuid.uuid4().hex}{self.suffix}")
            with system.open_output_stream(f"{root}/{names[-1]}", compression=None) as f:
                f.write(self.encode(pa.Table.from_batches(batches)))
            batches.clear()

        for b in iterator:
            if b.num_rows:
                batches.append(b)
                size += b.nbytes
            if size >= self.bytes:
                put()
                size = 0
        if batches:
            put()
        return Written(names)

    def abort(self, messages) -> None:
        system, root = filesystem(self.path)
        for m in messages:
            for n in m.names if m else ():
                system.delete_file(f"{root}/{n}")


class PlyWriter(_PartWriter):
    suffix = ".ply"

    def encode(self, table: pa.Table) -> bytes:
        comments = [c for line in self.options.get("comment", "").splitlines() for c in [line.strip()] if c]
        names = {"int8": "char", "uint8": "uchar", "int16": "short", "uint16": "ushort", "int32": "int", "uint32": "uint", "int64": "int", "float32": "float", "float64": "double", "float": "float", "double": "double"}
        colours = {"red", "green", "blue", "alpha"}
        head = ["ply", "format binary_little_endian 1.0", *(f"comment {c}" for c in comments), f"element {self.options.get('element', 'vertex')} {table.num_rows}"]
        plain, lists = [], []
        for f in table.schema:
            if pa.types.is_list(f.type):
                head.append(f"property list uchar {names[str(f.type.value_type)].replace('int', 'uint') if pa.types.is_integer(f.type.value_type) else names[str(f.type.value_type)]} {f.name}")
                lists.append(f.name)
            else:
                kind = "uchar" if f.name in colours else names[str(f.type)]
                head.append(f"property {kind} {f.name}")
                plain.append((f.name, "<" + PLY_TYPES[kind]))
        head = ("\n".join([*head, "end_header"]) + "\n").encode()
        if not lists:
            rows = np.empty(table.num_rows, np.dtype(plain))
            for n, _ in plain:
                rows[n] = table.column(n).to_numpy()
            return head + rows.tobytes()
        out = [head]
        columns = [table.column(f.name).to_pylist() for f in table.schema]
        kinds = dict(plain)
        for row in zip(*columns, strict=True):
            for f, v in zip(table.schema, row, strict=True):
                if f.name in kinds:
                    out.append(np.array(v, kinds[f.name]).tobytes())
                else:
                    out.append(bytes([len(v)]) + np.array(v, "<u4" if pa.types.is_integer(f.type.value_type) else "<f4").tobytes())
        return b"".join(out)


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return ", ".join(f"`{n}` {k}" for n, k in PlyReader(dict(self.options)).columns())

    def reader(self, schema) -> DataSourceReader:
        return PlyReader(dict(self.options))

    def writer(self, schema, overwrite) -> DataSourceArrowWriter:
        return PlyWriter(dict(self.options))


LAS_SCHEMA = "x double, y double, z double, intensity float, classification smallint, gps_time double, r smallint, g smallint, b smallint"
# Record lengths of LAS point formats 0 to 3, and where time and colour lie.
_LAS_LENGTH, _LAS_TIME, _LAS_RGB = (20, 28, 26, 34), {1: 20, 3: 20}, {2: 20, 3: 28}


def las_header(data: bytes) -> dict:
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    major, minor = data[24], data[25]
    offset, _, form, length, legacy = struct.unpack_from("<IIBHI", data, 96)
    scale = struct.unpack_from("<6d", data, 131)
    count = struct.unpack_from("<Q", data, 247)[0] if minor >= 4 else legacy
    return {"version": (major, minor), "offset": offset, "format": form & 0x3F, "length": length, "count": count, "scale": scale[:3], "origin": scale[3:]}


class LasReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[Range]:
        system, _ = filesystem(self.path)
        out = []
        for path in files(self.path, ".las"):
            with system.open_input_file(path) as f:
                h = las_header(f.read_at(375, 0))
            if h["format"] > 3:
                raise ValueError(f"LAS point format {h['format']}")
            step = max(1, RANGE // h["length"])
            out += [Range(path, i, min(step, h["count"] - i), h) for i in range(0, h["count"], step)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        h, system = part.extra, filesystem(self.path)[0]
        with system.open_input_file(part.path) as f:
            data = f.read_at(part.count * h["length"], h["offset"] + part.first * h["length"])
        if len(data) < part.count * h["length"]:
            raise ValueError(f"{part.path} ends within its points")
        raw = np.frombuffer(data, np.uint8).reshape(part.count, h["length"])
        at = lambda a, n, t: np.ascontiguousarray(raw[:, a : a + n]).view(t)
        xyz = at(0, 12, "<i4")
        none = lambda t: pa.nulls(part.count, t)
        cols = [pa.array(xyz[:, k] * h["scale"][k] + h["origin"][k]) for k in range(3)]
        cols += [pa.array((at(12, 2, "<u2")[:, 0] / 65535).astype(np.float32)), pa.array((raw[:, 15] & 31).astype(np.int16))]
        cols.append(pa.array(at(_LAS_TIME[h["format"]], 8, "<f8")[:, 0]) if h["format"] in _LAS_TIME else none(pa.float64()))
        if h["format"] in _LAS_RGB:
            rgb = np.floor(at(_LAS_RGB[h["format"]], 6, "<u2") / 257 + 0.5).astype(np.int16)
            cols += [pa.array(np.ascontiguousarray(rgb[:, k])) for k in range(3)]
        else:
            cols += [none(pa.int16())] * 3
        yield pa.RecordBatch.from_arrays(cols, ["x", "y", "z", "intensity", "classification", "gps_time", "r", "g", "b"])


class LasWriter(_PartWriter):
    """LAS 1.4; a coordinate that its 32 bits cannot hold is an error, never a wrap."""

    suffix = ".las"

    def encode(self, table: pa.Table) -> bytes:
        get = lambda n: table.column(n).to_numpy(zero_copy_only=False) if n in table.column_names and table.column(n).null_count < table.num_rows else None
        scale = float(self.options.get("scale", 0.001))
        xyz = np.stack([get(n).astype(float) for n in "xyz"], 1)
        middle = (xyz.min(0) + xyz.max(0)) / 2
        origin = np.array(json.loads(self.options["offset"]), float) if "offset" in self.options else np.floor(middle + 0.5)
        whole = np.floor((xyz - origin) / scale + 0.5)
        if np.abs(whole).max() > 2**31 - 1:
            raise ValueError("coordinates exceed LAS integers; choose a larger scale or another offset")
        time, rgb = get("gps_time"), [get(n) for n in "rgb"]
        form = (1 if time is not None else 0) + (2 if all(c is not None for c in rgb) else 0)
        rows = np.zeros((len(xyz), _LAS_LENGTH[form]), np.uint8)
        rows[:, :12] = np.ascontiguousarray(whole.astype("<i4")).view(np.uint8)
        if (i := get("intensity")) is not None:
            rows[:, 12:14] = np.floor(np.clip(np.nan_to_num(i), 0, 1) * 65535 + 0.5).astype("<u2").reshape(-1, 1).view(np.uint8)
        rows[:, 14] = 0b1001  # the first of one return
        if (c := get("classification")) is not None:
            rows[:, 15] = np.nan_to_num(c).astype(np.uint8)
        if form in _LAS_TIME:
            rows[:, _LAS_TIME[form] : _LAS_TIME[form] + 8] = np.ascontiguousarray(time.astype("<f8")).reshape(-1, 1).view(np.uint8)
        if form in _LAS_RGB:
            colour = np.stack([np.clip(np.nan_to_num(c.astype(float)), 0, 255) * 257 for c in rgb], 1).astype("<u2")
            rows[:, _LAS_RGB[form] : _LAS_RGB[form] + 6] = np.ascontiguousarray(colour).view(np.uint8)
        wkt = self.options.get("wkt", "").encode()
        vlr = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 2112, len(wkt) + 1, b"OGC WKT") + wkt + b"\0" if wkt else b""
        low, high = whole.min(0) * scale + origin, whole.max(0) * scale + origin
        head = bytearray(375)
        struct.pack_into("<4sHHIHH8sBB32s32sHHHIIBHI", head, 0, b"LASF", 0, 16 if wkt else 0, 0, 0, 0, bytes(8), 1, 4, b"plumbline", b"plumbline", 1, 2024, 375, 375 + len(vlr), 1 if wkt else 0, form, _LAS_LENGTH[form], min(len(xyz), 0xFFFFFFFF))
        struct.pack_into("<I", head, 111, min(len(xyz), 0xFFFFFFFF))
        struct.pack_into("<12d", head, 131, *[scale] * 3, *origin, high[0], low[0], high[1], low[1], high[2], low[2])
        struct.pack_into("<QQ", head, 247, len(xyz), len(xyz))
        return bytes(head) + vlr + rows.tobytes()


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return LAS_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LasReader(dict(self.options))

    def writer(self, schema, overwrite) -> DataSourceArrowWriter:
        return LasWriter(dict(self.options))


def obj_mesh(text: str) -> dict[str, np.ndarray]:
    """Positions, colours, uvs, normals and triangles of an OBJ file.

    A vertex is a distinct v/vt/vn corner, in order of first use; polygons fan
    out from their first corner; numbers below zero count back from the latest;
    v of a texture turns upside down.
    """
    raw: dict[str, list] = {"v": [], "vt": [], "vn": []}
    seen: dict[tuple, int] = {}
    tris = []
    for line in text.splitlines():
        w = line.split()
        if not w:
            continue
        if w[0] in raw:
            raw[w[0]].append([float(x) for x in w[1:]])
        elif w[0] == "f":
            corners = []
            for c in w[1:]:
                n = [int(x) if x else 0 for x in (c.split("/") + ["", ""])[:3]]
                key = tuple(k - 1 if k > 0 else len(raw[a]) + k if k < 0 else -1 for k, a in zip(n, ("v", "vt", "vn"), strict=True))
                corners.append(seen.setdefault(key, len(seen)))
            tris += [(corners[0], corners[i], corners[i + 1]) for i in range(1, len(corners) - 1)]
    pick = lambda a, j, n: np.array([(raw[a][k[j]] + [0.0] * n)[:n] if k[j] >= 0 else [0.0] * n for k in seen]).reshape(-1, n)
    out = {"positions": pick("v", 0, 3), "triangles": np.array(tris, np.int64).reshape(-1, 3)}
    if raw["vt"]:
        uv = pick("vt", 1, 2)
        out["uvs"] = np.stack([uv[:, 0], 1 - uv[:, 1]], 1)
    if raw["vn"]:
        out["normals"] = pick("vn", 2, 3)
    if any(len(v) >= 6 for v in raw["v"]):
        out["colors"] = np.array([(raw["v"][k[0]] + [1.0] * 6)[3:6] for k in seen])
    return out


def write_obj(positions: np.ndarray, triangles: np.ndarray, uvs: np.ndarray | None = None, normals: np.ndarray | None = None, material: str | None = None) -> str:
    lines = [f"mtllib {material}.mtl", f"usemtl {material}"] if material else []
    lines += ["v " + " ".join(f"{x:.9g}" for x in p) for p in positions]
    lines += [f"vt {u:.9g} {1 - v:.9g}" for u, v in uvs] if uvs is not None else []
    lines += ["vn " + " ".join(f"{x:.9g}" for x in n) for n in normals] if normals is not None else []
    corner = lambda k: f"{k}" if uvs is None and normals is None else f"{k}/{k if uvs is not None else ''}" + (f"/{k}" if normals is not None else "")
    lines += ["f " + " ".join(corner(int(k) + 1) for k in t) for t in triangles]
    return "\n".join(lines) + "\n"


# glTF component types and the widths of accessor types.
_COMPONENT = {5120: "<i1", 5121: "<u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
_WIDTH = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT2": 4, "MAT3": 9, "MAT4": 16}


def parse_glb(data: bytes) -> tuple[dict, bytes]:
    magic, version, size = struct.unpack_from("<4sII", data)
    if magic != b"glTF" or version != 2 or size > len(data):
        raise ValueError("not a GLB 2 file")
    at, doc, blob = 12, None, b""
    while at < size:
        n, kind = struct.unpack_from("<I4s", data, at)
        chunk = data[at + 8 : at + 8 + n]
        doc, blob = (json.loads(chunk), blob) if kind == b"JSON" else (doc, chunk) if kind == b"BIN\0" else (doc, blob)
        at += 8 + n
    if doc is None:
        raise ValueError("GLB without JSON")
    return doc, blob


def glb_accessor(doc: dict, blob: bytes, index: int) -> np.ndarray:
    a = doc["accessors"][index]
    view = doc["bufferViews"][a["bufferView"]]
    dtype, width = np.dtype(_COMPONENT[a["componentType"]]), _WIDTH[a["type"]]
    at, stride = view.get("byteOffset", 0) + a.get("byteOffset", 0), view.get("byteStride", dtype.itemsize * width)
    rows = np.lib.stride_tricks.as_strided(np.frombuffer(blob, np.uint8, offset=at), (a["count"], dtype.itemsize * width), (stride, 1))
    return np.ascontiguousarray(rows).view(dtype).reshape(a["count"], width)


class GlbBuilder:
    """Collects accessors in four-byte aligned views and puts out a container."""

    def __init__(self) -> None:
        self.blob, self.views, self.accessors = bytearray(), [], []

    def view(self, data: bytes, target: int | None = None) -> int:
        self.blob += bytes(-len(self.blob) % 4)
        self.views.append({"buffer": 0, "byteOffset": len(self.blob), "byteLength": len(data), **({"target": target} if target else {})})
        self.blob += data
        return len(self.views) - 1

    def accessor(self, a: np.ndarray, kind: str, target: int | None = None, bounds: bool = False) -> int:
        code = next(k for k, v in _COMPONENT.items() if np.dtype(v) == a.dtype)
        out = {"bufferView": self.view(np.ascontiguousarray(a).tobytes(), target), "componentType": code, "count": len(a), "type": kind}
        if bounds and len(a):
            out |= {"min": a.min(0).tolist(), "max": a.max(0).tolist()}
        self.accessors.append(out)
        return len(self.accessors) - 1

    def finish(self, doc: dict) -> bytes:
        doc = {"asset": {"version": "2.0", "generator": "plumbline"}, **doc, "bufferViews": self.views, "accessors": self.accessors, "buffers": [{"byteLength": len(self.blob)}]}
        text = json.dumps(doc, separators=(",", ":")).encode()
        text += b" " * (-len(text) % 4)
        blob = bytes(self.blob) + bytes(-len(self.blob) % 4)
        return struct.pack("<4sIII4s", b"glTF", 2, 28 + len(text) + len(blob), len(text), b"JSON") + text + struct.pack("<I4s", len(blob), b"BIN\0") + blob


def write_glb(positions: np.ndarray, triangles: np.ndarray, normals: np.ndarray | None = None, colors: np.ndarray | None = None) -> bytes:
    b = GlbBuilder()
    attributes = {"POSITION": b.accessor(positions.astype("<f4"), "VEC3", 34962, True)}
    if normals is not None:
        attributes["NORMAL"] = b.accessor(normals.astype("<f4"), "VEC3", 34962)
    if colors is not None:
        attributes["COLOR_0"] = b.accessor(colors.astype("<f4"), "VEC3", 34962)
    index = triangles.reshape(-1, 1).astype("<u2" if len(positions) <= 65535 else "<u4")
    primitive = {"attributes": attributes, "indices": b.accessor(index, "SCALAR", 34963), "mode": 4, "material": 0}
    return b.finish({"scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}], "meshes": [{"primitives": [primitive]}], "materials": [{"pbrMetallicRoughness": {"metallicFactor": 0, "roughnessFactor": 1}, "doubleSided": True}]})


def read_glb(data: bytes) -> dict[str, np.ndarray]:
    """One mesh of one primitive with float positions; anything more is refused."""
    doc, blob = parse_glb(data)
    if len(doc.get("meshes", [])) != 1 or len(doc["meshes"][0]["primitives"]) != 1:
        raise ValueError("one mesh of one primitive is expected")
    if any(k in n for n in doc.get("nodes", []) for k in ("matrix", "translation", "rotation", "scale")) or any("uri" in x for x in doc["buffers"]):
        raise ValueError("node transforms and external buffers are not read")
    p = doc["meshes"][0]["primitives"][0]
    out = {k.lower(): glb_accessor(doc, blob, i) for k, i in p["attributes"].items()}
    out["triangles"] = glb_accessor(doc, blob, p["indices"]).reshape(-1, 3).astype(np.int64)
    return out


def register(spark: SparkSession) -> None:
    for s in (PlySource, LasSource):
        spark.dataSource.register(s)


def basename(path: str) -> str:
    return posixpath.basename(path)
