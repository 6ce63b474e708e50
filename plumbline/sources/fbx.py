"""Binary FBX: a tree of named records with typed properties; meshes in and out of it."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MAGIC = b"Kaydara FBX Binary  \x00\x1a\x00"
VERSION = 7400
# Type letters of properties and of array properties.
_SCALAR = {"Y": "<h", "C": "<?", "I": "<i", "F": "<f", "D": "<d", "L": "<q"}
_ARRAY = {"f": "<f4", "d": "<f8", "l": "<i8", "i": "<i4", "b": "<u1"}


@dataclass
class Node:
    name: str
    properties: list = field(default_factory=list)
    children: list[Node] = field(default_factory=list)


def _property(v) -> bytes:
    if isinstance(v, bool):
        return b"C" + struct.pack("<?", v)
    if isinstance(v, np.ndarray):
        letter = next(k for k, t in _ARRAY.items() if np.dtype(t) == v.dtype)
        raw = v.tobytes()
        packed = zlib.compress(raw) if len(raw) > 128 else raw
        return letter.encode() + struct.pack("<III", v.size, int(packed is not raw), len(packed)) + packed
    if isinstance(v, int):
        return (b"I" + struct.pack("<i", v)) if -(2**31) <= v < 2**31 else (b"L" + struct.pack("<q", v))
    if isinstance(v, float):
        return b"D" + struct.pack("<d", v)
    data = v.encode() if isinstance(v, str) else v
    return (b"S" if isinstance(v, str) else b"R") + struct.pack("<I", len(data)) + data


def _record(node: Node, at: int) -> bytes:
    props = b"".join(map(_property, node.properties))
    name = node.name.encode()
    head = 13 + len(name)
    body, cursor = bytearray(props), at + head + len(props)
    for c in node.children:
        r = _record(c, cursor)
        body += r
        cursor += len(r)
    if node.children:
        body += bytes(13)
        cursor += 13
    return struct.pack("<IIIB", cursor, len(node.properties), len(props), len(name)) + name + bytes(body)


def serialise(nodes: list[Node]) -> bytes:
    out = bytearray(MAGIC + struct.pack("<I", VERSION))
    for n in nodes:
        out += _record(n, len(out))
    out += bytes(13)
    out += bytes(16) + bytes(4) + struct.pack("<I", VERSION) + bytes(120)
    out += bytes(-len(out) % 16)
    return bytes(out)


def parse(data: bytes) -> list[Node]:
    """Offsets have 32 bits before version 7500 and 64 from it on."""
    if not data.startswith(MAGIC):
        raise ValueError("not a binary FBX file")
    (version,) = struct.unpack_from("<I", data, len(MAGIC))
    form = "<QQQB" if version >= 7500 else "<IIIB"
    size = struct.calcsize(form)

    def read(at: int) -> tuple[Node | None, int]:
        end, count, _, n = struct.unpack_from(form, data, at)
        if end == 0:
            return None, at + size
        if end > len(data) or end <= at:
            raise ValueError("FBX record runs over the file")
        at += size
        node = Node(data[at : at + n].decode())
        at += n
        for _ in range(count):
            letter = chr(data[at])
            at += 1
            if letter in _SCALAR:
                node.properties.append(struct.unpack_from(_SCALAR[letter], data, at)[0])
                at += struct.calcsize(_SCALAR[letter])
            elif letter in _ARRAY:
                length, packed, stored = struct.unpack_from("<III", data, at)
                raw = data[at + 12 : at + 12 + stored]
                node.properties.append(np.frombuffer(zlib.decompress(raw) if packed else raw, _ARRAY[letter], length))
                at += 12 + stored
            elif letter in "SR":
                (length,) = struct.unpack_from("<I", data, at)
                raw = data[at + 4 : at + 4 + length]
                node.properties.append(raw.decode("utf-8", "replace") if letter == "S" else raw)
                at += 4 + length
            else:
                raise ValueError(f"FBX property of type {letter!r}")
        while at < end:
            child, at = read(at)
            if child is None:
                break
            node.children.append(child)
        return node, end

    out, at = [], len(MAGIC) + 4
    while at + size <= len(data):
        node, at = read(at)
        if node is None:
            break
        out.append(node)
    return out


def find(nodes: list[Node], name: str) -> Node | None:
    for n in nodes:
        if n.name == name:
            return n
        if (got := find(n.children, name)) is not None:
            return got
    return None


def write_mesh(positions: np.ndarray, triangles: np.ndarray, normals: np.ndarray | None = None, uvs: np.ndarray | None = None, scale: float = 100.0) -> bytes:
    """A mesh in centimetres by default; the last corner of a polygon is stored as its bitwise complement."""
    index = triangles.astype("<i4").copy()
    index[:, -1] = ~index[:, -1]
    layers = []
    geometry = Node("Geometry", [1, "mesh\x00\x01Geometry", "Mesh"], [Node("Vertices", [(positions * scale).astype("<f8").ravel()]), Node("PolygonVertexIndex", [index.ravel()]), Node("GeometryVersion", [124])])
    if normals is not None:
        geometry.children.append(Node("LayerElementNormal", [0], [Node("MappingInformationType", ["ByVertice"]), Node("ReferenceInformationType", ["Direct"]), Node("Normals", [normals.astype("<f8").ravel()])]))
        layers.append("LayerElementNormal")
    if uvs is not None:
        geometry.children.append(Node("LayerElementUV", [0], [Node("MappingInformationType", ["ByPolygonVertex"]), Node("ReferenceInformationType", ["IndexToDirect"]), Node("UV", [uvs.astype("<f8").ravel()]), Node("UVIndex", [triangles.astype("<i4").ravel()])]))
        layers.append("LayerElementUV")
    geometry.children.append(Node("Layer", [0], [Node("Version", [100]), *(Node("LayerElement", [], [Node("Type", [t]), Node("TypedIndex", [0])]) for t in layers)]))
    settings = Node("GlobalSettings", [], [Node("Version", [1000]), Node("Properties70", [], [Node("P", ["UnitScaleFactor", "double", "Number", "", 1.0]), Node("P", ["UpAxis", "int", "Integer", "", 1])])])
    objects = Node("Objects", [], [geometry, Node("Model", [2, "mesh\x00\x01Model", "Mesh"], [Node("Version", [232])])])
    return serialise([Node("FBXHeaderExtension", [], [Node("FBXHeaderVersion", [1003]), Node("FBXVersion", [VERSION])]), settings, objects, Node("Connections", [], [Node("C", ["OO", 2, 0]), Node("C", ["OO", 1, 2])])])


def read_mesh(data: bytes, scale: float = 100.0) -> dict[str, np.ndarray]:
    """Positions and triangles; polygons fan out from their first corner."""
    g = find(parse(data), "Geometry")
    if g is None:
        raise ValueError("FBX without geometry")
    flat = find(g.children, "PolygonVertexIndex").properties[0]
    tris, poly = [], []
    for i in flat.tolist():
        poly.append(~i if i < 0 else i)
        if i < 0:
            tris += [(poly[0], poly[k], poly[k + 1]) for k in range(1, len(poly) - 1)]
            poly = []
    return {"positions": find(g.children, "Vertices").properties[0].reshape(-1, 3) / scale, "triangles": np.array(tris, np.int64).reshape(-1, 3)}


def records(files: DataFrame) -> DataFrame:
    """(file, path, name, properties) of every record of files(path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for file, data in zip(x["path"], x["content"], strict=True):
                rows: list[tuple] = []

                def walk(nodes: list[Node], above: str, file=file, rows=rows) -> None:
                    for k, n in enumerate(nodes):
                        at = f"{above}/{k:06d}"
                        rows.append((file, at, n.name, [str(p) if not isinstance(p, np.ndarray) else f"{p.dtype}[{p.size}]" for p in n.properties]))
                        walk(n.children, at)

                walk(parse(bytes(data)), "")
                yield pd.DataFrame(rows, columns=["file", "path", "name", "properties"])

    return files.select("path", "content").mapInPandas(run, "file string, path string, name string, properties array<string>")
