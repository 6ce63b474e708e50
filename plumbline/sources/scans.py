"""E57 scans, PNG images and web pages: single-file formats, encoded and decoded in memory."""

from __future__ import annotations

import base64
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from html import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PAGE, PAYLOAD, PACKET = 1024, 1020, 65536
SIGNATURE = b"ASTM-E57"


@cache
def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0x82F63B78) ^ (t >> 1), t >> 1)
    return t


def crc32c(rows: np.ndarray) -> np.ndarray:
    """Castagnoli sums of the rows of a byte matrix, all at once."""
    t, c = _crc_table(), np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for k in range(rows.shape[1]):
        c = t[(c ^ rows[:, k]) & 0xFF] ^ (c >> np.uint32(8))
    return c ^ np.uint32(0xFFFFFFFF)


def to_physical(logical: int) -> int:
    return logical // PAYLOAD * PAGE + logical % PAYLOAD


def to_logical(physical: int) -> int:
    return physical // PAGE * PAYLOAD + physical % PAGE


def paginate(data: bytes) -> bytes:
    pages = max(1, -(-len(data) // PAYLOAD))
    rows = np.frombuffer(data.ljust(pages * PAYLOAD, b"\0"), np.uint8).reshape(pages, PAYLOAD)
    return np.concatenate([rows, crc32c(rows).astype("<u4").reshape(-1, 1).view(np.uint8)], 1).tobytes()


def depaginate(data: bytes, verify: bool = True) -> bytes:
    if len(data) % PAGE:
        raise ValueError("E57: the length is no multiple of a page")
    rows = np.frombuffer(data, np.uint8).reshape(-1, PAGE)
    if verify:
        bad = np.flatnonzero(crc32c(rows[:, :PAYLOAD]) != np.ascontiguousarray(rows[:, PAYLOAD:]).view("<u4")[:, 0])
        if len(bad):
            raise ValueError(f"E57: wrong checksum on page {bad[0]}")
    return np.ascontiguousarray(rows[:, :PAYLOAD]).tobytes()


def _cdata(name: str, text: str) -> str:
    return f'<{name} type="String"><![CDATA[{text.replace("]]>", "]]]]><![CDATA[>")}]]></{name}>'


def _float(name: str, v: float) -> str:
    return f'<{name} type="Float" precision="double">{v!r}</{name}>'


def write_e57(scans: list[dict], guid: str | None = None, metadata: str | None = None, single: bool = False) -> bytes:
    """Scans are {"positions", "colors"?, "intensity"?, "origin"?, "name"?}; an origin becomes the scan's pose."""
    make = lambda: f"{{{str(uuid.uuid4()).upper()}}}"
    out = bytearray(48)
    children = []
    for s in scans:
        p = np.asarray(s["positions"], float).reshape(-1, 3)
        kind = "single" if single else "double"
        fields = [(f"cartesian{a}", np.ascontiguousarray(p[:, k]).astype("<f4" if single else "<f8"), f'type="Float" precision="{kind}"') for k, a in enumerate("XYZ")]
        if s.get("colors") is not None:
            fields += [(f"color{n}", np.ascontiguousarray(np.asarray(s["colors"])[:, k]).astype("u1"), 'type="Integer" minimum="0" maximum="255"') for k, n in enumerate(("Red", "Green", "Blue"))]
        if s.get("intensity") is not None:
            fields.append(("intensity", np.asarray(s["intensity"]).astype("<f4"), 'type="Float" precision="single" minimum="0" maximum="1"'))
        out += bytes(-len(out) % 4)
        section = len(out)
        body = bytearray()
        width = sum(f[1].itemsize for f in fields)
        most = max(1, min((PACKET - 6 - 2 * len(fields) - 4) // width, *(0xFFFF // f[1].itemsize for f in fields)))
        for i in range(0, len(p), most):
            streams = [f[1][i : i + most].tobytes() for f in fields]
            packet = struct.pack(f"<H{len(fields)}H", len(fields), *map(len, streams)) + b"".join(streams)
            size = -(-(len(packet) + 4) // 4) * 4
            body += struct.pack("<BBH", 1, 0, size - 1) + packet.ljust(size - 4, b"\0")
        out += struct.pack("<B7xQQQ", 1, 32 + len(body), to_physical(section + 32), 0) + body
        low, high = (p.min(0), p.max(0)) if len(p) else (np.zeros(3), np.zeros(3))
        box = "".join(_float(f"{a}Minimum", float(low[k])) + _float(f"{a}Maximum", float(high[k])) for k, a in enumerate("xyz"))
        pose = ""
        if s.get("origin") is not None:
            turn = "".join(_float(n, v) for n, v in zip("wxyz", (1.0, 0.0, 0.0, 0.0), strict=True))
            move = "".join(_float(n, float(v)) for n, v in zip("xyz", s["origin"], strict=True))
            pose = f'<pose type="Structure"><rotation type="Structure">{turn}</rotation><translation type="Structure">{move}</translation></pose>'
        proto = "".join(f"<{n} {a}/>" for n, _, a in fields)
        children.append(f'<vectorChild type="Structure">{_cdata("guid", make())}{_cdata("name", s.get("name", "scan"))}{pose}<cartesianBounds type="Structure">{box}</cartesianBounds><points type="CompressedVector" fileOffset="{to_physical(section)}" recordCount="{len(p)}"><prototype type="Structure">{proto}</prototype><codecs type="Vector" allowHeterogeneousChildren="1"/></points></vectorChild>')
    head = _cdata("formatName", "ASTM E57 3D Imaging Data File") + _cdata("guid", guid or make()) + '<versionMajor type="Integer">1</versionMajor><versionMinor type="Integer">0</versionMinor>' + _cdata("e57LibraryVersion", "plumbline")
    xml = f'<?xml version="1.0" encoding="UTF-8"?><e57Root type="Structure" xmlns="http://www.astm.org/COMMIT/E57/2010-e57-v1.0">{head}{_cdata("coordinateMetadata", metadata) if metadata else ""}<data3D type="Vector" allowHeterogeneousChildren="1">{"".join(children)}</data3D><images2D type="Vector" allowHeterogeneousChildren="1"/></e57Root>'.encode()
    out += bytes(-len(out) % 4)
    at = len(out)
    out += xml
    struct.pack_into("<8sIIQQQQ", out, 0, SIGNATURE, 1, 0, -(-len(out) // PAYLOAD) * PAGE, to_physical(at), len(xml), PAGE)
    return paginate(bytes(out))


def e57_xml(data: bytes) -> str:
    if data[:8] != SIGNATURE:
        raise ValueError("not an E57 file")
    at, size = struct.unpack_from("<QQ", data, 24)
    logical = depaginate(data, verify=False)
    return logical[to_logical(at) : to_logical(at) + size].decode()


def read_e57(data: bytes, scan: int = 0) -> dict:
    """positions, and colors, intensity and origin where the scan has them."""
    logical, xml = depaginate(data), e57_xml(data)
    found = re.findall(r'<vectorChild type="Structure">.*?</vectorChild>', xml, re.S)
    if scan >= len(found):
        raise ValueError(f"E57: no scan {scan}")
    part = found[scan]
    head = re.search(r"<points[^>]*>", part)[0]
    number = lambda n, text=head: int(re.search(rf'{n}="(-?\d+)"', text)[1])
    count, at = number("recordCount"), to_logical(number("fileOffset"))
    fields = []
    for name, attributes in re.findall(r"<(\w+) ([^<]*?)/>", re.search(r"<prototype[^>]*>(.*?)</prototype>", part, re.S)[1]):
        if 'type="Float"' in attributes:
            fields.append((name, "<f4" if 'precision="single"' in attributes else "<f8", 0))
        else:
            low, high = (int(re.search(rf'{n}="(-?\d+)"', attributes)[1]) for n in ("minimum", "maximum"))
            span = high - low
            fields.append((name, "u1" if span <= 0xFF else "<u2" if span <= 0xFFFF else "<u4" if span <= 0xFFFFFFFF else "<u8", low))
    if logical[at] != 1:
        raise ValueError("E57: no compressed vector where one is said to be")
    at, got, cols = at + 32, 0, {n: [] for n, _, _ in fields}
    while got < count:
        kind, size = logical[at], struct.unpack_from("<H", logical, at + 2)[0] + 1
        if kind == 1:
            n, *lengths = struct.unpack_from(f"<H{len(fields)}H", logical, at + 4)
            if n != len(fields):
                raise ValueError("E57: a packet doesn't fit its prototype")
            cursor = at + 6 + 2 * n
            for (name, dtype, low), size_ in zip(fields, lengths, strict=True):
                cols[name].append(np.frombuffer(logical, dtype, size_ // np.dtype(dtype).itemsize, cursor) + (low if low else 0))
                cursor += size_
            got += lengths[0] // np.dtype(fields[0][1]).itemsize
        at += size
    col = {n: np.concatenate(v) if v else np.zeros(0) for n, v in cols.items()}
    out = {"positions": np.stack([col[f"cartesian{a}"].astype(float) for a in "XYZ"], 1)}
    if "colorRed" in col:
        out["colors"] = np.stack([col[f"color{n}"] for n in ("Red", "Green", "Blue")], 1)
    if "intensity" in col:
        out["intensity"] = col["intensity"]
    move = re.search(r"<translation[^>]*>(.*?)</translation>", part, re.S)
    if move:
        out["origin"] = [float(re.search(rf"<{a} [^>]*>([^<]*)<", move[1])[1]) for a in "xyz"]
    return out


def read_e57_files(files: DataFrame) -> DataFrame:
    """Points of files(path, content), each file within its task: its pages are checked in order."""
    schema = "path string, scan int, x double, y double, z double, r int, g int, b int, intensity double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for path, data in zip(x["path"], x["content"], strict=True):
                for k in range(e57_xml(data).count('<vectorChild type="Structure">')):
                    s = read_e57(data, k)
                    p, n = s["positions"] + np.array(s.get("origin", (0, 0, 0))), len(s["positions"])
                    c, i = s.get("colors"), s.get("intensity")
                    empty = pd.array([None] * n, "Int32")
                    yield pd.DataFrame({"path": path, "scan": k, "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "r": c[:, 0].astype(int) if c is not None else empty, "g": c[:, 1].astype(int) if c is not None else empty, "b": c[:, 2].astype(int) if c is not None else empty, "intensity": i.astype(float) if i is not None else np.nan})

    return files.select("path", "content").mapInPandas(run, schema)


def png(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB image."""
    h, w = rgb.shape[:2]
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rgb.astype(np.uint8).reshape(h, w * 3)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def web_page(glb: bytes, title: str, facts: dict[str, str]) -> str:
    """A page that carries its model as a data URI."""
    rows = "".join(f"<dt>{escape(k)}</dt><dd>{escape(v)}</dd>" for k, v in facts.items())
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><dl>{rows}</dl><a download="model.glb" href="data:model/gltf-binary;base64,{base64.b64encode(glb).decode()}">model.glb</a></body></html>'
