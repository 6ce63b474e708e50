"""Pictures as arrays: PNG and PPM here, others if an image library is installed; and colours for pixels of depth."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import camera as C

_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # by colour type


def _unfilter(raw: np.ndarray, rows: int, line: int, step: int) -> np.ndarray:
    """The lines of a PNG without their filters; ``step`` bytes make a pixel."""
    out = np.zeros((rows + 1, line), np.uint8)
    lines = raw[: rows * (line + 1)].reshape(rows, line + 1)
    for k in range(rows):
        kind, x, up = lines[k, 0], lines[k, 1:], out[k]
        if kind == 0:
            out[k + 1] = x
        elif kind == 1:
            out[k + 1] = np.cumsum(x.reshape(-1, step), 0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            out[k + 1] = x + up
        elif kind in (3, 4):
            # Each pixel needs the one before it: bytes of one pixel go together, pixels in turn.
            now, above, corner = [0] * step, up.tolist(), [0] * step
            new = x.tolist()
            for i in range(0, line, step):
                for c in range(step):
                    a, b = now[c], above[i + c]
                    if kind == 3:
                        guess = (a + b) // 2
                    else:
                        near = (abs(b - corner[c]), abs(a - corner[c]), abs(a + b - 2 * corner[c]))
                        guess = a if near[0] <= near[1] and near[0] <= near[2] else b if near[1] <= near[2] else corner[c]
                        corner[c] = b
                    now[c] = new[i + c] = (new[i + c] + guess) & 255
            out[k + 1] = new
        else:
            raise ValueError(f"line {k} has filter {kind}")
    return out[1:]


def read_png(data: bytes) -> np.ndarray:
    """(height, width, 3) bytes of an 8- or 16-bit PNG that isn't interlaced; alpha is left out."""
    at, pieces, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("the PNG ends early")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            pieces.append(body)
        elif kind == b"IEND":
            break
        at += size + 12
    if not head:
        raise ValueError("the PNG has no header")
    w, h, depth, colour, _, _, woven = head
    if depth not in (8, 16) or woven or colour not in _CHANNELS or colour == 3 and palette is None:
        raise ValueError(f"PNG of depth {depth}, colour type {colour}, interlace {woven} isn't read")
    step = _CHANNELS[colour] * depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(pieces)), np.uint8)
    if len(raw) < h * (w * step + 1):
        raise ValueError("the PNG ends early")
    pixels = _unfilter(raw, h, w * step, step).reshape(h, w, _CHANNELS[colour], depth // 8)[..., 0]
    if colour == 3:
        if pixels.max(initial=0) >= len(palette):
            raise ValueError("a pixel is beyond the palette")
        return palette[pixels[..., 0]]
    return np.repeat(pixels[..., :1], 3, 2) if colour in (0, 4) else np.ascontiguousarray(pixels[..., :3])


def read_ppm(data: bytes) -> np.ndarray:
    """A binary PPM of 8 bits."""
    words, at = [], 2
    while len(words) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        words.append(int(data[at:end]))
        at = end
    w, h, most = words
    if most != 255 or len(data) < at + 1 + w * h * 3:
        raise ValueError("PPM is cut short or not of 8 bits")
    return np.frombuffer(data, np.uint8, w * h * 3, at + 1).reshape(h, w, 3)


def read_picture(data: bytes) -> np.ndarray:
    """(height, width, 3) bytes; a ValueError for what can't be read here."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return read_png(data)
        if data[:2] == b"P6":
            return read_ppm(data)
    except (zlib.error, struct.error, IndexError) as e:
        raise ValueError(f"the picture is broken: {e}") from e
    try:
        from PIL import Image
    except ImportError:
        raise ValueError("only PNG and PPM are read without an image library") from None
    try:
        return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))
    except OSError as e:
        raise ValueError(f"the picture is broken: {e}") from e


def coloured(pixels: DataFrame, root: str) -> DataFrame:
    """Adds r, g and b (0..255) to pixels(px, py, d, camera, lens, image, ..): what the frame's picture shows at each measured point.

    A point goes from the depth camera's pixel through ``lens``, the picture's
    own camera, which shares the pose.  Colours are null where the picture doesn't
    show the point, where there is no picture, and where it can't be read.  Pixels
    of a frame stand together as they come from ``depth_pixels``, so a task reads
    each picture once, and no pixel moves.
    """
    from .points import filesystem

    local = C.unproject_pixel(F.col("px") + 0.5, F.col("py") + 0.5, F.col("d"), F.col("camera"))
    df = pixels.select("*", F.inline(F.array(F.struct(local.alias("_local")))))
    df = df.select("*", F.inline(F.array(F.struct(C.project_point(F.col("_local"), F.col("lens")).alias("_seen")))))
    across = lambda a, n: F.when(F.col("_seen.visible"), F.col(f"_seen.{a}") / F.col(f"lens.{n}"))

    @F.pandas_udf("r int, g int, b int")
    def look(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        system, base = filesystem(root)
        name, picture = None, None

        def open_(uri: str) -> np.ndarray | None:
            try:
                with system.open_input_stream(f"{base}/{uri}", compression=None) as f:
                    return read_picture(f.read())
            except (OSError, ValueError):
                return None

        for uris, u, v in batches:
            out = np.full((len(uris), 3), np.nan)
            u, v = u.to_numpy(float), v.to_numpy(float)
            known = uris.fillna("").to_numpy()
            cuts = np.flatnonzero(np.r_[True, known[1:] != known[:-1]]) if len(known) else []
            for a, b in zip(cuts, [*cuts[1:], len(known)], strict=True):
                if known[a] != name:
                    name, picture = known[a], open_(known[a]) if known[a] else None
                if picture is not None:
                    k = a + np.flatnonzero(~np.isnan(u[a:b]))
                    h, w = picture.shape[:2]
                    out[k] = picture[np.minimum((v[k] * h).astype(int), h - 1), np.minimum((u[k] * w).astype(int), w - 1)]
            table = pd.DataFrame(out, columns=["r", "g", "b"])
            yield table.astype("Int32")

    colour = look(F.col("image"), across("x", "width"), across("y", "height"))
    return df.select(*pixels.columns, colour.alias("_c")).select(*pixels.columns, "_c.r", "_c.g", "_c.b")
