"""Image features in numpy, whole arrays at a time: pyramid, corners, orientation, descriptors.

Spark hands out images (id, width, height, gray); an image is one row and stays
within its task, and its keypoints come out as rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# The sixteen places of a circle of radius three, clockwise from the top.
CIRCLE = ((0, -3), (1, -3), (2, -2), (3, -1), (3, 0), (3, 1), (2, 2), (1, 3), (0, 3), (-1, 3), (-2, 2), (-3, 1), (-3, 0), (-3, -1), (-2, -2), (-1, -3))
BITS, PATCH, SEED = 256, 31, 0x2545F491
KEYPOINTS = "image string, kp int, x double, y double, score double, angle double, level int, scale double, d0 long, d1 long, d2 long, d3 long"


class XorShift:
    """The 32-bit generator that fixes sampling tables and RANSAC draws."""

    def __init__(self, seed: int):
        self.state = seed & 0xFFFFFFFF

    def next(self) -> int:
        x = self.state
        x ^= x << 13 & 0xFFFFFFFF
        x ^= x >> 17
        x ^= x << 5 & 0xFFFFFFFF
        self.state = x
        return x


def gray_of(rgba: np.ndarray) -> np.ndarray:
    return np.floor(0.299 * rgba[..., 0] + 0.587 * rgba[..., 1] + 0.114 * rgba[..., 2] + 0.5).astype(np.uint8)


def _around(a: np.ndarray, reach: int):
    """A function of dx, dy: a[y + dy, x + dx] for every pixel, the edge repeated, up to ``reach``; padded once for all of them."""
    h, w = a.shape
    p = a[np.clip(np.arange(-reach, h + reach), 0, h - 1)][:, np.clip(np.arange(-reach, w + reach), 0, w - 1)]
    return lambda dx, dy: p[reach + dy : reach + dy + h, reach + dx : reach + dx + w]


def bilinear(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h, w = a.shape
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = x - x0, y - y0
    f = a.astype(float)
    return (f[y0, x0] * (1 - fx) + f[y0, x1] * fx) * (1 - fy) + (f[y1, x0] * (1 - fx) + f[y1, x1] * fx) * fy


def blur(a: np.ndarray) -> np.ndarray:
    """1-4-6-4-1 along rows and then columns, rounded in between."""
    k = (1, 4, 6, 4, 1)
    for axis in (0, 1):
        at = _around(a.astype(int), 2)
        a = np.floor(sum(c * at(*((i - 2, 0) if axis == 0 else (0, i - 2))) for i, c in enumerate(k)) / 16 + 0.5).astype(np.uint8)
    return a


def resample(a: np.ndarray, width: int, height: int) -> np.ndarray:
    x = (np.arange(width) + 0.5) * a.shape[1] / width - 0.5
    y = (np.arange(height) + 0.5) * a.shape[0] / height - 0.5
    return np.floor(bilinear(a, *np.meshgrid(x, y)) + 0.5).astype(np.uint8)


def pyramid(a: np.ndarray, factor: float = 1.2, levels: int = 8, least: int = 32) -> list[tuple[np.ndarray, float]]:
    """(image, scale): every level comes from the base."""
    out = []
    for k in range(levels):
        s = factor**k
        w, h = (int(math.floor(n / s + 0.5)) for n in (a.shape[1], a.shape[0]))
        if k and min(w, h) < least:
            break
        out.append((a if k == 0 else resample(a, w, h), s))
    return out


def fast_corners(a: np.ndarray, threshold: int = 20, arc: int = 9) -> np.ndarray:
    """Where nine in a row of the circle are all brighter, or all darker, by the threshold."""
    v = a.astype(int)
    at = _around(v, 3)
    ring = np.stack([at(dx, dy) for dx, dy in CIRCLE])
    hit = np.zeros(a.shape, bool)
    for side in (ring > v + threshold, ring < v - threshold):
        twice = np.concatenate([side, side[: arc - 1]])
        run = twice[: len(side)].copy()
        for k in range(1, arc):
            run &= twice[k : k + len(side)]
        hit |= run.any(0)
    return hit


def harris(a: np.ndarray, k: float = 0.04) -> np.ndarray:
    v = a.astype(float)
    at = _around(v, 1)
    gx, gy = at(1, 0) - at(-1, 0), at(0, 1) - at(0, -1)

    def box(p: np.ndarray) -> np.ndarray:
        across = _around(p, 3)
        down = _around(sum(across(d, 0) for d in range(-3, 4)), 3)
        return sum(down(0, d) for d in range(-3, 4)) / 4

    xx, yy, xy = box(gx * gx), box(gy * gy), box(gx * gy)
    return xx * yy - xy * xy - k * (xx + yy) ** 2


@cache
def _disc(radius: int = 15) -> np.ndarray:
    return np.array([(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-int(math.sqrt(radius * radius - dy * dy)), int(math.sqrt(radius * radius - dy * dy)) + 1)])


def angles(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The direction of the intensity centroid about each point."""
    d = _disc()
    h, w = a.shape
    v = a[np.clip(y[:, None] + d[:, 1], 0, h - 1), np.clip(x[:, None] + d[:, 0], 0, w - 1)].astype(float)
    return np.arctan2(v @ d[:, 1], v @ d[:, 0])


@cache
def sampling_pairs() -> np.ndarray:
    """256 rows of two offsets within the patch, gaussian about its middle, from the fixed seed."""
    rng, limit, spread = XorShift(SEED), (PATCH - 1) // 2, PATCH / 5 * 0.35

    def offset() -> int:
        while True:
            u, v = max(rng.next() / 2**32, 5e-324), rng.next() / 2**32
            r = math.floor(math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v) * spread + 0.5)
            if abs(r) <= limit:
                return r

    rows: list[list[int]] = []
    while len(rows) < BITS:
        row = [offset() for _ in range(4)]
        if row[:2] != row[2:]:
            rows.append(row)
    return np.array(rows)


def describe(a: np.ndarray, x: np.ndarray, y: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """Steered comparisons, as four 64-bit words for each point."""
    p = sampling_pairs()
    c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
    h, w = a.shape

    def value(ox: np.ndarray, oy: np.ndarray) -> np.ndarray:
        px = np.floor(x[:, None] + ox * c - oy * s + 0.5).astype(int)
        py = np.floor(y[:, None] + ox * s + oy * c + 0.5).astype(int)
        return a[np.clip(py, 0, h - 1), np.clip(px, 0, w - 1)].astype(int)

    bits = value(p[:, 0], p[:, 1]) < value(p[:, 2], p[:, 3])
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


def suppress(x: np.ndarray, y: np.ndarray, score: np.ndarray, radius: float) -> np.ndarray:
    """Greedy by score: the rows that no better kept row is near."""
    kept: dict[tuple[int, int], list[tuple[float, float]]] = {}
    out, apart, none = [], radius * radius, ()
    order = np.lexsort((x, y, -score))
    for i, px, py in zip(order.tolist(), x[order].tolist(), y[order].tolist(), strict=True):
        cx, cy = int(px // radius), int(py // radius)
        for key in ((cx, cy), (cx - 1, cy), (cx + 1, cy), (cx, cy - 1), (cx, cy + 1), (cx - 1, cy - 1), (cx - 1, cy + 1), (cx + 1, cy - 1), (cx + 1, cy + 1)):
            if any([(px - p) ** 2 + (py - q) ** 2 < apart for p, q in kept.get(key, none)]):
                break
        else:
            kept.setdefault((cx, cy), []).append((px, py))
            out.append(i)
    return np.array(out, int)


def features(a: np.ndarray, most: int = 1000, threshold: int = 20, radius: float = 5.0, border: int = 4) -> list[tuple]:
    """Keypoints of all levels, strongest first: (x, y, score, angle, level, scale, four words)."""
    levels = pyramid(a)
    area = sum(i.size for i, _ in levels)
    found = []
    for k, (image, scale) in enumerate(levels):
        hit = fast_corners(image, threshold)
        hit[:border], hit[-border:], hit[:, :border], hit[:, -border:] = (False,) * 4
        score = harris(image)
        y, x = np.nonzero(hit & (score > 0))
        if not len(x):
            continue
        keep = suppress(x, y, score[y, x], radius)[: math.floor(most * image.size / area + 0.5)]
        x, y = x[keep], y[keep]
        soft = blur(image)
        turn = angles(image, x, y)
        words = describe(soft, x, y, turn)
        found += [(float(px * scale), float(py * scale), float(sc), float(t), k, float(scale), *map(int, d)) for px, py, sc, t, d in zip(x, y, score[y, x], turn, words, strict=True)]
    return sorted(found, key=lambda r: (-r[2], r[4], r[1], r[0]))[:most]


def extract(images: DataFrame, most: int = 1000) -> DataFrame:
    """Keypoints of images(image, width, height, gray: binary)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in KEYPOINTS.split(", ")]
        for x in batches:
            rows = []
            for r in x.itertuples():
                a = np.frombuffer(r.gray, np.uint8).reshape(r.height, r.width)
                rows += [(r.image, k, *f) for k, f in enumerate(features(a, most))]
                if len(rows) >= 10_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return images.select("image", "width", "height", "gray").mapInPandas(run, KEYPOINTS)
