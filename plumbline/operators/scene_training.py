"""Splat scenes rendered and trained across tasks.

A view bins its splats to the tiles they reach, and Spark deals (tile, depth, id)
out by ranges, so a tile that holds a third of all splats is spread over as many
tasks as it needs.  A task cuts its sorted run into chunks of ``chunk`` splats of
one tile.  Blending is a prefix: chunks give the light they let through, a small
table of chunks for each tile adds up what enters each, then chunks give their
colour, and a suffix over the same small table what lies behind.  With both, a
chunk's slopes are its own affair; they are summed by splat id.

A chunk is the unit of memory: ``chunk`` splats times the pixels of a tile.  Per
tile only its chunks' rows of a few kilobytes come together.  Each round cuts
lineage with reliable checkpoints.

Defined results: splats behind the near plane, too faint for one step of an
8-bit channel, or outside the image add nothing and get no slope; splats of
equal depth blend in the order of their ids; a scene without splats renders
nothing and trains to itself; targets may cover part of the image, and only
what they cover counts; ids are unique and not null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import checkpointed
from .splats import SH_C0
from .training import SPLAT, _project, covariance_gradients

TILE = 16
_NEAR, _FAINT, _DARK, _MOST = 0.01, 1 / 255, 1e-4, 0.99
_LAYER = ["u", "v", "ca", "cb", "cc", "opacity", "r", "g", "b"]
_SLOPE = ["u", "v", "xx", "xy", "yy", "logit", "r", "g", "b"]


@dataclass(frozen=True)
class View:
    """A pinhole of one focal length whose axis meets the middle of a square image; r, t take the world to the camera."""

    r: np.ndarray
    t: np.ndarray
    f: float
    size: int


def _pack(*arrays: np.ndarray) -> bytes:
    return np.concatenate([np.asarray(a, np.float64).ravel() for a in arrays]).tobytes()


def _pixels(tile: int, size: int) -> np.ndarray:
    """The centres of a tile's pixels, also of those beyond the image's edge."""
    across = -(-size // TILE)
    g = np.arange(TILE) + 0.5
    return np.stack(np.meshgrid(g + tile % across * TILE, g + tile // across * TILE), -1).reshape(-1, 2)


def _front(p: np.ndarray, view: View) -> np.ndarray:
    return np.flatnonzero(p[:, :3] @ view.r[2] + view.t[2] >= _NEAR)


def _bin(state: DataFrame, view: View) -> DataFrame:
    """(tile, depth, id, and the columns of ``_LAYER``): a row for each tile that a splat reaches."""
    across = -(-view.size // TILE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            p = np.array(x["p"].tolist()).reshape(-1, len(SPLAT) - 1)
            front = _front(p, view)
            p, ids = p[front], x["id"].to_numpy()[front]
            seen = _project(p, (view.r, view.t), view.f, view.size / 2)
            opacity = 1 / (1 + np.exp(-p[:, 10]))
            cov = seen["a"] @ seen["a"].transpose(0, 2, 1) + 0.3 * np.eye(2)
            # Where alpha is a step of a channel or more: an ellipse, and its box is exact.
            far = np.sqrt(np.maximum(2 * np.log(np.maximum(opacity / _FAINT, 1e-300)), 0)[:, None] * cov[:, [0, 1], [0, 1]]) + 1e-9
            low = np.maximum(np.ceil(seen["uv"] - far - 0.5), 0)
            high = np.minimum(np.floor(seen["uv"] + far - 0.5), view.size - 1)
            k = np.flatnonzero((opacity >= _FAINT) & (low <= high).all(1))
            low, high = low[k].astype(np.int64) // TILE, high[k].astype(np.int64) // TILE
            n = high - low + 1
            of = np.repeat(np.arange(len(k)), n.prod(1))
            step = np.arange(len(of)) - np.repeat(np.cumsum(n.prod(1)) - n.prod(1), n.prod(1))
            tile = (low[of, 1] + step // n[of, 0]) * across + low[of, 0] + step % n[of, 0]
            i = k[of]
            colour = np.maximum(SH_C0 * p[i, 11:14] + 0.5, 0)
            layer = np.c_[seen["uv"][i], seen["conic"][i][:, [0, 0, 1], [0, 1, 1]], opacity[i], colour]
            yield pd.DataFrame({"tile": tile, "depth": seen["z"][i], "id": ids[i]} | dict(zip(_LAYER, layer.T, strict=True)))

    return state.select("id", "p").mapInPandas(run, "tile long, depth double, id long, " + ", ".join(f"{c} double" for c in _LAYER))


def _alpha(layer: np.ndarray, pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, offsets): of each layer at each pixel, nothing where it is fainter than a step."""
    d = pixels[None] - layer[:, None, :2]
    power = -0.5 * (layer[:, None, 2] * d[..., 0] ** 2 + layer[:, None, 4] * d[..., 1] ** 2) - layer[:, None, 3] * d[..., 0] * d[..., 1]
    a = np.minimum(_MOST, layer[:, None, 5] * np.exp(np.minimum(power, 0)))
    return np.where(a >= _FAINT, a, 0.0), d


def _through(alpha: np.ndarray, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, light before each layer) where layers in the dark are nothing."""
    before = enter * np.cumprod(np.concatenate([np.ones((1, alpha.shape[1])), 1 - alpha[:-1]]), 0)
    return np.where(before >= _DARK, alpha, 0.0), before


def _chunks(state: DataFrame, view: View, chunk: int) -> DataFrame:
    """(chunk, tile, ids, layers, light): chunks count up in the order of tile and depth; light is what passes all their layers."""
    parts = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = _bin(state, view).repartitionByRange(parts, "tile", "depth", "id").sortWithinPartitions("tile", "depth", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, rest = TaskContext.get().partitionId() << 40, None

        def made(x: pd.DataFrame) -> pd.DataFrame:
            nonlocal number
            number += 1
            layer, tile = x[_LAYER].to_numpy(float), int(x["tile"].iloc[0])
            light = np.prod(1 - _alpha(layer, _pixels(tile, view.size))[0], 0)
            return pd.DataFrame([[number, tile, x["id"].to_numpy(np.int64).tobytes(), layer.tobytes(), light.tobytes()]], columns=["chunk", "tile", "ids", "layers", "light"])

        for x in batches:
            x = x if rest is None else pd.concat([rest, x], ignore_index=True)
            tile = x["tile"].to_numpy()
            start = 0
            cuts = [*(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(x)]
            for end in cuts:
                while end - start >= chunk or end - start and end < len(x):
                    yield made(x.iloc[start : min(end, start + chunk)])
                    start = min(end, start + chunk)
            rest = x.iloc[start:]
        if rest is not None and len(rest):
            yield made(rest)

    return sorted_.mapInPandas(run, "chunk long, tile long, ids binary, layers binary, light binary")


def _enter(chunks: DataFrame) -> DataFrame:
    """(chunk, enter): the light that reaches each chunk."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("chunk")
        light = np.stack([np.frombuffer(b) for b in x["light"]])
        before = np.cumprod(np.concatenate([np.ones((1, light.shape[1])), light[:-1]]), 0)
        return pd.DataFrame({"chunk": x["chunk"].to_numpy(), "enter": [r.tobytes() for r in before]})

    return chunks.select("tile", "chunk", "light").groupBy("tile").applyInPandas(run, "chunk long, enter binary")


def _coloured(lit: DataFrame, size: int) -> DataFrame:
    """(chunk, tile, colour): what each chunk of lit(chunk, tile, layers, enter) adds to its pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for c, tile, layers, enter in zip(x["chunk"], x["tile"], x["layers"], x["enter"], strict=True):
                layer = np.frombuffer(layers).reshape(-1, len(_LAYER))
                alpha, before = _through(_alpha(layer, _pixels(tile, size))[0], np.frombuffer(enter))
                out.append((c, tile, ((before * alpha).T @ layer[:, 6:9]).tobytes()))
            yield pd.DataFrame(out, columns=["chunk", "tile", "colour"])

    return lit.select("chunk", "tile", "layers", "enter").mapInPandas(run, "chunk long, tile long, colour binary")


def _lit(state: DataFrame, view: View, chunk: int) -> DataFrame:
    chunks = checkpointed(_chunks(state, view, chunk))
    return chunks.drop("light").join(_enter(chunks), "chunk")


def _state(splats: DataFrame) -> DataFrame:
    return splats.select(F.col("id").cast("long").alias("id"), F.array(*(F.col(c).cast("double") for c in SPLAT[1:])).alias("p"))


def render(splats: DataFrame, view: View, chunk: int = 512) -> DataFrame:
    """(px, py, r, g, b) of splats(columns of ``SPLAT``): the pixels of all tiles that a splat reaches."""
    across = -(-view.size // TILE)

    def run(x: pd.DataFrame) -> pd.DataFrame:
        tile, colour = int(x["tile"].iloc[0]), np.sum([np.frombuffer(c) for c in x["colour"]], 0).reshape(-1, 3)
        k = np.arange(TILE * TILE)
        px, py = tile % across * TILE + k % TILE, tile // across * TILE + k // TILE
        inside = (px < view.size) & (py < view.size)
        return pd.DataFrame({"px": px[inside], "py": py[inside]} | dict(zip("rgb", colour[inside].T, strict=True)))

    coloured = _coloured(_lit(_state(splats), view, chunk), view.size)
    return coloured.groupBy("tile").applyInPandas(run, "px int, py int, r double, g double, b double")


def _targets(targets: DataFrame, views: list[View]) -> DataFrame:
    """(view, tile, pixels, count) of targets(view, px, py, r, g, b): a row of tile's pixels, not a number where none is known; count is over the view."""
    sizes = F.create_map(*(F.lit(x) for k, v in enumerate(views) for x in (k, -(-v.size // TILE))))
    inside = F.create_map(*(F.lit(x) for k, v in enumerate(views) for x in (k, v.size)))
    t = targets.where((F.col("view") < len(views)) & (F.col("px") >= 0) & (F.col("py") >= 0) & (F.col("px") < inside[F.col("view")]) & (F.col("py") < inside[F.col("view")]))
    t = t.withColumn("tile", F.floor(F.col("py") / TILE) * sizes[F.col("view")] + F.floor(F.col("px") / TILE))

    def run(x: pd.DataFrame) -> pd.DataFrame:
        pixels = np.full((TILE * TILE, 3), np.nan)
        pixels[x["py"] % TILE * TILE + x["px"] % TILE] = x[["r", "g", "b"]].to_numpy(float)
        return pd.DataFrame([[x["view"].iloc[0], x["tile"].iloc[0], pixels.tobytes()]], columns=["view", "tile", "pixels"])

    packed = t.groupBy("view", "tile").applyInPandas(run, "view int, tile long, pixels binary")
    count = t.groupBy("view").agg(F.count(F.lit(1)).alias("count"))
    return packed.join(F.broadcast(count), "view")  # a row a view


def _upstream(coloured: DataFrame, targets: DataFrame) -> DataFrame:
    """(chunk, up, behind, loss): a row for each chunk with the error's slope at its pixels and the colour behind it; of each tile one row carries its share of the loss."""

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("chunk")
        colour = np.stack([np.frombuffer(c).reshape(-1, 3) for c in x["colour"]]) if len(x) else np.zeros((0, TILE * TILE, 3))
        if not len(y):
            return pd.DataFrame(columns=["chunk", "up", "behind", "loss"])
        diff = np.nan_to_num(colour.sum(0) - np.frombuffer(y["pixels"].iloc[0]).reshape(-1, 3))
        n = 3 * int(y["count"].iloc[0])
        up = (2 * diff / n).tobytes()
        behind = colour[::-1].cumsum(0)[::-1] - colour
        rows = [(c, up, b.tobytes(), 0.0) for c, b in zip(x["chunk"], behind, strict=True)]
        return pd.DataFrame([*rows, (-1, None, None, float((diff**2).sum()) / n)], columns=["chunk", "up", "behind", "loss"])

    return coloured.groupBy("tile").cogroup(targets.groupBy("tile")).applyInPandas(run, "chunk long, up binary, behind binary, loss double")


def _slopes(lit: DataFrame, up: DataFrame, size: int) -> DataFrame:
    """(id, and the columns of ``_SLOPE``): slopes by place on the screen, conic, logit and colour, summed over all chunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for r in x.itertuples():
                layer = np.frombuffer(r.layers).reshape(-1, len(_LAYER))
                alpha, d = _alpha(layer, _pixels(r.tile, size))
                alpha, before = _through(alpha, np.frombuffer(r.enter))
                up, behind = np.frombuffer(r.up).reshape(-1, 3), np.frombuffer(r.behind).reshape(-1, 3)
                weight, colour = before * alpha, layer[:, 6:9]
                to_colour = weight @ up
                # What one layer hides of the light behind it, seen through the error's slope.
                mine = colour @ up.T
                later = (weight * mine)[::-1].cumsum(0)[::-1] - weight * mine + (behind * up).sum(1)
                slope = np.where((alpha > 0) & (alpha < _MOST), before * mine - later / np.maximum(1 - alpha, 1e-9), 0.0) * alpha
                conic = layer[:, 2:5]
                du, dv = d[..., 0], d[..., 1]
                out = np.c_[
                    (slope * (conic[:, :1] * du + conic[:, 1:2] * dv)).sum(1), (slope * (conic[:, 1:2] * du + conic[:, 2:] * dv)).sum(1),
                    -0.5 * (slope * du * du).sum(1), -0.5 * (slope * du * dv).sum(1), -0.5 * (slope * dv * dv).sum(1),
                    slope.sum(1) * (1 - layer[:, 5]), to_colour * SH_C0 * (colour > 0),
                ]
                yield pd.DataFrame({"id": np.frombuffer(r.ids, np.int64)} | dict(zip(_SLOPE, out.T, strict=True)))

    columns = ", ".join(f"{c} double" for c in _SLOPE)
    each = lit.join(up.select("chunk", "up", "behind"), "chunk").mapInPandas(run, f"id long, {columns}")
    return each.groupBy("id").agg(*(F.sum(c).alias(c) for c in _SLOPE))


def _world_slopes(p: np.ndarray, screen: np.ndarray, view: View) -> np.ndarray:
    """The slopes for all columns of p that come from those on the screen."""
    whole, front = np.zeros_like(p), _front(p, view)
    p, screen = p[front], screen[front]
    seen = _project(p, (view.r, view.t), view.f, view.size / 2)
    conics = screen[:, [2, 3, 3, 4]].reshape(-1, 2, 2)
    out = covariance_gradients(p, (view.r, view.t), seen, conics, view.f)
    out[:, :3] += np.einsum("ni,nij->nj", screen[:, :2], seen["j"]) @ view.r
    out[:, 10] = screen[:, 5]
    out[:, 11:14] = screen[:, 6:9]
    whole[front] = out
    return whole


def gradients(splats: DataFrame, view: View, targets: DataFrame, chunk: int = 512) -> tuple[DataFrame, float]:
    """((id, slope: array by column of ``SPLAT``), mean squared error) against targets(px, py, r, g, b)."""
    packed = _targets(targets.withColumn("view", F.lit(0)), [view])
    state = checkpointed(_state(splats))
    slopes, loss = _round(state, view, packed, chunk)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            p = np.array(x["p"].tolist()).reshape(-1, len(SPLAT) - 1)
            yield pd.DataFrame({"id": x["id"], "slope": list(_world_slopes(p, x[_SLOPE].to_numpy(float), view))})

    return state.join(slopes, "id").mapInPandas(run, "id long, slope array<double>"), loss


def _round(state: DataFrame, view: View, targets: DataFrame, chunk: int) -> tuple[DataFrame, float]:
    lit = _lit(state, view, chunk)
    up = checkpointed(_upstream(_coloured(lit, view.size), targets))
    return _slopes(lit, up.where("chunk >= 0"), view.size), float(up.agg(F.coalesce(F.sum("loss"), F.lit(0.0))).first()[0])


def train(splats: DataFrame, views: list[View], targets: DataFrame, rounds: int, rate: float = 0.01, shapes: bool = False, chunk: int = 512) -> tuple[DataFrame, list[float]]:
    """((id, and the columns of ``SPLAT``), the loss before each round).

    A round takes one view after the other, and one step of Adam; positions,
    opacity and base colour move, with ``shapes`` scales and rotations too.
    targets(view, px, py, r, g, b) has colours in 0..1, ``view`` as its number in
    ``views``.  A splat that a view doesn't show steps by its momentum alone.
    """
    n = len(SPLAT) - 1
    moves = np.ones(n, bool)
    moves[3:10] = shapes
    targets = checkpointed(_targets(targets, views))
    zero = F.array_repeat(F.lit(0.0), n)
    state, losses = checkpointed(_state(splats).withColumns({"m": zero, "s": zero})), []
    for k in range(rounds):
        view = views[k % len(views)]
        slopes, loss = _round(state, view, targets.where(F.col("view") == k % len(views)), chunk)
        losses.append(loss)

        def step(batches: Iterator[pd.DataFrame], k=k, view=view) -> Iterator[pd.DataFrame]:
            for x in batches:
                p, m, s = (np.array(x[c].tolist()).reshape(-1, n) for c in ("p", "m", "s"))
                g = np.where(moves, _world_slopes(p, x[_SLOPE].to_numpy(float), view), 0.0)
                m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
                p = p - rate * (m / (1 - 0.9 ** (k + 1))) / (np.sqrt(s / (1 - 0.999 ** (k + 1))) + 1e-15)
                yield pd.DataFrame({"id": x["id"], "p": list(p), "m": list(m), "s": list(s)})

        joined = state.join(slopes, "id", "left").na.fill(0.0, _SLOPE)
        state = checkpointed(joined.mapInPandas(step, "id long, p array<double>, m array<double>, s array<double>"))
    return state.select("id", *(F.col("p")[i].alias(c) for i, c in enumerate(SPLAT[1:]))), losses
