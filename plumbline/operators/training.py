"""Splat training: gradients of a view in numpy, parameters as rows, one Adam step for each view."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .splats import SH_C0

SPLAT = ["id", "x", "y", "z", "lx", "ly", "lz", "qx", "qy", "qz", "qw", "logit", "r", "g", "b"]


def _project(p: np.ndarray, pose: tuple, f: float, c: float) -> dict:
    r, t = pose
    local = p[:, :3] @ r.T + t
    z = np.maximum(local[:, 2], 1e-9)
    q = p[:, 6:10] / np.linalg.norm(p[:, 6:10], axis=1, keepdims=True)
    x, y, zz, w = q.T
    rot = np.stack([np.stack([1 - 2 * (y * y + zz * zz), 2 * (x * y - zz * w), 2 * (x * zz + y * w)], 1), np.stack([2 * (x * y + zz * w), 1 - 2 * (x * x + zz * zz), 2 * (y * zz - x * w)], 1), np.stack([2 * (x * zz - y * w), 2 * (y * zz + x * w), 1 - 2 * (x * x + y * y)], 1)], 1)
    m = rot * np.exp(p[:, None, 3:6])
    j = np.zeros((len(p), 2, 3))
    j[:, 0, 0] = j[:, 1, 1] = f / z
    j[:, 0, 2], j[:, 1, 2] = -f * local[:, 0] / z**2, -f * local[:, 1] / z**2
    a = j @ r @ m
    cov = a @ a.transpose(0, 2, 1) + 0.3 * np.eye(2)
    return {"uv": local[:, :2] / z[:, None] * f + c, "z": local[:, 2], "conic": np.linalg.inv(cov), "local": local, "j": j, "a": a, "m": m, "rot": rot}


def render(p: np.ndarray, pose: tuple, size: int, f: float) -> tuple[np.ndarray, dict]:
    """The image of splats p (columns of ``SPLAT`` without id) and what gradients need of it."""
    v = _project(p, pose, f, size / 2)
    order = np.argsort(v["z"], kind="stable")
    order = order[v["z"][order] >= 0.01]
    g = np.arange(size) + 0.5
    px = np.stack(np.meshgrid(g, g), -1).reshape(-1, 2)
    opacity = 1 / (1 + np.exp(-p[:, 10]))
    colour = np.maximum(SH_C0 * p[:, 11:14] + 0.5, 0)
    t, out, steps = np.ones(len(px)), np.zeros((len(px), 3)), []
    for i in order:
        d = px - v["uv"][i]
        power = -0.5 * np.einsum("ni,ij,nj->n", d, v["conic"][i], d)
        alpha = np.minimum(0.99, opacity[i] * np.exp(power))
        alpha = np.where((alpha >= 1 / 255) & (t >= 1e-4), alpha, 0.0)
        out += (t * alpha)[:, None] * colour[i]
        steps.append((i, d, power, alpha, t.copy()))
        t = t * (1 - alpha)
    return out.reshape(size, size, 3), {"view": v, "steps": steps, "opacity": opacity, "colour": colour}


def covariance_gradients(p: np.ndarray, pose: tuple, view: dict, conic_slope: np.ndarray, f: float) -> np.ndarray:
    """The slopes for position, log scale and rotation (columns as p) that come from slopes (n, 2, 2) of the conics.

    With A = J R M, M = rotation times scale, the covariance on the screen is
    A A' plus a constant, and the conic its inverse.  Position enters by J.
    """
    r, z, local = pose[0], view["z"], view["local"]
    conic, jac, m = view["conic"], view["j"], view["m"]
    slope = (conic_slope + conic_slope.transpose(0, 2, 1)) / 2
    by_a = -2 * conic @ slope @ conic @ view["a"]
    by_m = (jac @ r).transpose(0, 2, 1) @ by_a
    by_j = by_a @ (r @ m).transpose(0, 2, 1)
    zz = np.maximum(z, 1e-9)
    by_local = np.stack([
        -f / zz**2 * by_j[:, 0, 2],
        -f / zz**2 * by_j[:, 1, 2],
        -f / zz**2 * (by_j[:, 0, 0] + by_j[:, 1, 1]) + 2 * f / zz**3 * (local[:, 0] * by_j[:, 0, 2] + local[:, 1] * by_j[:, 1, 2]),
    ], 1)
    out = np.zeros_like(p)
    out[:, :3] = by_local @ r
    out[:, 3:6] = (by_m * m).sum(1)
    g = by_m * np.exp(p[:, None, 3:6])  # by the rotation's matrix
    size = np.linalg.norm(p[:, 6:10], axis=1, keepdims=True)
    x, y, k, w = (p[:, 6:10] / size).T
    # A rotation is 1 + 2 (w [v] + [v][v]): its slope splits into an antisymmetric part and a symmetric one.
    skew = np.stack([g[:, 2, 1] - g[:, 1, 2], g[:, 0, 2] - g[:, 2, 0], g[:, 1, 0] - g[:, 0, 1]], 1)
    v = np.stack([x, y, k], 1)
    sums = g + g.transpose(0, 2, 1)
    trace = np.trace(g, axis1=1, axis2=2)[:, None]
    by_q = np.concatenate([2 * w[:, None] * skew + 2 * np.einsum("nij,nj->ni", sums, v) - 4 * trace * v, 2 * (skew * v).sum(1, keepdims=True)], 1)
    unit = np.concatenate([v, w[:, None]], 1)
    out[:, 6:10] = (by_q - unit * (by_q * unit).sum(1, keepdims=True)) / size
    return out


def gradients(p: np.ndarray, pose: tuple, target: np.ndarray, f: float) -> tuple[np.ndarray, float]:
    """The mean squared error's slopes for all of p's columns, and the error."""
    size = target.shape[0]
    image, k = render(p, pose, size, f)
    diff = (image - target).reshape(-1, 3)
    up = 2 * diff / diff.size
    out, conics = np.zeros_like(p), np.zeros((len(p), 2, 2))
    behind = np.zeros_like(up)
    for i, d, _, alpha, t in reversed(k["steps"]):
        colour = k["colour"][i]
        out[i, 11:14] = (up * (t * alpha)[:, None]).sum(0) * SH_C0 * (SH_C0 * p[i, 11:14] + 0.5 > 0)
        slope = np.einsum("nc,nc->n", up, t[:, None] * colour - behind / np.maximum(1 - alpha, 1e-9)[:, None])
        slope = np.where((alpha > 0) & (alpha < 0.99), slope, 0.0)
        out[i, 10] = (slope * alpha).sum() * (1 - k["opacity"][i])
        power_slope = slope * alpha
        uv = (power_slope[:, None] * (d @ k["view"]["conic"][i])).sum(0)
        conics[i] = -0.5 * (power_slope[:, None] * d).T @ d
        out[i, :3] = uv @ k["view"]["j"][i] @ pose[0]
        behind += (t * alpha)[:, None] * colour
    return out + covariance_gradients(p, pose, k["view"], conics, f), float((diff**2).mean())


def train(splats: DataFrame, views: list[tuple], f: float, rounds: int, rate: float = 0.01, shapes: bool = False) -> DataFrame:
    """Cycles over views of (pose, target); positions, opacity and base colour move, with ``shapes`` scales and rotations too.

    A scene that one node can render is one group; larger scenes are cut into
    parts that train on their own.
    """
    schema = ", ".join(f"{c} {'long' if c == 'id' else 'double'}" for c in ["part", *SPLAT]).replace("part double", "part string") + ", losses array<double>"

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("id").reset_index(drop=True)
        p = x[SPLAT[1:]].to_numpy(float)
        m, v, losses = np.zeros_like(p), np.zeros_like(p), []
        moves = np.ones(p.shape[1], bool)
        moves[3:10] = shapes
        for k in range(rounds):
            g, loss = gradients(p, *views[k % len(views)], f)
            losses.append(loss)
            g[:, ~moves] = 0
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p -= rate * (m / (1 - 0.9 ** (k + 1))) / (np.sqrt(v / (1 - 0.999 ** (k + 1))) + 1e-15) * (np.abs(g).sum(0) > 0)
        x[SPLAT[1:]] = p
        x["losses"] = [losses] * len(x)
        return x[["part", *SPLAT, "losses"]]

    return splats.select("part", *SPLAT).groupBy("part").applyInPandas(run, schema)
