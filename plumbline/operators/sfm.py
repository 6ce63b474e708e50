"""Structure from motion: essential matrices, triangulation, resection, bundle adjustment.

Small solvers run in numpy, one pair or one view for a group.  Bundle adjustment is
in ``adjustment``.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .images import XorShift


def normalised(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points moved to their mean and scaled to a mean distance of the root of two, and the matrix that does it."""
    c = p.mean(0)
    s = np.sqrt(2) / max(np.linalg.norm(p - c, axis=1).mean(), 1e-12)
    return (p - c) * s, np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])


def homogeneous(p: np.ndarray) -> np.ndarray:
    return np.c_[p, np.ones(len(p))]


def to_essential(e: np.ndarray) -> np.ndarray:
    u, s, v = np.linalg.svd(e)
    k = (s[0] + s[1]) / 2
    return u @ np.diag([k, k, 0]) @ v


def essential(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Eight points or more to b' E a = 0, of unit size, and how well the points fix it (0 to 1).

    Below 1e-9 the points are degenerate.
    """
    if len(a) < 8:
        raise ValueError("an essential matrix needs eight points")
    (na, ta), (nb, tb) = normalised(a), normalised(b)
    rows = np.einsum("ni,nj->nij", homogeneous(nb), homogeneous(na)).reshape(len(a), 9)
    values, vectors = np.linalg.eigh(rows.T @ rows)
    e = to_essential(tb.T @ vectors[:, 0].reshape(3, 3) @ ta)
    return e / max(np.linalg.norm(e), 1e-300), float(max(values[1], 0) / max(values[-1], 1e-300))


def sampson(e: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared first-order distances."""
    ha, hb = homogeneous(a), homogeneous(b)
    ea, eb = ha @ e.T, hb @ e
    top = np.einsum("ni,ni->n", hb, ea) ** 2
    below = ea[:, 0] ** 2 + ea[:, 1] ** 2 + eb[:, 0] ** 2 + eb[:, 1] ** 2
    return np.where(below > 0, top / np.where(below > 0, below, 1), np.inf)


def essentials(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``essential`` of many draws (draw, point, xy) at once."""

    def moved(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = p.mean(1)
        s = np.sqrt(2) / np.maximum(np.linalg.norm(p - c[:, None], axis=2).mean(1), 1e-12)
        m = np.zeros((len(p), 3, 3))
        m[:, 0, 0], m[:, 1, 1], m[:, 2, 2] = s, s, 1
        m[:, :2, 2] = -s[:, None] * c
        return np.concatenate([(p - c[:, None]) * s[:, None, None], np.ones((*p.shape[:2], 1))], 2), m

    (ha, ta), (hb, tb) = moved(a), moved(b)
    rows = np.einsum("mni,mnj->mnij", hb, ha).reshape(*a.shape[:2], 9)
    values, vectors = np.linalg.eigh(rows.transpose(0, 2, 1) @ rows)
    u, s, v = np.linalg.svd(tb.transpose(0, 2, 1) @ vectors[:, :, 0].reshape(-1, 3, 3) @ ta)
    k = (s[:, 0] + s[:, 1]) / 2
    e = u @ (np.stack([k, k, 0 * k], 1)[:, :, None] * v)
    return e / np.maximum(np.linalg.norm(e, axis=(1, 2)), 1e-300)[:, None, None], np.maximum(values[:, 1], 0) / np.maximum(values[:, -1], 1e-300)


def triangulate(poses: list[tuple[np.ndarray, np.ndarray]], points: np.ndarray) -> np.ndarray | None:
    """One point of two views or more; poses are (R, t) of world to camera."""
    rows = []
    for (r, t), (x, y) in zip(poses, points, strict=True):
        p = np.c_[r, t]
        rows += [x * p[2] - p[0], y * p[2] - p[1]]
    h = np.linalg.svd(np.array(rows))[2][-1]
    return None if abs(h[3]) < 1e-12 else h[:3] / h[3]


def triangulate_all(one: np.ndarray, two: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``triangulate`` of points that two views (R | t) see at a and b; not numbers where there is none."""
    rows = np.stack([p[:, k, None] * m[2] - m[k] for p, m in ((a, one), (b, two)) for k in (0, 1)], 1)
    h = np.linalg.svd(rows)[2][:, -1]
    known = np.abs(h[:, 3:]) >= 1e-12
    return np.where(known, h[:, :3] / np.where(known, h[:, 3:], 1), np.nan)


def decompose(e: np.ndarray, a: np.ndarray, b: np.ndarray, least: float = 0.6) -> tuple[np.ndarray, np.ndarray] | None:
    """The (R, t) of four that has the points in front of both cameras; none if too few are."""
    u, _, v = np.linalg.svd(e)
    u, v = u * np.sign(np.linalg.det(u)), v * np.sign(np.linalg.det(v))
    w = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1]], float)
    best = (0, None)
    for r in (u @ w @ v, u @ w.T @ v):
        for t in (u[:, 2], -u[:, 2]):
            x = triangulate_all(np.c_[np.eye(3), np.zeros(3)], np.c_[r, t], a, b)
            front = int(((x[:, 2] > 0) & ((x @ r.T + t)[:, 2] > 0)).sum())
            if front > best[0]:
                best = (front, (r, t))
    return best[1] if best[1] is not None and best[0] >= least * len(a) else None


@lru_cache(maxsize=256)
def _draws(n: int, rounds: int, seed: int) -> np.ndarray:
    """Eight of n numbers for each round; a round that doesn't come to eight in a hundred tries is left out."""
    rng, out = XorShift(seed), []
    for _ in range(rounds):
        draw: dict[int, None] = {}
        for _ in range(100):
            draw[rng.next() % n] = None
            if len(draw) == 8:
                break
        if len(draw) == 8:
            out.append(list(draw))
    return np.array(out, int).reshape(-1, 8)


def ransac_essential(a: np.ndarray, b: np.ndarray, threshold: float, rounds: int = 512, seed: int = 0x9E3779B9) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(E, inlier numbers, conditioning): best of seeded eight-point draws, fitted again to its inliers."""
    n = len(a)
    if n < 8:
        return None
    best, draws, size = np.zeros(0, int), _draws(n, rounds, seed), max(1, 200_000 // n)
    for k in range(0, len(draws), size):
        i = draws[k : k + size]
        e, good = essentials(a[i], b[i])
        ea, eb = homogeneous(a) @ e.transpose(0, 2, 1), homogeneous(b) @ e
        top = (homogeneous(b) * ea).sum(2) ** 2
        below = ea[..., 0] ** 2 + ea[..., 1] ** 2 + eb[..., 0] ** 2 + eb[..., 1] ** 2
        fits = (below > 0) & (np.where(below > 0, top / np.where(below > 0, below, 1), np.inf) < threshold * threshold) & (good >= 1e-9)[:, None]
        count = fits.sum(1)
        if count.max() > len(best):
            best = np.flatnonzero(fits[count.argmax()])
    if len(best) < 8:
        return None
    e, good = essential(a[best], b[best])
    again = np.flatnonzero(sampson(e, a, b) < threshold * threshold)
    return e, again if len(again) >= len(best) else best, good


PAIR = "pair string, inliers long, ratio double, conditioning double, e array<double>, r array<double>, t array<double>"


def verify_pairs(matches: DataFrame, threshold: float | None, rounds: int = 512) -> DataFrame:
    """Relative poses per pair of matches(pair, a, b, ax, ay, bx, by), in normalised coordinates.

    Without a threshold each pair's is that of its column ``threshold``.
    """

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["a", "b"])
        a, b = x[["ax", "ay"]].to_numpy(float), x[["bx", "by"]].to_numpy(float)
        got = ransac_essential(a, b, float(x["threshold"].iloc[0]) if threshold is None else threshold, rounds)
        if got is None:
            return pd.DataFrame()
        e, fit, good = got
        pose = decompose(e, a[fit], b[fit])
        return pd.DataFrame([[x["pair"].iloc[0], len(fit), len(fit) / len(x), good, e.ravel().tolist(), pose[0].ravel().tolist() if pose else None, pose[1].tolist() if pose else None]], columns=["pair", "inliers", "ratio", "conditioning", "e", "r", "t"])

    return matches.groupBy("pair").applyInPandas(run, PAIR)


def orthogonal(m: np.ndarray) -> np.ndarray | None:
    """The nearest rotation; none for what has no volume."""
    u, s, v = np.linalg.svd(m)
    if s[2] < 1e-3 * s[0]:
        return None
    return u @ np.diag([1, 1, np.sign(np.linalg.det(u @ v))]) @ v


def pnp_dlt(world: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(R, t) of six points or more in normalised coordinates."""
    if len(world) < 6:
        return None
    c = world.mean(0)
    s = np.sqrt(3) / max(np.linalg.norm(world - c, axis=1).mean(), 1e-12)
    h = homogeneous((world - c) * s)
    z = np.zeros_like(h)
    rows = np.concatenate([np.c_[h, z, -image[:, :1] * h], np.c_[z, h, -image[:, 1:] * h]])
    p = np.linalg.eigh(rows.T @ rows)[1][:, 0].reshape(3, 4)
    p = np.c_[p[:, :3] * s, p[:, 3] - p[:, :3] @ c * s]
    k = np.cbrt(np.linalg.det(p[:, :3]))
    if abs(k) < 1e-12:
        return None
    r = orthogonal(p[:, :3] / k)
    return None if r is None else (r, p[:, 3] / k)


def exp_so3(w: np.ndarray) -> np.ndarray:
    angle = np.linalg.norm(w)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    if angle < 1e-12:
        return np.eye(3) + k
    return np.eye(3) + np.sin(angle) / angle * k + (1 - np.cos(angle)) / angle**2 * k @ k


def reprojection(world: np.ndarray, image: np.ndarray, r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Distances in the image; infinite behind the camera."""
    p = world @ r.T + t
    ok = p[:, 2] > 1e-9
    out = np.full(len(p), np.inf)
    out[ok] = np.linalg.norm(p[ok, :2] / p[ok, 2:] - image[ok], axis=1)
    return out


def _camera_jacobian(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of x / z and y / z to the point in camera space, and to a small turn and move of the camera."""
    x, y, z = p.T
    o = np.zeros_like(z)
    j = np.stack([np.stack([1 / z, o, -x / z**2], 1), np.stack([o, 1 / z, -y / z**2], 1)], 1)
    skew = np.stack([np.stack([o, z, -y], 1), np.stack([-z, o, x], 1), np.stack([y, -x, o], 1)], 1)
    return j, np.concatenate([j @ skew, j], 2)


def refine_pnp(world: np.ndarray, image: np.ndarray, r: np.ndarray, t: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Newton that takes a step only if it is better."""
    rms = lambda r, t: float(np.sqrt((reprojection(world, image, r, t) ** 2).mean()))
    now = rms(r, t)
    for _ in range(rounds):
        p = world @ r.T + t
        if (p[:, 2] <= 1e-9).any():
            break
        _, j = _camera_jacobian(p)
        e = (p[:, :2] / p[:, 2:] - image).reshape(-1)
        j = j.reshape(-1, 6)
        try:
            d = -np.linalg.solve(j.T @ j, j.T @ e)
        except np.linalg.LinAlgError:
            break
        turn = exp_so3(d[:3])
        nr, nt = turn @ r, turn @ t + d[3:]
        new = rms(nr, nt)
        if not new < now:
            break
        small = now - new < 1e-14
        r, t, now = nr, nt, new
        if small:
            break
    return r, t


def pnp_ransac(world: np.ndarray, image: np.ndarray, threshold: float = 0.004, rounds: int = 500, seed: int = 0x9E3779B9) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    n = len(world)
    if n < 6:
        return None
    rng, best = XorShift(seed), np.zeros(0, int)
    for _ in range(rounds):
        draw: dict[int, None] = {}
        while len(draw) < 6:
            draw[rng.next() % n] = None
        i = np.array(list(draw))
        got = pnp_dlt(world[i], image[i])
        if got is None:
            continue
        fit = np.flatnonzero(reprojection(world, image, *got) < threshold)
        if len(fit) > len(best):
            best = fit
            if len(best) == n:
                break
    if len(best) < 6 or (got := pnp_dlt(world[best], image[best])) is None:
        return None
    r, t = refine_pnp(world[best], image[best], *got)
    return r, t, np.flatnonzero(reprojection(world, image, r, t) < threshold)


def solve_views(observations: DataFrame, threshold: float = 0.004) -> DataFrame:
    """A pose for each view of observations(view, wx, wy, wz, x, y)."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["wx", "wy", "wz"])
        got = pnp_ransac(x[["wx", "wy", "wz"]].to_numpy(float), x[["x", "y"]].to_numpy(float), threshold)
        if got is None:
            return pd.DataFrame()
        return pd.DataFrame([[x["view"].iloc[0], got[0].ravel().tolist(), got[1].tolist(), len(got[2])]], columns=["view", "r", "t", "inliers"])

    return observations.groupBy("view").applyInPandas(run, "view string, r array<double>, t array<double>, inliers long")


def bundle_adjust(cameras: dict[int, tuple[np.ndarray, np.ndarray]], fixed: set[int], points: DataFrame, observations: DataFrame, rounds: int = 10, huber: float = 0.01, damping: float = 1e-3) -> tuple[dict, DataFrame, list[float]]:
    """``adjustment.adjust``: points(pt, x, y, z) and observations(cam, pt, x, y, weight) are tables, cameras a mapping."""
    from .adjustment import adjust

    return adjust(cameras, fixed, points, observations, rounds, huber, damping)
