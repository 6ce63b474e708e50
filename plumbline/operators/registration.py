"""Rigid registration of point pairs: Horn, gravity-constrained, outliers, placement.

Pairs are rows of (group, id, px, py, pz, qx, qy, qz, sigma): p observed, q in
the project.  Sums are Spark aggregates; only the 4 x 4 eigenproblem of Horn's
method runs in numpy, once for each group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_P, _Q = ("px", "py", "pz"), ("qx", "qy", "qz")
RIGID = "group string, n long, r00 double, r01 double, r02 double, r10 double, r11 double, r12 double, r20 double, r21 double, r22 double, tx double, ty double, tz double, scale double, rms double, max_error double"


def weight() -> Column:
    """One over sigma squared; one where sigma is unknown or not positive."""
    s = F.col("sigma")
    return F.when(s > 0, 1 / F.when(s > 0, s * s)).otherwise(1.0)


def weighted_centroid(pairs: DataFrame, by: str = "group") -> DataFrame:
    w = weight()
    return pairs.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *((F.sum(w * F.col(c)) / F.sum(w)).alias(f"c{c}") for c in (*_P, *_Q)))


def cross_covariance(pairs: DataFrame, by: str = "group") -> DataFrame:
    """The nine weighted sums of centred products, in one aggregation of raw moments."""
    w = weight()
    sums = [F.sum(w).alias("w"), F.count(F.lit(1)).alias("n")]
    sums += [F.sum(w * F.col(c)).alias(f"s{c}") for c in (*_P, *_Q)]
    sums += [F.sum(w * F.col(a) * F.col(b)).alias(f"m{a}{b}") for a in _P for b in _Q]
    got = pairs.groupBy(by).agg(*sums)
    return got.select(by, "n", *((F.col(f"m{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}") / F.col("w")).alias(f"s_{a[1]}{b[1]}") for a in _P for b in _Q))


def horn(p: np.ndarray, q: np.ndarray, w: np.ndarray, scale: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """The rotation, translation and scale of least weighted squares."""
    if len(p) < 3:
        raise ValueError("a rigid solution needs three pairs")
    cp, cq = (w @ p) / w.sum(), (w @ q) / w.sum()
    a, b = p - cp, q - cq
    far = np.linalg.norm(a, axis=1)
    axis = a[far.argmax()] / max(far.max(), 1e-300)
    if np.linalg.norm(np.cross(a, axis), axis=1).max() < 1e-3 * far.max():
        raise ValueError("the points lie on a line")
    s = (a * w[:, None]).T @ b
    (xx, xy, xz), (yx, yy, yz), (zx, zy, zz) = s
    n = np.array([[xx + yy + zz, yz - zy, zx - xz, xy - yx], [yz - zy, xx - yy - zz, xy + yx, zx + xz], [zx - xz, xy + yx, yy - xx - zz, yz + zy], [xy - yx, zx + xz, yz + zy, zz - xx - yy]])
    qw, qx, qy, qz = np.linalg.eigh(n)[1][:, -1]
    r = np.array([[1 - 2 * (qy * qy + qz * qz), 2 * (qx * qy - qz * qw), 2 * (qx * qz + qy * qw)], [2 * (qx * qy + qz * qw), 1 - 2 * (qx * qx + qz * qz), 2 * (qy * qz - qx * qw)], [2 * (qx * qz - qy * qw), 2 * (qy * qz + qx * qw), 1 - 2 * (qx * qx + qy * qy)]])
    k = float(np.sum(w[:, None] * b * (a @ r.T)) / np.sum(w[:, None] * a * a)) if scale else 1.0
    return r, cq - k * r @ cp, k


def _rms_without(p: np.ndarray, q: np.ndarray, w: np.ndarray, scale: bool) -> np.ndarray:
    """The error of the rest when each pair in turn is left out; not a number where the rest has no solution.

    Moments about the common centre lose one pair's share each; the eigenvectors
    of all of them come at once, and so do the errors: each solution is the common
    one and a small change, so its squares are sums of moments of the common
    residuals, which lose no digits.  Only where the rest may lie on a line are
    its points looked at one by one.
    """
    p, q = p - (w @ p) / w.sum(), q - (w @ q) / w.sum()
    total = w.sum() - w
    cp, cq = (w @ p - w[:, None] * p) / total[:, None], (w @ q - w[:, None] * q) / total[:, None]
    s = (p * w[:, None]).T @ q - np.einsum("i,ij,ik->ijk", w, p, q) - total[:, None, None] * cp[:, :, None] * cq[:, None, :]
    (xx, xy, xz), (yx, yy, yz), (zx, zy, zz) = np.moveaxis(s, 0, 2)
    n = np.stack([xx + yy + zz, yz - zy, zx - xz, xy - yx, yz - zy, xx - yy - zz, xy + yx, zx + xz, zx - xz, xy + yx, yy - xx - zz, yz + zy, xy - yx, zx + xz, yz + zy, zz - xx - yy], 1).reshape(-1, 4, 4)
    qw, qx, qy, qz = np.linalg.eigh(n)[1][:, :, -1].T
    r = np.stack([1 - 2 * (qy * qy + qz * qz), 2 * (qx * qy - qz * qw), 2 * (qx * qz + qy * qw), 2 * (qx * qy + qz * qw), 1 - 2 * (qx * qx + qz * qz), 2 * (qy * qz - qx * qw), 2 * (qx * qz - qy * qw), 2 * (qy * qz + qx * qw), 1 - 2 * (qx * qx + qy * qy)], 1).reshape(-1, 3, 3)
    outer, rest = (lambda x, y: np.einsum("ij,ik->ijk", x, y)), len(p) - 1
    r0, _, k0 = horn(p, q, w, scale)
    turned = k0 * p @ r0.T
    d = turned - q
    k = np.full(len(p), 1.0)
    if scale:
        k = np.einsum("ijk,ikj->i", r, s) / ((w * (p**2).sum(1)).sum() - w * (p**2).sum(1) - total * (cp**2).sum(1))
    change = k[:, None, None] / k0 * (r @ r0.T) - np.eye(3)
    ct = k0 * cp @ r0.T
    cd = ct - cq

    def moments(x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
        """Of all but one, about the centre of all but that one."""
        return x.T @ y - outer(x, y) - outer(x.sum(0) - x, cy) - outer(cx, y.sum(0) - y) + rest * outer(cx, cy)

    f = np.einsum("ijk,ikl,ijl->i", change, moments(turned, turned, ct, ct), change) + 2 * np.einsum("ijk,ikj->i", change, moments(turned, d, ct, cd)) + np.einsum("ijj->i", moments(d, d, cd, cd))
    out = np.sqrt(np.maximum(f, 0) / rest)
    # Squared distances from any line through the centre add up to this much at least.
    spread = np.linalg.eigvalsh(moments(p, p, cp, cp))
    reach = np.linalg.norm(p, axis=1).max() + np.linalg.norm(cp, axis=1)
    thin, size = np.flatnonzero(spread[:, 0] + spread[:, 1] <= rest * 1.01e-6 * reach**2), max(1, 200_000 // len(p))
    for i in range(0, len(thin), size):
        rows = thin[i : i + size]
        others = rows[:, None] != np.arange(len(p))
        a = p - cp[rows, None]
        far = np.where(others, np.linalg.norm(a, axis=2), -1.0)
        axis = a[np.arange(len(rows)), far.argmax(1)] / np.maximum(far.max(1), 1e-300)[:, None]
        off = np.where(others, np.linalg.norm(np.cross(a, axis[:, None]), axis=2), -1.0)
        out[rows[off.max(1) < 1e-3 * far.max(1)]] = np.nan
    return out


def _errors(p, q, r, t, k) -> np.ndarray:
    return np.linalg.norm(k * p @ r.T + t - q, axis=1)


def _arrays(x: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sigma = x["sigma"].to_numpy(float)
    w = np.where(sigma > 0, 1 / np.where(sigma > 0, sigma, 1) ** 2, 1.0)
    return x[list(_P)].to_numpy(float), x[list(_Q)].to_numpy(float), w


def solve_rigid(pairs: DataFrame, scale: bool = False) -> DataFrame:
    """Horn's solution per group; groups without one are left out.

    Control networks have tens of points, so a group fits its task.
    """

    def run(x: pd.DataFrame) -> pd.DataFrame:
        p, q, w = _arrays(x.sort_values("id"))
        try:
            r, t, k = horn(p, q, w, scale)
        except ValueError:
            return pd.DataFrame()
        e = _errors(p, q, r, t, k)
        return pd.DataFrame([[x["group"].iloc[0], len(x), *r.ravel(), *t, k, float(np.sqrt((e**2).mean())), float(e.max())]], columns=[c.split()[0] for c in RIGID.split(", ")])

    return pairs.groupBy("group").applyInPandas(run, RIGID)


def apply_rigid(p: Column, s: Column) -> Column:
    """scale * R p + t of a row of ``solve_rigid``, as a struct of x, y and z."""
    from ..functions.vectors import vec

    return vec(*(s["scale"] * sum((s[f"r{i}{j}"] * p[a] for j, a in enumerate("xyz")), F.lit(0.0)) + s[f"t{'xyz'[i]}"] for i in range(3)))


OUTLIERS = "group string, id string, error double, score double, rms_without double, influence double, by_mad boolean, by_influence boolean"


def find_outliers(pairs: DataFrame, mad: float = 3.5, influence: float = 3.0, scale: bool = False) -> DataFrame:
    """Pairs whose residual stands out, or whose removal makes the rest fit; most influential first in each group.

    Median and deviation take the upper of two middle values.  A removal that
    leaves no solution counts as no change.
    """

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("id").reset_index(drop=True)
        p, q, w = _arrays(x)
        try:
            e = _errors(p, q, *horn(p, q, w, scale))
        except ValueError:
            return pd.DataFrame()
        rms, upper = float(np.sqrt((e**2).mean())), lambda v: float(np.sort(v)[len(v) // 2])
        middle = upper(e)
        spread = upper(np.abs(e - middle))
        without = _rms_without(p, q, w, scale) if len(x) >= 4 else np.full(len(x), np.nan)
        score = np.zeros(len(x)) if spread < 1e-12 else np.abs(e - middle) / (1.4826 * spread)
        left = np.where(np.isnan(without), rms, without)
        by = np.where(left > 1e-12, rms / np.maximum(left, 1e-300), 1.0)
        at = np.flatnonzero((score > mad) | (by > influence))
        at = at[np.lexsort((-score[at], -by[at]))]
        found = (x["group"].to_numpy()[at], x["id"].to_numpy()[at], e[at], score[at], left[at], by[at], score[at] > mad, by[at] > influence)
        return pd.DataFrame(dict(zip([c.split()[0] for c in OUTLIERS.split(", ")], found, strict=True)))

    return pairs.groupBy("group").applyInPandas(run, OUTLIERS)


def solve_gravity(pairs: DataFrame) -> DataFrame:
    """Level registration per group: a heading about z and a translation, in one aggregation.

    Groups with fewer than two pairs, or without horizontal extent, are left out.
    """
    w = weight()
    sums = {"w": w, **{f"s{c}": w * F.col(c) for c in (*_P, *_Q)}}
    sums |= {f"m{a}{b}": w * F.col(a) * F.col(b) for a in ("px", "py") for b in ("qx", "qy")}
    sums |= {f"m{a}{a}": w * F.col(a) * F.col(a) for a in ("px", "py")}
    got = pairs.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(k) for k, c in sums.items()))
    m = lambda a, b: F.col(f"m{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}") / F.col("w")
    got = got.withColumn("extent", m("px", "px") + m("py", "py")).where("n >= 2 and extent > 1e-12 * w")
    got = got.withColumn("heading", F.atan2(m("px", "qy") - m("py", "qx"), m("px", "qx") + m("py", "qy")))
    c, s = F.cos("heading"), F.sin("heading")
    mean = lambda k: F.col(f"s{k}") / F.col("w")
    return got.select("group", "n", "heading", (mean("qx") - (c * mean("px") - s * mean("py"))).alias("tx"), (mean("qy") - (s * mean("px") + c * mean("py"))).alias("ty"), (mean("qz") - mean("pz")).alias("tz"))


def gravity_residuals(pairs: DataFrame, solution: DataFrame) -> DataFrame:
    got = pairs.join(solution.drop("n"), "group")
    c, s = F.cos("heading"), F.sin("heading")
    dx = c * F.col("px") - s * F.col("py") + F.col("tx") - F.col("qx")
    dy = s * F.col("px") + c * F.col("py") + F.col("ty") - F.col("qy")
    dz = F.col("pz") + F.col("tz") - F.col("qz")
    return got.select("group", "id", F.sqrt(dx * dx + dy * dy + dz * dz).alias("error"))


def solve_best(pairs: DataFrame, force_gravity: bool = False) -> DataFrame:
    """(group, method, n, rms): Horn from three pairs on, else the level solution."""
    size = Window.partitionBy("group")
    counted = pairs.withColumn("_n", F.count(F.lit(1)).over(size))
    few = counted.where(F.lit(force_gravity) | (F.col("_n") < 3)).drop("_n")
    many = counted.where(~F.lit(force_gravity) & (F.col("_n") >= 3)).drop("_n")
    level = gravity_residuals(few, solve_gravity(few)).groupBy("group").agg(F.lit("gravity").alias("method"), F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rms"))
    return solve_rigid(many).select("group", F.lit("horn").alias("method"), "n", "rms").unionByName(level)


def redundancy_guidance(n: Column) -> Column:
    return F.when(n < 2, "too few pairs for a solution").when(n == 2, "solved without redundancy: errors cannot show").when(n == 3, "one spare pair: an error shows but cannot be placed").otherwise("redundant: a single bad pair can be found")


def hand_placement(anchors: DataFrame) -> DataFrame:
    """Yaw about the y axis and translation by least squares, per group of (px, py, pz) to (qx, qy, qz)."""
    sums = {f"s{c}": F.col(c) for c in (*_P, *_Q)} | {f"m{a}{b}": F.col(a) * F.col(b) for a in ("px", "pz") for b in ("qx", "qz")} | {f"m{a}{a}": F.col(a) * F.col(a) for a in ("px", "pz")}
    got = anchors.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(k) for k, c in sums.items()))
    m = lambda a, b: F.col(f"m{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}") / F.col("n")
    known = m("px", "px") + m("pz", "pz") > 1e-9
    got = got.withColumn("determined", known & (F.col("n") >= 2))
    got = got.withColumn("yaw", F.when(F.col("determined"), F.atan2(m("pz", "qx") - m("px", "qz"), m("px", "qx") + m("pz", "qz"))).otherwise(0.0))
    c, s = F.cos("yaw"), F.sin("yaw")
    mean = lambda k: F.col(f"s{k}") / F.col("n")
    return got.select("group", "n", "determined", "yaw", (mean("qx") - (c * mean("px") + s * mean("pz"))).alias("tx"), (mean("qy") - mean("py")).alias("ty"), (mean("qz") - (-s * mean("px") + c * mean("pz"))).alias("tz"))


def nudge(p: Column, pivot: Column, yaw: Column, offset: Column) -> Column:
    """``p`` turned about a pivot's vertical, then moved."""
    from ..functions.vectors import vec

    dx, dz = p["x"] - pivot["x"], p["z"] - pivot["z"]
    return vec(pivot["x"] + F.cos(yaw) * dx + F.sin(yaw) * dz + offset["x"], p["y"] + offset["y"], pivot["z"] - F.sin(yaw) * dx + F.cos(yaw) * dz + offset["z"])
