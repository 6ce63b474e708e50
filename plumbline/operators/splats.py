"""Gaussian splats as rows: activation, covariance, projection, compositing, losses, training steps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

# Real spherical-harmonic constants of bands 0 to 2.
SH_C0 = 0.28209479177387814
SH_C1 = 0.4886025119029199
SH_C2 = (1.0925484305920792, -1.0925484305920792, 0.31539156525252005, -1.0925484305920792, 0.5462742152960396)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def sh_rest(degree: int) -> int:
    """Coefficients beyond the first, per channel."""
    return (degree + 1) ** 2 - 1


def to_channel_major(rest: Column, count: int) -> Column:
    """[c0 r, c0 g, c0 b, c1 r, ..] to [r of all, g of all, b of all]."""
    return F.transform(F.sequence(F.lit(0), F.lit(3 * count - 1)), lambda i: F.get(rest, ((i % count) * 3 + F.floor(i / count)).cast("int")))


def to_coefficient_major(rest: Column, count: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(3 * count - 1)), lambda i: F.get(rest, ((i % 3) * count + F.floor(i / 3)).cast("int")))


def from_points(points: DataFrame, cell: float) -> DataFrame:
    """Splats of coloured points(id, x, y, z, r, g, b in 0..1): spacing gives the size."""
    from .matching import grid_neighbours

    got = points.join(grid_neighbours(points, cell), "id")
    size = F.ln("spacing")
    return got.select("id", V.vec(F.col("x"), F.col("y"), F.col("z")).alias("position"), V.vec(size, size, size).alias("log_scale"), V.quat_identity().alias("rotation"), logit(F.lit(0.1)).alias("logit"), *(((F.col(c) - 0.5) / SH_C0).alias(f"sh0_{c}") for c in "rgb"))


def covariance(rotation: Column, scale: Column) -> list[Column]:
    """xx, xy, xz, yy, yz and zz of R S S' R'."""
    r, s = V.quat_to_rows(V.quat_normalize(rotation)), [scale[a] * scale[a] for a in "xyz"]
    return [sum((r[i][k] * r[j][k] * s[k] for k in range(3)), F.lit(0.0)) for i in range(3) for j in range(i, 3)]


def evaluate_sh(coefficients: Column, direction: Column, degree: int) -> list[Column]:
    """r, g and b; coefficients are coefficient-major with three channels each; bands 0 to 2."""
    x, y, z = V.parts(direction)
    basis = [F.lit(SH_C0)]
    if degree >= 1:
        basis += [-SH_C1 * y, SH_C1 * z, -SH_C1 * x]
    if degree >= 2:
        basis += [SH_C2[0] * x * y, SH_C2[1] * y * z, SH_C2[2] * (2 * z * z - x * x - y * y), SH_C2[3] * x * z, SH_C2[4] * (x * x - y * y)]
    return [F.greatest(sum((b * coefficients[3 * k + c] for k, b in enumerate(basis)), F.lit(0.5)), F.lit(0.0)) for c in range(3)]


def project(splats: DataFrame, pose: Column, fx: float, fy: float, cx: float, cy: float, width: int, height: int, near: float = 0.01) -> DataFrame:
    """Splats seen by a pinhole: u, v, depth and the conic a, b, c; culled ones are left out."""
    local = V.rotate(V.quat_conjugate(pose["q"]), V.sub(F.col("position"), pose["t"]))
    df = V.fenced(splats, {"_p": local, "_q": V.quat_normalize(F.col("rotation")), "_v": V.quat_conjugate(pose["q"])}).where(F.col("_p.z") >= near)
    rows, size = V.quat_to_rows(F.col("_q")), [F.exp(2 * F.col(f"log_scale.{a}")) for a in "xyz"]
    df = V.fenced(df, {f"_s{i}{j}": sum((rows[i][k] * rows[j][k] * size[k] for k in range(3)), F.lit(0.0)) for i in range(3) for j in range(i, 3)})
    s = lambda i, j: F.col(f"_s{min(i, j)}{max(i, j)}")
    view = V.quat_to_rows(F.col("_v"))
    x, y, z = (F.col(f"_p.{a}") for a in "xyz")
    jac = [[fx / z, F.lit(0.0), -fx * x / (z * z)], [F.lit(0.0), fy / z, -fy * y / (z * z)]]
    df = V.fenced(df, {f"_t{r}{c}": sum((jac[r][k] * view[k][c] for k in range(3)), F.lit(0.0)) for r in range(2) for c in range(3)})
    flat = lambda r, q: sum((F.col(f"_t{r}{i}") * s(i, j) * F.col(f"_t{q}{j}") for i in range(3) for j in range(3)), F.lit(0.0))
    df = V.fenced(df, {"u": fx * x / z + cx, "v": fy * y / z + cy, "depth": z, "_a": flat(0, 0) + 0.3, "_b": flat(0, 1), "_c": flat(1, 1) + 0.3})
    df = V.fenced(df, {"_det": F.col("_a") * F.col("_c") - F.col("_b") * F.col("_b"), "radius": 3 * F.sqrt(F.greatest(F.col("_a"), F.col("_c")))}).where(F.col("_det") > 1e-12)
    reach = F.col("radius")
    seen = (F.col("u") + reach >= 0) & (F.col("u") - reach < width) & (F.col("v") + reach >= 0) & (F.col("v") - reach < height)
    out = df.where(seen).withColumns({"conic_a": F.col("_c") / F.col("_det"), "conic_b": -F.col("_b") / F.col("_det"), "conic_c": F.col("_a") / F.col("_det")})
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def composite(layers: DataFrame, by: list[str], depth: str | list[str], alpha: str, values: list[str]) -> DataFrame:
    """Front-to-back blending: sums of transmittance times alpha times value.

    Layers below 1/255 go first; alpha stops at 0.99; layers behind a
    transmittance of 1e-4 add nothing.  ``depth`` may name more columns to settle ties.
    """
    a = F.least(F.col(alpha), F.lit(0.99))
    w = Window.partitionBy(*by).orderBy(*([depth] if isinstance(depth, str) else depth)).rowsBetween(Window.unboundedPreceding, -1)
    df = layers.where(F.col(alpha) >= 1 / 255).withColumn("_a", a)
    df = df.withColumn("_t", F.coalesce(F.exp(F.sum(F.ln(1 - F.col("_a"))).over(w)), F.lit(1.0))).where("_t >= 1e-4")
    return df.groupBy(*by).agg(*(F.sum(F.col("_t") * F.col("_a") * F.col(v)).alias(v) for v in values), (1 - F.sum(F.col("_t") * F.col("_a"))).alias("transmittance"))


def rasterize(splats: DataFrame, width: int, height: int) -> DataFrame:
    """Each pixel's blended colour of projected splats with u, v, radius, conic_*, opacity, r, g, b."""
    low = lambda c, n: F.greatest(F.lit(0), F.floor(F.col(c) - F.col("radius"))).cast("int")  # noqa: E731, ARG005
    high = lambda c, n: F.least(F.lit(n - 1), F.ceil(F.col(c) + F.col("radius"))).cast("int")
    span = lambda c, n: F.when(low(c, n) <= high(c, n), F.sequence(low(c, n), high(c, n)))
    df = splats.withColumn("px", F.explode(span("u", width))).withColumn("py", F.explode(span("v", height)))
    dx, dy = F.col("px") + 0.5 - F.col("u"), F.col("py") + 0.5 - F.col("v")
    power = -0.5 * (F.col("conic_a") * dx * dx + F.col("conic_c") * dy * dy) - F.col("conic_b") * dx * dy
    df = df.withColumn("alpha", F.when(power <= 0, F.col("opacity") * F.exp(power)).otherwise(0.0))
    return composite(df, ["px", "py"], "depth", "alpha", ["r", "g", "b"])


def l1(a: Column, b: Column) -> Column:
    return F.avg(F.abs(a - b))


def psnr(a: Column, b: Column) -> Column:
    """Of values in 0..1; infinite where they are the same."""
    mse = F.avg((a - b) * (a - b))
    return F.when(mse < 1e-20, F.lit(float("inf"))).otherwise(10 * F.log10(1 / F.greatest(mse, F.lit(1e-300))))


def adam(df: DataFrame, value: str, gradient: str, m: str, v: str, step: int, rate: float, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-15) -> DataFrame:
    """One step of Adam on the rows' own state columns."""
    df = df.withColumn(m, b1 * F.col(m) + (1 - b1) * F.col(gradient)).withColumn(v, b2 * F.col(v) + (1 - b2) * F.col(gradient) * F.col(gradient))
    return df.withColumn(value, F.col(value) - rate * (F.col(m) / (1 - b1**step)) / (F.sqrt(F.col(v) / (1 - b2**step)) + eps))


def densify(splats: DataFrame, gradient: float = 2e-7, size: float = 0.01, opacity: float = 0.005, most: int | None = None, seed: int = 17) -> DataFrame:
    """Prunes faint splats, clones small and splits large ones that move much; ids of new ones are negative.

    Splits step by a hash of id and seed along each axis, so a run can be repeated.
    """
    alive = splats.where(sigmoid(F.col("logit")) >= opacity)
    largest = F.greatest(*(F.exp(F.col(f"log_scale.{a}")) for a in "xyz"))
    busy = F.col("gradient") >= gradient
    room = F.lit(True) if most is None else F.lit(alive.count() < most)
    clone = alive.where(busy & (largest <= size) & room).withColumn("id", -F.col("id") * 2 - 1)
    split = alive.where(busy & (largest > size) & room)
    rest = alive.where(~(busy & (largest > size) & room))

    def half(sign: int) -> DataFrame:
        unit = lambda a: (F.pmod(F.xxhash64("id", F.lit(a), F.lit(seed)), F.lit(2000)) / 1000 - 1)
        moved = V.vec(*(F.col(f"position.{a}") + sign * unit(a) * F.exp(F.col(f"log_scale.{a}")) for a in "xyz"))
        small = V.vec(*(F.col(f"log_scale.{a}") - math.log(1.6) for a in "xyz"))
        return split.withColumn("position", moved).withColumn("log_scale", small).withColumn("id", F.when(F.lit(sign > 0), F.col("id")).otherwise(-F.col("id") * 2 - 2))

    return rest.unionByName(clone).unionByName(half(1)).unionByName(half(-1))
