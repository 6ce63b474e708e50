"""Vectors, quaternions (x, y, z, w), matrices and bounds as Column expressions.

Vectors are structs of x, y and z; matrices are arrays of 16 doubles, column by
column.  Everything is plain arithmetic, so it stays in generated code.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(value: Column, use) -> Column:
    """``use(v)`` with ``value`` worked out once, however often ``v`` occurs in it.

    A plain column is used as it is; any other expression is bound by a lambda,
    which keeps nested formulas from growing beyond all bounds.
    """
    if re.fullmatch(r"Column<'[\w.\[\]]+'>", str(value)):
        return use(value)
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fenced(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that the optimiser won't write out again in every later use."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def vec(x, y, z) -> Column:
    as_double = lambda v: (v if isinstance(v, Column) else F.lit(float(v))).cast("double")
    xyz = tuple(map(as_double, (x, y, z)))
    out = F.struct(*(c.alias(n) for c, n in zip(xyz, "xyz", strict=True)))
    out.__dict__["_xyz"] = xyz  # lets formulas go on with the components instead of a struct of them
    return out


def parts(v: Column) -> tuple[Column, Column, Column]:
    return v.__dict__.get("_xyz") or (v["x"], v["y"], v["z"])


def add(a: Column, b: Column) -> Column:
    return vec(*(p + q for p, q in zip(parts(a), parts(b), strict=True)))


def sub(a: Column, b: Column) -> Column:
    return vec(*(p - q for p, q in zip(parts(a), parts(b), strict=True)))


def scale(a: Column, k) -> Column:
    return vec(*(p * k for p in parts(a)))


def mul(a: Column, b: Column) -> Column:
    return vec(*(p * q for p, q in zip(parts(a), parts(b), strict=True)))


def negate(a: Column) -> Column:
    return vec(*(-p for p in parts(a)))


def dot(a: Column, b: Column) -> Column:
    return sum((p * q for p, q in zip(parts(a), parts(b), strict=True)), F.lit(0.0))


def cross(a: Column, b: Column) -> Column:
    ax, ay, az = parts(a)
    bx, by, bz = parts(b)
    return vec(ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx)


def length_squared(a: Column) -> Column:
    return dot(a, a)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return length(sub(a, b))


def normalize(a: Column) -> Column:
    def unit(v: Column) -> Column:
        n = length(v)
        return vec(*(F.when(n > 0, p / F.when(n > 0, n)).otherwise(0.0) for p in parts(v)))

    return once(a, unit)


def lerp(a: Column, b: Column, t) -> Column:
    return vec(*(p + (q - p) * t for p, q in zip(parts(a), parts(b), strict=True)))


def clamp(v: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def quat(x, y, z, w) -> Column:
    as_double = lambda v: (v if isinstance(v, Column) else F.lit(float(v))).cast("double")
    return F.struct(*(as_double(v).alias(n) for v, n in zip((x, y, z, w), "xyzw", strict=True)))


def quat_identity() -> Column:
    return quat(0, 0, 0, 1)


def quat_multiply(a: Column, b: Column) -> Column:
    def product(p: Column, q: Column) -> Column:
        return quat(
            p["w"] * q["x"] + p["x"] * q["w"] + p["y"] * q["z"] - p["z"] * q["y"],
            p["w"] * q["y"] - p["x"] * q["z"] + p["y"] * q["w"] + p["z"] * q["x"],
            p["w"] * q["z"] + p["x"] * q["y"] - p["y"] * q["x"] + p["z"] * q["w"],
            p["w"] * q["w"] - p["x"] * q["x"] - p["y"] * q["y"] - p["z"] * q["z"],
        )

    return once(a, lambda p: once(b, lambda q: product(p, q)))


def quat_conjugate(q: Column) -> Column:
    return quat(-q["x"], -q["y"], -q["z"], q["w"])


def quat_dot(a: Column, b: Column) -> Column:
    return sum((a[n] * b[n] for n in "xyzw"), F.lit(0.0))


def quat_normalize(q: Column) -> Column:
    def unit(r: Column) -> Column:
        n = F.sqrt(quat_dot(r, r))
        safe = F.when(n > 0, n)
        return quat(*(F.when(n > 0, r[k] / safe).otherwise(1.0 if k == "w" else 0.0) for k in "xyzw"))

    return once(q, unit)


def quat_from_axis_angle(axis: Column, angle) -> Column:
    half = (angle if isinstance(angle, Column) else F.lit(float(angle))) / 2
    return once(normalize(axis), lambda u: quat(u["x"] * F.sin(half), u["y"] * F.sin(half), u["z"] * F.sin(half), F.cos(half)))


def rotate(q: Column, v: Column) -> Column:
    """``v`` turned by the unit quaternion ``q``."""
    def turned(r: Column, p: Column) -> Column:
        axis = vec(r["x"], r["y"], r["z"])
        t = scale(cross(axis, p), 2.0)
        return add(add(p, scale(t, r["w"])), cross(axis, t))

    return once(q, lambda r: once(v, lambda p: turned(r, p)))


def slerp(a: Column, b: Column, t: Column) -> Column:
    """Along the shorter arc; nearly equal rotations are mixed straight."""
    def mixed(raw: Column) -> Column:
        sign = F.when(raw < 0, -1.0).otherwise(1.0)
        c = F.least(raw * sign, F.lit(1.0))
        angle, close = F.acos(c), c > 0.9995
        s = F.when(close, F.lit(1.0)).otherwise(F.sin(angle))
        ka = F.when(close, 1 - t).otherwise(F.sin((1 - t) * angle) / s)
        kb = F.when(close, t).otherwise(F.sin(t * angle) / s) * sign
        return quat(*(a[n] * ka + b[n] * kb for n in "xyzw"))

    return quat_normalize(once(quat_dot(a, b), mixed))


def shortest_arc(a: Column, b: Column) -> Column:
    """The rotation from one direction to another; opposite ones turn about a fixed cross axis."""
    def arc(u: Column, v: Column) -> Column:
        d, c = dot(u, v), cross(u, v)
        side = normalize(F.when(F.abs(u["x"]) < 0.9, cross(u, vec(1, 0, 0))).otherwise(cross(u, vec(0, 1, 0))))
        back = once(side, lambda s: quat(s["x"], s["y"], s["z"], 0))
        return F.when(d < -1 + 1e-12, back).otherwise(quat_normalize(quat(c["x"], c["y"], c["z"], 1 + d)))

    return once(normalize(a), lambda u: once(normalize(b), lambda v: arc(u, v)))


def quat_to_rows(q: Column) -> list[list[Column]]:
    x, y, z, w = (q[n] for n in "xyzw")
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def quat_from_rows(m: list[list[Column]]) -> Column:
    """Of a rotation matrix, from the largest of the four squares."""
    trace = m[0][0] + m[1][1] + m[2][2]
    root = lambda v: F.sqrt(F.greatest(v, F.lit(1e-300)))
    s0 = root(trace + 1) * 2
    s1, s2, s3 = (root(1 + m[i][i] - m[j][j] - m[k][k]) * 2 for i, j, k in ((0, 1, 2), (1, 0, 2), (2, 0, 1)))
    return (
        F.when(trace > 0, quat((m[2][1] - m[1][2]) / s0, (m[0][2] - m[2][0]) / s0, (m[1][0] - m[0][1]) / s0, s0 / 4))
        .when((m[0][0] >= m[1][1]) & (m[0][0] >= m[2][2]), quat(s1 / 4, (m[0][1] + m[1][0]) / s1, (m[0][2] + m[2][0]) / s1, (m[2][1] - m[1][2]) / s1))
        .when(m[1][1] >= m[2][2], quat((m[0][1] + m[1][0]) / s2, s2 / 4, (m[1][2] + m[2][1]) / s2, (m[0][2] - m[2][0]) / s2))
        .otherwise(quat((m[0][2] + m[2][0]) / s3, (m[1][2] + m[2][1]) / s3, s3 / 4, (m[1][0] - m[0][1]) / s3))
    )


def matrix(rows: list[list], move: Column | None = None) -> Column:
    """A 4 x 4 matrix, column by column, of three rows of three and a translation."""
    t = [F.lit(0.0)] * 3 if move is None else list(parts(move))
    cell = lambda v: (v if isinstance(v, Column) else F.lit(float(v))).cast("double")
    return F.array(*(cell(rows[r][c]) if r < 3 else F.lit(0.0) for c in range(3) for r in range(4)), *map(cell, t), F.lit(1.0))


def matrix_identity() -> Column:
    return matrix([[1, 0, 0], [0, 1, 0], [0, 0, 1]])


def matrix_scale(s: Column) -> Column:
    return matrix([[s["x"], 0, 0], [0, s["y"], 0], [0, 0, s["z"]]])


def compose(move: Column, turn: Column, size: Column | None = None) -> Column:
    rows = quat_to_rows(turn)
    if size is not None:
        rows = [[c * k for c, k in zip(r, parts(size), strict=True)] for r in rows]
    return matrix(rows, move)


def matrix_multiply(a: Column, b: Column) -> Column:
    return F.array(*(sum((a[k * 4 + r] * b[c * 4 + k] for k in range(4)), F.lit(0.0)) for c in range(4) for r in range(4)))


def matrix_transpose(m: Column) -> Column:
    return F.array(*(m[r * 4 + c] for c in range(4) for r in range(4)))


def _minor(m: Column, rows: list[int], cols: list[int]) -> Column:
    if len(rows) == 1:
        return m[cols[0] * 4 + rows[0]]
    out = F.lit(0.0)
    for k, c in enumerate(cols):
        out = out + (-1) ** k * m[c * 4 + rows[0]] * _minor(m, rows[1:], cols[:k] + cols[k + 1 :])
    return out


def determinant(m: Column) -> Column:
    return _minor(m, [0, 1, 2, 3], [0, 1, 2, 3])


def invert(m: Column) -> Column:
    """Null where the determinant is zero."""
    others = lambda i: [k for k in range(4) if k != i]
    cells = [(-1) ** (r + c) * _minor(m, others(c), others(r)) for c in range(4) for r in range(4)]
    return once(determinant(m), lambda d: F.when(d != 0, F.transform(F.array(*cells), lambda x: x / d)))


def invert_rigid(m: Column) -> Column:
    t = [m[12], m[13], m[14]]
    rows = [[m[r * 4 + c] for c in range(3)] for r in range(3)]
    move = [-sum((rows[r][c] * t[c] for c in range(3)), F.lit(0.0)) for r in range(3)]
    return matrix(rows, vec(*move))


def transform_point(m: Column, p: Column) -> Column:
    x = parts(p)
    w = sum((m[c * 4 + 3] * x[c] for c in range(3)), m[15])
    k = F.when((w == 0) | (w == 1), F.lit(1.0)).otherwise(w)
    return vec(*((sum((m[c * 4 + r] * x[c] for c in range(3)), m[12 + r])) / k for r in range(3)))


def transform_direction(m: Column, d: Column) -> Column:
    x = parts(d)
    return vec(*(sum((m[c * 4 + r] * x[c] for c in range(3)), F.lit(0.0)) for r in range(3)))


def perspective(fov_y: float, aspect: float, near: float, far: float) -> Column:
    f = 1 / math.tan(fov_y / 2)
    cells = [0.0] * 16
    cells[0], cells[5], cells[10], cells[11], cells[14] = f / aspect, f, (far + near) / (near - far), -1.0, 2 * far * near / (near - far)
    return F.array(*map(F.lit, cells))


def look_at(eye: Column, target: Column, up: Column) -> Column:
    """A view matrix; the camera looks along its own negative z."""
    z = normalize(sub(eye, target))
    x = normalize(cross(up, z))
    y = cross(z, x)
    return matrix([list(parts(a)) for a in (x, y, z)], vec(*(-dot(a, eye) for a in (x, y, z))))


def pose_matrix(pose: Column) -> Column:
    """Camera to world, of struct(t, q)."""
    return compose(pose["t"], pose["q"])


def view_matrix(pose: Column) -> Column:
    return invert_rigid(pose_matrix(pose))


def matrix_pose(m: Column) -> Column:
    """struct(t, q) of a rigid matrix."""
    rows = [[m[c * 4 + r] for c in range(3)] for r in range(3)]
    return F.struct(vec(m[12], m[13], m[14]).alias("t"), quat_from_rows(rows).alias("q"))


def bounds(x: str = "x", y: str = "y", z: str = "z") -> list[Column]:
    """Aggregates min_x .. max_z."""
    return [f(F.col(c)).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for c, a in ((x, "x"), (y, "y"), (z, "z"))]


def inside(v: Column, low: Column, high: Column) -> Column:
    """In the closed box; an axis that isn't a number is outside."""
    out = F.lit(True)
    for p, a, b in zip(parts(v), parts(low), parts(high), strict=True):
        out &= p.between(a, b) & ~F.isnan(p)
    return out


def round_half_up(v: Column) -> Column:
    """Halves go towards positive infinity, unlike Spark's round."""
    return F.floor(v + 0.5)


def upper_median(v: Column) -> Column:
    """Aggregate: the element at half the count of the sorted values."""
    return F.get(F.sort_array(F.collect_list(v)), F.floor(F.count(v) / 2).cast("int"))


def mean_median(v: Column) -> Column:
    """Aggregate: of an even count, the mean of the middle two."""
    return F.median(v)
