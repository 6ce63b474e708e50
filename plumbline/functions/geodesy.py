"""Ellipsoids, projections, zones, units and local frames as Column expressions.

Angles are degrees.  Projections work in metres whatever a zone's unit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .vectors import fenced, vec

# Semi-major axis (m) and inverse flattening.
GRS80 = (6378137.0, 298.257222101)
WGS84 = (6378137.0, 298.257223563)
#: Mean earth radius (m) of great-circle distances.
EARTH_RADIUS = 6371008.8
#: Metres per unit.
UNITS = {"metre": 1.0, "usSurveyFoot": 1200 / 3937, "internationalFoot": 0.3048}


@dataclass(frozen=True)
class Zone:
    code: str
    metric_code: str
    name: str
    state: str
    epsg: int
    epsg2011: int
    kind: str
    lat0: float
    lon0: float
    sp1: float | None
    sp2: float | None
    k0: float | None
    false_easting: float
    false_northing: float
    unit: str = "usSurveyFoot"


def _dm(degrees: int, minutes: int) -> float:
    return math.copysign(abs(degrees) + minutes / 60, degrees)


# State Plane zones of NAD83 (public EPSG parameters).
ZONES = (
    Zone("TX83-NF", "TX83-N", "Texas North", "TX", 2275, 6582, "lcc", _dm(34, 0), _dm(-101, 30), _dm(34, 39), _dm(36, 11), None, 200000.0, 1000000.0),
    Zone("TX83-NCF", "TX83-NC", "Texas North Central", "TX", 2276, 6584, "lcc", _dm(31, 40), _dm(-98, 30), _dm(32, 8), _dm(33, 58), None, 600000.0, 2000000.0),
    Zone("TX83-CF", "TX83-C", "Texas Central", "TX", 2277, 6586, "lcc", _dm(29, 40), _dm(-100, 20), _dm(30, 7), _dm(31, 53), None, 700000.0, 3000000.0),
    Zone("TX83-SCF", "TX83-SC", "Texas South Central", "TX", 2278, 6588, "lcc", _dm(27, 50), _dm(-99, 0), _dm(28, 23), _dm(30, 17), None, 600000.0, 4000000.0),
    Zone("TX83-SF", "TX83-S", "Texas South", "TX", 2279, 6590, "lcc", _dm(25, 40), _dm(-98, 30), _dm(26, 10), _dm(27, 50), None, 300000.0, 5000000.0),
    Zone("CA83-IIIF", "CA83-III", "California zone 3", "CA", 2227, 6418, "lcc", _dm(36, 30), _dm(-120, 30), _dm(37, 4), _dm(38, 26), None, 2000000.0, 500000.0),
    Zone("CO83-CF", "CO83-C", "Colorado Central", "CO", 2232, 6428, "lcc", _dm(37, 50), _dm(-105, 30), _dm(38, 27), _dm(39, 45), None, 914401.8289, 304800.6096),
    Zone("FL83-EF", "FL83-E", "Florida East", "FL", 2236, 6437, "tm", _dm(24, 20), _dm(-81, 0), None, None, 0.9999411764705882, 200000.0, 0.0),
)


def lookup_zone(code: str) -> Zone:
    """By code or metric code, whatever the case; the metric code has metres for its unit."""
    want = code.strip().upper()
    for z in ZONES:
        if z.code.upper() == want:
            return z
        if z.metric_code.upper() == want:
            return Zone(**{**z.__dict__, "unit": "metre"})
    raise ValueError(f"unknown zone {code!r}; known: {', '.join(z.code for z in ZONES)}")


def zones_for_state(state: str) -> list[Zone]:
    return [z for z in ZONES if z.state == state.strip().upper()]


def zone_table(spark: SparkSession) -> DataFrame:
    """The registry, eight rows, for a broadcast join."""
    return spark.createDataFrame([tuple(z.__dict__.values()) for z in ZONES], "code string, metric_code string, name string, state string, epsg int, epsg2011 int, kind string, lat0 double, lon0 double, sp1 double, sp2 double, k0 double, false_easting double, false_northing double, unit string")


def eccentricity_squared(ellipsoid=WGS84) -> float:
    f = 1 / ellipsoid[1]
    return f * (2 - f)


def geodetic_to_ecef(lat: Column, lon: Column, height: Column, ellipsoid=WGS84) -> Column:
    a, e2 = ellipsoid[0], eccentricity_squared(ellipsoid)
    phi, lam = F.radians(lat), F.radians(lon)
    n = a / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    return vec((n + height) * F.cos(phi) * F.cos(lam), (n + height) * F.cos(phi) * F.sin(lam), (n * (1 - e2) + height) * F.sin(phi))


def _bowring(x: Column, y: Column, z: Column, ellipsoid) -> tuple[Column, Column, Column]:
    """Distance from the axis, and the sides of Bowring's first latitude."""
    a, e2 = ellipsoid[0], eccentricity_squared(ellipsoid)
    b = a * math.sqrt(1 - e2)
    r = F.hypot(x, y)
    side = F.greatest(F.hypot(z * a, r * b), F.lit(1e-300))
    return r, z + e2 / (1 - e2) * b * F.pow(z * a / side, F.lit(3)), r - e2 * a * F.pow(r * b / side, F.lit(3))


def _steeper(z: Column, up: Column, out: Column, ellipsoid) -> Column:
    """The upright side of the next latitude; the other is the distance from the axis."""
    e2 = eccentricity_squared(ellipsoid)
    return z + e2 * ellipsoid[0] * up / F.hypot(up * math.sqrt(1 - e2), out)


def _settled(x: Column, y: Column, z: Column, r: Column, up: Column, ellipsoid) -> Column:
    a, e2 = ellipsoid[0], eccentricity_squared(ellipsoid)
    flat = math.sqrt(1 - e2)
    axis, whole = r < 1e-9, F.hypot(up, r)
    n = a * whole / F.hypot(up * flat, r)
    steep = r <= 0.1 * whole
    height = F.when(steep, z * whole / F.when(steep, up) - n * (1 - e2)).otherwise(whole - n)
    return F.struct(
        F.when(axis, F.when(z < 0, -90.0).otherwise(90.0)).otherwise(F.degrees(F.atan2(up, r))).alias("lat"),
        F.when(axis, 0.0).otherwise(F.degrees(F.atan2(y, x))).alias("lon"),
        F.when(axis, F.abs(z) - a * flat).otherwise(height).alias("height"),
    )


def ecef_to_geodetic(p: Column, ellipsoid=WGS84) -> Column:
    """struct(lat, lon, height): Bowring's start and two more steps; on the axis the latitude is a pole.

    Sines and cosines are kept as sides of a triangle, so each step is plain
    arithmetic.  Tables go through ``with_geodetic``, which works out each step
    once.
    """
    x, y, z = p["x"], p["y"], p["z"]
    r, up, out = _bowring(x, y, z, ellipsoid)
    up = _steeper(z, _steeper(z, up, out, ellipsoid), r, ellipsoid)
    return _settled(x, y, z, r, up, ellipsoid)


def with_geodetic(df: DataFrame, p: Column, name: str, ellipsoid=WGS84) -> DataFrame:
    """``df`` with ``name``: ``ecef_to_geodetic`` of ``p``, its steps as columns that stay apart."""
    own = df.columns
    at, first = {f"_{a}": p[a] for a in "xyz"}, ("_r", "_up", "_out")
    df = fenced(df, at)
    x, y, z = (F.col(f"_{a}") for a in "xyz")
    df = fenced(df, dict(zip(first, _bowring(x, y, z, ellipsoid), strict=True)))
    df = fenced(df, {"_up1": _steeper(z, F.col("_up"), F.col("_out"), ellipsoid)})
    df = fenced(df, {"_up2": _steeper(z, F.col("_up1"), F.col("_r"), ellipsoid)})
    return df.select(*own, _settled(x, y, z, F.col("_r"), F.col("_up2"), ellipsoid).alias(name))


def _enu_rows(lat: Column, lon: Column) -> list[list]:
    sp, cp, sl, cl = F.sin(F.radians(lat)), F.cos(F.radians(lat)), F.sin(F.radians(lon)), F.cos(F.radians(lon))
    return [[-sl, cl, F.lit(0.0)], [-sp * cl, -sp * sl, cp], [cp * cl, cp * sl, sp]]


def ecef_to_enu(p: Column, lat: Column, lon: Column, height: Column, ellipsoid=WGS84) -> Column:
    """East, north and up of a point as seen from a reference."""
    o = geodetic_to_ecef(lat, lon, height, ellipsoid)
    d = [p[n] - o[n] for n in "xyz"]
    return vec(*(sum((c * q for c, q in zip(row, d, strict=True)), F.lit(0.0)) for row in _enu_rows(lat, lon)))


def enu_to_ecef(enu: Column, lat: Column, lon: Column, height: Column, ellipsoid=WGS84) -> Column:
    o, rows = geodetic_to_ecef(lat, lon, height, ellipsoid), _enu_rows(lat, lon)
    return vec(*(o[n] + sum((rows[r][c] * enu[m] for r, m in enumerate("xyz")), F.lit(0.0)) for c, n in enumerate("xyz")))


def geodetic_to_enu(lat, lon, height, lat0, lon0, height0, ellipsoid=WGS84) -> Column:
    return ecef_to_enu(geodetic_to_ecef(lat, lon, height, ellipsoid), lat0, lon0, height0, ellipsoid)


def enu_to_geodetic(enu, lat0, lon0, height0, ellipsoid=WGS84) -> Column:
    return ecef_to_geodetic(enu_to_ecef(enu, lat0, lon0, height0, ellipsoid), ellipsoid)


def lambert_constants(z: Zone, ellipsoid=GRS80) -> dict[str, float]:
    """n, F, rho0 and e, on the driver: literals of the expression."""
    e = math.sqrt(eccentricity_squared(ellipsoid))
    p0, p1, p2 = (math.radians(v) for v in (z.lat0, z.sp1, z.sp2))
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    n = math.sin(p1) if abs(p1 - p2) < 1e-10 else math.log(m(p1) / m(p2)) / math.log(t(p1) / t(p2))
    f = m(p1) / (n * t(p1) ** n)
    return {"n": n, "F": f, "rho0": ellipsoid[0] * f * t(p0) ** n, "e": e}


def _wrapped(d: Column) -> Column:
    """An angle (radians) brought to within half a turn."""
    return d - 2 * math.pi * F.floor((d + math.pi) / (2 * math.pi))


def lcc_forward(lat: Column, lon: Column, z: Zone, ellipsoid=GRS80) -> Column:
    k = lambert_constants(z, ellipsoid)
    s = F.sin(F.radians(lat)) * k["e"]
    t = F.tan(math.pi / 4 - F.radians(lat) / 2) / F.pow((1 - s) / (1 + s), F.lit(k["e"] / 2))
    rho = ellipsoid[0] * k["F"] * F.pow(t, F.lit(k["n"]))
    theta = k["n"] * _wrapped(F.radians(lon) - math.radians(z.lon0))
    return F.struct((z.false_easting + rho * F.sin(theta)).alias("easting"), (z.false_northing + k["rho0"] - rho * F.cos(theta)).alias("northing"))


def lcc_inverse(easting: Column, northing: Column, z: Zone, ellipsoid=GRS80, steps: int = 6) -> Column:
    k = lambert_constants(z, ellipsoid)
    sign = math.copysign(1, k["n"])
    x, y = easting - z.false_easting, k["rho0"] - (northing - z.false_northing)
    t = F.pow(sign * F.sqrt(x * x + y * y) / (ellipsoid[0] * k["F"]), F.lit(1 / k["n"]))
    start = math.pi / 2 - 2 * F.atan(t)
    again = lambda phi, _: math.pi / 2 - 2 * F.atan(t * F.pow((1 - k["e"] * F.sin(phi)) / (1 + k["e"] * F.sin(phi)), F.lit(k["e"] / 2)))
    phi = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, again)  # contracts by e squared a step
    return F.struct(F.degrees(phi).alias("lat"), (F.degrees(F.atan2(sign * x, sign * y) / k["n"]) + z.lon0).alias("lon"))


def _arc(phi, a: float, e2: float, sin):
    return a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * sin(4 * phi) - 35 * e2**3 / 3072 * sin(6 * phi))


def meridional_arc(lat: Column, ellipsoid=GRS80) -> Column:
    return _arc(F.radians(lat), ellipsoid[0], eccentricity_squared(ellipsoid), F.sin)


def tm_forward(lat: Column, lon: Column, z: Zone, ellipsoid=GRS80) -> Column:
    a, e2 = ellipsoid[0], eccentricity_squared(ellipsoid)
    ep2, phi = e2 / (1 - e2), F.radians(lat)
    s, c, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    n, t, q = a / F.sqrt(1 - e2 * s * s), tan * tan, ep2 * c * c
    d = _wrapped(F.radians(lon) - math.radians(z.lon0)) * c
    d2 = d * d
    east = d + (1 - t + q) * d2 * d / 6 + (5 - 18 * t + t * t + 72 * q - 58 * ep2) * d2 * d2 * d / 120
    north = _arc(phi, a, e2, F.sin) - _arc(math.radians(z.lat0), a, e2, math.sin) + n * tan * (d2 / 2 + (5 - t + 9 * q + 4 * q * q) * d2 * d2 / 24 + (61 - 58 * t + t * t + 600 * q - 330 * ep2) * d2 * d2 * d2 / 720)
    return F.struct((z.false_easting + z.k0 * n * east).alias("easting"), (z.false_northing + z.k0 * north).alias("northing"))


def tm_inverse(easting: Column, northing: Column, z: Zone, ellipsoid=GRS80) -> Column:
    a, e2 = ellipsoid[0], eccentricity_squared(ellipsoid)
    ep2, root = e2 / (1 - e2), math.sqrt(1 - e2)
    e1 = (1 - root) / (1 + root)
    mu = (_arc(math.radians(z.lat0), a, e2, math.sin) + (northing - z.false_northing) / z.k0) / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    phi = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + 151 * e1**3 / 96 * F.sin(6 * mu) + 1097 * e1**4 / 512 * F.sin(8 * mu)
    s, c, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    w = 1 - e2 * s * s
    n, r, t, q = a / F.sqrt(w), a * (1 - e2) / F.pow(w, F.lit(1.5)), tan * tan, ep2 * c * c
    d = (easting - z.false_easting) / (n * z.k0)
    d2 = d * d
    lat = phi - n * tan / r * (d2 / 2 - (5 + 3 * t + 10 * q - 4 * q * q - 9 * ep2) * d2 * d2 / 24 + (61 + 90 * t + 298 * q + 45 * t * t - 252 * ep2 - 3 * q * q) * d2 * d2 * d2 / 720)
    lon = (d - (1 + 2 * t + q) * d2 * d / 6 + (5 - 2 * q + 28 * t - 3 * q * q + 8 * ep2 + 24 * t * t) * d2 * d2 * d / 120) / c
    return F.struct(F.degrees(lat).alias("lat"), (F.degrees(lon) + z.lon0).alias("lon"))


def project(lat: Column, lon: Column, z: Zone) -> Column:
    return lcc_forward(lat, lon, z) if z.kind == "lcc" else tm_forward(lat, lon, z)


def unproject(easting: Column, northing: Column, z: Zone) -> Column:
    return lcc_inverse(easting, northing, z) if z.kind == "lcc" else tm_inverse(easting, northing, z)


def grid_scale(lat: Column, lon: Column, z: Zone) -> Column:
    """Grid length over ground length of a step of a millionth of a degree to the north."""
    step = 1e-6
    a, b = project(lat, lon, z), project(lat + step, lon, z)
    g = geodetic_to_enu(lat + step, lon, F.lit(0.0), lat, lon, F.lit(0.0), GRS80)
    return F.hypot(b["easting"] - a["easting"], b["northing"] - a["northing"]) / F.hypot(g["x"], g["y"])


def zone_plausibility(easting: Column, northing: Column, z: Zone) -> Column:
    """Whether a position (metres) lies within five degrees of the zone's origin."""
    g = unproject(easting, northing, z)
    near = (F.abs(g["lat"] - z.lat0) <= 5) & (F.abs(g["lon"] - z.lon0) <= 5)
    return F.struct(F.coalesce(near, F.lit(False)).alias("plausible"), g["lat"].alias("lat"), g["lon"].alias("lon"))


def to_metres(value: Column, unit: str) -> Column:
    return value * UNITS[unit]


def from_metres(value: Column, unit: str) -> Column:
    return value / UNITS[unit]


def float32_ulp(value: Column) -> Column:
    """The step of a 32-bit float at a value; of zero the least one; null is null."""
    size = F.abs(value)
    safe = F.when((size > 0) & ~F.isnan(size) & (size != float("inf")), size)
    return F.when(size == 0, F.lit(2.0**-149)).when(F.isnan(size) | (size == float("inf")), F.lit(float("inf"))).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(safe)) - 23))


def precision_report(p: Column, unit: str, tolerance: float = 0.001) -> Column:
    worst = F.greatest(*(F.abs(p[n]) for n in "xyz"))
    ulp = float32_ulp(worst)
    return F.struct((ulp * UNITS[unit] > tolerance).alias("requires_floating_origin"), ulp.alias("ulp"), (ulp * UNITS[unit] * 1000).alias("ulp_millimetres"), F.lit(tolerance).alias("tolerance"))


def choose_origin(low: Column, high: Column, grid: float = 1000.0) -> Column:
    """The middle of the bounds on a grid; elevation stays."""
    snap = lambda a, b: F.floor((a + b) / 2 / grid + 0.5) * grid
    return vec(snap(low["x"], high["x"]), snap(low["y"], high["y"]), 0.0)


def to_local(p: Column, origin: Column, unit: str) -> Column:
    """Project units, z up, to metres from the origin, y up."""
    k = UNITS[unit]
    return vec((p["x"] - origin["x"]) * k, (p["z"] - origin["z"]) * k, -(p["y"] - origin["y"]) * k)


def to_project(p: Column, origin: Column, unit: str) -> Column:
    k = UNITS[unit]
    return vec(p["x"] / k + origin["x"], -p["z"] / k + origin["y"], p["y"] / k + origin["z"])


def crs_block(code: str, name: str, unit: str, origin: tuple[float, float, float] | None = None, vertical_datum: str | None = None, geoid: str | None = None) -> Column:
    o = F.array(*map(F.lit, origin)) if origin else F.lit(None).cast("array<double>")
    text = lambda v: F.lit(v).cast("string")
    return F.struct(text(code).alias("code"), text(name).alias("name"), text(unit).alias("unit"), F.lit(UNITS[unit]).alias("metres_per_unit"), o.alias("origin"), text(vertical_datum).alias("vertical_datum"), text(geoid).alias("geoid_model"))


def foot_divergence(value: Column) -> Column:
    """How far apart the two feet put a value, in metres."""
    return F.abs(value * (UNITS["usSurveyFoot"] - UNITS["internationalFoot"]))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


# The largest RMS (m) of each band.
ACCURACY_BANDS = ((0.003, "layout"), (0.006, "penetrations"), (0.010, "dimensional-control"), (0.050, "coordination"), (0.250, "context"))


def accuracy_band(rms: Column) -> Column:
    """Errors that are negative, not a number or infinite are unusable."""
    out = F.when(rms.isNull() | F.isnan(rms) | (rms < 0), "unusable")
    for limit, name in ACCURACY_BANDS:
        out = out.when(rms <= limit, name)
    return out.otherwise("unusable")
