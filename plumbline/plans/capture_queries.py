"""Queries over the driver's tables, for the operators that SQL can express.

The tables hold no captures, so each query derives its inputs from columns, the
same way in Spark and in SQL.  Results are rounded where floating point may
differ in the last place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geodesy as G
from ..functions import text as T
from ..functions import vectors as V
from ..operators import fusion, matching, mesh, records, registration, splats, surface
from ..sources import interop, survey
from .catalog import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(name: str = "ts"):
    """Microseconds since 1970 of a time with or without a zone (read as UTC)."""
    return F.unix_micros(F.col(name).cast("timestamp"))


def _r(c, n: int = 6):
    """Rounded, with no negative zero."""
    return F.round(c, n) + 0.0


_VOXELS = """
SELECT CAST(floor(l_quantity) AS INT) AS vx, CAST(floor(l_discount * 100 + 0.5) AS INT) AS vy, CAST(l_linenumber AS INT) AS vz,
  sum((l_tax - 4.1e-2) / (1 + l_extendedprice / 1e4)) / sum(1 / (1 + l_extendedprice / 1e4)) AS sdf, sum(1 / (1 + l_extendedprice / 1e4)) AS weight
FROM lineitem GROUP BY 1, 2, 3"""


def _voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    samples = li.select(
        F.floor("l_quantity").cast("int").alias("vx"), F.floor(F.col("l_discount") * 100 + 0.5).cast("int").alias("vy"), F.col("l_linenumber").cast("int").alias("vz"),
        (F.col("l_tax") - 0.041).alias("sdf"), (1 / (1 + F.col("l_extendedprice") / 1e4)).alias("w"),
    )
    return fusion.fuse(samples)


@query(f"""
WITH v AS ({_VOXELS}), d(dx, dy, dz) AS (VALUES (1, 0, 0), (0, 1, 0), (0, 0, 1))
SELECT round((a.vx + 0.5 + d.dx * (a.sdf / (a.sdf - b.sdf))) * 0.05, 6) + 0.0 AS x, round((a.vy + 0.5 + d.dy * (a.sdf / (a.sdf - b.sdf))) * 0.05, 6) + 0.0 AS y,
  round((a.vz + 0.5 + d.dz * (a.sdf / (a.sdf - b.sdf))) * 0.05, 6) + 0.0 AS z
FROM v a CROSS JOIN d JOIN v b ON b.vx = a.vx + d.dx AND b.vy = a.vy + d.dy AND b.vz = a.vz + d.dz
WHERE a.sdf <> b.sdf AND (a.sdf > 0) <> (b.sdf > 0)""")
def voxel_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fusion.extract_points(_voxels(spark, sf_dir), 0.05)
    return points.select(*(_r(F.col(a)).alias(a) for a in "xyz"))


_COLOURS = """
SELECT CAST(floor(l_quantity) AS INT) AS vx, CAST(floor(l_discount * 100 + 0.5) AS INT) AS vy, CAST(l_linenumber AS INT) AS vz, sum((l_tax - 4.1e-2) * w) / sum(w) AS sdf,
  sum(w * (l_partkey % 256)) / sum(w) AS r, sum(w * (l_suppkey % 256)) / sum(w) AS g, sum(CASE WHEN l_returnflag <> 'R' THEN w * (l_orderkey % 256) END) / sum(CASE WHEN l_returnflag <> 'R' THEN w END) AS b
FROM (SELECT *, 1 / (1 + l_extendedprice / 1e4) AS w FROM lineitem) GROUP BY 1, 2, 3"""


def _coloured_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels whose blue is unknown to part of their samples."""
    li = table(spark, sf_dir, "lineitem")
    colour = {"r": F.col("l_partkey") % 256, "g": F.col("l_suppkey") % 256, "b": F.when(F.col("l_returnflag") != "R", F.col("l_orderkey") % 256)}
    samples = li.select(
        F.floor("l_quantity").cast("int").alias("vx"), F.floor(F.col("l_discount") * 100 + 0.5).cast("int").alias("vy"), F.col("l_linenumber").cast("int").alias("vz"),
        (F.col("l_tax") - 0.041).alias("sdf"), (1 / (1 + F.col("l_extendedprice") / 1e4)).alias("w"), *(c.alias(n) for n, c in colour.items()),
    )
    return fusion.fuse(samples)


@query(f"SELECT vx, vy, vz, {', '.join(f'round({c}, 7) + 0.0 AS {c}' for c in 'rgb')} FROM ({_COLOURS})")
def voxel_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coloured_voxels(spark, sf_dir).select("vx", "vy", "vz", *(_r(F.col(c), 7).alias(c) for c in "rgb"))


#: The field of ``_COLOURS`` in cubes whose eight corners are known; an edge of their tetrahedra runs from a corner to one that has its bits and more.
_CUBES = f"""v AS MATERIALIZED (SELECT vx AS x, vy AS y, vz AS z, CASE WHEN abs(sdf) < 1e-7 THEN 1e-7 ELSE sdf END AS v, r, g, b FROM ({_COLOURS})), k AS (SELECT k FROM range(8) t(k)),
c AS MATERIALIZED (SELECT v.x - (k & 1) AS x, v.y - ((k >> 1) & 1) AS y, v.z - (k >> 2) AS z, k, v, r, g, b FROM v CROSS JOIN k),
full_ AS (SELECT x, y, z FROM c GROUP BY 1, 2, 3 HAVING count(*) = 8), u AS MATERIALIZED (SELECT c.* FROM c JOIN full_ USING (x, y, z))"""


@query(f"""WITH {_CUBES}, e AS (SELECT p.x, p.y, p.z, p.k AS pk, q.k AS qk, greatest(0, least(1, (0 - p.v) / (q.v - p.v))) AS t, p.r AS pr, p.g AS pg, p.b AS pb, q.r AS qr, q.g AS qg, q.b AS qb
  FROM u p JOIN u q ON q.x = p.x AND q.y = p.y AND q.z = p.z AND p.k < q.k AND (p.k & q.k) = p.k AND (p.v < 0) <> (q.v < 0)),
w AS (SELECT concat_ws(',', x + (pk & 1), y + ((pk >> 1) & 1), z + (pk >> 2), x + (qk & 1), y + ((qk >> 1) & 1), z + (qk >> 2)) AS vid,
  (x + (pk & 1) + ((qk & 1) - (pk & 1)) * t) * 0.05 + 0.025 AS x, (y + ((pk >> 1) & 1) + (((qk >> 1) & 1) - ((pk >> 1) & 1)) * t) * 0.05 + 0.025 AS y, (z + (pk >> 2) + ((qk >> 2) - (pk >> 2)) * t) * 0.05 + 0.025 AS z,
  coalesce(pr + (qr - pr) * t, pr, qr, 255) AS r, coalesce(pg + (qg - pg) * t, pg, qg, 255) AS g, coalesce(pb + (qb - pb) * t, pb, qb, 255) AS b FROM e)
SELECT vid, {', '.join(f'round(min({c}), 6) + 0.0 AS {c}' for c in 'xyzrgb')} FROM w GROUP BY 1""")
def surface_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertices of the zero level of all voxels, with the colours of their edges' ends mixed."""
    field = _coloured_voxels(spark, sf_dir).select(F.col("vx").alias("x"), F.col("vy").alias("y"), F.col("vz").alias("z"), F.col("sdf").alias("v"), "r", "g", "b")
    vertices, _ = surface.march(field, 0.05)
    return vertices.select("vid", *(_r(F.col(c)).alias(c) for c in "xyzrgb"))


@query(f"SELECT vx, vy, vz, round(sdf, 9) + 0.0 AS sdf, round(weight, 6) + 0.0 AS weight FROM ({_VOXELS})")
def voxel_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voxels(spark, sf_dir).select("vx", "vy", "vz", _r(F.col("sdf"), 9).alias("sdf"), _r(F.col("weight")).alias("weight"))


@query(f"""SELECT CAST(min(floor(vx / 8.0) * 8) AS INT) AS min_vx, CAST(max(floor(vx / 8.0) * 8) + 7 AS INT) AS max_vx, CAST(min(floor(vy / 8.0) * 8) AS INT) AS min_vy,
  CAST(max(floor(vy / 8.0) * 8) + 7 AS INT) AS max_vy, CAST(min(floor(vz / 8.0) * 8) AS INT) AS min_vz, CAST(max(floor(vz / 8.0) * 8) + 7 AS INT) AS max_vz FROM ({_VOXELS})""")
def voxel_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.voxel_bounds(_voxels(spark, sf_dir))


@query("SELECT min(l_quantity) AS min_x, min(l_extendedprice) AS min_y, min(l_tax) + 0.0 AS min_z, max(l_quantity) AS max_x, max(l_extendedprice) AS max_y, max(l_tax) + 0.0 AS max_z FROM lineitem")
def bounds_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("l_tax", F.col("l_tax") + 0.0)  # no negative zero
    return li.agg(*V.bounds("l_quantity", "l_extendedprice", "l_tax"))


@query("""SELECT p_brand AS brand, floor((min(p_retailprice) + max(p_retailprice)) / 2 / 100 + 0.5) * 100 AS x, floor((min(p_size) + max(p_size)) / 2.0 / 100 + 0.5) * 100 AS y, CAST(0 AS DOUBLE) AS z
FROM part GROUP BY 1""")
def choose_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.min("p_retailprice").alias("a"), F.max("p_retailprice").alias("b"), F.min("p_size").alias("c"), F.max("p_size").alias("d"))
    o = G.choose_origin(V.vec(F.col("a"), F.col("c"), 0.0), V.vec(F.col("b"), F.col("d"), 0.0), 100.0)
    return p.select("brand", o.alias("o")).select("brand", "o.*")


@query("""SELECT CASE WHEN user_id % 3 = 0 THEN 'noPose' WHEN event_type = 'view' THEN 'noDepth' WHEN value > 90 THEN 'unreadable' ELSE 'integrated' END AS reason, count(*) AS n
FROM events GROUP BY ROLLUP(1)""")
def skip_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = records.skip_reason(F.col("user_id") % 3 != 0, F.col("event_type") != "view", F.col("value") <= 90)
    return records.skip_counts(table(spark, sf_dir, "events"), reason)


@query("SELECT event_id, value FROM events WHERE value / 20 > 0.15 AND value / 20 < 4.0 AND NOT isnan(value) AND user_id % 3 >= 1")
def gate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.where(fusion.depth_gate(F.col("value") / 20, F.col("user_id") % 3, 0.15, 4.0)).select("event_id", "value")


@query("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS total, count(*) AS n FROM events GROUP BY 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("total"), F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, list_reduce(list_prepend(0, list_transform(string_split(url, ''), lambda c: ascii(c))), lambda a, b: xor(a, b)) AS checksum FROM pages WHERE regexp_full_match(url, '[ -~]*')")
def nmea_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(F.col("url").rlike("^[ -~]*$")).select("page_id", T.nmea_checksum(F.col("url")).alias("checksum"))


@query("""SELECT o_orderkey, round(CASE WHEN o_orderkey % 2 = 1 THEN -1 ELSE 1 END * (o_orderkey % 90 + (o_orderkey % 60 + 0.1237) / 60), 9) + 0.0 AS degrees,
  CAST((o_orderkey % 24) * 3600 + (o_orderkey % 60) * 60 + o_orderkey % 59 AS DOUBLE) AS seconds,
  round(CASE WHEN o_orderkey % 2 = 1 THEN -1 ELSE 1 END * (o_orderkey % 180 + (o_orderkey % 60) / 60.0 + (o_orderkey % 59) / 3600.0), 9) + 0.0 AS dms FROM orders""")
def angle_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    ddmm = F.concat(two(k % 90), two(k % 60), F.lit(".1237"))
    hms = F.concat(two(k % 24), two(k % 60), two(k % 59))
    side = F.when(k % 2 == 1, "S").otherwise("N")
    return table(spark, sf_dir, "orders").select("o_orderkey", _r(T.nmea_coordinate(ddmm, side), 9).alias("degrees"), T.utc_seconds(hms).alias("seconds"), _r(T.dms_degrees(k % 180, k % 60, k % 59, side), 9).alias("dms"))


_POSITIONS = "SELECT o_orderkey, 28 + (o_orderkey % 1000) * 2.1e-3 + sin(o_orderkey) * 1e-3 AS lat, -99.5 + (o_custkey % 1000) * 1.3e-3 + cos(o_orderkey) * 1e-3 AS lon, o_totalprice / 1e3 AS h FROM orders"


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", (28 + (k % 1000) * 2.1e-3 + F.sin(k) * 1e-3).alias("lat"), (-99.5 + (F.col("o_custkey") % 1000) * 1.3e-3 + F.cos(k) * 1e-3).alias("lon"), (F.col("o_totalprice") / 1e3).alias("h"))


_LCC, _TM = G.lookup_zone("TX83-SC"), G.lookup_zone("FL83-E")
_K = G.lambert_constants(_LCC)
_E2, _A = G.eccentricity_squared(G.GRS80), G.GRS80[0]


def _n(v: float) -> str:
    """A double literal of SQL."""
    return f"({v!r})" if "e" in repr(v) else f"({v!r}e0)"


def _lcc_sql(lat: str, lon: str) -> tuple[str, str]:
    t = f"(tan(pi() / 4 - radians({lat}) / 2) / pow((1 - {_n(_K['e'])} * sin(radians({lat}))) / (1 + {_n(_K['e'])} * sin(radians({lat}))), {_n(_K['e'] / 2)}))"
    rho = f"({_n(_A * _K['F'])} * pow({t}, {_n(_K['n'])}))"
    theta = f"({_n(_K['n'])} * (radians({lon}) - radians({_n(_LCC.lon0)})))"
    return f"({_n(_LCC.false_easting)} + {rho} * sin({theta}))", f"({_n(_LCC.false_northing)} + {_n(_K['rho0'])} - {rho} * cos({theta}))"


_LE, _LN = _lcc_sql("lat", "lon")


@query(f"SELECT o_orderkey, round({_LE}, 3) + 0.0 AS easting, round({_LN}, 3) + 0.0 AS northing FROM ({_POSITIONS})")
def lcc_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _positions(spark, sf_dir).withColumn("g", G.lcc_forward(F.col("lat"), F.col("lon"), _LCC))
    return p.select("o_orderkey", _r(F.col("g.easting"), 3).alias("easting"), _r(F.col("g.northing"), 3).alias("northing"))


@query(f"SELECT o_orderkey, round(lat, 8) + 0.0 AS lat, round(lon, 8) + 0.0 AS lon FROM ({_POSITIONS})")
def lcc_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverse of the forward projection gives the positions back."""
    p = _positions(spark, sf_dir).withColumn("g", G.lcc_forward(F.col("lat"), F.col("lon"), _LCC))
    p = p.withColumn("b", G.lcc_inverse(F.col("g.easting"), F.col("g.northing"), _LCC))
    return p.select("o_orderkey", _r(F.col("b.lat"), 8).alias("lat"), _r(F.col("b.lon"), 8).alias("lon"))


def _tm_sql(lat: str, lon: str) -> tuple[str, str]:
    ep2 = _E2 / (1 - _E2)
    c1, c2, c3, c4 = 1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256, 3 * _E2 / 8 + 3 * _E2**2 / 32 + 45 * _E2**3 / 1024, 15 * _E2**2 / 256 + 45 * _E2**3 / 1024, 35 * _E2**3 / 3072
    arc = lambda p: f"({_n(_A)} * ({_n(c1)} * {p} - {_n(c2)} * sin(2 * {p}) + {_n(c3)} * sin(4 * {p}) - {_n(c4)} * sin(6 * {p})))"
    phi = f"radians({lat})"
    n, t, c = f"({_n(_A)} / sqrt(1 - {_n(_E2)} * sin({phi}) * sin({phi})))", f"(tan({phi}) * tan({phi}))", f"({_n(ep2)} * cos({phi}) * cos({phi}))"
    d = f"((radians({lon}) - radians({_n(_TM.lon0)})) * cos({phi}))"
    east = f"({d} + (1 - {t} + {c}) * pow({d}, 3) / 6 + (5 - 18 * {t} + {t} * {t} + 72 * {c} - {_n(58 * ep2)}) * pow({d}, 5) / 120)"
    north = f"({arc(phi)} - {arc(f'radians({_n(_TM.lat0)})')} + {n} * tan({phi}) * (pow({d}, 2) / 2 + (5 - {t} + 9 * {c} + 4 * {c} * {c}) * pow({d}, 4) / 24 + (61 - 58 * {t} + {t} * {t} + 600 * {c} - {_n(330 * ep2)}) * pow({d}, 6) / 720))"
    return f"({_n(_TM.false_easting)} + {_n(_TM.k0)} * {n} * {east})", f"({_n(_TM.false_northing)} + {_n(_TM.k0)} * {north})"


_TE, _TN = _tm_sql("lat", "(lon + 18)")


@query(f"SELECT o_orderkey, round({_TE}, 3) + 0.0 AS easting, round({_TN}, 3) + 0.0 AS northing FROM ({_POSITIONS})")
def tm_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _positions(spark, sf_dir).withColumn("g", G.tm_forward(F.col("lat"), F.col("lon") + 18, _TM))
    return p.select("o_orderkey", _r(F.col("g.easting"), 3).alias("easting"), _r(F.col("g.northing"), 3).alias("northing"))


@query(f"SELECT o_orderkey, round(lat, 4) + 0.0 AS lat, round(lon + 18, 4) + 0.0 AS lon, true AS close FROM ({_POSITIONS})")
def tm_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverse gives the positions back that the forward way, which has a query of its own, took."""
    p = _positions(spark, sf_dir).withColumn("g", G.tm_forward(F.col("lat"), F.col("lon") + 18, _TM))
    p = p.withColumn("b", G.tm_inverse(F.col("g.easting"), F.col("g.northing"), _TM))
    return p.select("o_orderkey", _r(F.col("b.lat"), 4).alias("lat"), _r(F.col("b.lon"), 4).alias("lon"), ((F.abs(F.col("b.lat") - F.col("lat")) < 1e-8) & (F.abs(F.col("b.lon") - F.col("lon") - 18) < 1e-8)).alias("close"))


_W2, _WA = G.eccentricity_squared(), G.WGS84[0]


def _ecef_sql(lat: str, lon: str, h: str) -> tuple[str, str, str]:
    n = f"({_n(_WA)} / sqrt(1 - {_n(_W2)} * sin(radians({lat})) * sin(radians({lat}))))"
    return f"(({n} + {h}) * cos(radians({lat})) * cos(radians({lon})))", f"(({n} + {h}) * cos(radians({lat})) * sin(radians({lon})))", f"(({n} * {_n(1 - _W2)} + {h}) * sin(radians({lat})))"


_X, _Y, _Z = _ecef_sql("lat", "lon", "h")


@query(f"SELECT o_orderkey, round({_X}, 4) + 0.0 AS x, round({_Y}, 4) + 0.0 AS y, round({_Z}, 4) + 0.0 AS z FROM ({_POSITIONS})")
def geodetic_ecef(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _positions(spark, sf_dir).withColumn("p", G.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.col("h")))
    return p.select("o_orderkey", *(_r(F.col(f"p.{a}"), 4).alias(a) for a in "xyz"))


@query(f"SELECT o_orderkey, round(lat, 8) + 0.0 AS lat, round(lon, 8) + 0.0 AS lon, round(h, 2) + 0.0 AS height FROM (SELECT o_orderkey, lat, lon, h + sin(o_orderkey) AS h FROM ({_POSITIONS}))")
def ecef_geodetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _positions(spark, sf_dir).withColumn("p", G.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.col("h") + F.sin("o_orderkey")))
    p = G.with_geodetic(p.select("o_orderkey", "p"), F.col("p"), "g")
    return p.select("o_orderkey", _r(F.col("g.lat"), 8).alias("lat"), _r(F.col("g.lon"), 8).alias("lon"), _r(F.col("g.height"), 2).alias("height"))


_X0, _Y0, _Z0 = _ecef_sql("29", "(-98.5e0)", "200")
_SL, _CL, _SP, _CP = "sin(radians(-98.5e0))", "cos(radians(-98.5e0))", "sin(radians(29))", "cos(radians(29))"


@query(f"""SELECT o_orderkey, round(-{_SL} * dx + {_CL} * dy, 3) + 0.0 AS east, round(-{_SP} * {_CL} * dx - {_SP} * {_SL} * dy + {_CP} * dz, 3) + 0.0 AS north,
  round({_CP} * {_CL} * dx + {_CP} * {_SL} * dy + {_SP} * dz, 3) + 0.0 AS up FROM (SELECT o_orderkey, {_X} - {_X0} AS dx, {_Y} - {_Y0} AS dy, {_Z} - {_Z0} AS dz FROM ({_POSITIONS}))""")
def ecef_enu(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _positions(spark, sf_dir).withColumn("e", G.geodetic_to_enu(F.col("lat"), F.col("lon"), F.col("h"), F.lit(29.0), F.lit(-98.5), F.lit(200.0)))
    return p.select("o_orderkey", _r(F.col("e.x"), 3).alias("east"), _r(F.col("e.y"), 3).alias("north"), _r(F.col("e.z"), 3).alias("up"))


@query(f"""SELECT o_orderkey, round(sqrt(pow(e2 - e1, 2) + pow(n2 - n1, 2)) / (radians(1e-3) * {_n(_A * (1 - _E2))} / pow(1 - {_n(_E2)} * pow(sin(radians(lat + 5e-4)), 2), 1.5)), 3) + 0.0 AS k
FROM (SELECT o_orderkey, lat, {_LE} AS e1, {_LN} AS n1, {_lcc_sql("(lat + 1e-3)", "lon")[0]} AS e2, {_lcc_sql("(lat + 1e-3)", "lon")[1]} AS n2 FROM ({_POSITIONS}))""")
def grid_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(spark, sf_dir).select("o_orderkey", _r(G.grid_scale(F.col("lat"), F.col("lon"), _LCC), 3).alias("k"))


@query("SELECT o_orderkey, pow(2, floor(log2(abs(o_totalprice * 100))) - 23) AS ulp, pow(2, floor(log2(abs(o_totalprice * 100))) - 23) * (1200e0 / 3937) > 1e-3 AS needs_origin FROM orders WHERE o_totalprice <> 0")
def float32_ulp(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_totalprice <> 0")
    report = G.precision_report(V.vec(F.col("o_totalprice") * 100, 0.0, 0.0), "usSurveyFoot")
    return o.select("o_orderkey", report.alias("r")).select("o_orderkey", "r.ulp", F.col("r.requires_floating_origin").alias("needs_origin"))


@query("""SELECT s_suppkey, round(s_acctbal * (1200e0 / 3937), 6) + 0.0 AS metres, round(s_acctbal / 3.048e-1, 6) + 0.0 AS feet, round(abs(s_acctbal * (1200e0 / 3937 - 3.048e-1)), 9) + 0.0 AS divergence FROM supplier""")
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("s_acctbal")
    return table(spark, sf_dir, "supplier").select("s_suppkey", _r(G.to_metres(b, "usSurveyFoot")).alias("metres"), _r(G.from_metres(b, "internationalFoot")).alias("feet"), _r(G.foot_divergence(b), 9).alias("divergence"))


@query("""SELECT l_suppkey AS suppkey, CASE WHEN e < 0 THEN 'unusable' WHEN e <= 3e-3 THEN 'layout' WHEN e <= 6e-3 THEN 'penetrations' WHEN e <= 1e-2 THEN 'dimensional-control' WHEN e <= 5e-2 THEN 'coordination' WHEN e <= 2.5e-1 THEN 'context' ELSE 'unusable' END AS band
FROM (SELECT l_suppkey, avg(l_tax * sin(l_partkey)) * 3 AS e FROM lineitem GROUP BY 1)""")
def accuracy_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("suppkey")).agg((F.avg(F.col("l_tax") * F.sin("l_partkey")) * 3).alias("e"))
    return e.select("suppkey", G.accuracy_band(F.col("e")).alias("band"))


_BASES = "SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 25 + s_nationkey + sin(s_suppkey) END AS lat, -100 + cos(s_suppkey) * 3 AS lon FROM supplier"


@query(f"""SELECT s_suppkey, round(d, 3) + 0.0 AS distance, row_number() OVER (ORDER BY d ASC NULLS LAST, s_suppkey) AS place FROM (SELECT s_suppkey, 2 * 6371008.8e0 * asin(least(1, sqrt(pow(sin(radians(30 - lat) / 2), 2)
  + cos(radians(lat)) * cos(radians(30)) * pow(sin(radians(-98 - lon) / 2), 2)))) AS d FROM ({_BASES})) ORDER BY place LIMIT 25""")
def haversine_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 nearest bases; a report, so its limit is its meaning."""
    k = F.col("s_suppkey")
    lat = F.when(k % 7 != 0, 25 + F.col("s_nationkey") + F.sin(k))
    mounts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("mount"), lat.alias("lat"), (-100 + F.cos(k) * 3).alias("lon"))
    top = survey.order_mounts(mounts, 30.0, -98.0).limit(25)
    return top.select(F.col("mount").alias("s_suppkey"), _r(F.col("distance"), 3).alias("distance"), F.row_number().over(Window.orderBy(F.asc_nulls_last("distance"), "mount")).cast("bigint").alias("place"))


@query("""WITH g AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, min(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), s AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, event_id FROM events WHERE event_type <> 'purchase'),
m AS (SELECT g.user_id, g.t, s.event_id, row_number() OVER (PARTITION BY g.user_id, g.t ORDER BY abs(g.t - s.t), s.t, s.event_id) AS k FROM g JOIN s ON s.user_id = g.user_id AND abs(s.t - g.t) <= 60000)
SELECT g.user_id, g.event_id, m.event_id AS gst_event FROM g LEFT JOIN m ON m.user_id = g.user_id AND m.t = g.t AND m.k = 1""")
def epoch_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases, one a second, with their user's nearest other event within a thousand minutes."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (micros() / 1e6).alias("t"))
    g = e.where("event_type = 'purchase'").groupBy("user_id", "t").agg(F.min("event_id").alias("event_id"))
    s = e.where("event_type <> 'purchase'").select("user_id", "t", F.col("event_id").alias("gst_event"))
    return matching.pair_epochs(g, s, "user_id", 60_000.0).select("user_id", "event_id", "gst_event")


@query("""SELECT g.event_id, s.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'purchase') g ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2) s ON g.user_id = s.user_id AND g.ts >= s.ts""")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("t", micros())
    right = e.where("event_type <> 'purchase'").groupBy("user_id", "t").agg(F.max("value").alias("last_value"))
    return matching.as_of(e.where("event_type = 'purchase'").select("user_id", "t", "event_id"), right, "user_id", "t", ["last_value"]).select("event_id", "last_value")


_PAIRS = """SELECT c_nationkey AS g, c_custkey AS id, sin(c_custkey) * 20 AS px, cos(c_custkey * 1.7e0) * 20 AS py, sin(c_custkey * 0.3e0) * 3 AS pz,
  cos(0.4e0) * sin(c_custkey) * 20 - sin(0.4e0) * cos(c_custkey * 1.7e0) * 20 + 12.5e0 + c_acctbal * 1e-6 AS qx, sin(0.4e0) * sin(c_custkey) * 20 + cos(0.4e0) * cos(c_custkey * 1.7e0) * 20 - 3.25e0 AS qy,
  sin(c_custkey * 0.3e0) * 3 + 7 AS qz, 1e-2 + 1e-3 * (c_custkey % 5) AS sigma FROM customer"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c, s = F.col("c_custkey"), F.cos(F.lit(0.4)), F.sin(F.lit(0.4))
    px, py, pz = F.sin(k) * 20, F.cos(k * 1.7) * 20, F.sin(k * 0.3) * 3
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("group"), k.cast("string").alias("id"), px.alias("px"), py.alias("py"), pz.alias("pz"), (c * px - s * py + 12.5 + F.col("c_acctbal") * 1e-6).alias("qx"), (s * px + c * py - 3.25).alias("qy"), (pz + 7).alias("qz"), (0.01 + 0.001 * (k % 5)).alias("sigma"))


@query(f"""WITH p AS ({_PAIRS}), w AS (SELECT *, 1 / (sigma * sigma) AS w FROM p), m AS (SELECT g, sum(w * px) / sum(w) AS cx, sum(w * py) / sum(w) AS cy, sum(w * pz) / sum(w) AS cz, sum(w * qx) / sum(w) AS ex, sum(w * qy) / sum(w) AS ey, sum(w * qz) / sum(w) AS ez FROM w GROUP BY 1),
h AS (SELECT g, count(*) AS n, atan2(sum(w * ((px - cx) * (qy - ey) - (py - cy) * (qx - ex))), sum(w * ((px - cx) * (qx - ex) + (py - cy) * (qy - ey)))) AS heading FROM w JOIN m USING (g) GROUP BY 1)
SELECT CAST(g AS VARCHAR) AS "group", n, round(heading, 7) + 0.0 AS heading, round(ex - (cos(heading) * cx - sin(heading) * cy), 5) + 0.0 AS tx, round(ey - (sin(heading) * cx + cos(heading) * cy), 5) + 0.0 AS ty FROM h JOIN m USING (g)""")
def gravity_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registration.solve_gravity(_pairs(spark, sf_dir)).select("group", "n", _r(F.col("heading"), 7).alias("heading"), _r(F.col("tx"), 5).alias("tx"), _r(F.col("ty"), 5).alias("ty"))


@query(f"""WITH p AS ({_PAIRS}), w AS (SELECT *, 1 / (sigma * sigma) AS w FROM p), m AS (SELECT g, sum(w * px) / sum(w) AS cx, sum(w * py) / sum(w) AS cy, sum(w * qx) / sum(w) AS ex, sum(w * qy) / sum(w) AS ey FROM w GROUP BY 1)
SELECT CAST(g AS VARCHAR) AS "group", count(*) AS n, round(sum(w * (px - cx) * (qx - ex)) / 1e6, 5) + 0.0 AS s_xx, round(sum(w * (px - cx) * (qy - ey)) / 1e6, 5) + 0.0 AS s_xy FROM w JOIN m USING (g) GROUP BY 1""")
def cross_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = registration.cross_covariance(_pairs(spark, sf_dir))
    return got.select("group", "n", *(_r(F.col(c) / 1e6, 5).alias(c) for c in ("s_xx", "s_xy")))


@query()
def horn_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registration.solve_rigid(_pairs(spark, sf_dir))


@query()
def outliers_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir).withColumn("qx", F.when(F.pmod(F.col("id").cast("long"), F.lit(97)) == 0, F.col("qx") + 0.3).otherwise(F.col("qx")))
    return registration.find_outliers(p)


@query()
def best_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registration.solve_best(_pairs(spark, sf_dir))


@query("""WITH a AS (SELECT c_nationkey AS g, sin(c_custkey) AS px, cos(c_custkey * 1.7e0) AS pz, cos(0.7e0) * sin(c_custkey) + sin(0.7e0) * cos(c_custkey * 1.7e0) + 2 AS qx, -sin(0.7e0) * sin(c_custkey) + cos(0.7e0) * cos(c_custkey * 1.7e0) + c_acctbal * 1e-6 AS qz FROM customer),
m AS (SELECT g, avg(px) AS cx, avg(pz) AS cz, avg(qx) AS ex, avg(qz) AS ez FROM a GROUP BY 1)
SELECT CAST(g AS VARCHAR) AS "group", count(*) AS n, round(atan2(sum((pz - cz) * (qx - ex) - (px - cx) * (qz - ez)), sum((px - cx) * (qx - ex) + (pz - cz) * (qz - ez))), 7) + 0.0 AS yaw FROM a JOIN m USING (g) GROUP BY 1""")
def hand_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c, s = F.col("c_custkey"), F.cos(F.lit(0.7)), F.sin(F.lit(0.7))
    px, pz = F.sin(k), F.cos(k * 1.7)
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("group"), px.alias("px"), F.lit(0.0).alias("py"), pz.alias("pz"), (c * px + s * pz + 2).alias("qx"), F.lit(1.0).alias("qy"), (-s * px + c * pz + F.col("c_acctbal") * 1e-6).alias("qz"))
    return registration.hand_placement(a).select("group", "n", _r(F.col("yaw"), 7).alias("yaw"))


@query("""WITH e AS (SELECT l_suppkey AS k, l_extendedprice * (1 + sin(l_partkey)) AS e FROM lineitem), u AS (SELECT k, list_sort(list(e))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS upper, median(e) AS mean FROM e GROUP BY 1)
SELECT k AS suppkey, round(upper, 4) + 0.0 AS upper_median, round(mean, 4) + 0.0 AS mean_median, round(1.4826e0 * median(abs(e - mean)), 4) + 0.0 AS mad FROM e JOIN u USING (k) GROUP BY 1, 2, 3""")
def mad_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("suppkey"), (F.col("l_extendedprice") * (1 + F.sin("l_partkey"))).alias("e"))
    u = e.groupBy("suppkey").agg(V.upper_median(F.col("e")).alias("u"), V.mean_median(F.col("e")).alias("m"))
    got = e.join(u, "suppkey").groupBy("suppkey", "u", "m").agg((1.4826 * F.median(F.abs(F.col("e") - F.col("m")))).alias("mad"))
    return got.select("suppkey", _r(F.col("u"), 4).alias("upper_median"), _r(F.col("m"), 4).alias("mean_median"), _r(F.col("mad"), 4).alias("mad"))


@query("""WITH e AS (SELECT l_suppkey AS k, l_orderkey AS o, l_linenumber AS l, l_quantity + sin(l_partkey) AS dx, l_discount * 100 + cos(l_partkey) AS dy FROM lineitem), m AS (SELECT k, median(dx) AS mx, median(dy) AS my, count(*) AS n FROM e GROUP BY 1),
s AS (SELECT k, 1.4826e0 * median(abs(dx - mx)) AS sx, 1.4826e0 * median(abs(dy - my)) AS sy FROM e JOIN m USING (k) GROUP BY 1)
SELECT k AS pair, o, l FROM e JOIN m USING (k) JOIN s USING (k) WHERE n < 8 OR (abs(dx - mx) <= 0.5e0 * sx + 2 AND abs(dy - my) <= 0.5e0 * sy + 2)""")
def motion_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pair"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), (F.col("l_quantity") + F.sin("l_partkey")).alias("dx"), (F.col("l_discount") * 100 + F.cos("l_partkey")).alias("dy"))
    return matching.motion_filter(e, 0.5).select("pair", "o", "l")


def _descriptors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bits = lambda a: sum((F.when(F.get("embedding", F.lit(a + i)) > 0, F.lit(1 << i)).otherwise(0) for i in range(16)), F.lit(0)).cast("long")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("kp"), F.col("label").cast("string").alias("pair"), *(bits(16 * k).alias(f"d{k}") for k in range(4)))
    return e.where("kp % 2 = 0"), e.where("kp % 2 = 1")


_BITS = "list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)"
_NEAR = "SELECT *, row_number() OVER (PARTITION BY pair, a ORDER BY d, b) AS rank, lead(d) OVER (PARTITION BY pair, a ORDER BY d, b) AS second FROM ({})"
_HAMMING = f"""WITH e AS (SELECT vec_id AS kp, CAST(label AS VARCHAR) AS pair, {_BITS} AS v FROM embeddings),
d AS (SELECT x.pair, x.kp AS a, y.kp AS b, CAST(list_sum(list_transform(list_zip(x.v, y.v), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS INT) AS d FROM e x JOIN e y ON x.pair = y.pair AND x.kp % 2 = 0 AND y.kp % 2 = 1),
f AS ({_NEAR.format("d")}), r AS ({_NEAR.format("SELECT pair, b AS a, a AS b, d FROM d")})"""


@query(f"{_HAMMING} SELECT pair, a, b, d AS distance FROM f WHERE rank = 1 AND d < 0.95 * second")
def hamming_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.nearest_two(*_descriptors(spark, sf_dir), ratio=0.95)


@query(f"{_HAMMING} SELECT f.pair, f.a, f.b, f.d AS distance FROM f JOIN r ON f.pair = r.pair AND f.a = r.b AND f.b = r.a WHERE f.rank = 1 AND r.rank = 1 AND f.d < 0.95 * f.second AND r.d < 0.95 * r.second")
def mutual_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.mutual(*_descriptors(spark, sf_dir), ratio=0.95)


@query("""WITH p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings), c AS (SELECT *, floor(x / 0.1e0) AS cx, floor(y / 0.1e0) AS cy, floor(z / 0.1e0) AS cz FROM p),
d AS (SELECT a.id, b.id AS o, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d FROM c a JOIN c b ON abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AND abs(a.cz - b.cz) <= 1 AND a.id <> b.id),
k AS (SELECT id, avg(d) AS m FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, o) AS r FROM d) WHERE r <= 3 GROUP BY 1)
SELECT p.id, round(greatest(coalesce(m, 0.1e0), 1e-4), 7) + 0.0 AS spacing FROM p LEFT JOIN k ON k.id = p.id""")
def knn_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *(F.get("embedding", F.lit(k)).cast("double").alias(a) for k, a in enumerate("xyz")))
    return matching.grid_neighbours(p, 0.1).select("id", _r(F.col("spacing"), 7).alias("spacing"))


@query("""WITH b AS (SELECT p_brand, max(p_size) AS area FROM part GROUP BY 1), t AS (SELECT sum(area) AS total FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part)
SELECT r.p_partkey AS id, r.p_brand AS level, r.p_retailprice AS score FROM r JOIN b ON b.p_brand = r.p_brand CROSS JOIN t WHERE rank <= floor(100.0 * b.area / total + 0.5) ORDER BY score DESC, id LIMIT 100""")
def level_budget_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hundred by level budgets; a top-k report, so its limit is its meaning."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("level"), F.col("p_retailprice").alias("score"), F.col("p_size").alias("area"))
    return matching.level_budget(p, 100).select("id", "level", "score")


@query()
def nms_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("image"), F.lit(0).alias("level"), (F.sin("p_partkey") * 100).alias("x"), (F.cos(F.col("p_partkey") * 1.7) * 100).alias("y"), F.col("p_retailprice").alias("score"))
    return matching.non_max_suppression(p, 8.0)


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS z, l_extendedprice AS p, l_partkey AS q, least(l_discount + 1e-2, 0.99e0) AS a, sin(l_partkey) AS c FROM lineitem WHERE l_discount + 1e-2 >= 1e0 / 255),
t AS (SELECT *, coalesce(exp(sum(ln(1 - a)) OVER (PARTITION BY k ORDER BY z, p, q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS t FROM l)
SELECT k AS orderkey, round(sum(t * a * c), 8) + 0.0 AS colour FROM t WHERE t >= 1e-4 GROUP BY 1""")
def alpha_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_linenumber", "l_extendedprice", "l_partkey", (F.col("l_discount") + 0.01).alias("alpha"), F.sin("l_partkey").alias("colour"))  # noqa: E741
    got = splats.composite(l, ["orderkey"], ["l_linenumber", "l_extendedprice", "l_partkey"], "alpha", ["colour"])
    return got.select("orderkey", _r(F.col("colour"), 8).alias("colour"))


@query("""SELECT l_returnflag AS flag, round(avg(abs(a - b)), 8) + 0.0 AS l1, round(10 * log10(1 / avg(pow(a - b, 2))), 6) + 0.0 AS psnr, round(sqrt(avg(pow(a - b, 2))), 8) + 0.0 AS rms FROM (SELECT l_returnflag, sin(l_partkey) AS a, cos(l_suppkey) AS b FROM lineitem) GROUP BY 1""")
def l1_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.sin("l_partkey"), F.cos("l_suppkey")
    got = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(splats.l1(a, b).alias("l1"), splats.psnr(a, b).alias("psnr"), F.sqrt(F.avg((a - b) * (a - b))).alias("rms"))
    return got.select("flag", _r(F.col("l1"), 8).alias("l1"), _r(F.col("psnr")).alias("psnr"), _r(F.col("rms"), 8).alias("rms"))


def _grid_mesh(spark: SparkSession, side: int = 30) -> tuple[DataFrame, DataFrame]:
    n = side + 1
    i = F.col("id")
    x, y = i % n, F.floor(i / n)
    v = spark.range(n * n).select(i.alias("vid"), (x / side).alias("x"), (y / side).alias("y"), (0.15 * F.sin(x * 0.5) * F.cos(y * 0.4)).alias("z"))
    q = spark.range(side * side).select((F.floor(i / side) * n + i % side).cast("long").alias("o"), i)
    f = q.select((i * 2).alias("fid"), F.col("o").alias("a"), (F.col("o") + 1).alias("b"), (F.col("o") + n).alias("c")).unionByName(q.select((i * 2 + 1).alias("fid"), (F.col("o") + 1).alias("a"), (F.col("o") + n + 1).alias("b"), (F.col("o") + n).alias("c")))
    return v, f


def _part_mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All parts as the vertices of a strip of 40 across, with two triangles between four of them."""
    p = table(spark, sf_dir, "part")
    i = F.col("vid")
    x, y = i % 40, F.floor(i / 40)
    v = p.select(F.col("p_partkey").cast("long").alias("vid"), "p_retailprice").select(
        i, (x / 39).alias("x"), (y / 39).alias("y"), (0.15 * F.sin(x * 0.5) * F.cos(y * 0.4) + F.col("p_retailprice").cast("double") * 1e-6).alias("z")
    )
    q = v.where(i % 40 < 39).select(i.alias("o")).join(v.select((i - 41).alias("o")), "o", "left_semi")
    o = F.col("o")
    f = q.select((o * 2).alias("fid"), o.alias("a"), (o + 1).alias("b"), (o + 40).alias("c")).unionByName(q.select((o * 2 + 1).alias("fid"), (o + 1).alias("a"), (o + 41).alias("b"), (o + 40).alias("c")))
    return v, f


_GRID = """v AS (SELECT vid, (vid % 40) / 39e0 AS x, floor(vid / 40.0) / 39e0 AS y, 0.15e0 * sin((vid % 40) * 0.5e0) * cos(floor(vid / 40.0) * 0.4e0) + CAST(p_retailprice AS DOUBLE) * 1e-6 AS z
  FROM (SELECT CAST(p_partkey AS BIGINT) AS vid, p_retailprice FROM part)),
q AS (SELECT vid AS o FROM v WHERE vid % 40 < 39 AND vid + 41 IN (SELECT vid FROM v)), f AS (SELECT o * 2 AS fid, o AS a, o + 1 AS b, o + 40 AS c FROM q UNION ALL SELECT o * 2 + 1, o + 1, o + 41, o + 40 FROM q),
n AS (SELECT f.*, (b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y) AS nx, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) AS ny, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS nz,
  (a.x * (b.y * c.z - b.z * c.y) + a.y * (b.z * c.x - b.x * c.z) + a.z * (b.x * c.y - b.y * c.x)) / 6 AS vol FROM f JOIN v a ON a.vid = f.a JOIN v b ON b.vid = f.b JOIN v c ON c.vid = f.c)"""


@query(f"""WITH {_GRID}, s AS (SELECT vid, sum(nx) AS x, sum(ny) AS y, sum(nz) AS z FROM (SELECT unnest([a, b, c]) AS vid, nx, ny, nz FROM n) GROUP BY 1)
SELECT vid, round(x / sqrt(x * x + y * y + z * z), 7) + 0.0 AS nx, round(y / sqrt(x * x + y * y + z * z), 7) + 0.0 AS ny, round(z / sqrt(x * x + y * y + z * z), 7) + 0.0 AS nz FROM s""")
def face_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = _part_mesh(spark, sf_dir)
    return mesh.vertex_normals(f, v).select("vid", *(_r(F.col(f"n{a}"), 7).alias(f"n{a}") for a in "xyz"))


@query(f"WITH {_GRID} SELECT round(sum(sqrt(nx * nx + ny * ny + nz * nz)) / 2, 7) + 0.0 AS area, round(sum(vol), 7) + 0.0 AS volume FROM n")
def signed_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = _part_mesh(spark, sf_dir)
    return mesh.area_and_volume(f, v).select(_r(F.col("area"), 7).alias("area"), _r(F.col("volume"), 7).alias("volume"))


_EDGES = "SELECT c_custkey AS u, 1000000 + c_custkey % 977 AS v FROM customer UNION SELECT 2000000 + s_suppkey, 1000000 + s_suppkey * 7 % 977 FROM supplier"


@query(f"""WITH RECURSIVE e AS ({_EDGES}), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r AS (SELECT u AS node, u AS seen FROM b UNION SELECT r.node, b.v FROM r JOIN b ON b.u = r.seen)
SELECT node, min(seen) AS label FROM r GROUP BY 1""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("u"), (1_000_000 + F.col("c_custkey") % 977).alias("v"))
    s = table(spark, sf_dir, "supplier").select((2_000_000 + F.col("s_suppkey")).alias("u"), (1_000_000 + F.col("s_suppkey") * 7 % 977).alias("v"))
    return mesh.connected(c.unionByName(s))


@query("""SELECT n_nationkey AS nation, round(sqrt(max(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))), 6) + 0.0 AS baseline FROM (SELECT n_nationkey FROM nation WHERE n_nationkey = 3)
CROSS JOIN (SELECT sin(s_suppkey) * 10 AS x, cos(s_suppkey * 1.7e0) * 8 AS y, s_acctbal / 1e4 AS z FROM supplier) a CROSS JOIN (SELECT sin(s_suppkey) * 10 AS x, cos(s_suppkey * 1.7e0) * 8 AS y, s_acctbal / 1e4 AS z FROM supplier) b GROUP BY 1""")
def max_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    p = table(spark, sf_dir, "supplier").select((F.sin(k) * 10).alias("x"), (F.cos(k * 1.7) * 8).alias("y"), (F.col("s_acctbal") / 1e4).alias("z"))
    return mesh.max_baseline(p).select(F.lit(3).alias("nation"), _r(F.col("baseline")).alias("baseline"))


@query("SELECT arg_min(s_suppkey, pow(sin(s_suppkey) * 10 - 1, 2) + pow(cos(s_suppkey * 1.7e0) * 8 - 2, 2)) AS vid FROM supplier")
def nearest_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    v = table(spark, sf_dir, "supplier").select(k.alias("vid"), (F.sin(k) * 10).alias("x"), (F.cos(k * 1.7) * 8).alias("y"), F.lit(0.0).alias("z"))
    return mesh.nearest_vertex(v, V.vec(1, 2, 0)).select("vid")


@query("SELECT 'P' || (max(s_suppkey) + 1) AS next_id FROM supplier WHERE s_suppkey >= 100 HAVING max(s_suppkey) >= 100 UNION ALL SELECT 'P' || lpad(CAST(max(s_suppkey) + 1 AS VARCHAR), 3, '0') FROM supplier HAVING max(s_suppkey) < 100")
def next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.concat(F.lit("P"), F.col("s_suppkey").cast("string"))
    return table(spark, sf_dir, "supplier").agg(T.next_point_id(ids).alias("next_id"))


@query("""WITH o AS (SELECT floor((min(l_extendedprice) + max(l_extendedprice)) / 2 + 0.5) AS o FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(floor((l_extendedprice + sin(l_partkey) - o) / 1e-3 + 0.5) AS BIGINT) AS q FROM lineitem, o""")
def las_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    o = li.agg(F.floor((F.min("l_extendedprice") + F.max("l_extendedprice")) / 2 + 0.5).alias("o"))
    got = li.crossJoin(F.broadcast(o))  # one row
    return got.select("l_orderkey", "l_linenumber", F.floor((F.col("l_extendedprice") + F.sin("l_partkey") - F.col("o")) / 1e-3 + 0.5).cast("bigint").alias("q"))


@query("""SELECT vec_id, round(exp(embedding[1]), 6) + 0.0 AS scale, round(1 / (1 + exp(-CAST(embedding[2] AS DOUBLE))), 6) + 0.0 AS opacity, CAST(embedding[5] AS DOUBLE) AS first_green, CAST(embedding[6] AS DOUBLE) AS second_green FROM embeddings""")
def splat_activate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activations, and two coefficients of one channel found by their places in channel-major order."""
    e = table(spark, sf_dir, "embeddings")
    rest = splats.to_coefficient_major(F.slice("embedding", 1, 9), 3)
    at = lambda k: F.get(rest, F.lit(k)).cast("double")
    return e.select("vec_id", _r(F.exp(F.get("embedding", F.lit(0)).cast("double"))).alias("scale"), _r(splats.sigmoid(F.get("embedding", F.lit(1)).cast("double"))).alias("opacity"), at(4).alias("first_green"), at(7).alias("second_green"))


@query("""SELECT doc_id, 'recovered' AS origin FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) UNION ALL SELECT doc_id, 'index' FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)""")
def reconcile_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index against what is on disk: listed ones that exist, and found ones that are not listed."""
    disk, index = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    found = interop.reconcile(index.toDF("id"), disk.toDF("id"))
    return found.select(F.col("id").alias("doc_id"), F.when(F.col("recovered"), "recovered").otherwise("index").alias("origin"))


@query("""SELECT doc_id, quality + 10 AS quality FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, quality FROM labels WHERE doc_id % 2 = 1""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the same id give way to the new ones."""
    old = table(spark, sf_dir, "labels").select("doc_id", "quality")
    new = old.where("doc_id % 2 = 0").withColumn("quality", F.col("quality") + 10)
    return records.upsert(old, new, "doc_id")


@query("""SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND contains(lower(source), 'rc1') ORDER BY n_chars DESC, doc_id""")
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "source", "n_chars")
    return records.search(d, " RC1 ", ["source"], [F.desc("n_chars"), F.asc("doc_id")])


@query("""SELECT 'P' || o_orderkey AS id, o_totalprice AS easting, CAST(o_custkey AS DOUBLE) AS northing, CAST(o_orderkey % 100 AS DOUBLE) AS elevation, CASE WHEN o_orderkey % 4 = 0 THEN 'checkpoint' ELSE 'gcp' END AS role FROM orders WHERE o_orderkey % 5 <> 0""")
def pnezd_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.survey import parse_pnezd

    k = F.col("o_orderkey")
    line = F.when(k % 5 == 0, "Point,Northing,Easting,Elev,Desc").otherwise(F.concat_ws(",", F.concat(F.lit("P"), k.cast("string")), F.col("o_custkey").cast("string"), F.col("o_totalprice").cast("string"), (k % 100).cast("string"), F.when(k % 4 == 0, "CHK").otherwise("GCP")))
    got = parse_pnezd(table(spark, sf_dir, "orders").select(line.alias("value")))
    return got.select("id", "easting", "northing", "elevation", "role")


@query("""SELECT 'M' || s_suppkey AS mount, CAST(s_nationkey AS DOUBLE) AS lat, CAST(-s_nationkey AS DOUBLE) AS lon, s_suppkey % 2 = 1 AS needs_auth FROM supplier""")
def ntrip_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.survey import parse_ntrip

    k = F.col("s_suppkey")
    line = F.concat_ws(";", F.lit("STR"), F.concat(F.lit("M"), k.cast("string")), F.lit("Town"), F.lit("RTCM 3.2"), F.lit("1004"), F.lit("2"), F.lit("GPS"), F.lit("NET"), F.lit("USA"), F.col("s_nationkey").cast("string"), (-F.col("s_nationkey")).cast("string"), F.lit("1"), F.lit("1"), F.lit("gen"), F.lit("none"), F.when(k % 2 == 1, "B").otherwise("N"), F.lit("N"), F.lit("9600"))
    return parse_ntrip(table(spark, sf_dir, "supplier").select(line.alias("value"))).select("mount", "lat", "lon", "needs_auth")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 43200000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, count(*) AS n, min(ts) AS started, max(ts) AS ended FROM s GROUP BY user_id, s""")
def silence_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a device's sightings without a silence of over twelve hours."""
    s = records.sessions(table(spark, sf_dir, "events"), "user_id", micros(), ["ts", "event_id"], 43_200_000_000)
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended")).drop("session")


@query("""WITH RECURSIVE e AS (SELECT user_id AS capture, epoch_us(ts) AS t, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), value) AS n FROM events),
r AS (SELECT capture, n, t, x, x AS last, true AS keep FROM e WHERE n = 1
  UNION ALL SELECT e.capture, e.n, e.t, e.x, CASE WHEN abs(e.x - r.last) >= 25 THEN e.x ELSE r.last END, abs(e.x - r.last) >= 25 FROM r JOIN e ON e.capture = r.capture AND e.n = r.n + 1)
SELECT capture, t, x, 0e0 AS y, 0e0 AS z FROM r WHERE keep""")
def keyframe_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events kept when their value has moved far enough from the last kept one of the user."""
    from ..streaming.keyframes import keep_moved

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("capture"), micros().alias("t"), F.col("value").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return keep_moved(e, 25.0)


@query("SELECT l_shipdate >= TIMESTAMP '1996-01-01' AS late, count(*) FILTER (WHERE l_returnflag = 'R') AS gcp, count(*) FILTER (WHERE l_returnflag <> 'R') AS checkpoint FROM lineitem GROUP BY 1")
def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("l_returnflag") == "R", "gcp").otherwise("checkpoint")
    return records.role_counts(table(spark, sf_dir, "lineitem"), (F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp")).alias("late"), role)


@query("""WITH p AS (SELECT user_id, ts, event_id, value AS x, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, round(sum(sqrt(pow(x - before, 2) + pow(sin(x) - sin(before), 2))), 6) + 0.0 AS path FROM p GROUP BY 1""")
def path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("p", V.vec(F.col("value"), F.sin("value"), 0.0))
    return records.path_length(e, "user_id", ["ts", "event_id"]).select("user_id", _r(F.col("path")).alias("path"))


@query("""SELECT c_mktsegment AS segment, dense_rank() OVER (ORDER BY first) - 1 AS camera, n FROM (SELECT c_mktsegment, min(c_custkey) AS first, count(*) AS n FROM customer GROUP BY 1)""")
def camera_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras numbered by where they first appear; ranks run over the few distinct ones."""
    got = records.number_cameras(table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "segment"), "segment", "c_custkey")
    return got.withColumnRenamed("number", "camera")
