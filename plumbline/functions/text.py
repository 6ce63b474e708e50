"""Parsing of survey text: NMEA, angles, XMP, payload links, endpoints, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each GGA quality indicator is called; only 4 is usable.
FIX_QUALITY = {0: "No fix", 1: "Single point", 2: "DGPS", 3: "PPS", 4: "RTK fixed", 5: "RTK float", 6: "Dead reckoning", 7: "Manual input", 8: "Simulated"}


def number(c: Column) -> Column:
    return c.try_cast("double")


def nmea_checksum(body: Column) -> Column:
    """The exclusive or of the body's characters."""
    return F.aggregate(F.split(body, ""), F.lit(0), lambda a, c: a.bitwiseXOR(F.ascii(c)))


def nmea(line: Column) -> Column:
    """struct(talker, type, fields, valid), or null for what is no sentence.

    The checksum counts only as two hexadecimal digits.
    """
    t = F.trim(line)
    has = t.rlike(r"^.*\*[0-9A-Fa-f]{2}")
    body = F.regexp_extract(t, r"^[$!](.*?)(?:\*[^*]*)?$", 1)
    declared = F.conv(F.regexp_extract(t, r"\*([0-9A-Fa-f]{2})[^*]*$", 1), 16, 10).cast("int")
    parts = F.split(body, ",")
    tag = F.get(parts, F.lit(0))
    own = tag.startswith("P")
    out = F.struct(
        F.when(own, "P").otherwise(F.substring(tag, 1, 2)).alias("talker"),
        F.when(own, F.substring(tag, 2, 1 << 20)).otherwise(F.substring(tag, 3, 1 << 20)).alias("type"),
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("fields"),
        (has & (nmea_checksum(body) == declared)).alias("valid"),
    )
    return F.when(t.rlike(r"^[$!]"), out)


def nmea_coordinate(value: Column, hemisphere: Column) -> Column:
    """ddmm.mmmm or dddmm.mmmm to signed degrees."""
    v = number(value)
    whole = F.floor(v / 100)
    degrees = whole + (v - whole * 100) / 60
    return F.when(hemisphere.isin("S", "W"), -degrees).otherwise(degrees)


def utc_seconds(value: Column) -> Column:
    """hhmmss.sss to seconds of the day."""
    part = lambda a, n: number(F.substring(value, a, n))
    return F.when(F.length(value) >= 6, part(1, 2) * 3600 + part(3, 2) * 60 + part(5, 1 << 10))


def gga(s: Column) -> Column:
    """A position of a parsed sentence; null without fourteen fields or a position."""
    f = lambda k: F.get(s["fields"], F.lit(k))
    lat, lon = nmea_coordinate(f(1), f(2)), nmea_coordinate(f(3), f(4))
    or_zero = lambda k: F.coalesce(number(f(k)), F.lit(0.0))
    out = F.struct(
        utc_seconds(f(0)).alias("utc_seconds"), lat.alias("lat"), lon.alias("lon"),
        F.coalesce(f(5).try_cast("tinyint"), F.lit(0).cast("tinyint")).alias("quality"), F.coalesce(f(6).try_cast("int"), F.lit(0)).alias("satellites"),
        or_zero(7).alias("hdop"), or_zero(8).alias("orthometric_height"), or_zero(10).alias("geoid_separation"), (or_zero(8) + or_zero(10)).alias("height"),
        number(f(12)).alias("correction_age"), F.nullif(f(13), F.lit("")).alias("station"),
    )
    return F.when((s["type"] == "GGA") & (F.size(s["fields"]) >= 14) & lat.isNotNull() & lon.isNotNull(), out)


def gst(s: Column) -> Column:
    """The accuracy of a parsed sentence; null without eight fields or horizontal sigmas."""
    f = lambda k: F.get(s["fields"], F.lit(k))
    lat, lon = number(f(5)), number(f(6))
    out = F.struct(utc_seconds(f(0)).alias("utc_seconds"), lat.alias("lat_sigma"), lon.alias("lon_sigma"), F.coalesce(number(f(7)), F.lit(0.0)).alias("height_sigma"), F.hypot(lat, lon).alias("horizontal_sigma"))
    return F.when((s["type"] == "GST") & (F.size(s["fields"]) >= 8) & lat.isNotNull() & lon.isNotNull(), out)


def fix_usable(quality: Column) -> Column:
    return F.coalesce(quality == 4, F.lit(False))


def fix_label(quality: Column) -> Column:
    out = F.lit(FIX_QUALITY[0])
    for k, v in FIX_QUALITY.items():
        out = F.when(quality == k, v).otherwise(out)
    return out


def dms_degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    v = d + m / 60 + s / 3600
    return F.when(F.upper(ref).isin("S", "W"), -v).otherwise(v)


def exif_time(value: Column) -> Column:
    """'yyyy:MM:dd HH:mm:ss' to ISO without a zone."""
    p = r"^(\d{4}):(\d{2}):(\d{2}) (\d{2}:\d{2}:\d{2})"
    part = lambda k: F.regexp_extract(value, p, k)
    return F.when(value.rlike(p), F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit("T"), part(4)))


def xmp_value(xmp: Column, name: str) -> Column:
    """An XMP property written as an attribute, else as an element."""
    attribute = F.regexp_extract(xmp, rf'(?i)[\w-]*:{name}\s*=\s*"([^"]*)"', 1)
    element = F.regexp_extract(xmp, rf"(?is)<[\w-]*:{name}[^>]*>\s*([^<]*?)\s*</", 1)
    return F.coalesce(F.nullif(attribute, F.lit("")), F.nullif(element, F.lit("")))


def xmp_number(xmp: Column, name: str) -> Column:
    return number(F.regexp_replace(xmp_value(xmp, name), r"^\+", ""))


def drone_attitude(xmp: Column) -> Column:
    flag = xmp_value(xmp, "RtkFlag")
    names = {"gimbal_yaw": "GimbalYawDegree", "gimbal_pitch": "GimbalPitchDegree", "gimbal_roll": "GimbalRollDegree", "flight_yaw": "FlightYawDegree", "relative_altitude": "RelativeAltitude", "absolute_altitude": "AbsoluteAltitude"}
    return F.struct(*(xmp_number(xmp, n).alias(k) for k, n in names.items()), (flag.isNotNull() & (flag != "0")).alias("rtk"))


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def link(raw: Column, scheme: str) -> Column:
    """struct(kind, set_id, id) of scheme://p/set/id, scheme://m/bundle and scheme://t/endpoint/token; else null."""
    p = rf"^{scheme}://([pmt])/([^/]+)(?:/(.+))?$"
    part = lambda k: F.nullif(F.regexp_extract(raw, p, k), F.lit(""))
    kind = F.when(part(1) == "p", "point").when(part(1) == "m", "model").when(part(1) == "t", "transfer")
    good = F.when(part(1) == "p", part(2).rlike("^[0-9a-fA-F]{8}$") & part(3).isNotNull()).when(part(1) == "t", part(2).rlike("^[0-9a-fA-F]{12}$") & part(3).isNotNull()).otherwise(part(2).isNotNull())
    return F.when(raw.rlike(p) & good, F.struct(kind.alias("kind"), part(2).alias("set_id"), part(3).alias("id")))


def endpoint_from_hex(code: Column) -> Column:
    """Twelve hexadecimal digits: four bytes of address, two of port."""
    byte = lambda k: F.conv(F.substring(code, 2 * k + 1, 2), 16, 10)
    host = F.concat_ws(".", *(byte(k) for k in range(4)))
    port = F.conv(F.substring(code, 9, 4), 16, 10).cast("int")
    return F.when(code.rlike("^[0-9a-fA-F]{12}$"), F.struct(host.alias("host"), port.alias("port")))


def endpoint(raw: Column, default_port: int = 2101) -> Column:
    """struct(host, port): a scheme and a path go; IPv6 hosts stand in brackets; ports are 1 to 65535."""
    t = F.regexp_replace(F.regexp_replace(F.trim(raw), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"/.*$", "")
    six = r"^\[([0-9A-Fa-f:.]+)\](?::(\d+))?$"
    four = r"^([^:\s]+)(?::(\d+))?$"
    bare = F.size(F.split(t, ":")) > 2
    host = F.when(t.rlike(six), F.regexp_extract(t, six, 1)).when(t.rlike(four), F.regexp_extract(t, four, 1)).when(bare & t.rlike("^[0-9A-Fa-f:.]+$"), t)
    digits = F.nullif(F.when(t.rlike(six), F.regexp_extract(t, six, 2)).when(t.rlike(four), F.regexp_extract(t, four, 2)), F.lit(""))
    port = F.coalesce(F.when(digits.isNotNull(), F.coalesce(digits.try_cast("int"), F.lit(-1))), F.lit(default_port))
    return F.when(host.isNotNull() & port.between(1, 65535), F.struct(host.alias("host"), port.alias("port")))


def path_is_safe(name: Column) -> Column:
    """Relative, without '..', backslash, colon or control characters, of 255 bytes at most."""
    parts = F.split(name, "/")
    return F.coalesce((F.octet_length(name) <= 255) & (name != "") & ~name.startswith("/") & ~name.rlike(r"[\\:\x00-\x1f\x7f]") & ~F.exists(parts, lambda p: p.isin("", ".", "..")), F.lit(False))


def version_supported(version: Column, major: int = 1) -> Column:
    return F.coalesce(F.split_part(version, F.lit("."), F.lit(1)).try_cast("int") == major, F.lit(False))


def stream_kind(data: Column) -> Column:
    """What the first bytes of a receiver's stream are."""
    h = F.hex(F.substring(data, 1, 512))
    text = F.decode(F.substring(data, 1, 512), "ISO-8859-1")
    return F.when(text.rlike(r"[$!][A-Z]{2}[A-Z0-9]{3},"), "nmea").when(h.rlike("^(..)*?D30[0-3]"), "rtcm3").when(h.rlike("^(..)*?B562"), "ubx").otherwise("unrecognised")


def gimbal_rotation(yaw: Column, pitch: Column, roll: Column) -> Column:
    """The camera's rotation in an east-north-up frame, of compass yaw and gimbal pitch and roll (degrees)."""
    from . import vectors as V

    half = 0.5**0.5
    base = V.quat(-half, 0, 0, half)  # camera z to north, y to down
    turn = V.quat_from_axis_angle(V.vec(0, 0, 1), -F.radians(yaw))
    tilt = V.quat_from_axis_angle(V.vec(1, 0, 0), F.radians(pitch))
    bank = V.quat_from_axis_angle(V.vec(0, 0, 1), F.radians(roll))
    return V.quat_multiply(V.quat_multiply(V.quat_multiply(turn, base), tilt), bank)


def next_point_id(ids: Column) -> Column:
    """Aggregate: P and the largest number so far and one, in three digits at least."""
    n = F.coalesce(F.max(F.regexp_extract(ids, r"^P(\d+)$", 1).try_cast("int")), F.lit(0)) + 1
    return F.concat(F.lit("P"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string")))
