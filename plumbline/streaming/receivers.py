"""Receiver streams: line assembly, position and accuracy pairing, sightings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LINE_CAP = 4096


def split_lines(rest: bytes, chunk: bytes, cap: int = LINE_CAP) -> tuple[list[str], bytes]:
    """Whole lines and what is left over; bytes that don't print go, and so does a line beyond the cap."""
    parts = (rest + chunk).replace(b"\r", b"\n").split(b"\n")
    clean = lambda p: bytes(b for b in p if 32 <= b < 127).decode()
    lines = [clean(p) for p in parts[:-1]]
    return [x for x in lines if x], parts[-1] if len(parts[-1]) <= cap else b""


def lines(chunks: DataFrame) -> DataFrame:
    """Stream of chunks(device, seq, data) to (device, line); a line's beginning waits in the state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest = bytes(state.get[0]) if state.exists else b""
        out: list[str] = []
        for data in pd.concat(list(batches)).sort_values("seq")["data"]:
            got, rest = split_lines(rest, bytes(data))
            out += got
        state.update((rest,))
        yield pd.DataFrame({"device": key[0], "line": out})

    return chunks.groupBy("device").applyInPandasWithState(run, "device string, line string", "rest binary", "append", GroupStateTimeout.NoTimeout)


def sentences(lines: DataFrame) -> DataFrame:
    """Valid sentences: those with a wrong checksum go."""
    return lines.withColumn("s", T.nmea(F.col("line"))).where("s.valid")


def assemble(lines: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """Batch: each position of lines(device, line) with its nearest accuracy, and t since the device's first."""
    from ..operators.matching import pair_epochs

    s = sentences(lines)
    gga = s.select("device", T.gga(F.col("s")).alias("g")).where("g is not null and g.utc_seconds is not null").select("device", F.col("g.utc_seconds").alias("t"), "g.lat", "g.lon", "g.height", "g.orthometric_height", "g.geoid_separation", "g.quality", "g.satellites", "g.hdop")
    gst = s.select("device", T.gst(F.col("s")).alias("g")).where("g is not null and g.utc_seconds is not null").select("device", F.col("g.utc_seconds").alias("t"), F.col("g.horizontal_sigma").alias("h_accuracy"), F.col("g.height_sigma").alias("v_accuracy"))
    got = pair_epochs(gga, gst, "device", tolerance)
    first = Window.partitionBy("device").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return got.withColumn("since", F.col("t") - F.min("t").over(first))


def assemble_stream(gga: DataFrame, gst: DataFrame, tolerance: str = "250 milliseconds", late: str = "5 seconds") -> DataFrame:
    """Stream-stream: positions(device, ts, ..) with accuracies(device, ts, ..) within the tolerance, else alone once late."""
    a = gga.withWatermark("ts", late).alias("a")
    b = gst.withWatermark("ts", late).alias("b")
    near = F.expr(f"a.device = b.device AND b.ts BETWEEN a.ts - INTERVAL {tolerance} AND a.ts + INTERVAL {tolerance}")
    rest = [F.col(f"b.{c}") for c in gst.columns if c not in ("device", "ts")]
    return a.join(b, near, "leftOuter").select("a.*", *rest)


def merge_sightings(sightings: DataFrame) -> DataFrame:
    """Latest state per device: a name or a flag once seen stays."""
    w = Window.partitionBy("id").orderBy("seen").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = sightings.withColumn("_name", F.last(F.nullif("name", F.lit("")), ignorenulls=True).over(w))
    return named.groupBy("id").agg(F.max("_name").alias("name"), F.bool_or("serial").alias("serial"), F.max("seen").alias("seen"), F.max_by("signal", "seen").alias("signal"))


def unexpired(merged: DataFrame, now: float, silence: float = 12.0) -> DataFrame:
    return merged.where(F.lit(now) - F.col("seen") <= silence)


# What the names of receivers contain, by vendor, in order of trial.
VENDORS = (("emlid", "Emlid"), ("reach", "Emlid"), ("trimble", "Trimble"), ("leica", "Leica"), ("topcon", "Topcon"), ("septentrio", "Septentrio"), ("u-blox", "u-blox"), ("ublox", "u-blox"))


def vendor(name: str = "name"):
    """The vendor of the first part that a name contains."""
    out = F.lit(None).cast("string")
    for part, who in reversed(VENDORS):
        out = F.when(F.contains(F.lower(F.col(name)), F.lit(part)), who).otherwise(out)
    return out


def visible(receivers: DataFrame) -> DataFrame:
    """Likely receivers, in a total order."""
    got = receivers.withColumn("vendor", vendor()).where(F.col("vendor").isNotNull() | F.col("serial"))
    return got.orderBy(F.desc(F.col("vendor").isNotNull()), F.desc("serial"), F.desc_nulls_last("signal"), F.asc_nulls_last("vendor"), F.asc_nulls_last("name"), "id")
