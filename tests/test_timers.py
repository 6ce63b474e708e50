"""Timers, expiry and the capture writer on fed streams, with restarts from their checkpoints."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import camera as C
from plumbline.sources import survey
from plumbline.streaming import capture, timers


class Feed:
    """Batches of rows as files that a stream reads one by one; each run goes on where the last one stopped."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, path, schema, 0

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.path}/in/{self.n:04}")
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(self.spark.createDataFrame([], self.schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in/*")

    def run(self, make):
        q = make(self.stream()).writeStream.format("parquet").option("path", f"{self.path}/out").option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return self.spark.read.parquet(f"{self.path}/out")


def at(s):
    return f"CAST(TIMESTAMP_MICROS({round(s * 1e6)}) AS TIMESTAMP)"


def stamped(spark, rows, schema):
    df = spark.createDataFrame(rows, schema.replace("ts timestamp", "s double"))
    return [tuple(r) for r in df.withColumn("s", F.timestamp_micros((F.col("s") * 1e6).cast("long"))).collect()]


def test_reports_come_every_ten_seconds(spark, tmp_path):
    schema = "device string, ts timestamp, sentence string"
    feed = Feed(spark, str(tmp_path), schema)
    clock = lambda s: ("other", s, "x")  # noqa: E731  another device moves time on
    feed.add(stamped(spark, [("a", 100.0, "A0"), ("a", 100.5, "A1"), ("a", 100.2, "old"), ("a", 100.3, None), (None, 100.0, "none")], schema))
    feed.add(stamped(spark, [clock(104.0)], schema))
    feed.run(timers.position_reports)
    feed.add(stamped(spark, [("a", 112.0, "A2"), clock(125.0)], schema))
    feed.add(stamped(spark, [clock(145.0)], schema))
    got = feed.run(timers.position_reports).where("device = 'a'").select(F.col("due").cast("double"), "sentence").orderBy("due").collect()
    assert [tuple(r) for r in got] == [(101.0, "A1"), (111.0, "A1"), (121.0, "A2"), (131.0, "A2"), (141.0, "A2")]


def test_silence_ends_a_receiver(spark, tmp_path):
    schema = "device string, ts timestamp, name string, serial boolean, signal double"
    feed = Feed(spark, str(tmp_path), schema)
    clock = lambda s: ("other", s, None, None, None)
    feed.add(stamped(spark, [("a", 10.0, "Reach", None, -60.0), ("a", 11.0, "", True, -50.0)], schema))
    feed.add(stamped(spark, [("a", 20.0, None, False, -55.0)], schema))
    feed.run(timers.presence)
    feed.add(stamped(spark, [clock(33.0)], schema))
    feed.add(stamped(spark, [clock(40.0)], schema))
    feed.add(stamped(spark, [("a", 50.0, None, None, -70.0)], schema))
    got = feed.run(timers.presence).where("device = 'a'").orderBy("seen", "gone").collect()
    rows = [(r.seen.timestamp(), r.name, r.serial, r.signal, r.gone) for r in got]
    assert rows == [(11.0, "Reach", True, -50.0, False), (20.0, "Reach", True, -55.0, False), (20.0, "Reach", True, -55.0, True), (50.0, None, False, -70.0, False)]


def test_the_machines_clock_fires_without_data(spark, tmp_path):
    import time

    feed = Feed(spark, str(tmp_path), "device string, ts timestamp, sentence string")
    feed.add(stamped(spark, [("a", 1.0, "A")], "device string, ts timestamp, sentence string"))
    made = timers.position_reports(feed.stream(), every=1.0, first=0.5, clock="processing")
    q = made.writeStream.format("memory").queryName("ticks").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="300 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("ticks").count() < 3:
            time.sleep(0.5)
    finally:
        q.stop()
    assert spark.table("ticks").count() >= 3
    with pytest.raises(ValueError, match="clock"):
        timers.position_reports(feed.stream(), clock="sun")


FRAME = f"t double, camera {C.SCHEMA}, pose struct<t:array<double>,q:array<double>>, image_data binary, image_kind string, depth_data binary, depth struct<width:int,height:int,encoding:string,camera:{C.SCHEMA}>, note string"
LENS = ("pinhole", 4, 3, 5.0, 5.0, 2.0, 1.5, None, None, None, None, None, None, None, None)
WIDE = ("pinhole", 8, 6, 5.0, 5.0, 4.0, 3.0, None, None, None, None, None, None, None, None)
POSE = ([0.0, 1.0, 2.0], [0.0, 0.0, 0.0, 1.0])


def frames(*ts, lens=LENS):
    return [(float(t), lens, POSE, bytearray(b"picture %d" % t), "png", bytearray(bytes([1, 2] * 12)), (4, 3, "uint16-mm", LENS), "n") for t in ts]


def test_a_stream_becomes_a_bundle(spark, tmp_path):
    root = str(tmp_path / "bundle")
    feed = Feed(spark, str(tmp_path), FRAME)

    def run(most=4):
        writer = capture.CaptureWriter(root, "site", most)
        feed.stream().writeStream.foreachBatch(writer).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return writer

    feed.add([*frames(3, 1, 2), (None, LENS, *[None] * 6)])
    feed.add(frames(14, 10, 12, 11, 13, 15, lens=WIDE))
    assert run().report == capture.Report(7, 2)
    feed.add(frames(20, lens=WIDE) + frames(21))
    feed.add([(30.0, *[None] * 7)])
    assert run().report == capture.Report(10, 2)
    tables = survey.read_bundle(spark, root)
    manifest = tables["captures"].first()
    assert manifest.frameCount == 10 and manifest.name == "site" and [c.width for c in manifest.cameras] == [4, 8]
    got = [(r.id, r.t, r.camera, r.image) for r in tables["frames"].orderBy("id").collect()]
    assert got[:4] == [("000000", 1.0, 0, "images/000000.png"), ("000001", 2.0, 0, "images/000001.png"), ("000002", 3.0, 0, "images/000002.png"), ("000003", 10.0, 1, "images/000003.png")]
    assert [g[1:3] for g in got[4:]] == [(11.0, 1), (12.0, 1), (13.0, 1), (20.0, 1), (21.0, 0), (30.0, None)] and got[9][3] is None
    assert (tmp_path / "bundle/images/000001.png").read_bytes() == b"picture 2" and len(list((tmp_path / "bundle/depth").iterdir())) == 9
    pixels = survey.depth_pixels(tables["frames"].where("id = '000004'").select("id", "depth"), root)
    assert pixels.count() == 12 and pixels.first().d == pytest.approx(0.513)


def test_a_batch_written_again_takes_its_own_place(spark, tmp_path):
    writer = capture.CaptureWriter(str(tmp_path), "again")
    table = lambda rows: spark.createDataFrame(rows, FRAME)
    writer(table(frames(1, 2)), 0)
    writer(table(frames(3, lens=WIDE)), 1)
    (tmp_path / "_batches/1.json").unlink()  # as if the driver had died before the note
    again = capture.CaptureWriter(str(tmp_path), "again")
    again(table(frames(3, lens=WIDE)), 1)
    again(table(frames(3, lens=WIDE)), 1)
    assert again.report == capture.Report(3, 0)
    rows = survey.read_bundle(spark, str(tmp_path))["frames"].orderBy("id").collect()
    assert [(r.id, r.t, r.camera) for r in rows] == [("000000", 1.0, 0), ("000001", 2.0, 0), ("000002", 3.0, 1)]
    assert len(json.loads((tmp_path / "manifest.json").read_text())["cameras"]) == 2
    again(table([]), 2)
    assert again.report.frames == 3
