"""A stream of frames into a capture bundle, batch by batch.

Each micro-batch has a folder of its own below ``frames.jsonl``, named by its id, and
a note of what it left behind: the number of the next frame, and the cameras so
far.  A batch begins from the note of the one before it, so frames and cameras
count on across batches, and a batch that is written again after a failure gets
the same numbers and takes its own folder's place: nothing is written twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import camera as C
from ..operators import mesh
from ..operators.lineage import checkpointed

#: Cameras of one capture, which go to the driver.
MOST_CAMERAS = 1000


@dataclass
class Report:
    """What the batches so far have written and dropped."""

    frames: int = 0
    dropped: int = 0


class CaptureWriter:
    """For ``foreachBatch`` over frames(t, camera, pose, poseSource, image_data, image_kind, depth_data, depth, ..).

    camera is a struct as of ``functions.camera``; pose is struct(t, q) of arrays.
    image_data and depth_data are files' bytes, written below images/ and depth/;
    depth is struct(width, height, encoding, camera).  All but t may be null or
    left out, and other columns are.  A batch takes ``most_pending`` frames, the
    earliest first, and drops the rest, as a queue that is full does; the
    ``report`` counts them.  Frames of equal time go in the order of a hash.
    """

    OPTIONAL = {"poseSource": "string", "poseWeight": "double", "exposure": "double", "iso": "double", "blur": "double"}

    def __init__(self, root: str, name: str = "capture", most_pending: int = 10_000):
        from ..sources.points import filesystem

        self.root, self.name, self.most = root.rstrip("/"), name, most_pending
        self.system, self.base = filesystem(self.root)
        self.system.create_dir(f"{self.base}/_batches", recursive=True)
        self.report = Report()

    def _note(self, batch: int) -> dict:
        """What the last batch before ``batch`` left behind."""
        from pyarrow import fs

        made = [int(i.base_name.removesuffix(".json")) for i in self.system.get_file_info(fs.FileSelector(f"{self.base}/_batches")) if i.base_name.removesuffix(".json").isdigit()]
        before = [b for b in made if b < batch]
        if not before:
            return {"next": 0, "cameras": [], "dropped": 0}
        with self.system.open_input_stream(f"{self.base}/_batches/{max(before)}.json") as f:
            return json.loads(f.read())

    def _write(self, path: str, value: dict) -> None:
        with self.system.open_output_stream(f"{self.base}/{path}.new", compression=None) as f:
            f.write(json.dumps(value, sort_keys=True).encode())
        self.system.move(f"{self.base}/{path}.new", f"{self.base}/{path}")

    def __call__(self, frames: DataFrame, batch: int) -> None:
        note = self._note(batch)
        for c, kind in {"camera": C.SCHEMA, "pose": "struct<t:array<double>,q:array<double>>", "image_data": "binary", "image_kind": "string", "depth_data": "binary", "depth": f"struct<width:int,height:int,encoding:string,camera:{C.SCHEMA}>", **self.OPTIONAL}.items():
            frames = frames.withColumn(c, (F.col(c) if c in frames.columns else F.lit(None)).cast(kind))
        own = ["t", "camera", "pose", "image_data", "image_kind", "depth_data", "depth", *self.OPTIONAL]
        rows = frames.where("t is not null").select(*own, F.to_json("camera").alias("lens"))
        order = F.xxhash64(*own[:4])
        rows = checkpointed(rows.withColumn("tie", order))
        numbered = mesh.row_numbers(rows, ["t", "tie"], "n")
        seen = Observation()
        taken = numbered.observe(seen, F.count(F.lit(1)).alias("all"), F.count_if(F.col("n") >= self.most).alias("dropped")).where(F.col("n") < self.most)
        taken = checkpointed(taken)
        fresh = taken.where("lens is not null").groupBy("lens").agg(F.min("n").alias("n")).orderBy("n").limit(MOST_CAMERAS + 1).collect()
        cameras = [*note["cameras"], *(r.lens for r in fresh if r.lens not in set(note["cameras"]))]
        if len(cameras) > MOST_CAMERAS:
            raise ValueError(f"over {MOST_CAMERAS} cameras in one capture")
        number = rows.sparkSession.createDataFrame(list(zip(cameras, range(len(cameras)), strict=True)), "lens string, number int")
        named = taken.join(F.broadcast(number), "lens", "left").withColumn("id", F.lpad((F.col("n") + note["next"]).cast("string"), 6, "0"))
        named = named.withColumn("id", F.when(F.length((F.col("n") + note["next"]).cast("string")) > 6, (F.col("n") + note["next"]).cast("string")).otherwise(F.col("id")))
        kind = F.coalesce("image_kind", F.lit("jpg"))
        named = named.withColumns({"image": F.when(F.col("image_data").isNotNull(), F.concat(F.lit("images/"), "id", F.lit("."), kind)), "uri": F.when(F.col("depth_data").isNotNull(), F.concat(F.lit("depth/"), "id", F.lit(".bin")))})
        depth = F.when(F.col("uri").isNotNull(), F.struct(F.col("uri"), F.col("depth.width").alias("width"), F.col("depth.height").alias("height"), F.col("depth.encoding").alias("encoding"), F.col("depth.camera").alias("camera")))
        out = self._files(named).select("id", "t", "image", F.col("number").alias("camera"), "pose", *self.OPTIONAL, depth.alias("depth"))
        out.write.mode("overwrite").json(f"{self.root}/frames.jsonl/batch={batch}")
        counts = seen.get
        kept = counts["all"] - counts["dropped"]
        after = {"next": note["next"] + kept, "cameras": cameras, "dropped": note["dropped"] + counts["dropped"]}
        self._write("manifest.json", {"formatVersion": 1, "name": self.name, "frameCount": after["next"], "cameras": [json.loads(c) for c in cameras]})
        self._write(f"_batches/{batch}.json", after)  # last: from here on the batch counts as written
        self.report = Report(after["next"], after["dropped"])

    def _files(self, named: DataFrame) -> DataFrame:
        """Writes pictures and rasters where their rows are; names follow from numbers, so a second try writes the same files."""
        root = self.root
        schema = named.drop("image_data", "depth_data").schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from ..sources.points import filesystem

            system, base = filesystem(root)
            for d in ("images", "depth"):
                system.create_dir(f"{base}/{d}", recursive=True)
            for b in batches:
                for name, data in (("image", "image_data"), ("uri", "depth_data")):
                    for path, value in zip(b.column(name), b.column(data), strict=True):
                        if value.is_valid:
                            with system.open_output_stream(f"{base}/{path.as_py()}", compression=None) as f:
                                f.write(value.as_buffer())
                yield b.drop_columns(["image_data", "depth_data"])

        return named.mapInArrow(run, schema)


def write_capture(frames: DataFrame, root: str, checkpoint: str, name: str = "capture", most_pending: int = 10_000):
    """A stream writer of frames into the bundle at ``root``; start() it.  See ``CaptureWriter``."""
    return frames.writeStream.foreachBatch(CaptureWriter(root, name, most_pending)).option("checkpointLocation", checkpoint)
