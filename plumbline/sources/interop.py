"""Exchange files: point sets, model bundles, capture and project records, presets, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import version_supported

POINTS = "contractVersion string, setId string, provenance map<string,string>, points array<struct<id:string,label:string,position:array<double>,grid:struct<easting:double,northing:double,elevation:double>,viewpoint:struct<position:array<double>,direction:array<double>>,qrPayload:string>>"
BUNDLE = "contractVersion string, bundleId string, modelId string, name string, appliedOffset array<double>, importedAt string, zUp boolean"

# The presets' names and numbers.
DETAIL = (("fast", 0.05, 0.05), ("balanced", 0.025, 0.12), ("fine", 0.012, 0.4))


class ProcessingError(Exception):
    """A failure with a hint at what to do."""

    def __init__(self, message: str, hint: str):
        super().__init__(f"{message}. {hint}")
        self.message, self.hint = message, hint


def detail_levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DETAIL, "level string, voxel double, seconds_per_frame double")


def estimate_seconds(frames: int, level: str, mesh: bool) -> float:
    return frames * next(s for n, _, s in DETAIL if n == level) * (1.6 if mesh else 1.0)


# Mode, subject distance (m), overlap, rotation threshold, voxel, least and largest depth (m), share of triangles kept.
SCAN_MODES = (("object", 0.6, 0.92, 0.09, 0.006, 0.10, 1.5, 0.4), ("room", 2.0, 0.9, 0.13, 0.025, 0.15, 5.0, 0.25), ("area", 5.0, 0.85, 0.17, 0.05, 0.30, 5.0, 0.12))
# Cleanup, share of triangles kept (none: all), extent of noise in voxels.
CLEANUPS = (("none", None, 0.0), ("standard", 0.25, 3.0), ("aggressive", 0.06, 6.0))


def scan_modes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCAN_MODES, "mode string, distance double, overlap double, rotation double, voxel double, min_depth double, max_depth double, keep double")


def cleanups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLEANUPS, "cleanup string, keep double, noise_extent double")


def nearest_cleanup(keep):
    """Column: the cleanup whose share is nearest, the first of two as near; without a share, none."""
    out = F.lit(None).cast("string")
    best = F.lit(float("inf"))
    for name, share, _ in CLEANUPS:
        if share is not None:
            gap = F.abs(F.lit(share) - keep)
            out, best = F.when(gap < best, name).otherwise(out), F.least(best, gap)
    return F.when(keep.isNull(), "none").otherwise(out)


def nearest_preset(voxel: float) -> str:
    return min(DETAIL, key=lambda d: abs(d[1] - voxel))[0]


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """A row per point of point-set files; another major version is an error."""
    raw = spark.read.schema(POINTS).option("multiLine", True).json(path)
    ok = F.when(version_supported(F.col("contractVersion")), F.col("contractVersion")).otherwise(F.raise_error(F.concat(F.lit("contract version isn't supported: "), F.coalesce("contractVersion", F.lit("none")))))
    return raw.withColumn("contractVersion", ok.cast("string")).select("contractVersion", "setId", "provenance", F.explode("points").alias("p")).select("contractVersion", "setId", "provenance", "p.*")


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Model bundles, newest first; either spelling of the id counts."""
    raw = spark.read.schema(BUNDLE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "ar-model.json").json(path)
    return raw.withColumn("id", F.coalesce("bundleId", "modelId")).where("id is not null").orderBy(F.desc("importedAt"), "id")


def write_points(points: DataFrame) -> DataFrame:
    """One JSON text per set of points(setId, id, label, x, y, z), keys in a fixed order.

    A set is what one person has measured, so it fits a row.
    """
    rows = F.sort_array(F.collect_list(F.struct("id", "label", F.array("x", "y", "z").alias("position"))))
    return points.groupBy("setId").agg(rows.alias("points")).select("setId", F.to_json(F.struct(F.lit("1.0.0").alias("contractVersion"), "setId", "points")).alias("value"))


def resolve(links: DataFrame, points: DataFrame) -> DataFrame:
    """Links(set_id, id) joined to the points of the first set whose id begins with theirs."""
    got = links.join(points, (F.substring(points["setId"], 1, 8) == links["set_id"]) & (points["id"] == links["id"]))
    return got.groupBy(links["set_id"], links["id"]).agg(F.min_by(points["position"], points["setId"]).alias("position"))


def capture_json(solutions: DataFrame) -> DataFrame:
    """Capture records with their version first and no numbers that JSON lacks."""
    safe = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)).alias(c)
    return solutions.select("capture_id", F.to_json(F.struct(F.lit("1.0.0").alias("contractVersion"), F.col("capture_id").alias("captureId"), F.col("method"), safe("rms"))).alias("value"))


def match_control(observed: DataFrame, control: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Correspondences joined to control by id, and those whose id is unknown."""
    return observed.join(control, "id"), observed.join(control, "id", "left_anti")


def reconcile(index: DataFrame, disk: DataFrame) -> DataFrame:
    """Listed projects that exist, and found ones that are not listed."""
    return index.join(disk, "id", "left_semi").withColumn("recovered", F.lit(False)).unionByName(disk.join(index, "id", "left_anti").withColumn("recovered", F.lit(True)), allowMissingColumns=True)


def save_cached(df: DataFrame, root: str, settings: dict) -> str:
    """Writes a result under the hash of its settings."""
    path = cached_path(root, settings)
    df.write.mode("overwrite").parquet(path)
    return path


def cached_path(root: str, settings: dict) -> str:
    import hashlib
    import json

    return f"{root}/settings_hash={hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:16]}"
