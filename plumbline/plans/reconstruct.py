"""From a capture bundle to points and a mesh in one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import fusion, mesh, surface
from ..operators.lineage import checkpointed
from ..sources import pictures, survey

# Voxel sizes in metres.
DETAIL = {"fast": 0.05, "balanced": 0.025, "fine": 0.012}
_WHY = {"no_depth": "have no depth (photographs alone go through sfm)", "no_pose": "have no pose", "unreadable": "have rasters or a camera that can't be read"}
STATES = ("fused", "no_pose", "no_depth", "unreadable")


class NothingFused(ValueError):
    """No frame could be fused; ``hint`` says why."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.hint = ", ".join(f"{counts[s]} of {sum(counts.values())} frames {why}" for s, why in _WHY.items() if counts[s]) or "the capture has no frames"
        super().__init__(f"No frames could be fused: {self.hint}")


@dataclass(frozen=True)
class Reconstruction:
    """voxels as of ``fusion``, points(x, y, z), and with a mesh vertices(vid, x, y, z, nx, ny, nz) and faces(fid, a, b, c).

    Where a fused frame has a picture, voxels, points and vertices have r, g and b
    (0..255, null or white where no picture shows them).  counts: frames by state,
    of ``STATES``.
    """

    voxel: float
    counts: dict[str, int]
    voxels: DataFrame
    points: DataFrame
    vertices: DataFrame | None = None
    faces: DataFrame | None = None


def frame_states(spark: SparkSession, root: str) -> DataFrame:
    """The frames of a bundle with their camera, their pose as structs and their ``state``.

    A frame's depth has a camera of its own, or that of the capture; only
    pinholes are fused.  Rasters that are missing or too short, and frames whose
    confidence raster is, are unreadable: they cost themselves alone.
    """
    tables = survey.read_bundle(spark, root)
    frames = survey.frame_cameras(tables["frames"], tables["captures"])
    frames = frames.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    t, q = F.col("pose.t"), F.col("pose.q")
    pose = F.when(F.col("pose").isNotNull(), F.struct(V.vec(*(F.get(t, F.lit(k)) for k in range(3))).alias("t"), V.quat(*(F.get(q, F.lit(k)) for k in range(4))).alias("q")))
    lens = F.coalesce(F.col("depth.camera"), F.col("intrinsics"))
    df = frames.select("id", "image", "depth", pose.alias("pose"), lens.alias("camera"), F.col("intrinsics").alias("lens"))
    df = survey.sound_rasters(df, root)
    state = F.when(F.col("pose").isNull(), "no_pose").when(F.col("depth").isNull(), "no_depth").when(F.coalesce(F.col("camera.model") == "pinhole", F.lit(False)) & F.col("sound"), "fused").otherwise("unreadable")
    return df.withColumn("state", state).drop("sound")


def reconstruct(spark: SparkSession, root: str, detail: str = "balanced", surfaces: bool = True, min_confidence: int = 1, min_triangles: int = 32, colour: bool = True) -> Reconstruction:
    """Reads, filters and fuses the frames of a bundle and extracts points and, if asked for, a mesh.

    Pixels never leave the plan: rasters are read where their frames are, and
    only fused voxels are shuffled.  Voxels and mesh are cut by reliable
    checkpoints, since points and surface both read them.
    """
    voxel = DETAIL[detail]
    frames = checkpointed(frame_states(spark, root))
    counts = dict.fromkeys(STATES, 0) | {r["state"]: r["count"] for r in frames.groupBy("state").count().collect()}
    if not counts["fused"]:
        raise NothingFused(counts)
    pixels = survey.depth_pixels(frames.where("state = 'fused'").drop("state"), root)
    pixels = pixels.where(F.coalesce("conf", F.lit(min_confidence)) >= min_confidence)
    if colour and frames.where("state = 'fused' and image is not null and lens is not null").limit(1).count():
        pixels = pictures.coloured(pixels, root)
    voxels = checkpointed(fusion.integrate(pixels, voxel))
    points = fusion.extract_points(voxels, voxel)
    if not surfaces:
        return Reconstruction(voxel, counts, voxels, points)
    vertices, faces = surface.march(voxels.select(F.col("vx").alias("x"), F.col("vy").alias("y"), F.col("vz").alias("z"), F.col("sdf").alias("v"), *(c for c in "rgb" if c in voxels.columns)), voxel)
    faces = checkpointed(mesh.remove_small(checkpointed(faces), min_triangles))
    # Edges that are named alike weld; numbers in place of names make the mesh ready for any export.
    faces = faces.withColumn("fid", F.xxhash64("a", "b", "c"))
    vertices, faces = mesh.compact(faces, vertices)
    vertices, faces = checkpointed(vertices), checkpointed(faces.select("fid", "a", "b", "c"))
    normals = mesh.vertex_normals(faces, vertices)
    return Reconstruction(voxel, counts, voxels, points, vertices.join(normals, "vid"), faces)
