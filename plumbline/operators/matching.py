"""Nearest-neighbour joins: descriptors, grids, epochs and records."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = ("d0", "d1", "d2", "d3")


def hamming(a: str = "a", b: str = "b") -> Column:
    """Differing bits of two descriptors of four longs."""
    return sum((F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in WORDS), F.lit(0))


TILE = 4_096
_NEAR = "pair {pair}, back boolean, kp {kp}, other {kp}, d int"


def _two_least(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in y, distance) of the two least of each row of x, the first in y on ties; distances are below 2**12."""
    places, found = [], []
    step = max(1, (1 << 21) // max(1, len(y)))
    for i in range(0, len(x), step):
        d = np.zeros((len(x[i : i + step]), len(y)), np.int64)
        for w in range(len(WORDS)):
            d += np.bitwise_count(x[i : i + step, w, None] ^ y[None, :, w])
        key = (d << 32) + np.arange(len(y))
        least = np.sort(np.partition(key, min(1, len(y) - 1), axis=1)[:, :2], axis=1)
        places.append(least & 0xFFFFFFFF)
        found.append(least >> 32)
    return np.concatenate(places), np.concatenate(found)


def _near(a: DataFrame, b: DataFrame, ways: tuple[bool, ...], tile: int) -> DataFrame:
    """(pair, back, kp, other, d, rank): the two nearest of each keypoint within its pair, for a in b and (back) for b in a.

    A pair's keypoints are cut into tiles of about ``tile`` by ``tile``, one task
    each, which give back two rows a keypoint; the two least over all tiles are
    taken from those.
    """
    words = [F.col(w) for w in WORDS]
    parts = lambda df, name: df.groupBy("pair").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias(name))
    sizes = parts(a, "pa").join(parts(b, "pb"), "pair")
    ranged = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = lambda n: F.pmod(F.xxhash64("kp"), F.col(n)).cast("int")
    left = a.join(sizes, "pair").select("pair", mine("pa"), F.explode(ranged("pb")), "kp", *words).toDF("pair", "ta", "tb", "kp", *WORDS)
    right = b.join(sizes, "pair").select("pair", F.explode(ranged("pa")), mine("pb"), "kp", *words).toDF("r_pair", "r_ta", "r_tb", "r_kp", *(f"r_{w}" for w in WORDS))

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"pair": [], "back": [], "kp": [], "other": [], "d": []})
        y = y.rename(columns=lambda c: c.removeprefix("r_"))
        x, y = x.sort_values("kp", kind="stable"), y.sort_values("kp", kind="stable")
        bits = [z[list(WORDS)].to_numpy(np.int64).view(np.uint64) for z in (x, y)]
        names, out = (x["kp"].to_numpy(), y["kp"].to_numpy()), []
        for back in ways:
            at, d = _two_least(bits[back], bits[not back])
            out.append(pd.DataFrame({"pair": x["pair"].iloc[0], "back": back, "kp": np.repeat(names[back], at.shape[1]), "other": names[not back][at.ravel()], "d": d.ravel().astype(np.int32)}))
        return pd.concat(out)

    kinds = dict(a.dtypes)
    tiles = left.groupBy("pair", "ta", "tb").cogroup(right.groupBy("r_pair", "r_ta", "r_tb")).applyInPandas(run, _NEAR.format(pair=kinds["pair"], kp=kinds["kp"]))
    w = Window.partitionBy("pair", "back", "kp").orderBy("d", "other")
    got = tiles.withColumn("second", F.lead("d").over(w)).withColumn("rank", F.row_number().over(w))
    return got.where("rank = 1")


def _clear(near: DataFrame, ratio: float, longest: int) -> DataFrame:
    return near.where((F.col("d") <= longest) & (F.col("d") < ratio * F.col("second")))


def nearest_two(a: DataFrame, b: DataFrame, ratio: float = 0.75, longest: int = 256, tile: int = TILE) -> DataFrame:
    """For each keypoint of ``a`` its nearest of ``b`` in the same pair, if clearly nearer than the second.

    (pair, kp, d0..d3) on both sides; of equally near ones the least kp counts.
    """
    got = _clear(_near(a, b, (False,), tile), ratio, longest)
    return got.select("pair", F.col("kp").alias("a"), F.col("other").alias("b"), F.col("d").alias("distance"))


def mutual(a: DataFrame, b: DataFrame, ratio: float = 0.75, longest: int = 256, tile: int = TILE) -> DataFrame:
    """Matches that are each other's nearest; both ways come from one pass over the tiles."""
    got = _clear(_near(a, b, (False, True), tile), ratio, longest)
    ends = got.select("pair", F.when(F.col("back"), F.col("other")).otherwise(F.col("kp")).alias("a"), F.when(F.col("back"), F.col("kp")).otherwise(F.col("other")).alias("b"), F.col("d").alias("distance"))
    return ends.groupBy("pair", "a", "b", "distance").agg(F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")


def motion_filter(matches: DataFrame, sigmas: float = 3.0, slack: float = 2.0, least: int = 8) -> DataFrame:
    """Matches(pair, dx, dy, ..) whose shift is near the pair's median shift; small pairs pass whole."""
    med = matches.groupBy("pair").agg(F.median("dx").alias("mx"), F.median("dy").alias("my"), F.count(F.lit(1)).alias("n"))
    got = matches.join(med, "pair")
    mad = got.groupBy("pair").agg((1.4826 * F.median(F.abs(F.col("dx") - F.col("mx")))).alias("sx"), (1.4826 * F.median(F.abs(F.col("dy") - F.col("my")))).alias("sy"))
    near = (F.abs(F.col("dx") - F.col("mx")) <= sigmas * F.col("sx") + slack) & (F.abs(F.col("dy") - F.col("my")) <= sigmas * F.col("sy") + slack)
    return got.join(mad, "pair").where((F.col("n") < least) | near).select(*matches.columns)


#: Places a cell holds that its points look among, on the mean; cells on the side of a tile; places of a tile that one task holds.
_CROWD, _ACROSS, _HELD = 4, 4, 50_000


def _least_k(own: np.ndarray, others: np.ndarray, copies: np.ndarray, k: int, cell: float | None) -> list[list[float]]:
    """The distances of the ``k`` nearest copies of ``others``, one's own copy left out; with ``cell`` of the 27 cells around alone."""
    out: list[list[float]] = []
    step = max(1, (1 << 20) // max(1, len(others)))
    most = min(k + 1, len(others))
    for i in range(0, len(own), step):
        mine = own[i : i + step]
        d = sum((mine[:, None, j] - others[None, :, j]) ** 2 for j in range(3))
        if cell is not None:
            for j in range(3):
                d[np.abs(np.floor(mine[:, None, j] / cell) - np.floor(others[None, :, j] / cell)) > 1] = np.inf
        at = np.argpartition(d, most - 1, axis=1)[:, :most]
        near = np.take_along_axis(d, at, 1)
        order = np.argsort(near, axis=1, kind="stable")
        near, at = np.take_along_axis(near, order, 1), np.take_along_axis(at, order, 1)
        weight = np.cumsum(np.where(np.isfinite(near), copies[at] - (others[at] == mine[:, None]).all(2), 0), axis=1)
        rank = np.stack([(weight <= j).sum(1) for j in range(k)], 1)
        found = np.take_along_axis(np.c_[np.sqrt(near), np.full(len(mine), np.inf)], rank, 1)
        out += [[x for x in row if x < np.inf] for row in found.tolist()]
    return out


def _tile_least(k: int, cell: float | None):
    """For cogroups of own places and those around them: (x, y, z, d), the least distances of each."""
    xyz = ["x", "y", "z"]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        mine = a[xyz].to_numpy(float)
        near = _least_k(mine, b[xyz].to_numpy(float), b["copies"].to_numpy(np.int64), k, cell) if len(b) else [[] for _ in mine]
        return pd.DataFrame(mine, columns=xyz).assign(d=near)

    return run


def grid_neighbours(points: DataFrame, cell: float, k: int = 3) -> DataFrame:
    """(id, spacing): the mean distance to the ``k`` nearest of the 27 cells around each point.

    A point without a neighbour takes the cell's size; no spacing is below 1e-4.
    A point without a finite place has no neighbour.

    Points of one place count once, with their number.  Cells are halved until few
    places share one; where the ``k`` nearest are no farther than such a cell is
    wide, they are the nearest of all, and only the rest look again in cells twice
    as wide, up to ``cell``.  Tiles of cells with one cell around go to tasks, the
    places of a crowded one in parts whose least distances are put together.
    """
    from .lineage import checkpointed

    xyz, tile = ["x", "y", "z"], ["tx", "ty", "tz"]
    p = points.select("id", *(F.col(a).cast("double").alias(a) for a in xyz))
    finite = p.where(~F.isnan(sum((F.col(a) - F.col(a) for a in xyz), F.lit(0.0))))  # an infinite place less itself is no number, and null is no row
    places = checkpointed(finite.groupBy(*xyz).agg(F.count(F.lit(1)).alias("copies")))
    at = lambda wide: [F.floor(F.col(a) / wide).cast("long") for a in xyz]
    level = 0
    while level < 20:
        sizes = places.groupBy(*at(cell / 2**level)).agg(F.count(F.lit(1)).alias("n"))
        total, crowd = sizes.agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
        if total is None or crowd <= _CROWD * total:
            break
        level += 1
    mean = F.aggregate("d", F.lit(0.0), lambda a, b: a + b) / F.when(F.size("d") > 0, F.size("d"))
    done = places.where(F.col("copies") > k).select(*xyz, F.lit(0.0).alias("mean"))
    own = places.where(F.col("copies") <= k).select(*xyz)
    for now in range(level, -1, -1):
        wide = cell / 2**now

        mine = own.select(*xyz, *(F.floor(c / _ACROSS).cast("long").alias(t) for c, t in zip(at(wide), tile, strict=True)))
        others = places
        for c, t in zip(at(wide), tile, strict=True):
            others = others.withColumn(t, F.explode(F.sequence(F.floor((c - 1) / _ACROSS), F.floor((c + 1) / _ACROSS))))
        others = others.join(mine.select(*tile).distinct(), tile, "left_semi")
        parts = others.groupBy(*tile).agg(F.ceil(F.count(F.lit(1)) / _HELD).cast("int").alias("parts"))
        others = others.join(parts, tile).withColumn("part", F.pmod(F.xxhash64(*xyz), F.col("parts")).cast("int"))
        others = others.select(*xyz, "copies", *tile, "part").toDF(*xyz, "copies", "tx_", "ty_", "tz_", "part_")
        mine = mine.join(parts, tile).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        found = mine.groupBy(*tile, "part").cogroup(others.groupBy("tx_", "ty_", "tz_", "part_")).applyInPandas(_tile_least(k, None if now else wide), "x double, y double, z double, d array<double>")
        found = checkpointed(found.groupBy(*xyz).agg(F.slice(F.array_sort(F.flatten(F.collect_list("d"))), 1, k).alias("d")))
        near = (F.size("d") == k) & (F.try_element_at("d", F.lit(k)) <= wide * (1 - 1e-9)) if now else F.lit(True)
        done = done.unionByName(found.where(near).select(*xyz, mean.alias("mean")))
        own = found.where(~near).select(*xyz)
    got = p.join(done, xyz, "left")
    return got.select("id", F.greatest(F.coalesce("mean", F.lit(cell)), F.lit(1e-4)).alias("spacing"))


def as_of(left: DataFrame, right: DataFrame, by: str, time: str, value: list[str], tolerance: float | None = None) -> DataFrame:
    """``left`` with the last row of ``right`` at or before its time, per key; times are numbers.

    One union and one window: no pair of rows is made.
    """
    a = left.select(by, time, F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_left"), F.lit(None).cast(right.select(F.struct(*[F.col(time), *map(F.col, value)]).alias("s")).schema["s"].dataType).alias("_right"))
    b = right.select(by, time, F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), F.struct(F.col(time), *map(F.col, value)).alias("_right"))
    w = Window.partitionBy(by).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    got = a.unionByName(b).withColumn("_seen", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    fresh = F.lit(True) if tolerance is None else F.col(time) - F.col(f"_seen.{time}") <= tolerance
    return got.select("_left.*", *(F.when(fresh, F.col(f"_seen.{c}")).alias(c) for c in value), F.when(fresh, F.col(f"_seen.{time}")).alias(f"matched_{time}"))


def interpolate(left: DataFrame, right: DataFrame, by: str, time: str, value: str) -> DataFrame:
    """``left`` with ``value`` of ``right`` mixed straight between the readings around its time."""
    a = left.select(by, time, F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_v"), F.lit(None).cast("double").alias("_t"))
    b = right.select(by, time, F.lit(0).alias("_side"), F.col(value).cast("double").alias("_v"), F.col(time).cast("double").alias("_t"))
    w = Window.partitionBy(by).orderBy(time, "_side")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    got = a.unionByName(b).select(by, time, "_side", *(F.last(c, True).over(before).alias(f"{c}0") for c in ("_v", "_t")), *(F.first(c, True).over(after).alias(f"{c}1") for c in ("_v", "_t"))).where("_side = 1")
    gap = F.col("_t1") - F.col("_t0")
    mixed = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col(time) - F.col("_t0")) / F.when(gap > 0, gap)
    return got.select(by, time, F.when(F.col("_t0") == F.col("_t1"), F.col("_v0")).otherwise(mixed).alias(value))


def pair_epochs(gga: DataFrame, gst: DataFrame, by: str, tolerance: float = 0.25) -> DataFrame:
    """Each position with the nearest accuracy within the tolerance, else alone.

    Times are cut into cells of the tolerance, so only neighbouring cells meet.
    """
    cell = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    left = gga.withColumn("_cell", F.explode(F.array(*(cell("t") + k for k in (-1, 0, 1)))))
    right = gst.select(by, F.col("t").alias("_t"), F.struct(*[F.col(c) for c in gst.columns if c not in (by, "t")]).alias("_gst"), cell("t").alias("_cell"))
    near = left.join(right, [by, "_cell"]).where(F.abs(F.col("t") - F.col("_t")) <= tolerance)
    best = near.groupBy(by, "t").agg(F.min(F.struct(F.abs(F.col("t") - F.col("_t")).alias("gap"), "_t", "_gst")).alias("_best"))
    return gga.join(best, [by, "t"], "left").select(*gga.columns, "_best._gst.*")


def _settle(x, radius: float):
    """One pass over a tile, strongest first: what of its own corners can be told now.

    status: 0 open, 1 kept, 2 gone.  A corner goes if a kept one is near, waits if
    an open one is, and else stays; open corners of the rim are for other tiles.
    """
    at: dict[tuple[int, int], list[tuple[float, float, bool]]] = {}
    status = x["status"].to_numpy().copy()
    for i, (px, py, own) in enumerate(zip(x["x"], x["y"], x["own"], strict=True)):
        if status[i] == 2:
            continue
        cx, cy = int(px // radius), int(py // radius)
        if own and not status[i]:
            near = [q[2] for a in (-1, 0, 1) for b in (-1, 0, 1) for q in at.get((cx + a, cy + b), ()) if (px - q[0]) ** 2 + (py - q[1]) ** 2 < radius * radius]
            status[i] = 2 if any(near) else 0 if near else 1
            if status[i] == 2:
                continue
        at.setdefault((cx, cy), []).append((px, py, status[i] == 1))
    return status


def non_max_suppression(corners: DataFrame, radius: float, tile: float = 256.0, rounds: int = 100) -> DataFrame:
    """Greedy by score within each image and level: keeps a corner unless a better kept one is near.

    Equal scores go by y, then x, then a hash of the row.  The choice is
    sequential, but a corner depends on stronger ones within ``radius`` alone: tiles
    settle what they can from their own corners and a rim of neighbours', and the
    few that wait for a neighbour's are settled in later rounds, each cut by a
    reliable checkpoint.  The strongest open corner never waits, so rounds end; the
    result is that of one pass over all.  A tile of ``tile`` pixels a side holds no
    more corners than pixels if they lie on whole ones, however large an image is.
    """
    from .lineage import checkpointed

    tile = max(tile, 4 * radius)
    names = corners.columns
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")
    rows = corners.select(row, "image", "level", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("score").cast("double").alias("score"), F.xxhash64(*(F.col(f"`{c}`") for c in names)).alias("tie"))
    now = checkpointed(rows.withColumns({"id": F.monotonically_increasing_id(), "status": F.lit(0)}))
    reach = lambda c: F.sequence(F.floor((F.col(c) - radius) / tile), F.floor((F.col(c) + radius) / tile))
    columns = ["id", "image", "level", "x", "y", "score", "tie", "status"]
    out = "id long, status int"

    def run(part):
        part = part.sort_values(["score", "y", "x", "tie", "id"], ascending=[False, True, True, True, True])
        status = _settle(part, radius)
        return part.assign(status=status)[part["own"].to_numpy()][["id", "status"]]

    for _ in range(rounds):
        spread = now.where("status < 2").select(*columns).withColumn("tx", F.explode(reach("x"))).withColumn("ty", F.explode(reach("y")))
        spread = spread.withColumn("own", (F.floor(F.col("x") / tile) == F.col("tx")) & (F.floor(F.col("y") / tile) == F.col("ty")))
        told = spread.groupBy("image", "level", "tx", "ty").applyInPandas(run, out).withColumnRenamed("status", "told")
        now = checkpointed(now.join(told, "id", "left").withColumn("status", F.coalesce("told", "status")).drop("told"))
        if not now.where("status = 0").limit(1).count():
            return now.where("status = 1").select("row.*")
    raise RuntimeError(f"suppression did not settle in {rounds} rounds")


def level_budget(keypoints: DataFrame, most: int, area: str = "area", by: str = "level") -> DataFrame:
    """The best of each level by a budget in proportion to its area, then the best of all."""
    levels = keypoints.groupBy(by).agg(F.max(area).alias("_area"))
    total = levels.agg(F.sum("_area").alias("_total"))
    budget = levels.crossJoin(F.broadcast(total)).select(by, F.floor(most * F.col("_area") / F.col("_total") + 0.5).alias("_budget"))  # one row
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id"))
    got = keypoints.withColumn("_rank", rank).join(budget, by).where("_rank <= _budget")
    return got.drop("_rank", "_budget").orderBy(F.desc("score"), "id").limit(most)


def best_frame(triangles: DataFrame, frames: DataFrame, cutoff: float = 0.2, block: int = 5_000) -> DataFrame:
    """The frame of the largest score for each triangle(tri, centre, normal); the first frame wins ties.

    Frames(frame, eye) are broadcast in blocks of about ``block``, as many as
    their count asks for; scores fold into one maximum per triangle and block as
    they are made.
    """
    from ..functions import vectors as V

    parts = max(1, -(-frames.count() // block))
    best = []
    for k in range(parts):
        some = frames.where(F.pmod(F.xxhash64("frame"), F.lit(parts)) == k)
        got = triangles.join(F.broadcast(some))
        ray = V.sub(F.col("eye"), F.col("centre"))
        cosine = V.dot(V.normalize(ray), F.col("normal"))
        got = got.withColumn("score", cosine / F.greatest(V.length_squared(ray), F.lit(1e-6))).where(cosine > cutoff)
        best.append(got.groupBy("tri").agg(F.max(F.struct(F.col("score"), (-F.col("frame")).alias("first"))).alias("best")))
    every = best[0]
    for more in best[1:]:
        every = every.unionByName(more)
    every = every.groupBy("tri").agg(F.max("best").alias("best")) if parts > 1 else every
    return every.select("tri", (-F.col("best.first")).alias("frame"), F.col("best.score").alias("score"))
