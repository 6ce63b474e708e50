"""What larger tables showed: numbers, views and turns that small ones can't tell apart."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators import matching, mesh
from plumbline.plans import catalog, texture


def against_sql(spark, folder, name, **tables):
    """(rows of the query, rows of its SQL), sorted, over ``tables`` given as SQL of DuckDB."""
    import duckdb

    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = catalog.queries()[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.collect())), sorted(want)


def test_half_of_a_turn_of_more_than_half_a_round(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "arcs", customer="SELECT range * 1301 AS c_custkey, (range % 7 + 1) * 900.5e0 AS c_acctbal FROM range(200)")
    assert got == want


def test_numbers_have_no_gap_however_ranges_are_cut(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst")}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "400kb")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    try:
        rows = spark.range(60_000).select(F.xxhash64("id").alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
        got = mesh.row_numbers(rows, ["k"], "n").select("k", "n", "wide").toPandas().sort_values("k")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert (got["n"].to_numpy() == np.arange(60_000)).all()


def test_cells_get_no_coarser_as_a_mesh_gets_longer(spark, monkeypatch):
    made, keep = [], texture.checkpointed
    monkeypatch.setattr(texture, "checkpointed", lambda df: made.append(keep(df)) or made[-1])
    k = F.col("id")
    tri = spark.range(40_000).select(k.alias("fid"), V.vec(k / 40, (k % 7) / 7, F.sin(k) / 9).alias("centre"), V.vec(0, 0, 1).alias("normal"))
    pose = F.struct(V.vec(0.5 + F.sin(k) / 4, F.cos(k) / 4, 1).alias("t"), V.quat(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("q"))
    camera = F.struct(*(F.lit(x).alias(n) for n, x in (("fx", 50.0), ("fy", 50.0), ("cx", 32.0), ("cy", 24.0), ("width", 64), ("height", 48))))
    frames = spark.range(300).select(k.alias("frame"), pose.alias("pose"), camera.alias("camera"))
    got = {r.fid: r.frame for r in texture.best_views(tri, frames, leaf=16).collect()}
    cells = [f"c{a}" for a in "xyz"]
    met = next(df for df in made if "camera" in df.columns)
    assert made[1].count() > 1000 and met.groupBy(*cells).count().count() < 40  # of a grid of 12 a side, one cell would hold all that is seen
    c = np.array([(i / 40, i % 7 / 7, np.sin(i) / 9) for i in range(400)])
    e = np.array([(0.5 + np.sin(i) / 4, np.cos(i) / 4, 1.0) for i in range(300)])
    d = c[:, None] - e
    z = -d[..., 2]
    u, v, facing = d[..., 0] * 50 / z + 32, -d[..., 1] * 50 / z + 24, z / np.linalg.norm(d, axis=2)
    score = np.where((u >= 0) & (u <= 63) & (v >= 0) & (v <= 47) & (facing > 0.25), facing**2 / z**2, -1)
    assert got == {i: int(s.argmax()) for i, s in enumerate(score) if s.max() > 0} and len(got) > 40


def test_spacing_of_crowded_places_copies_and_points_at_no_place(spark):
    rng = np.random.default_rng(3)
    p = np.r_[rng.normal(0, 0.05, (600, 3)), rng.normal(0, 0.3, (60, 3)), np.repeat(rng.normal(0, 0.1, (30, 3)), [1, 2, 3, 4, 5] * 6, axis=0)]
    cells = np.floor(p / 0.1)
    want = {}
    for i in range(len(p)):
        near = (np.abs(cells - cells[i]) <= 1).all(1) & (np.arange(len(p)) != i)
        d = np.sort(np.sqrt(((p[near] - p[i]) ** 2).sum(1)))[:3]
        want[i] = max(d.mean() if len(d) else 0.1, 1e-4)
    odd = [(1000, float("inf"), 0.0, 0.0), (1001, None, 0.0, 0.0), (1002, 0.0, float("nan"), 0.0)]
    rows = [(i, *map(float, q)) for i, q in enumerate(p)] + odd
    got = {r.id: r.spacing for r in matching.grid_neighbours(spark.createDataFrame(rows, "id long, x double, y double, z double"), 0.1).collect()}
    assert [got.pop(k) for k, *_ in odd] == [0.1] * 3
    assert got.keys() == want.keys() and all(np.isclose(got[i], d) for i, d in want.items())


def test_rows_that_take_long_are_dealt_out_whatever_files_there_are(spark):
    for name in ("image_features", "camera_rays"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition" in plan, name
