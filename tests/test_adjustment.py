"""Bundle adjustment by products alone: against dense normal equations, and with hundreds of cameras."""

from __future__ import annotations

import numpy as np
import pytest

from plumbline.operators import adjustment, sfm


def turned(r, t, d):
    turn = sfm.exp_so3(d[:3])
    return turn @ r, turn @ t + d[3:]


def seen(r, t, w):
    p = r @ w + t
    return p[:2] / p[2]


def dense_step(cams, free, world, rows, lam, huber):
    """The cameras' steps by full matrices, with slopes by finite differences."""
    n, m, h = 6 * len(free), 3 * len(world), 1e-6
    jac, res = [], []
    for c, i, x, y, weight in rows:
        r, t = cams[c]
        e = seen(r, t, world[i]) - [x, y]
        k = weight * (np.sqrt(huber / np.linalg.norm(e)) if np.linalg.norm(e) > huber else 1.0)
        j = np.zeros((2, n + m))
        if c in free:
            for a in range(6):
                d = np.zeros(6)
                d[a] = h
                j[:, 6 * free.index(c) + a] = (seen(*turned(r, t, d), world[i]) - seen(*turned(r, t, -d), world[i])) / (2 * h)
        for a in range(3):
            d = np.zeros(3)
            d[a] = h
            j[:, n + 3 * i + a] = (seen(r, t, world[i] + d) - seen(r, t, world[i] - d)) / (2 * h)
        jac.append(k * j)
        res.append(k * e)
    jac, res = np.concatenate(jac), np.concatenate(res)
    full, g = jac.T @ jac, jac.T @ res
    u, w, v = full[:n, :n], full[:n, n:], full[n:, n:]
    v = v + lam * np.diag(np.diag(v))
    s = u - w @ np.linalg.inv(v) @ w.T
    b = g[:n] - w @ np.linalg.inv(v) @ g[n:]
    x = -np.linalg.solve(s + lam * np.diag(np.diag(s)), b)
    return x.reshape(-1, 6), (world.ravel() - np.linalg.inv(v) @ (g[n:] + w.T @ x)).reshape(-1, 3)


def made(n_cams, n_points, per_point, seed):
    rng = np.random.default_rng(seed)
    world = rng.uniform(-1, 1, (n_points, 3))
    cams = {k: (sfm.exp_so3(rng.normal(0, 0.2, 3)), np.array([0.0, 0.0, 6.0]) + rng.normal(0, 0.2, 3)) for k in range(n_cams)}
    rows = []
    for i in range(n_points):
        for c in rng.choice(n_cams, per_point, replace=False).tolist():
            rows.append((c, i, *map(float, seen(*cams[c], world[i])), float(rng.uniform(0.5, 1.5))))
    return rng, world, cams, rows


def tables(spark, world, rows):
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(world)], "pt long, x double, y double, z double")
    return points, spark.createDataFrame(rows, "cam int, pt long, x double, y double, weight double").repartition(4)


def test_one_step_is_that_of_the_dense_equations(spark, monkeypatch):
    monkeypatch.setattr(adjustment, "PACK", 30)
    rng, world, cams, rows = made(5, 40, 3, 1)
    rows += rows[:7]  # a camera that sees a point twice
    rows = [(c, i, x + float(rng.normal(0, 0.02)), y, w) for c, i, x, y, w in rows]
    free = [2, 3, 4]
    points, obs = tables(spark, world, rows)
    number, r, t, place = adjustment._camera_index(cams, {0, 1})
    packs = adjustment.pack(points, obs, number).cache()
    assert packs.count() > 2
    problem = adjustment.Problem(spark, place, 0.01)
    gradient, blocks, _ = problem.system(packs, r, t, 1e-3)
    x = problem.solve(packs, r, t, 1e-3, gradient, blocks, 1e-13, 100)
    want, moved = dense_step(cams, free, world, rows, 1e-3, 0.01)
    assert np.allclose(x, want, atol=1e-6)
    got = {int(p): v for row in problem.step(packs, r, t, 1e-3, x).collect() for p, v in zip(np.frombuffer(row.pts, np.int64), np.frombuffer(row.xyz).reshape(-1, 3), strict=True)}
    assert np.allclose([got[i] for i in range(40)], moved, atol=1e-6)


def test_five_hundred_cameras(spark):
    rng, world, cams, rows = made(500, 2500, 8, 2)
    start = {k: turned(*c, rng.normal(0, 0.004, 6) * (k > 1)) for k, c in cams.items()}
    points, obs = tables(spark, world + rng.normal(0, 0.01, world.shape), rows)
    got, moved, history = adjustment.adjust(start, {0, 1}, points, obs, rounds=3, most_products=25)
    assert history[-1] < 0.02 * history[0] and all(b < a for a, b in zip(history, history[1:], strict=False))
    assert got[0] is start[0] and moved.count() == 2500


def test_odd_problems(spark):
    _, world, cams, rows = made(3, 6, 3, 4)
    keep = [r for r in rows if r[1] != 5 or r[0] == 0]  # one point seen once
    points, obs = tables(spark, world + 0.01, [*keep, (9, 1, 0.0, 0.0, 1.0), (0, 77, 0.0, 0.0, 1.0), (1, None, 0.0, 0.0, 1.0), (1, 2, None, 0.0, 1.0)])
    got, moved, history = adjustment.adjust(cams, {0, 1, 2}, points, obs, rounds=3)
    out = {r.pt: (r.x, r.y, r.z) for r in moved.collect()}
    assert history[-1] < 1e-5 and out[5] == pytest.approx(tuple(world[5] + 0.01), abs=0) and all(np.array_equal(got[k][0], cams[k][0]) for k in cams)
    assert out[0] == pytest.approx(tuple(world[0]), abs=1e-4)
    _, moved, history = adjustment.adjust(cams, {0}, points, obs.limit(0), rounds=3)
    assert history[0] == 0 and moved.count() == 6
    with pytest.raises(ValueError, match="cameras"):
        adjustment.adjust(dict.fromkeys(range(adjustment.MOST_CAMERAS + 1)), set(), points, obs)


def test_groups_of_cameras_without_common_points_are_each_held(spark, tmp_path):
    """supplier_cameras over two sets of suppliers that ship no part in common equals its SQL."""
    import duckdb
    from pyspark.sql import functions as F

    from plumbline.plans import catalog

    keys = {"supplier": {"s_suppkey": 1_000}, "part": {"p_partkey": 10_000}, "lineitem": {"l_suppkey": 1_000, "l_partkey": 10_000}}
    con = duckdb.connect()
    for name, columns in keys.items():
        one = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").select(*columns)
        other = one.select(*((F.col(c) + by).alias(c) for c, by in columns.items()))
        both = one.unionByName(other)
        if name == "lineitem":
            both = both.unionByName(spark.createDataFrame([(None, 1)], both.schema))
        both.write.parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(map(tuple, catalog.queries()["supplier_cameras"](spark, str(tmp_path)).collect()))
    want = sorted(con.execute(catalog.oracle_sql()["supplier_cameras"]).fetchall())
    assert len(want) > 300 and got == want


def test_anchors(spark):
    obs = spark.createDataFrame([(5, 1), (3, 1), (4, 2), (3, 2), (9, 7), (8, 8), (7, 8), (None, 1), (2, None)], "cam long, pt long")
    assert adjustment.anchors(obs) == {3, 4, 7, 8, 9}


def test_groups_that_hang_together_by_one_key_are_each_held(spark, tmp_path):
    """supplier_cameras over copies that share one supplier, which lineitem alone names, and one part, which has two rows, equals its SQL."""
    import duckdb
    from pyspark.sql import functions as F

    from plumbline.plans import catalog

    keys = {"supplier": {"s_suppkey": 9}, "part": {"p_partkey": 199}, "lineitem": {"l_suppkey": 9, "l_partkey": 199}}
    con = duckdb.connect()
    for name, columns in keys.items():
        one = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").select(*columns)
        both = one.unionByName(one.select(*((F.col(c) + by).alias(c) for c, by in columns.items())))
        if name == "supplier":
            both = both.where("s_suppkey <> 9")
        both.write.parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(map(tuple, catalog.queries()["supplier_cameras"](spark, str(tmp_path)).collect()))
    want = sorted(con.execute(catalog.oracle_sql()["supplier_cameras"]).fetchall())
    assert len(want) == 400 and got == want


def packed(spark, pairs):
    """Packs of (camera, point) pairs without places, and the number of cameras."""
    points = spark.createDataFrame([(p, 0.0, 0.0, 0.0) for p in sorted({p for _, p in pairs})], "pt long, x double, y double, z double")
    obs = spark.createDataFrame([(c, p, 0.0, 0.0, 1.0) for c, p in pairs], "cam long, pt long, x double, y double, weight double")
    cams = sorted({c for c, _ in pairs})
    return adjustment.pack(points, obs, cams).cache(), len(cams)


def test_held_cameras(spark, monkeypatch):
    monkeypatch.setattr(adjustment, "PACK", 300)
    rng = np.random.default_rng(5)
    one = [(c, p) for p in range(300) for c in rng.choice(40, 8, replace=False).tolist()]
    packs, n = packed(spark, one)
    assert np.flatnonzero(adjustment.held(packs, n)).tolist() == [0, 1]
    # A second group that shares camera 39 and point 299; cameras 79 and 80 share too few points.
    packs, n = packed(spark, [*one, *((c + 39, p + 299) for c, p in one), (79, 3), (79, 4), (79, 5), (80, 3)])
    got = np.flatnonzero(adjustment.held(packs, n)).tolist()
    assert {0, 1, 79, 80} <= set(got) and sum(39 < c < 79 for c in got) >= 2 and len(got) <= 9
    packs, n = packed(spark, [(0, 1)])
    assert adjustment.held(packs, n).tolist() == [True]


def test_many_cameras_with_two_fixed_come_to_their_places(spark):
    """The turn of all cameras about the fixed ones is told by few observations: damping must not keep it."""
    rng, world, cams, rows = made(300, 1500, 8, 7)
    start = {k: turned(*c, np.r_[np.full(3, 0.004), 0, 0, 0] * (k > 1)) for k, c in cams.items()}
    points, obs = tables(spark, world, rows)
    _, moved, history = adjustment.adjust(start, {0, 1}, points, obs, rounds=3)
    off = [np.linalg.norm(np.array(r[1:]) - world[r.pt]) for r in moved.collect()]
    assert history[-1] < 1e-6 and max(off) < 1e-3


def test_sums_in_blocks_are_those_collected_at_once(spark, monkeypatch):
    monkeypatch.setattr(adjustment, "PACK", 30)
    _, world, cams, rows = made(30, 200, 3, 8)
    points, obs = tables(spark, world + 0.01, rows)
    number, r, t, place = adjustment._camera_index(cams, {0, 1})
    packs = adjustment.pack(points, obs, number).cache()
    want = adjustment.Problem(spark, place, 0.01).system(packs, r, t, 1e-3)
    monkeypatch.setattr(adjustment, "BLOCK", 7)
    monkeypatch.setattr(adjustment, "AT_ONCE", 0)
    got = adjustment.Problem(spark, place, 0.01).system(packs, r, t, 1e-3)
    assert all(np.allclose(a, b, rtol=1e-9, atol=1e-12) for a, b in zip(got, want, strict=True))


def test_turns_are_exp_so3():
    w = np.array([[0.1, -0.2, 0.3], [0.0, 0.0, 0.0], [1e-14, 0.0, 0.0], [0.0, 2.0, 1.0]])
    assert np.allclose(adjustment.turns(w), [sfm.exp_so3(x) for x in w], atol=1e-15)


def test_more_than_a_hundred_thousand_suppliers(spark, tmp_path):
    """supplier_cameras equals its SQL where most of 100,210 suppliers ship a part or none."""
    import duckdb
    from pyspark.sql import functions as F

    from plumbline.plans import catalog

    tables = {n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet").select(*c) for n, c in {"supplier": ["s_suppkey"], "part": ["p_partkey"], "lineitem": ["l_suppkey", "l_partkey"]}.items()}
    more = spark.range(10, 100_210)
    tables["supplier"] = tables["supplier"].union(more)
    tables["part"] = tables["part"].union(spark.range(1_000, 2_000))
    tables["lineitem"] = tables["lineitem"].union(more.select("id", F.col("id") % 1_000 + 1_000))
    con = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(map(tuple, catalog.queries()["supplier_cameras"](spark, str(tmp_path)).collect()))
    want = sorted(con.execute(catalog.oracle_sql()["supplier_cameras"]).fetchall())
    assert len(want) == 1_200 and got == want
