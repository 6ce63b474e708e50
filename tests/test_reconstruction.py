"""Features, relative poses, resection, bundle adjustment and scan files."""

from __future__ import annotations

import numpy as np
import pytest

from plumbline.operators import images, sfm
from plumbline.sources import scans


def turn(axis, angle):
    return sfm.exp_so3(np.array(axis, float) / np.linalg.norm(axis) * angle)


def scene(n=60, seed=1):
    rng = np.random.default_rng(seed)
    world = rng.uniform(-1, 1, (n, 3)) + [0, 0, 5]
    r, t = turn([0, 1, 0.2], 0.15), np.array([-0.5, 0.05, 0.1])
    p = world @ r.T + t
    return world, world[:, :2] / world[:, 2:], p[:, :2] / p[:, 2:], r, t


def test_essential_pose_of_two_views():
    _, a, b, r, t = scene()
    e, good = sfm.essential(a, b)
    assert good > 1e-9 and sfm.sampson(e, a, b).max() < 1e-20
    got_r, got_t = sfm.decompose(e, a, b)
    assert np.allclose(got_r, r, atol=1e-8) and np.allclose(got_t, t / np.linalg.norm(t), atol=1e-8)
    with pytest.raises(ValueError):
        sfm.essential(a[:7], b[:7])


def test_ransac_is_seeded_and_drops_outliers(spark):
    _, a, b, r, _ = scene()
    b = b.copy()
    b[:12] += np.random.default_rng(2).uniform(0.05, 0.3, (12, 2))
    one, two = sfm.ransac_essential(a, b, 0.002), sfm.ransac_essential(a, b, 0.002)
    assert np.array_equal(one[1], two[1]) and set(range(12, 60)) <= set(one[1])
    rows = [("p", i, i, *map(float, a[i]), *map(float, b[i])) for i in range(60)]
    got = sfm.verify_pairs(spark.createDataFrame(rows, "pair string, a int, b int, ax double, ay double, bx double, by double"), 0.002).first()
    assert got.inliers >= 48 and np.allclose(np.array(got.r).reshape(3, 3), r, atol=1e-4)


def test_resection():
    world, _, b, r, t = scene()
    got = sfm.pnp_dlt(world, b)
    assert np.allclose(got[0], r, atol=1e-8) and np.allclose(got[1], t, atol=1e-8)
    bad = b.copy()
    bad[:15] += 0.2
    rr, tt, fit = sfm.pnp_ransac(world, bad)
    assert np.allclose(rr, r, atol=1e-6) and np.allclose(tt, t, atol=1e-6) and set(fit) == set(range(15, 60))
    assert sfm.pnp_dlt(world[:5], b[:5]) is None


def test_bundle_adjustment(spark):
    rng = np.random.default_rng(5)
    world = rng.uniform(-1, 1, (40, 3))
    cams = {k: (turn([0, 1, 0], a), np.array([0.0, 0.0, 6.0])) for k, a in enumerate((-0.5, -0.2, 0.2, 0.5))}
    rows = []
    for c, (r, t) in cams.items():
        p = world @ r.T + t
        rows += [(c, i, float(x), float(y), 1.0) for i, (x, y) in enumerate(p[:, :2] / p[:, 2:])]
    start = {k: (turn([1, 0, 0], 0.01 * (k > 1)) @ r, t + 0.02 * (k > 1)) for k, (r, t) in cams.items()}
    off = world + rng.normal(0, 0.02, world.shape)
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(off)], "pt long, x double, y double, z double")
    obs = spark.createDataFrame(rows, "cam int, pt long, x double, y double, weight double")
    got, moved, history = sfm.bundle_adjust(start, {0, 1}, points, obs, rounds=6)
    assert history[-1] < 1e-3 * history[0] and all(b < a for a, b in zip(history, history[1:], strict=False))
    assert np.array_equal(got[0][0], start[0][0]) and np.allclose(got[3][0], cams[3][0], atol=1e-4)
    assert np.abs(np.array([(r.x, r.y, r.z) for r in moved.orderBy("pt").collect()]) - world).max() < 1e-3


def textured(seed=3, w=160, h=120):
    rng = np.random.default_rng(seed)
    a = np.full((h, w), 90, np.uint8)
    for _ in range(60):
        x, y, s = rng.integers(5, w - 20), rng.integers(5, h - 20), rng.integers(4, 14)
        a[y : y + s, x : x + s] = rng.integers(0, 255)
    return a


def test_features_follow_a_shift(spark):
    a = textured()
    b = np.roll(a, 6, axis=1)
    df = spark.createDataFrame([("a", a.shape[1], a.shape[0], bytearray(a.tobytes())), ("b", a.shape[1], a.shape[0], bytearray(b.tobytes()))], "image string, width int, height int, gray binary")
    got = images.extract(df, 300).toPandas()
    fa, fb = got[(got.image == "a") & (got.level == 0)], got[(got.image == "b") & (got.level == 0)]
    assert len(fa) > 20
    words = ["d0", "d1", "d2", "d3"]
    d = np.bitwise_count(fa[words].to_numpy()[:, None] ^ fb[words].to_numpy()[None]).sum(2)
    best = d.argmin(1)
    shift = fb.x.to_numpy()[best] - fa.x.to_numpy()
    assert np.median(shift) == 6 and (np.abs(shift - 6) < 1).mean() > 0.6
    assert images.features(a, 300) == images.features(a, 300)


def test_sampling_pairs_and_corners():
    p = images.sampling_pairs()
    assert p.shape == (256, 4) and np.abs(p).max() <= 15 and (p[:, :2] != p[:, 2:]).any(1).all()
    a = np.zeros((40, 40), np.uint8)
    a[20:, 20:] = 255
    hit = images.fast_corners(a)
    assert hit[20, 20] and not hit[10, 10] and not hit[30, 20] and images.harris(a)[20, 20] > 0 > images.harris(a)[30, 20]
    assert (images.blur(np.full((9, 9), 77, np.uint8)) == 77).all()
    assert [round(s, 3) for _, s in images.pyramid(np.zeros((64, 64), np.uint8))] == [1.0, 1.2, 1.44, 1.728]


def test_crc32c_check_value():
    assert scans.crc32c(np.frombuffer(b"123456789", np.uint8).reshape(1, -1))[0] == 0xE3069283


def test_e57_round_trip_and_corruption(spark):
    i = np.arange(9000)
    p = np.stack([646000 + i / 1000, 4181000 + 10 * np.sin(i), 30 + (i % 17) / 2], 1)
    c = np.stack([i % 256, i * 3 % 256, i * 7 % 256], 1)
    data = scans.write_e57([{"positions": p, "colors": c, "intensity": (i % 100) / 100}, {"positions": p[:5] - p[0], "origin": p[0].tolist(), "name": "a]]>b"}], metadata="EPSG:2278")
    s = scans.read_e57(data)
    assert np.array_equal(s["positions"], p) and np.array_equal(s["colors"], c) and np.allclose(s["intensity"], (i % 100) / 100)
    assert scans.read_e57(data, 1)["origin"] == p[0].tolist()
    bad = bytearray(data)
    bad[2100] ^= 1
    with pytest.raises(ValueError, match="page 2"):
        scans.read_e57(bytes(bad))
    with pytest.raises(ValueError):
        scans.read_e57(data[:-3])
    got = scans.read_e57_files(spark.createDataFrame([("f", bytearray(data))], "path string, content binary"))
    assert got.groupBy("scan").count().orderBy("scan").collect()[1]["count"] == 5
    for k in (0, 1019, 1020, 5000):
        assert scans.to_logical(scans.to_physical(k)) == k


def test_png_and_page():
    import zlib

    img = np.arange(4 * 3 * 3, dtype=np.uint8).reshape(4, 3, 3)
    data = scans.png(img)
    at = data.index(b"IDAT")
    raw = zlib.decompress(data[at + 4 : at + 4 + int.from_bytes(data[at - 4 : at], "big")])
    assert np.array_equal(np.frombuffer(raw, np.uint8).reshape(4, 10)[:, 1:].reshape(4, 3, 3), img)
    assert "&lt;b&gt;" in scans.web_page(b"glb", "<b>", {"a": "1"})


def test_scene_queries_read_whole_tables(spark):
    from plumbline.plans import scene_queries

    sf = "/root/testdata/sf0.01"
    parts, vectors = (spark.read.parquet(f"{sf}/{n}.parquet").count() for n in ("part", "embeddings"))
    assert sum(r.inliers for r in scene_queries.ransac_pair(spark, sf).collect()) > 0.9 * parts > 400
    assert scene_queries.pnp(spark, sf).count() == -(-parts // 80)
    assert scene_queries._views(spark, sf).count() == parts
    assert scene_queries.image_features(spark, sf).select("image").distinct().count() == vectors > 20
