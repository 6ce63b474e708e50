"""Two-tree clustering against plain rounds in Python integers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from plumbline.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, p):
    kept = []
    for i, v, *_ in rows:
        if v is not None and len(v) == p.dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(p.scale * float(np.float32(x))) for x in v]))
    order = sorted((x for x in kept if x[0] is not None), key=lambda x: (hashlib.sha256(f"{p.salt}{x[0]}".encode()).hexdigest(), x[1]))
    now = [q for _, q in order[: p.k]]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), k) for k, c in enumerate(now))

    for _ in range(p.rounds if now else 0):
        took = [near(q)[1] for _, q in kept]
        for k in range(len(now)):
            own = [q for (_, q), t in zip(kept, took, strict=True) if t == k]
            if own:
                now[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = [(i, *near(q)[::-1]) for i, q in kept] if now else []
    total = sum(x[2] for x in out)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return [(i, k, d, sum(x[2] for x in out if x[1] == k), total, digest[k]) for i, k, d in out]


def check(spark, rows, **params):
    p = centroids.Params(**params)
    got = centroids.clustered(spark.createDataFrame(rows, SCHEMA), p)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rows, p), key=repr)


def vectors(seed, n, dims, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (6, dims))
    return [(i, (centres[rng.integers(6)] + rng.normal(0, spread, dims)).astype(np.float32).tolist(), 0) for i in range(n)]


@pytest.mark.parametrize(("dims", "k", "spread", "block", "leaf"), [(4, 7, 0.05, 64, 4), (4, 12, 0.5, 1024, 16), (16, 9, 0.2, 100, 1), (1, 5, 0.01, 1024, 16)])
def test_rounds_are_exact(spark, dims, k, spread, block, leaf):
    rows = vectors(dims, 300, dims, spread)
    rows += [(1000 + i, rows[3][1], 1) for i in range(200)]  # one vector very often
    check(spark, rows, dims=dims, k=k, block=block, leaf=leaf, rounds=4)


def test_odd_rows(spark):
    good = vectors(5, 12, 3)
    odd = [(100, None, 1), (101, [1.0, 2.0], 1), (102, [1.0, None, 2.0], 1), (103, [1.0, float("nan"), 2.0], 1), (104, [float("inf"), 0.0, 0.0], 1), (105, [], 1), (None, [0.5, 0.5, 0.5], None)]
    check(spark, good + odd + good[:3] + odd[-1:], dims=3, k=4, rounds=3)
    check(spark, good[:2], dims=3, k=40)
    check(spark, [], dims=3, k=4)
    check(spark, odd, dims=3, k=4)
    check(spark, [(i, [x, x, x], 0) for i, x in enumerate((-1.0, 1.0, 0.0, -1.0, 1.0, 0.0))], dims=3, k=3)  # ties and negative means
    check(spark, [(i, [400_000.0 + i, -5.0, 0.25], 0) for i in range(9)], dims=3, k=2)  # beyond 32-bit squares
    with pytest.raises(Exception, match=r"2\^27"):
        check(spark, [(1, [1e30, 0.0, 0.0], 0)], dims=3, k=2)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, [1.0], 5, "x"), (2, [2.0], 6, "y")], "vec_id long, embedding array<double>, cluster int, q string")
    got = centroids.clustered(df, centroids.Params(dims=1, k=2))
    assert sorted(r.distance for r in got.collect()) == [0, 0]


@pytest.mark.parametrize("dims", [1, 3, 40])
def test_cover_tree(dims):
    rng = np.random.default_rng(dims)
    x = rng.integers(-50, 50, (400, dims))
    x[100:150] = x[7]
    order, nodes = centroids.cover_tree(x, 5)
    assert sorted(order.tolist()) == list(range(400))
    for node in nodes:
        own = x[order[node["start"] : node["end"]]]
        d = np.sqrt(np.square(own - x[order[node["centre"]]]).sum(1))
        assert node["radius"] == d.max() and node["start"] <= node["centre"] < node["end"]
        kids = nodes[node["child"] : node["child"] + node["children"]]
        if len(kids):
            assert kids["start"][0] == node["start"] and kids["end"][-1] == node["end"] and (kids["start"][1:] == kids["end"][:-1]).all()
            assert (kids["radius"] <= node["radius"] / 2).all()
            c = x[order[kids["centre"]]]
            apart = np.sqrt(np.square(c[:, None] - c[None]).sum(2))
            assert (apart[~np.eye(len(kids), dtype=bool)] > node["radius"] / 2).all()
        else:
            assert node["end"] - node["start"] <= 5 or node["radius"] == 0


def test_whole_nodes_are_settled_at_once():
    """Clusters that lie far apart are given to centroids without looking at their vectors."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(0, 20, (300, 8)) + 1000 * k for k in range(4)])
    order, nodes = centroids.cover_tree(x, 16)
    (start, end, _), (rows, _, _) = centroids.Centroids(np.stack([np.full(8, 1000 * k) for k in range(4)]), centroids.Params(dims=8)).walk(x[order], nodes)
    assert (end - start).sum() == 1200 and not len(rows)
