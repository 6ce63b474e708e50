"""Work done for many rows at once gives what one row after the other gives."""

from __future__ import annotations

import numpy as np

from plumbline.operators import images, registration, sfm


def pairs(n, seed=0):
    rng = np.random.default_rng(seed)
    p = rng.normal(size=(n, 3)) * 20
    q = 1.1 * p @ sfm.exp_so3(np.array([0.1, 0.4, -0.3])).T + [1, 2, 3] + rng.normal(size=(n, 3)) * 0.01
    q[3] += 0.5
    return p, q, rng.uniform(1, 9, n)


def test_errors_without_one_pair_are_those_of_a_new_solution():
    for n in (5, 40):
        for scale in (False, True):
            p, q, w = pairs(n)
            want = []
            for i in range(n):
                rest = np.arange(n) != i
                e = registration._errors(p[rest], q[rest], *registration.horn(p[rest], q[rest], w[rest], scale))
                want.append(np.sqrt((e**2).mean()))
            assert np.allclose(registration._rms_without(p, q, w, scale), want, rtol=1e-9)
    p = np.outer(np.arange(20.0), [1, 2, 3])
    p[5] += [1, 0, 0]
    assert np.flatnonzero(np.isnan(registration._rms_without(p, p + 1, np.ones(20), False))).tolist() == [5]


def test_many_pairs_take_no_table_of_all_by_all():
    p, q, w = pairs(60_000)  # squared, these are 3.6 billion differences
    got = registration._rms_without(p, q, w, True)
    assert got.argmin() == 3 and np.isfinite(got).all()


def test_draws_at_once_are_those_of_one_at_a_time(monkeypatch):
    world = np.random.default_rng(5).uniform(-1, 1, (60, 3)) + [0, 0, 5]
    moved = world @ sfm.exp_so3(np.array([0.0, 0.15, 0.0])).T + [-0.5, 0.05, 0.1]
    a, b = world[:, :2] / world[:, 2:], moved[:, :2] / moved[:, 2:]
    b[::7] += 0.05
    draws = sfm._draws(60, 64, 0x9E3779B9)
    e, good = sfm.essentials(a[draws], b[draws])
    for k, i in enumerate(draws):
        one, fit = sfm.essential(a[i], b[i])
        assert np.isclose(good[k], fit) and min(np.abs(e[k] - one).max(), np.abs(e[k] + one).max()) < 1e-6
    called = []
    kept = sfm.essential
    monkeypatch.setattr(sfm, "essential", lambda *x: called.append(1) or kept(*x))
    fit = sfm.ransac_essential(a, b, 0.002)[1]
    assert set(fit) >= set(np.flatnonzero(np.arange(60) % 7)) and len(called) == 1


def test_a_picture_is_padded_once_for_all_shifts():
    a = np.random.default_rng(2).integers(0, 255, (9, 7))
    at = images._around(a, 3)
    for dx, dy in images.CIRCLE:
        assert (at(dx, dy) == a[np.clip(np.arange(9) + dy, 0, 8)][:, np.clip(np.arange(7) + dx, 0, 6)]).all()


def test_a_cross_product_of_two_vectors_is_that_of_arrays():
    from plumbline.operators import simplify

    for u, v in np.random.default_rng(7).normal(size=(50, 2, 3)):
        assert (simplify._cross(u, v) == np.cross(u, v)).all()
