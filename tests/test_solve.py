"""Kernels against plain dense algebra, and stamps of a small mosaic against the same."""

import numpy as np
import pytest

from skyweft.operators import kernels as K
from skyweft.operators import systems as S


def made(seed, n=30, m=6):
    random = np.random.default_rng(seed)
    inputs, outputs = random.uniform(0, 5, (n, 2)), random.uniform(1, 4, (m, 2))
    a, b, c = S.gaussian_system(outputs, inputs, 1.0, 1.3)
    return a, b, c, np.sqrt(((outputs[:, None] - inputs[None]) ** 2).sum(axis=2))


def test_single_kappa():
    a, b, c, d = made(1)
    wanted = np.linalg.solve(a + 1e-3 * c * np.eye(len(a)), b.T).T
    for found in (K.cholesky(a, b, c, 1e-3), K.eigen(a, b, c, 1e-3), K.iterated(a, b, c, 1e-3, d < 99, 1e-12, 300, True)):
        assert np.allclose(found.t, wanted, atol=1e-7) and np.allclose(found.sigma, (wanted**2).sum(axis=1), atol=1e-7)
        assert np.allclose(found.leakage, 1 + (np.einsum("ai,ij,aj->a", wanted, a, wanted) - 2 * (b * wanted).sum(axis=1)) / c, atol=1e-7)


def test_indefinite_systems_are_repaired():
    random = np.random.default_rng(0)
    for _ in range(200):
        q, _ = np.linalg.qr(random.normal(size=(30, 30)))
        values = random.uniform(0.01, 1, 30)
        values[0] = -0.05
        a = (q * values) @ q.T
        assert np.isfinite(K.cholesky((a + a.T) / 2, random.normal(size=(4, 30)), 1.0, 0.01).t).all()
    assert np.isfinite(K.factored(np.zeros((3, 3)))).all()


def test_bisection_ends_at_a_limit():
    """Where a limit lies inside the range, kappa ends where noise or leakage crosses it."""
    a, b, c, _ = made(2)
    low, high, target, most = 1e-6, 1e-1, 1e-9, 0.3
    found = K.eigen_bisected(a, b, c, low, high, target, most, 40)
    for at in range(len(b)):
        edge = lambda k: (K.eigen(a, b[at : at + 1], c, k).sigma[0])
        if edge(low) > most > edge(high):
            assert found.sigma[at] == pytest.approx(most, rel=1e-3)


def test_nodes_hold_the_exact_solution():
    """A node's own solution lies in the span; weights between nodes come close to the exact solution at their kappa."""
    a, b, c, d = made(3)
    found = K.cholesky_nodes(a, b, c, [1e-5, 1e-4, 1e-3], 1e-9, 0.4)
    for at in range(len(b)):
        exact = K.eigen(a, b[at : at + 1], c, found.kappa[at] / c)
        assert found.leakage[at] >= exact.leakage[0] - 1e-2 and abs(found.leakage[at] - K.exact_leakage(a, b, c, found.t)[at]) < 1e-6
    near = K.iterated_nodes(a, b, c, [1e-4, 1e-2], 1e-9, 0.4, d < 2, 1e-10, 200)
    assert (near.t[d >= 2] == 0).all() and np.allclose(near.leakage, K.exact_leakage(a, b, c, near.t), atol=1e-6)


def test_no_inputs():
    for kernel in ("Eigen", "Cholesky", "Iterative", "Empirical"):
        found = K.solve(kernel, np.zeros((0, 0)), np.zeros((4, 0)), 1.0, np.zeros((4, 0)), 1.0, [1e-3])
        assert found.t.shape == (4, 0) and (found.leakage == 1).all() and (found.sigma == 0).all() and (found.kappa == 1).all()


@pytest.mark.parametrize("kernel", ["Cholesky", "Eigen", "Iterative", "Empirical"])
def test_stamps(spark, kernel):
    random = np.random.default_rng(5)
    rows = [(int(i), float(y), float(x), float(v)) for i in range(3) for y, x, v in zip(random.uniform(0, 8, 40), random.uniform(0, 8, 40), random.normal(size=40), strict=True)]
    pixels = spark.createDataFrame(rows, "img long, py double, px double, v double")
    found = {(r.oy, r.ox): r for r in S.solve_stamps(pixels, 4, 1.5, kernel, [1e-3]).collect()}
    every = np.array(rows)
    assert {(y, x) for y in range(8) for x in range(8)} <= set(found)
    for j in range(2):
        for i in range(2):
            low, high = np.array([j, i]) * 4 - 0.5, np.array([j, i]) * 4 + 3.5
            beyond = np.maximum(np.maximum(low - every[:, 1:3], every[:, 1:3] - high), 0)
            mine = every[(beyond**2).sum(axis=1) < 1.5**2]
            out = np.array([(y, x) for y in range(4 * j, 4 * j + 4) for x in range(4 * i, 4 * i + 4)], float)
            a, b, c = S.gaussian_system(out, mine[:, 1:3], 1.0, 1.2)
            d = np.sqrt(((out[:, None] - mine[None, :, 1:3]) ** 2).sum(axis=2))
            want = K.solve(kernel, a, b, c, d, 1.5, [1e-3])
            for k, (y, x) in enumerate(out.astype(int).tolist()):
                r = found[y, x]
                assert r.inputs == len(mine) and r.value == pytest.approx(want.t[k] @ mine[:, 3], abs=1e-6) and r.constant == pytest.approx(want.t[k].sum(), abs=1e-6)
                assert (r.sigma, r.leakage) == pytest.approx((want.sigma[k], want.leakage[k]), abs=1e-6)
                w = np.array([want.t[k][mine[:, 0] == n].sum() for n in range(3)])
                assert r.neff == pytest.approx(np.abs(w).sum() ** 2 / (w**2).sum() if (w**2).sum() else 0.0, rel=1e-6)
    with pytest.raises(ValueError):
        S.near_stamps(pixels, 4, 5.0)
