"""Adaptive moments of known spots, and exact quantiles against sorting."""

import numpy as np
import pytest

from skyweft.operators.moments import adaptive_moments
from skyweft.operators.psf import gaussian_stamp
from skyweft.operators.quantiles import quantiles


def test_adaptive_moments_of_gaussian_spots():
    shapes = [np.eye(2) * 2.0, np.array([[3.0, 0.5], [0.5, 2.0]]), np.array([[2.0, -0.4], [-0.4, 3.5]])]
    cube = np.stack([*(gaussian_stamp(25, c) for c in shapes), np.zeros((25, 25)), -np.ones((25, 25))])
    found = adaptive_moments(cube, 200)
    for i, c in enumerate(shapes):
        assert found["sigma"][i] == pytest.approx(np.linalg.det(c) ** 0.25, rel=1e-3)
        assert found["e1"][i] == pytest.approx((c[0, 0] - c[1, 1]) / np.trace(c), abs=1e-3) and found["e2"][i] == pytest.approx(2 * c[0, 1] / np.trace(c), abs=1e-3)
    assert found["converged"].tolist() == [True] * 3 + [False] * 2 and (found["sigma"][3:] == 0).all()
    alone = [adaptive_moments(cube[i : i + 1], 200)["sigma"][0] for i in range(5)]
    assert np.allclose(alone, found["sigma"])


def test_quantiles(spark):
    random = np.random.default_rng(1)
    values = {0: random.normal(size=501), 1: np.full(40, 3.0), 2: np.round(random.normal(size=300), 1), 3: np.array([7.0]), 4: np.concatenate([random.normal(size=99), [1e9]])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [(0, None), (5, None)]
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.97, "e": 1.0}
    found = {r.k: r for r in quantiles(spark.createDataFrame(rows, "k int, v double"), "k", "v", shares, 16).collect()}
    assert found.keys() == values.keys()
    for k, vs in values.items():
        assert [found[k][n] for n in shares] == pytest.approx([np.quantile(vs, q) for q in shares.values()], rel=1e-12)
