"""Interpolation, resampling and profiles against closed forms."""

import numpy as np
import pytest

from skyweft.operators import interpolate as I
from skyweft.operators import psf as P


def test_smooth_functions_come_back():
    y, x = np.mgrid[:24, :24].astype(float)
    cube = np.stack([np.cos(0.3 * x + 0.2 * y), np.exp(-((x - 12) ** 2 + (y - 11) ** 2) / 18)])
    random = np.random.default_rng(1)
    py, px = random.uniform(4, 18, (2, 2, 40))
    wanted = np.stack([np.cos(0.3 * px[0] + 0.2 * py[0]), np.exp(-((px[1] - 12) ** 2 + (py[1] - 11) ** 2) / 18)])
    assert np.allclose(I.scattered(cube, py, px), wanted, atol=2e-5)
    assert np.allclose(I.tap_weights(random.uniform(0, 9, 100))[1].sum(axis=1), 1, atol=2e-5)
    whole = I.scattered(cube, np.full((2, 1), 9.0), np.full((2, 1), 7.0))[:, 0]
    assert np.allclose(whole, cube[:, 9, 7], atol=2e-5)
    assert (I.scattered(cube, np.array([[3.9], [19.1]]), np.array([[9.0], [9.0]])) == 0).all()


def test_grids_and_symmetry_agree_with_scattered():
    random = np.random.default_rng(2)
    cube = random.normal(size=(3, 20, 21))
    y, x = random.uniform(2, 17, (3, 5)), random.uniform(2, 18, (3, 6))
    found = I.gridded(cube, y, x)
    wanted = I.scattered(cube, np.repeat(y, 6, axis=1), np.tile(x, (1, 5))).reshape(3, 5, 6)
    assert np.allclose(found, wanted)
    half = random.normal(size=(3, 21, 21))
    even = half + half[:, ::-1, ::-1]
    at = random.uniform(-1.5, 1.5, (3, 4, 2))
    lag = at[:, None] - at[:, :, None]
    y, x = 10 + lag[..., 0], 10 + lag[..., 1]
    assert np.allclose(I.symmetric(even, y, x), I.scattered(even, y.reshape(3, 16), x.reshape(3, 16)).reshape(3, 4, 4), atol=1e-9)


def test_resampling_attenuates_plane_waves_and_spots():
    """A plane wave loses what the smoothing takes from it; a Gaussian spot becomes the wider one."""
    random = np.random.default_rng(3)
    fy, fx = random.uniform(0, 1, (2, 30))
    xx, xy, yy = 0.5, 0.1, 0.4
    ty, tx, w, leakage, noise = I.gaussian_taps(fy, fx, 4.0, 2.8, (xx, xy, yy))
    assert np.allclose(w.sum(axis=1), 1) and (leakage < 1e-3).all() and (noise < 1).all()
    for u, v in ((0.05, 0.02), (-0.1, 0.08)):
        wave = (w * np.cos(2 * np.pi * (u * tx + v * ty))).sum(axis=1)
        lost = np.exp(-2 * np.pi**2 * (xx * u * u + 2 * xy * u * v + yy * v * v))
        assert np.allclose(wave, lost * np.cos(2 * np.pi * (u * fx + v * fy)), atol=3e-3)
    variance = 2.8**2 / (8 * np.log(2))
    spot = (w * np.exp(-(tx**2 + ty**2) / (2 * variance))).sum(axis=1)
    both = variance * np.eye(2) + np.array([[xx, xy], [xy, yy]])
    place = np.stack([fx, fy])
    wanted = variance / np.sqrt(np.linalg.det(both)) * np.exp(-0.5 * (place * np.linalg.solve(both, place)).sum(axis=0))
    assert np.allclose(spot, wanted, atol=3e-3)


def test_bessel_and_airy():
    known = {0.0: 1.0, 1.0: 2 * 0.44005058574493355, 3.8317059702075125: 0.0, 20.0: 2 * 0.06683312417584991 / 20, 300.0: 2 * -0.03188740816612455 / 300}
    assert np.allclose(P.bessel_mean(np.array(list(known))), list(known.values()), atol=1e-7)
    assert P.airy(255, 3.0).sum() == pytest.approx(1, abs=0.02)
    plain, hidden = P.airy(65, 3.0), P.airy(65, 3.0, 0.4)
    assert P.half_width(plain) == pytest.approx(1.029 * 3.0, rel=5e-3) and P.half_width(hidden) < P.half_width(plain)
    base = P.airy_with_struts(64, 2.5)
    assert base.sum() == pytest.approx(1, abs=0.1)
    for features in range(1, 8):
        assert abs(P.airy_with_struts(64, 2.5, features=features).sum() - base.sum()) < 0.06
    moved = P.airy_with_struts(64, 2.5, features=2)
    y = np.arange(64)[:, None]
    assert ((moved - 0.85 * base) * y).sum() / (moved - 0.85 * base).sum() == pytest.approx((base * y).sum() / base.sum() - 8, abs=0.5)


def test_smoothing_and_widths():
    spot = P.gaussian_stamp(33, np.eye(2) * 2.0)
    wide = P.smooth_and_pad(spot, 0.0, 1.5)
    assert np.allclose(wide, P.gaussian_stamp(wide.shape[0], np.eye(2) * (2.0 + 1.5**2)), atol=1e-6)
    assert P.padding(0, 1.5) % 4 == 0 and P.half_width(spot) == pytest.approx(np.sqrt(8 * np.log(2) * 2.0), rel=2e-3)
    assert np.isnan(P.half_width(np.ones((9, 9))))
    box = P.smooth_and_pad(np.pad(np.ones((1, 1)), 10), 3.0)
    assert box.sum() == pytest.approx(1)


def test_split():
    """Short range and wings add up to the spot; the kernel under the Gaussian gives the wings back but for what is left."""
    n = 48
    spot = P.gaussian_stamp(n, np.eye(2) * 30.0)
    cov = np.eye(2) * 2.0
    short, kernel, left = P.split(spot[None], lambda x, y: cov, 1.0, 6.0, 14.0, 1e-3)
    window = P.radial_window(n, 6.0, 14.0)
    assert np.allclose(short[0], window * spot) and window[n // 2, n // 2] == 1 and window[0, 0] == 0
    back = P._same_convolution(kernel[0], P.gaussian_stamp(n, cov))
    assert np.allclose(back + left[0], (1 - window) * spot, atol=1e-12) and np.abs(left).max() < 0.05 * spot.max()
    four = np.stack([spot, 0.2 * spot, 0.1 * spot, 0.05 * spot])
    _, kernels, _ = P.split(four, lambda x, y: cov, 1.0, 6.0, 14.0, 1e-3)
    assert np.allclose(kernels[1], 0.2 * kernels[0]) and np.allclose(kernels[0], kernel[0])
    with pytest.raises(ValueError):
        P.split(four[:3], lambda x, y: cov)
