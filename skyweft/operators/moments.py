"""Adaptive Gaussian moments of stamps, a batch at a time."""

from __future__ import annotations

import numpy as np


def adaptive_moments(cube: np.ndarray, rounds: int = 50) -> dict[str, np.ndarray]:
    """sigma, e1, e2, amplitude and converged of each stamp of cube (n, side, side) by fixed-point iteration of a Gaussian weight.

    Negative pixels count as zero. A stamp without light, or whose weight collapses, has zeros and isn't converged. A
    stamp that has settled isn't moved any more.
    """
    n, side = len(cube), cube.shape[-1]
    y, x = (p.ravel().astype(float) for p in np.indices((side, side)))
    light = np.maximum(cube.reshape(n, -1), 0)
    total = light.sum(axis=1)
    failed = total <= 0
    safe = np.where(failed, 1, total)
    cx, cy = light @ x / safe, light @ y / safe
    xx, xy, yy = np.full(n, 2.0), np.zeros(n), np.full(n, 2.0)
    amplitude, going = np.zeros(n), ~failed
    for _ in range(rounds):
        det = xx * yy - xy**2
        failed |= going & (det <= 1e-6)
        going &= ~failed
        some = np.flatnonzero(going)
        if not len(some):
            break
        dx, dy = x - cx[some, None], y - cy[some, None]
        k = light[some] * np.exp(-0.5 * (yy[some, None] * dx * dx - 2 * xy[some, None] * dx * dy + xx[some, None] * dy * dy) / det[some, None])
        sums = k.sum(axis=1)
        bad = sums <= 1e-12
        failed[some[bad]], going[some[bad]] = True, False
        some, k, dx, dy, sums = some[~bad], k[~bad], dx[~bad], dy[~bad], sums[~bad]
        new = [2 * (k * p).sum(axis=1) / sums for p in (dx * dx, dx * dy, dy * dy)]
        cx[some], cy[some] = cx[some] + (k * dx).sum(axis=1) / sums, cy[some] + (k * dy).sum(axis=1) / sums
        amplitude[some] = sums
        settled = np.max([np.abs(a - m[some]) for a, m in zip(new, (xx, xy, yy), strict=True)], axis=0) < 1e-6
        going[some[settled]] = False
        move = some[~settled]
        for a, m in zip(new, (xx, xy, yy), strict=True):
            m[move] = 0.5 * (m[move] + np.clip(a[~settled], -50, 50))
    det, trace = np.maximum(xx * yy - xy**2, 0), xx + yy
    out = {"sigma": det**0.25, "e1": (xx - yy) / trace, "e2": 2 * xy / trace, "amplitude": amplitude}
    return {name: np.where(failed, 0.0, v) for name, v in out.items()} | {"converged": ~failed}
