"""Ten-tap interpolation and Gaussian resampling of stamps, whole batches at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Polynomials of the ten-tap kernel in f, the fraction of a pixel less one half. Tap k and tap 9 - k are
#: even(f * f) + f * odd(f * f) and even(f * f) - f * odd(f * f); coefficients from the highest power down.
EVEN = (
    (1.651881673372979740e-05, -3.145538007199505447e-04, 1.793518183780194427e-03, -2.904014557029917318e-03, 6.187591260980151433e-04),
    (-1.146756217210629335e-04, 2.883845374976550142e-03, -1.857047531896089884e-02, 3.147734488597204311e-02, -6.753293626461192439e-03),
    (3.256838096371517067e-04, -9.702063770653997568e-03, 8.678848026470635524e-02, -1.659182651092198924e-01, 3.620560878249733799e-02),
    (-4.541830837949564726e-04, 1.494862093737218955e-02, -1.668775957435094937e-01, 5.879306056792649171e-01, -1.367845996704077915e-01),
    (2.266560930061513573e-04, -7.815848920941316502e-03, 9.686607348538181506e-02, -4.505856722239036105e-01, 6.067135256905490381e-01),
)
ODD = (
    (-3.486978652054735998e-06, 6.753750285320532433e-05, -3.871378836550175566e-04, 6.279918076641771273e-04, -1.338434614116611838e-04),
    (3.121412120355294799e-05, -8.040343683015897672e-04, 5.209574765466357636e-03, -8.847326408846412429e-03, 1.898674086370833597e-03),
    (-1.243658986204533102e-04, 3.804930695189636097e-03, -3.434861846914529643e-02, 6.581033749134083954e-02, -1.436476114189205733e-02),
    (2.894406669584551734e-04, -9.794291009695265532e-03, 1.104231510875857830e-01, -3.906954914039130755e-01, 9.092432925988773451e-02),
    (-4.336085507644610966e-04, 1.537862263741893339e-02, -1.925091434770601628e-01, 8.993141455798455697e-01, -1.213035309579723942e00),
)
TAPS, BEFORE = 10, 4
#: Taps that are held at once.
MOST_TAPS = 1 << 20


def tap_weights(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whole part of each place, its ten weights on a last axis)."""
    whole = np.trunc(place).astype(np.int64)
    f = (place - whole - 0.5)[..., None]
    powers = (f * f) ** np.arange(4, -1, -1)
    even, odd = powers @ np.array(EVEN).T, f * (powers @ np.array(ODD).T)
    return whole, np.concatenate([even + odd, (even - odd)[..., ::-1]], axis=-1)


def _inside(whole: np.ndarray, size: int) -> np.ndarray:
    return (whole >= BEFORE) & (whole < size - TAPS + BEFORE + 1)


def scattered(cube: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """cube (n, ny, nx) at places y, x (n, p); zero where the ten by ten taps don't lie in the cube. So many stamps at a time that
    their taps take little memory, however large a batch is."""
    piece = max(1, MOST_TAPS // max(1, y.shape[-1] * TAPS * TAPS))
    if len(cube) > piece:
        return np.concatenate([scattered(*(a[i : i + piece] for a in (cube, y, x))) for i in range(0, len(cube), piece)])
    (yi, wy), (xi, wx) = tap_weights(y), tap_weights(x)
    good = _inside(yi, cube.shape[1]) & _inside(xi, cube.shape[2])
    step = np.arange(TAPS) - BEFORE
    rows, columns = np.where(good, yi, BEFORE)[..., None] + step, np.where(good, xi, BEFORE)[..., None] + step
    taken = cube[np.arange(len(cube))[:, None, None, None], rows[..., :, None], columns[..., None, :]]
    return np.where(good, np.einsum("npij,npi,npj->np", taken, wy, wx), 0.0)


def symmetric(cube: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """cube (n, ny, nx) at places y, x (n, s, s) whose values are known to be symmetric: half are computed and mirrored."""
    size = y.shape[-1]
    i, j = np.triu_indices(size)
    out = np.zeros(y.shape)
    out[:, i, j] = scattered(cube, y[:, i, j], x[:, i, j])
    out[:, j, i] = out[:, i, j]
    return out


def axis_weights(place: np.ndarray, size: int) -> np.ndarray:
    """Weights of all `size` pixels of an axis at each place, on a last axis; none where the ten taps don't lie on it."""
    whole, w = tap_weights(place)
    good = _inside(whole, size)
    out = np.zeros((*place.shape, size))
    at = np.where(good, whole, BEFORE)[..., None] + np.arange(TAPS) - BEFORE
    np.put_along_axis(out, at, np.where(good[..., None], w, 0.0), axis=-1)
    return out


def gridded(cube: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """cube (n, ny, nx) at the crossings of rows y (n, q) and columns x (n, p): one matrix product for each axis."""
    return axis_weights(y, cube.shape[1]) @ cube @ np.swapaxes(axis_weights(x, cube.shape[2]), -1, -2)


def cubes(pixels: pd.Series, side: int, pad: int) -> np.ndarray:
    """Array column as cube padded with zeros; null arrays, null pixels and arrays of another size count as zero."""
    out = np.zeros((len(pixels), side + 2 * pad, side + 2 * pad))
    for i, v in enumerate(pixels):
        if v is not None and len(v) == side * side:
            out[i, pad : pad + side, pad : pad + side] = np.nan_to_num(np.asarray(v, float)).reshape(side, side)
    return out


def map_stamps(stamps: DataFrame, name: str, pixels: str, function: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str, side: int = 8, pad: int = 6) -> DataFrame:
    """Rows that `function` (names, cubes) makes of every batch of stamps. schema: of its columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame(function(pdf[name].to_numpy(), cubes(pdf[pixels], side, pad)))

    return stamps.select(name, pixels).mapInPandas(run, schema)


def gaussian_taps(y: np.ndarray, x: np.ndarray, reach: float, sampling: float, smoothing: tuple[float, float, float], epsilon: float = 1e-7) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(dy, dx of the taps, weights (m, taps), leakage, noise) that take Gaussian spots to more smoothed ones.

    y, x: fractions of a pixel at which m outputs lie; spots have a full width of `sampling` pixels at half maximum,
    smoothing is the covariance (xx, xy, yy) put on top. Each corner of the pixel has the taps within reach; its
    optimal weights are blended by the outputs' distances from the corners and normalised.
    """
    limit = np.ceil(reach**2) + 0.01
    most = int(np.ceil(np.sqrt(limit)) + 1)
    ty, tx = (p.ravel() for p in np.mgrid[-most + 1 : most + 1, -most + 1 : most + 1])
    near = (np.abs(tx - 0.5) - 0.5) ** 2 + (np.abs(ty - 0.5) - 0.5) ** 2 <= limit
    ty, tx = ty[near], tx[near]
    variance, fine = sampling**2 / (8 * np.log(2)), 0.5
    square = (ty[:, None] - ty) ** 2 + (tx[:, None] - tx) ** 2
    overlaps = np.exp(-square / (4 * variance))
    steadied = overlaps + epsilon * np.exp(-square / (4 * fine))
    extra = np.array([[smoothing[0], smoothing[1]], [smoothing[1], smoothing[2]]], float)
    lag = np.stack([x[:, None] - tx, y[:, None] - ty], axis=-1)

    def against(v: float) -> np.ndarray:
        both = 2 * v * np.eye(2) + extra
        return 2 * v / np.sqrt(np.linalg.det(both)) * np.exp(-0.5 * np.einsum("mti,ij,mtj->mt", lag, np.linalg.inv(both), lag))

    plain = against(variance)
    b = plain + epsilon * against(fine)
    weights = np.zeros_like(b)
    for cy, cx in ((0, 0), (0, 1), (1, 0), (1, 1)):
        some = np.flatnonzero((tx - cx) ** 2 + (ty - cy) ** 2 <= limit)
        share = np.where(cy, y, 1 - y) * np.where(cx, x, 1 - x)
        weights[:, some] += share[:, None] * np.linalg.solve(steadied[np.ix_(some, some)], b[:, some].T).T
    weights /= weights.sum(axis=1, keepdims=True)
    own = variance / np.sqrt(np.linalg.det(variance * np.eye(2) + extra))
    leakage = own + np.einsum("mt,tu,mu->m", weights, overlaps, weights) - 2 * (plain * weights).sum(axis=1)
    return ty, tx, weights, leakage, (weights**2).sum(axis=1)


def affine_taps(out_side: int, origin: tuple[float, float], matrix: np.ndarray, reach: float, sampling: float, smoothing: tuple[float, float, float]) -> list[tuple[int, int, int, int, float]]:
    """(output y, x, input y, x, weight) of an affine map: output pixel (y, x) lies at origin + matrix (x, y) of the input."""
    oy, ox = (p.ravel() for p in np.mgrid[:out_side, :out_side])
    px, py = np.array(origin)[:, None] + matrix @ np.stack([ox, oy])
    iy, ix = np.floor(py).astype(int), np.floor(px).astype(int)
    ty, tx, w, _, _ = gaussian_taps(py - iy, px - ix, reach, sampling, smoothing)
    rows = zip(np.repeat(oy, len(ty)), np.repeat(ox, len(ty)), (iy[:, None] + ty).ravel(), (ix[:, None] + tx).ravel(), w.ravel(), strict=True)
    return [(int(a), int(b), int(c), int(d), float(e)) for a, b, c, d, e in rows if e]
