"""Correlations of square stamps by fast Fourier transform, whole Arrow batches at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def correlate(first: np.ndarray, second: np.ndarray, reach: int) -> np.ndarray:
    """Sum over places p of first[p] * second[p + d] for each pair of stamps (axis 0) and each lag d up to `reach`.

    Stamps are padded to twice their side, so that nothing wraps around; lags run from -reach to reach.
    """
    size = 2 * first.shape[1], 2 * first.shape[2]
    product = np.conj(np.fft.rfft2(first, size)) * np.fft.rfft2(second, size)
    whole = np.fft.irfft2(product, size)
    lags = np.arange(-reach, reach + 1)
    return whole[:, lags[:, None], lags[None, :]]


def correlations(stamps: np.ndarray, reach: int) -> np.ndarray:
    """correlate() of each stamp with itself and all later ones, in the order of np.triu_indices; each is transformed once."""
    size = 2 * stamps.shape[1], 2 * stamps.shape[2]
    modes = np.fft.rfft2(stamps, size)
    first, second = np.triu_indices(len(stamps))
    whole = np.fft.irfft2(np.conj(modes[first]) * modes[second], size)
    lags = np.arange(-reach, reach + 1)
    return whole[:, lags[:, None], lags[None, :]]


def autocorrelation(stamps: DataFrame, name: str, pixels: str, side: int, reach: int) -> DataFrame:
    """(name, dy, dx, overlap) of every stamp of side x side pixels in an array column.

    A null or wrongly sized array has null overlaps; null pixels count as zero.
    """
    lags = range(-reach, reach + 1)
    dy, dx = np.repeat(lags, len(lags)), np.tile(lags, len(lags))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fits = np.array([v is not None and len(v) == side * side for v in pdf[pixels]], bool)
            cube = np.zeros((len(pdf), side, side))
            for i in np.flatnonzero(fits):
                cube[i] = np.nan_to_num(np.asarray(pdf[pixels].iat[i], float)).reshape(side, side)
            found = correlate(cube, cube, reach).reshape(len(pdf), -1)
            found[~fits] = np.nan
            values = pd.Series(found.ravel()).astype("Float64").mask(np.repeat(~fits, len(dy)))
            yield pd.DataFrame({name: pdf[name].repeat(len(dy)).to_numpy(), "dy": np.tile(dy, len(pdf)), "dx": np.tile(dx, len(pdf)), "overlap": values})

    return stamps.select(name, pixels).mapInPandas(run, f"{name} long, dy long, dx long, overlap double")


def power_by(stamps: DataFrame, group: str, pixels: str, side: int) -> DataFrame:
    """(group, ky, kx, total, n): squared moduli of Fourier modes added up over the stamps of a batch and group."""
    from .interpolate import cubes

    ky, kx = (k.ravel() for k in np.indices((side, side)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            power = np.abs(np.fft.fft2(cubes(pdf[pixels], side, 0))) ** 2
            for key, rows in pdf.groupby(group).indices.items():
                yield pd.DataFrame({group: key, "ky": ky, "kx": kx, "total": power[rows].sum(axis=0).ravel(), "n": len(rows)})

    return stamps.select(group, pixels).mapInPandas(run, f"{group} int, ky long, kx long, total double, n long")
