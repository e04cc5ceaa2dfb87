"""Sums over all pairs of places on a grid by their lag, without a row for a pair.

Points that share a place of the grid are counted there first. A tile of lenses is correlated with the sources of the nine
tiles around it by fast Fourier transform, so the work follows the number of places, not that of pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lag_sums(places: DataFrame, lens: str, values: list[str], reach: int) -> DataFrame:
    """places(gy, gx, lens, values), a row a place -> (ty, tx, dy, dx, values): over all pairs of a lens in tile (ty, tx), whose
    side is `reach`, with a source dy, dx away, both from -reach to reach, the sums of the source's values. Counts are whole to
    rounding. Lags at which no value adds up to anything have no row."""
    around = F.sequence(F.lit(-1), F.lit(1))
    home = {c: F.floor(F.col(f"g{c}") / reach).cast("long") for c in "yx"}
    sent = places.select("*", home["y"].alias("_y"), home["x"].alias("_x"), F.explode(around).alias("_dy")).select("*", F.explode(around).alias("_dx"))
    sent = sent.select((F.col("_y") + F.col("_dy")).alias("ty"), (F.col("_x") + F.col("_dx")).alias("tx"), "gy", "gx", lens, *values)
    lags, most = np.arange(-reach, reach + 1), 4 * reach
    dy, dx = (d.ravel() for d in np.meshgrid(lags, lags, indexing="ij"))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        y, x = (group[f"g{c}"].to_numpy() - t * reach for c, t in zip("yx", key, strict=True))
        lenses, around_it = np.zeros((most, most)), np.zeros((len(values), most, most))
        inside = (y >= 0) & (y < reach) & (x >= 0) & (x < reach)
        lenses[y[inside], x[inside]] = group[lens].to_numpy()[inside]
        for cube, c in zip(around_it, values, strict=True):
            cube[y + reach, x + reach] = group[c].to_numpy()
        if not lenses.any():
            return pd.DataFrame(columns=["ty", "tx", "dy", "dx", *values])
        whole = np.fft.irfft2(np.conj(np.fft.rfft2(lenses)) * np.fft.rfft2(around_it), (most, most))
        found = whole[:, dy + reach, dx + reach]
        some = (np.abs(found) > 1e-6).any(axis=0)
        return pd.DataFrame({"ty": key[0], "tx": key[1], "dy": dy[some], "dx": dx[some]} | dict(zip(values, found[:, some], strict=True)))

    return sent.groupBy("ty", "tx").applyInPandas(run, "ty long, tx long, dy long, dx long, " + ", ".join(f"{c} double" for c in values))
