"""Systems of output stamps on a mosaic that grows with the images: inputs meet a stamp by its key, a task solves it.

A stamp's inputs lie within a radius of it, so the size of a system is bounded by geometry and depth, not by the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels

SCHEMA = "j_st long, i_st long, oy long, ox long, inputs long, kappa double, sigma double, leakage double, value double, constant double, neff double"


def near_stamps(pixels: DataFrame, side: int, radius: float) -> DataFrame:
    """pixels(img, py, px, v) -> (j_st, i_st, img, py, px, v): every pixel at each stamp whose outputs it may reach.

    A pixel goes to its own stamp and those around it. At a stamp beside its own, it must be within the radius of the
    nearest edge; at a corner, of the nearest corner. The radius must not exceed a stamp.
    """
    if radius > side:
        raise ValueError("the acceptance radius exceeds the stamp")
    around = F.sequence(F.lit(-1), F.lit(1))
    own = {c: F.floor((F.col(c) + 0.5) / side).cast("long") for c in ("py", "px")}
    out = pixels.select("*", own["py"].alias("_j"), own["px"].alias("_i"), F.explode(around).alias("_dj")).select("*", F.explode(around).alias("_di"))

    def beyond(place: str, home: str, step: str):
        """How far a place is from the nearest edge of the stamp `step` away from its own; nothing for its own."""
        low = (F.col(home) + F.col(step)) * side - 0.5
        return F.when(F.col(step) > 0, low - F.col(place)).when(F.col(step) < 0, F.col(place) - low - side).otherwise(0.0)

    y, x = beyond("py", "_j", "_dj"), beyond("px", "_i", "_di")
    out = out.where((F.col("_dj") == 0) & (F.col("_di") == 0) | (y * y + x * x < radius * radius))
    return out.select((F.col("_j") + F.col("_dj")).alias("j_st"), (F.col("_i") + F.col("_di")).alias("i_st"), *pixels.columns)


#: Stamps along a side of a tile whose inputs meet in one call, distances or elements of matrices that a call holds at once, and stamps
#: that are solved together.
TILE, HELD, TOGETHER = 8, 1 << 20, 32


def _met(y: np.ndarray, x: np.ndarray, img: np.ndarray, one: slice, other: slice, same: bool) -> tuple[int, float]:
    """Number and overlaps of the pairs of two runs of inputs, of one run with itself each pair once; by blocks of bounded size."""
    n, total, step = 0, 0.0, max(1, HELD // max(1, other.stop - other.start))
    for at in range(one.start, one.stop, step):
        a = np.arange(at, min(at + step, one.stop))
        w = np.exp(-((y[a, None] - y[None, other]) ** 2 + (x[a, None] - x[None, other]) ** 2) / 4)
        if same:  # inputs are sorted; those of one place and image meet both ways
            b = np.arange(other.start, other.stop)
            up = a[:, None] <= b[None, :]
            up |= (y[a, None] == y[None, other]) & (x[a, None] == x[None, other]) & (img[a, None] == img[None, other])
            n, total = n + int(up.sum()), total + float(w[up].sum())
        else:
            n, total = n + w.size, total + float(w.sum())
    return n, total


def stamp_overlaps(pixels: DataFrame, side: int) -> DataFrame:
    """pixels(img, py, px) -> (j, i, dj, di, n, overlap): pairs of the inputs of stamp (j, i) with those of the one dj, di on, each pair
    of stamps within five by five once, and the sum of their overlaps.

    A task gets tiles of TILE by TILE stamps with a margin of two, so an input is sent to two tiles on average and no pair has a row.
    """
    h = pixels.select("img", "py", "px", *[F.floor((F.col(c) + 0.5) / side).cast("long").alias(k) for c, k in (("py", "j"), ("px", "i"))])
    # rows of stamp j are wanted by tiles that hold j - 2 to j, columns by those that hold i - 2 to i + 2
    over = lambda low, high: F.explode(F.sequence(F.floor(low / TILE), F.floor(high / TILE)))
    sent = h.select("*", over(F.col("j") - 2, F.col("j")).alias("tj")).select("*", over(F.col("i") - 2, F.col("i") + 2).alias("ti"))
    steps = [(dj, di) for dj in range(3) for di in range(-2, 3) if dj or di >= 0]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["j", "i", "img", "py", "px"])
        j, i, img, y, x = (group[c].to_numpy() for c in ("j", "i", "img", "py", "px"))
        first = np.flatnonzero(np.concatenate([[True], (j[1:] != j[:-1]) | (i[1:] != i[:-1])]))
        runs = {(int(j[s]), int(i[s])): slice(int(s), int(e)) for s, e in zip(first, [*first[1:], len(j)], strict=True)}
        rows = []
        for (sj, si), one in runs.items():
            if sj // TILE == key[0] and si // TILE == key[1]:
                for dj, di in steps:
                    if (other := runs.get((sj + dj, si + di))) is not None:
                        rows.append((sj, si, dj, di, *_met(y, x, img, one, other, not (dj or di))))
        return pd.DataFrame(rows, columns=["j", "i", "dj", "di", "n", "overlap"])

    return sent.groupBy("tj", "ti").applyInPandas(run, "j long, i long, dj long, di long, n long, overlap double")


def gaussian_system(out: np.ndarray, inputs: np.ndarray, width: float, target: float) -> tuple[np.ndarray, np.ndarray, float]:
    """A, B and C of Gaussian spots: inputs of one width, the target of another; C is the target's own overlap."""

    def overlap(p: np.ndarray, q: np.ndarray, u: float, v: float) -> np.ndarray:
        square = ((p[:, None, :] - q[None, :, :]) ** 2).sum(axis=2)
        return np.exp(-square / (2 * (u * u + v * v))) / (2 * np.pi * (u * u + v * v))

    return overlap(inputs, inputs, width, width), overlap(out, inputs, target, width), float(1 / (4 * np.pi * target**2))


def described(j: int, i: int, out: np.ndarray, image: np.ndarray, value: np.ndarray, found: kernels.Solution) -> dict[str, np.ndarray]:
    """Columns of SCHEMA of a stamp whose solution is known; image, value: of its inputs."""
    images, image = np.unique(image, return_inverse=True)
    by_image = found.t @ (image[:, None] == np.arange(len(images))).astype(float)
    squares = (by_image**2).sum(axis=1)
    neff = np.divide(np.abs(by_image).sum(axis=1) ** 2, squares, out=np.zeros(len(out)), where=squares > 0)
    whole = out.astype(np.int64)
    return {
        "j_st": np.full(len(out), j), "i_st": np.full(len(out), i), "oy": whole[:, 0], "ox": whole[:, 1], "inputs": np.full(len(out), len(value)), "kappa": found.kappa, "sigma": found.sigma,
        "leakage": found.leakage, "value": found.t @ value, "constant": found.t.sum(axis=1), "neff": neff,
    }


def outputs(j: int, i: int, out: np.ndarray, places: np.ndarray, image: np.ndarray, value: np.ndarray, system: tuple, radius: float, kernel: str, kappas: list[float], most_leak: float, most_noise: float) -> dict[str, np.ndarray]:
    """Columns of SCHEMA of a stamp whose system (A, B, C) is known; out, places: of outputs and inputs."""
    distance = np.sqrt(((out[:, None, :] - places[None, :, :]) ** 2).sum(axis=2))
    return described(j, i, out, image, value, kernels.solve(kernel, *system, distance, radius, kappas, most_leak, most_noise))


def solved(stamps: Iterator[tuple], radius: float, kernel: str, kappas: list[float], most_leak: float, most_noise: float) -> Iterator[dict[str, np.ndarray]]:
    """outputs() of stamps (j, i, out, places, image, value, (A, B, C)); those of equal shape are solved together, so that what a call
    costs is shared. Of matrices, HELD elements and one stamp are kept at most."""

    def flushed(some: list[tuple]) -> Iterator[dict[str, np.ndarray]]:
        a, b = (np.stack([s[6][k] for s in some]) for k in (0, 1))
        distance = np.sqrt(((np.stack([s[2] for s in some])[:, :, None] - np.stack([s[3] for s in some])[:, None]) ** 2).sum(axis=3))
        found = kernels.solve(kernel, a, b, some[0][6][2], distance, radius, kappas, most_leak, most_noise)
        for n, (j, i, out, _, image, value, _) in enumerate(some):
            yield described(j, i, out, image, value, kernels.Solution(found.t[n], found.kappa[n], found.sigma[n], found.leakage[n]))

    waiting, held = {}, 0
    for stamp in stamps:
        a, b, c = stamp[6]
        some = waiting.setdefault((b.shape, c), [])
        some.append(stamp)
        held += a.size
        while held > HELD or len(some) == TOGETHER:
            most = max(waiting, key=lambda k: len(waiting[k]) * k[0][1] ** 2)
            full = waiting.pop((b.shape, c) if len(some) == TOGETHER else most)
            held -= sum(s[6][0].size for s in full)
            some = []
            yield from flushed(full)
    for some in waiting.values():
        yield from flushed(some)


def tables(stamps: Iterator[dict[str, np.ndarray]]) -> Iterator[pd.DataFrame]:
    """Tables of many stamps each, from the columns of single ones."""
    stamps = iter(stamps)
    while some := list(islice(stamps, 256)):
        yield pd.DataFrame({c: np.concatenate([s[c] for s in some]) for c in some[0]})


def solve_stamps(pixels: DataFrame, side: int, radius: float, kernel: str, kappas: list[float], width: float = 1.0, target: float = 1.2, most_leak: float = 1e-6, most_noise: float = 0.5) -> DataFrame:
    """pixels(img, py, px, v) -> SCHEMA, a row for every output pixel of every stamp that has pixels of its own.

    value and constant are the image and a layer of ones under the same weights; neff is the effective coverage.
    """

    oy, ox = (x.ravel() for x in np.mgrid[:side, :side])

    def solved(rows) -> Iterator[dict[str, np.ndarray]]:
        for row in rows:
            out, inputs = np.stack([row.j_st * side + oy, row.i_st * side + ox], axis=1).astype(float), np.stack([row.py, row.px], axis=1).astype(float)
            a, b, c = gaussian_system(out, inputs, width, target)
            yield outputs(row.j_st, row.i_st, out, inputs, row.img, np.asarray(row.v, float), (a, b, c), radius, kernel, kappas, most_leak, most_noise)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from tables(solved(pdf.itertuples(index=False)))

    own = (F.floor((F.col("py") + 0.5) / side) == F.col("j_st")) & (F.floor((F.col("px") + 0.5) / side) == F.col("i_st"))
    # a row a stamp, so that a task takes many stamps at a time; stamps without pixels of their own don't reach it
    lists = near_stamps(pixels, side, radius).groupBy("j_st", "i_st").agg(F.bool_or(own).alias("own"), F.sort_array(F.collect_list(F.struct("img", "py", "px", "v"))).alias("inputs"))
    return lists.where("own").select("j_st", "i_st", *[F.col(f"inputs.{c}").alias(c) for c in ("img", "py", "px", "v")]).mapInPandas(run, SCHEMA)
