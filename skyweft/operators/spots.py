"""Systems of stamps from the exposures' own spots: planes looked up by group of stamps, correlated and assembled.

A group is two by two stamps. Each exposure that has pixels in a group has one plane there: its spot, sampled on the
mosaic's grid under the exposure's own map near the group's centre. Planes are keyed by (group, exposure) and made once,
however many stamps look them up. A stamp correlates the planes that meet there, each transformed once, and its matrices
are those correlations at the separations of its pixels, shifted once for a pair of planes where these lie on grids: planes are shuffled,
not their far more numerous correlations. What a stamp holds is bounded by geometry and depth.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fourier, systems
from . import interpolate as I

#: Pixels of a plane's side, zeros around it for ten taps, and the largest lag of a correlation.
SIDE, PAD, REACH = 8, 6, 7
LAGS = 2 * REACH + 1
MIDDLE = (SIDE - 1) / 2
#: Planes that a task works on at once, and weights that a system holds at once.
PIECE, HELD = 1024, 1 << 22
Map = Callable[[Column, Column], tuple[Column, Column]]


def stamp_of(place: str, side: int) -> Column:
    return F.floor((F.col(place) + 0.5) / side).cast("long")


def with_group(pixels: DataFrame, side: int) -> DataFrame:
    """pixels(py, px) with the group of two by two stamps of `side` in which they lie."""
    return pixels.withColumns({"gj": F.floor(stamp_of("py", side) / 2).cast("long"), "gi": F.floor(stamp_of("px", side) / 2).cast("long")})


def centre(group: str, side: int) -> Column:
    """Where the four stamps of a group meet."""
    return (F.col(group) * 2 + 1).cast("double") * side - 0.5


def cardinal(mapped: Map, y: Column, x: Column) -> tuple[Column, Column, Column, Column]:
    """The linear form of a map near a place (dy'/dy, dy'/dx, dx'/dy, dx'/dx), from half the differences of four points around it."""
    (uy, ux), (dy, dx), (ry, rx), (ly, lx) = mapped(y + 1, x), mapped(y - 1, x), mapped(y, x + 1), mapped(y, x - 1)
    return (uy - dy) / 2, (ry - ly) / 2, (ux - dx) / 2, (rx - lx) / 2


def places(mapped: Map, y: Column, x: Column) -> tuple[Column, Column]:
    """Where in a spot each place of the grid lies under the map itself, off the spot's middle."""
    every = F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))
    off = lambda k: (F.floor(k / SIDE) - MIDDLE, k % SIDE - MIDDLE)
    y0, x0 = mapped(y, x)
    return F.transform(every, lambda k: mapped(y + off(k)[0], x + off(k)[1])[0] - y0), F.transform(every, lambda k: mapped(y + off(k)[0], x + off(k)[1])[1] - x0)


def _parts(table: DataFrame) -> int:
    """Partitions for work that costs far more than the bytes it reads, by which Spark would merge them into a few."""
    return int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def planes(pixels: DataFrame, spots: DataFrame, side: int, mapped: Map, linear: bool = True) -> DataFrame:
    """pixels(img, py, px), spots(img, spot array, columns of the map) -> (gj, gi, img, plane array<double>).

    A row for every exposure with pixels in a group. Exposures without a spot have none; null or wrongly sized spots are zero.
    """
    used = with_group(pixels, side).select("gj", "gi", "img").distinct().repartition(_parts(pixels), "img")
    form = (cardinal if linear else places)(mapped, centre("gj", side), centre("gi", side))
    rows = used.join(spots.hint("merge"), "img").select("gj", "gi", "img", "spot", *[c.alias(f"m{n}") for n, c in enumerate(form)])
    oy, ox = (g.ravel() - MIDDLE for g in np.mgrid[:SIDE, :SIDE])

    def at(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        if linear:
            yy, yx, xy, xx = (pdf[f"m{n}"].to_numpy(float)[:, None] for n in range(4))
            return yy * oy + yx * ox, xy * oy + xx * ox
        return np.stack(pdf["m0"].to_numpy()), np.stack(pdf["m1"].to_numpy())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), PIECE):
                pdf = whole[start : start + PIECE]
                y, x = (p + MIDDLE + PAD for p in at(pdf))
                yield pdf[["gj", "gi", "img"]].assign(plane=list(I.scattered(I.cubes(pdf["spot"], SIDE, PAD), y, x)))

    return rows.mapInPandas(run, "gj long, gi long, img long, plane array<double>")


KEY = ("gj", "gi", "img")


def met(pixels: DataFrame, side: int, radius: float) -> DataFrame:
    """(j_st, i_st, spot): the planes that a stamp's inputs look up, by their own groups; spot is struct(gj, gi, img)."""
    sent = systems.near_stamps(with_group(pixels, side), side, radius)
    return sent.select("j_st", "i_st", F.struct(*KEY).alias("spot")).distinct()


def correlations(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, lags): the correlation of two planes for each different pair of spots, lags from -REACH to REACH in rows."""
    of = lambda end: found.select(F.struct(*KEY).alias(end), F.col("plane").alias(f"plane_{end}"))
    both = pairs.select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), PIECE):
                pdf = whole[start : start + PIECE]
                lags = fourier.correlate(*(I.cubes(pdf[f"plane_{e}"], SIDE, 0) for e in "ab"), REACH)
                yield pdf[[f"{e}_{k}" for e in "ab" for k in KEY]].assign(lags=list(lags.reshape(len(pdf), -1)))

    flat = both.select(*[F.col(f"{e}.{k}").alias(f"{e}_{k}") for e in "ab" for k in KEY], "plane_a", "plane_b")
    out = flat.mapInPandas(run, ", ".join(f"{e}_{k} long" for e in "ab" for k in KEY) + ", lags array<double>")
    return out.select(*[F.struct(*[F.col(f"{e}_{k}").alias(k) for k in KEY]).alias(e) for e in "ab"], "lags")


def target_plane(width: float) -> np.ndarray:
    y, x = np.mgrid[:SIDE, :SIDE] - MIDDLE
    return np.exp(-(y * y + x * x) / (2 * width * width)) / (2 * np.pi * width * width)


def _lines(spot: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(spot and place of each line of pixels of one spot, the line of each pixel); lines go by spot."""
    order = np.lexsort((at, spot))
    s, p = spot[order], at[order]
    first = np.concatenate([[True], (s[1:] != s[:-1]) | (p[1:] != p[:-1])])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(first) - 1
    return s[first], p[first], of


def _runs(spot: np.ndarray) -> list[tuple[int, slice]]:
    """Where each spot's lines begin and end."""
    first = np.flatnonzero(np.diff(spot, prepend=-1))
    return [(int(spot[i]), slice(int(i), int(j))) for i, j in zip(first, [*first[1:], len(spot)], strict=True)]


def _weights(apart: np.ndarray) -> np.ndarray:
    """Weights of the lags of a correlation at each separation on a last axis, none beyond its lags."""
    return I.axis_weights(apart + REACH + PAD, 2 * (REACH + PAD) + 1)[..., PAD:-PAD]


def _by_lines(spot: np.ndarray, y: np.ndarray, x: np.ndarray, n: int, lags: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The correlations of the first n pixels with all of no lesser spot, wherever they lie: along one axis for pairs of lines, along the
    other for pairs of pixels."""
    out = np.zeros((n, len(y)))
    step = max(1, HELD // (len(y) * LAGS))
    for start in range(0, n, step):
        some, later = slice(start, min(start + step, n)), slice(int(np.searchsorted(spot, spot[start])), None)
        (si, yi, ri), (sj, yj, rj) = _lines(spot[some], y[some]), _lines(spot[later], y[later])
        (_, xi, ci), (_, xj, cj) = _lines(spot[some], x[some]), _lines(spot[later], x[later])
        along_y, along_x = _weights(yi[:, None] - yj), _weights(xi[:, None] - xj)
        others = _runs(sj)
        for s, i in _runs(si):
            for t, j in others:
                if s <= t:
                    along_y[i, j] = (along_y[i, j].reshape(-1, LAGS) @ lags[number[s, t]]).reshape(along_y[i, j].shape)
        meet = np.flatnonzero(spot[some, None] <= spot[None, later])
        at_y, at_x = ((of[:, None] * len(to) + others_of).ravel()[meet] for of, to, others_of in ((ri, yj, rj), (ci, xj, cj)))
        values = np.zeros((min(step, n - start), len(rj)))
        for part in (slice(k, k + PIECE) for k in range(0, len(meet), PIECE)):
            values.ravel()[meet[part]] = np.einsum("pk,pk->p", along_y.reshape(-1, LAGS).take(at_y[part], axis=0), along_x.reshape(-1, LAGS).take(at_x[part], axis=0))
        out[some, later] = values
    return out


#: Whole steps at which a correlation is not zero, and the tap that takes a lag to each; one more tap is zero.
STEPS = np.arange(I.BEFORE - REACH - PAD, REACH + PAD + 2 + I.BEFORE - I.TAPS)
TAP = np.arange(LAGS) - (STEPS[:, None] + REACH - I.BEFORE)
TAP = np.where((TAP >= 0) & (TAP < I.TAPS), TAP, I.TAPS)


def _by_steps(spot: np.ndarray, y: np.ndarray, x: np.ndarray, n: int, lags: np.ndarray, number: np.ndarray) -> np.ndarray | None:
    """The same where the pixels of each spot are whole steps apart, as they are on an exposure's own grid: two spots' pixels then differ
    by one fraction and whole steps, so that a correlation is shifted once by that fraction. None if they aren't."""
    first = np.searchsorted(spot, np.arange(len(number)))
    whole = [np.rint(p - p[first][spot]).astype(np.int64) for p in (y, x)]
    if any((np.abs(p - p[first][spot] - k) > 1e-9).any() for p, k in zip((y, x), whole, strict=True)):
        return None
    s, t = np.triu_indices(len(number))
    at, shifts = [], []
    for p, k in zip((y, x), whole, strict=True):
        apart = p[first][s] - p[first][t]
        base = np.floor(apart + 1e-9).astype(np.int64)
        taps = I.tap_weights(np.maximum(apart - base, 0.0))[1]
        shifts.append(np.concatenate([taps, np.zeros((len(taps), 1))], axis=1)[:, TAP])
        step = base[number[spot[:n, None], spot]] + k[:n, None] - k - STEPS[0]
        at.append(np.where((step >= 0) & (step < len(STEPS)), step, len(STEPS)))
    shifted = np.zeros((len(lags), len(STEPS) + 1, len(STEPS) + 1))
    shifted[:, :-1, :-1] = shifts[0] @ lags @ np.swapaxes(shifts[1], 1, 2)
    return shifted[number[spot[:n, None], spot], at[0], at[1]]


def assembled(spot: np.ndarray, y: np.ndarray, x: np.ndarray, own: np.ndarray, out: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """A, B and C of inputs at y, x with the spots numbered `spot`, each met and in ascending order.

    own: the spots' planes; out: places of the outputs, which meet the inputs as pixels of one more spot, the target.
    """
    n, last = len(y), len(own)
    spot = np.concatenate([spot, np.full(len(out), last)])
    y, x = np.concatenate([y, out[:, 0]]), np.concatenate([x, out[:, 1]])
    lags = np.ascontiguousarray(fourier.correlations(np.concatenate([own, target[None]]), REACH))
    number = np.zeros((last + 1, last + 1), np.int64)
    number[np.triu_indices(last + 1)] = np.arange(len(lags))
    whole = _by_steps(spot, y, x, n, lags, number)
    if whole is None:
        whole = _by_lines(spot, y, x, n, lags, number)
    a, b = whole[:, :n], whole[:, n:].T
    a = np.where(spot[:n, None] <= spot[:n], a, a.T)
    return (a + a.T) / 2, b, float((target * target).sum())


def stamp_systems(pixels: DataFrame, found: DataFrame, side: int, radius: float) -> DataFrame:
    """A row a stamp: its inputs, and the planes they look up with their own inputs. Planes are looked up once.

    pixels(img, py, px, v), found: planes. -> (j_st, i_st, inputs array<struct>, spots array<struct>), inputs in the order of spots
    """
    sent = systems.near_stamps(with_group(pixels, side), side, radius)
    lists = sent.groupBy("j_st", "i_st", *KEY).agg(F.sort_array(F.collect_list(F.struct("py", "px", "v"))).alias("inputs"))
    one = found.groupBy(*KEY).agg(F.max("plane").alias("plane"))
    spots = lists.join(one.hint("merge"), list(KEY)).repartition(_parts(pixels), "j_st", "i_st").groupBy("j_st", "i_st").agg(F.sort_array(F.collect_list(F.struct(*KEY, "plane", "inputs"))).alias("spots"))
    return spots.select("j_st", "i_st", F.flatten("spots.inputs").alias("inputs"), "spots")


def matrices(row, side: int, target: np.ndarray) -> tuple:
    """(A, B, C, outputs, inputs) of a stamp: py, px, img of its inputs, `many` inputs to each of its `planes`."""
    own = np.asarray(row.planes).reshape(-1, SIDE, SIDE)
    y, x = np.asarray(row.py), np.asarray(row.px)
    out = np.stack([g.ravel() for g in np.mgrid[row.j_st * side : (row.j_st + 1) * side, row.i_st * side : (row.i_st + 1) * side]], axis=1).astype(float)
    return *assembled(np.repeat(np.arange(len(own)), row.many), y, x, own, out, target), out, np.stack([y, x], axis=1)


def solve_stamps(pixels: DataFrame, found: DataFrame, side: int, radius: float, kernel: str, kappas: list[float], target: float = 1.6, most_leak: float = 1e-6, most_noise: float = 0.5) -> DataFrame:
    """pixels(img, py, px, v), found: planes -> systems.SCHEMA, a row for every output of every stamp with pixels of its own."""
    plane = target_plane(target)

    def stamps(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                y, x = np.asarray(row.py), np.asarray(row.px)
                if ((np.floor((y + 0.5) / side) == row.j_st) & (np.floor((x + 0.5) / side) == row.i_st)).any():
                    a, b, c, out, places = matrices(row, side, plane)
                    yield row.j_st, row.i_st, out, places, np.repeat(row.img, row.many), np.asarray(row.v), (a, b, c)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from systems.tables(systems.solved(stamps(batches), radius, kernel, kappas, most_leak, most_noise))

    many = F.transform("spots", lambda s: F.size(s["inputs"])).alias("many")
    flat = stamp_systems(pixels, found, side, radius).select("j_st", "i_st", *[F.col(f"inputs.{c}").alias(c) for c in ("py", "px", "v")], F.col("spots.img").alias("img"), many, F.flatten("spots.plane").alias("planes"))
    return flat.mapInPandas(run, systems.SCHEMA)
