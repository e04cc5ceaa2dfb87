"""Interpolation and resampling of stamps, overlaps of point-spread functions, and their profiles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import fourier
from ..operators import interpolate as I
from ..operators import psf as P
from .registry import PIX, long, query, r6, stamp_pixels


def _polynomial(coefficients, square: str) -> str:
    out = "0"
    for c in coefficients:
        out = f"({out} * {square} + {c!r}::double)"
    return out


def _tap(f: str) -> str:
    """The weight of tap k in SQL."""
    cases = " ".join(f"when {k} then {_polynomial(I.EVEN[k if k < 5 else 9 - k], f'({f} * {f})')} {'+' if k < 5 else '-'} {f} * {_polynomial(I.ODD[k if k < 5 else 9 - k], f'({f} * {f})')}" for k in range(10))
    return f"case k {cases} end"


TAPPED = f"""wx as (select pt.*, k, cast(trunc(x) as int) - 4 + k as ix, {_tap('(x - trunc(x) - 0.5)')} as w from pt, range(10) t(k)),
wy as (select pt.*, k, cast(trunc(y) as int) - 4 + k as iy, {_tap('(y - trunc(y) - 0.5)')} as w from pt, range(10) t(k))"""
#: Places of a stamp that is padded by six zeros; the last one is off the grid.
PLACES = 7


def places(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(PLACES)
    y = 6 + 0.4 + k * 1.1 + (names[:, None] % 5) / 10.0
    x = 6 + 6.7 - k * 0.9 + (names[:, None] % 7) / 10.0
    y[:, -1] += 40
    return y, x


PT = f"pt as (select vec_id, p, 6 + 0.4 + p * 1.1::double + (vec_id % 5) / 10.0::double + case when p = {PLACES - 1} then 40 else 0 end y, 6 + 6.7 - p * 0.9::double + (vec_id % 7) / 10.0::double x from embeddings, range({PLACES}) t(p))"


@query(f"""with {PIX}, {PT}, {TAPPED}, s as (select wx.vec_id, wx.p, sum(wx.w * wy.w * v) v from wx join wy on wx.vec_id = wy.vec_id and wx.p = wy.p join pix on pix.vec_id = wx.vec_id and pix.x + 6 = ix and pix.y + 6 = iy group by all)
select pt.vec_id, cast(pt.p as bigint) p, round(coalesce(s.v, 0), 6) v from pt left join s on pt.vec_id = s.vec_id and pt.p = s.p""")
def interp_scattered(read):
    """Ten-by-ten-tap values of every stamp at scattered places; zero off the grid. No shuffle."""

    def at(names: np.ndarray, cube: np.ndarray) -> dict:
        return {"vec_id": np.repeat(names, PLACES), "p": np.tile(np.arange(PLACES), len(names)), "v": I.scattered(cube, *places(names)).ravel()}

    return I.map_stamps(read("embeddings"), "vec_id", "embedding", at, "vec_id long, p long, v double").select("vec_id", "p", r6("v", "v"))


@query(f"""with {PIX}, pt as (select vec_id, p, 6 + 0.5 + 1.7 * p::double y, 6 + 0.25 + p + (vec_id % 9) / 10.0::double x from embeddings, range(4) t(p)), {TAPPED}
select wx.vec_id, cast(wy.p as bigint) row, cast(wx.p as bigint) col, round(sum(wx.w * wy.w * v), 6) v from wx join wy on wx.vec_id = wy.vec_id join pix on pix.vec_id = wx.vec_id and pix.x + 6 = ix and pix.y + 6 = iy group by all""")
def interp_gridded(read):
    """The same at the crossings of four rows and four columns, one axis after the other."""

    def at(names: np.ndarray, cube: np.ndarray) -> dict:
        k = np.arange(4)
        y, x = 6.5 + 1.7 * k + 0.0 * names[:, None], 6.25 + k + (names[:, None] % 9) / 10.0
        return {"vec_id": np.repeat(names, 16), "row": np.tile(np.repeat(k, 4), len(names)), "col": np.tile(k, 4 * len(names)), "v": I.gridded(cube, y, x).ravel()}

    return I.map_stamps(read("embeddings"), "vec_id", "embedding", at, "vec_id long, row long, col long, v double").select("vec_id", "row", "col", r6("v", "v"))


#: Pixels of an exposure whose overlaps are asked for, and the flat penalty on them.
PIXELS, FLAT = ((0.0, 0.0), (0.6, -0.7), (-0.9, 1.1)), 1e-3
LAGS = f"""c as (select a.vec_id, b.y - a.y dy, b.x - a.x dx, sum(a.v * b.v) v from pix a join pix b on a.vec_id = b.vec_id group by all),
site as (select * from (values {', '.join(f'({i}, {y}::double, {x}::double)' for i, (y, x) in enumerate(PIXELS))}) t(i, oy, ox))"""


def _own(names: np.ndarray, cube: np.ndarray) -> dict:
    found = np.pad(fourier.correlate(cube, cube, 7), [(0, 0), (6, 6), (6, 6)])
    at = np.array(PIXELS)
    lag = at[None, :, :] - at[:, None, :]
    y, x = (np.broadcast_to(13 + lag[..., c], (len(names), 3, 3)) for c in (0, 1))
    a = I.symmetric(found, y, x) - FLAT / 4 + FLAT
    i, j = np.indices((3, 3))
    return {"vec_id": np.repeat(names, 9), "i": np.tile(i.ravel(), len(names)), "j": np.tile(j.ravel(), len(names)), "overlap": a.ravel()}


@query(f"""with {PIX}, {LAGS}, pt as (select vec_id, a.i, b.i as j, 13 + least(a.i, b.i) * 0 + case when a.i <= b.i then b.oy - a.oy else a.oy - b.oy end y, 13 + case when a.i <= b.i then b.ox - a.ox else a.ox - b.ox end x from embeddings, site a, site b), {TAPPED}
select wx.vec_id, cast(wx.i as bigint) i, cast(wx.j as bigint) j, round(sum(wx.w * wy.w * v) - {FLAT} / 4 + {FLAT}, 5) overlap from wx join wy on wx.vec_id = wy.vec_id and wx.i = wy.i and wx.j = wy.j join c on c.vec_id = wx.vec_id and c.dx + 13 = ix and c.dy + 13 = iy group by all""")
def psf_overlap_self(read):
    """System matrix of three pixels of one exposure: its spot's correlation with itself at their separations, half of it
    computed and mirrored, less the flat penalty over four exposures, which pixels of one exposure get back."""
    out = I.map_stamps(read("embeddings"), "vec_id", "embedding", _own, "vec_id long, i long, j long, overlap double", pad=0)
    return out.select("vec_id", "i", "j", F.round("overlap", 5).alias("overlap"))


@query(f"""with {PIX}, t as (select y, x, exp(-((y - 3.5) ** 2 + (x - 3.5) ** 2) / 4.5) / (4.5 * pi()) g from range(8) a(y), range(8) b(x)),
c as (select vec_id, t.y - pix.y dy, t.x - pix.x dx, sum(v * g) v from pix, t group by all),
site as (select * from (values {', '.join(f'({i}, {y}::double, {x}::double)' for i, (y, x) in enumerate(PIXELS))}) t(i, oy, ox)), pt as (select vec_id, i, 13 + oy y, 13 + ox x from embeddings, site), {TAPPED}
select wx.vec_id, cast(wx.i as bigint) i, round(sum(wx.w * wy.w * v), 6) overlap from wx join wy on wx.vec_id = wy.vec_id and wx.i = wy.i join c on c.vec_id = wx.vec_id and c.dx + 13 = ix and c.dy + 13 = iy group by all""")
def psf_overlap_target(read):
    """Overlaps of three pixels of each exposure with a Gaussian target."""
    y, x = np.mgrid[:8, :8]
    target = np.exp(-((y - 3.5) ** 2 + (x - 3.5) ** 2) / 4.5) / (4.5 * np.pi)

    def at(names: np.ndarray, cube: np.ndarray) -> dict:
        found = np.pad(fourier.correlate(cube, np.broadcast_to(target, cube.shape), 7), [(0, 0), (6, 6), (6, 6)])
        py, px = (np.broadcast_to([13 + p[c] for p in PIXELS], (len(names), 3)) for c in (0, 1))
        return {"vec_id": np.repeat(names, 3), "i": np.tile(np.arange(3), len(names)), "overlap": I.scattered(found, py, px).ravel()}

    out = I.map_stamps(read("embeddings"), "vec_id", "embedding", at, "vec_id long, i long, overlap double", pad=0)
    return out.select("vec_id", "i", r6("overlap", "overlap"))


@query(f"""with {PIX}, c as (select a.vec_id, b.y - a.y dy, b.x - a.x dx, sum(a.v * b.v) v from pix a join pix b on b.vec_id = a.vec_id + 1 group by all)
select vec_id, cast(dy as bigint) dy, cast(dx as bigint) dx, round(v - {FLAT} / 4, 6) overlap from c where abs(dy) <= 1 and abs(dx) <= 1""")
def psf_overlap_cross(read):
    """Overlaps of one exposure's spot with the next one's at small whole lags, less the flat penalty."""
    a = read("embeddings").select("vec_id", "embedding")
    pairs = a.join(a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    lag = np.arange(-1, 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = fourier.correlate(I.cubes(pdf["embedding"], 8, 0), I.cubes(pdf["other"], 8, 0), 1) - FLAT / 4
            yield pd.DataFrame({"vec_id": pdf["vec_id"].repeat(9).to_numpy(), "dy": np.tile(np.repeat(lag, 3), len(pdf)), "dx": np.tile(lag, 3 * len(pdf)), "overlap": found.ravel()})

    return pairs.mapInPandas(run, "vec_id long, dy long, dx long, overlap double").select("vec_id", "dy", "dx", r6("overlap", "overlap"))


OUT, ORIGIN, MATRIX = 5, (1.3, 1.1), ((0.98, 0.05), (-0.04, 1.03))
TAPS = I.affine_taps(OUT, ORIGIN, np.array(MATRIX), 2.0, 2.5, (0.3, 0.05, 0.2))


@query(f"""with {PIX}, taps as (select * from (values {', '.join(f'({a}, {b}, {c}, {d}, {e!r}::double)' for a, b, c, d, e in TAPS)}) t(oy, ox, iy, ix, w)),
l as (select vec_id, y, x, v, v * v q, (vec_id * 7 + pos) % 31 = 0 bad from pix)
select vec_id, cast(oy as bigint) y, cast(ox as bigint) x, round(sum(w * v), 6) v, round(sum(w * q), 6) q, bool_or(bad) masked from l join taps on y = iy and x = ix group by all""")
def affine_gaussian(read):
    """Layers of every stamp under an affine map, smoothed; an output is masked if any of its taps is. The taps are those of
    one stamp, so their number doesn't grow with the table."""
    pix = stamp_pixels(read).withColumn("bad", (F.col("vec_id") * 7 + F.col("pos")) % 31 == 0)
    taps = pix.sparkSession.createDataFrame(TAPS, "oy int, ox int, y int, x int, w double")
    out = pix.join(F.broadcast(taps), ["y", "x"]).groupBy("vec_id", "oy", "ox")
    w = F.col("w")
    return out.agg(r6(F.sum(w * F.col("v")), "v"), r6(F.sum(w * F.col("v") * F.col("v")), "q"), F.bool_or("bad").alias("masked")).select("vec_id", long("oy", "y"), long("ox", "x"), "v", "q", "masked")


@query(f"""with {PIX}, k as (select n, u, sinc * gauss as h from (select n, u, case when u = 0 then 1 else sin(pi() * u * 1.5) / (pi() * u * 1.5) end sinc, exp(-2 * pi() ** 2 * 0.64 * u * u) gauss from (select n, case when n > 16 then n - 32 else n end / 32.0::double u from range(32) t(n)))),
g as (select d, sum(h * cos(2 * pi() * u * d)) / 32 w from k, (select unnest(range(-31, 32)) d) group by d)
select vec_id, cast(oy as bigint) y, cast(ox as bigint) x, round(sum(gy.w * gx.w * v), 6) v from pix, range(10, 22) a(oy), range(10, 22) b(ox), g gy, g gx where gy.d = oy - (y + 12) and gx.d = ox - (x + 12) group by all""")
def psf_smoothed(read):
    """Every stamp convolved with a top hat and a Gaussian in Fourier space, padded by twelve zeros."""

    def at(names: np.ndarray, cube: np.ndarray) -> dict:
        found = P.smooth_and_pad(cube, 1.5, 0.8)[:, 10:22, 10:22]
        k = np.arange(10, 22)
        return {"vec_id": np.repeat(names, 144), "y": np.tile(np.repeat(k, 12), len(names)), "x": np.tile(k, 12 * len(names)), "v": found.ravel()}

    assert P.padding(1.5, 0.8) == 8
    out = I.map_stamps(read("embeddings"), "vec_id", "embedding", at, "vec_id long, y long, x long, v double", pad=4)
    return out.select("vec_id", "y", "x", r6("v", "v"))


def _spots(read, make, schema: str):
    """A row of results for each supplier, whose numbers set the spot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known: dict = {}
            rows = []
            for key in pdf["k"]:
                kind = key % 20
                if kind not in known:
                    known[kind] = make(int(kind))
                rows.append((key, *known[kind]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return read("supplier").select(F.col("s_suppkey").alias("k")).mapInPandas(run, schema)


@query()
def psf_airy(read):
    """Obscured Airy spots, smoothed: their sum, peak and full width at half maximum, by supplier's number."""

    def make(kind: int) -> tuple:
        spot = P.airy(32, 2 + kind / 10, 0.3, 1.0, 0.3)
        return float(spot.sum()), float(spot.max()), P.half_width(P.airy(33, 2 + kind / 10, 0.3, 1.0, 0.3))

    out = _spots(read, make, "k long, total double, peak double, width double")
    return out.select("k", *[r6(c, c) for c in ("total", "peak", "width")])


@query()
def psf_airy_struts(read):
    """Airy spots with struts and features: their sum and centre."""

    def make(kind: int) -> tuple:
        spot = P.airy_with_struts(32, 2.5, 1.0, 0.3, kind % 8)
        y, x = np.mgrid[:32, :32]
        return float(spot.sum()), float((spot * y).sum() / spot.sum()), float((spot * x).sum() / spot.sum())

    return _spots(read, make, "k long, total double, cy double, cx double").select("k", *[r6(c, c) for c in ("total", "cy", "cx")])


@query(f"""with g as (select s_suppkey k, 2 + (s_suppkey % 20) / 10.0::double s from supplier) select k, round(2 * sqrt(2 * ln(2)) * s, 2) width from g""")
def psf_half_width(read):
    """Full width at half maximum of Gaussian spots, by interpolation and bisection."""

    def make(kind: int) -> tuple:
        return (P.half_width(P.gaussian_stamp(49, np.eye(2) * (2 + kind / 10) ** 2)),)

    return _spots(read, make, "k long, width double").select("k", F.round("width", 2).alias("width"))


@query()
def psf_split(read):
    """Spots of two by two Legendre terms split into a short range and a deconvolved long range, and what is left over."""

    def at(names: np.ndarray, cube: np.ndarray) -> dict:
        out: dict = {"vec_id": [], "short": [], "kernel": [], "left": [], "short_sum": []}
        for name, image in zip(names.tolist(), cube, strict=True):
            four = np.stack([image, 0.1 * image[::-1], 0.1 * image[:, ::-1], 0.01 * image.T])
            short, kernel, left = P.split(four, lambda x, y: np.array([[1.0 + 0.1 * x, 0.0], [0.0, 1.0 + 0.1 * y]]), 1.0, 1.5, 4.0, 0.05, 1)
            for key, value in zip(out, (name, float((short**2).sum()), float((kernel**2).sum()), float(np.abs(left).max()), float(short.sum())), strict=True):
                out[key].append(value)
        return out

    found = I.map_stamps(read("embeddings"), "vec_id", "embedding", at, "vec_id long, short double, kernel double, left double, short_sum double", pad=4)
    return found.select("vec_id", *[r6(c, c) for c in ("short", "kernel", "left", "short_sum")])


WINDOW = """case when {x} >= 1 then 1.0 when {x} <= -1 then 0.0 else 0.5 * ({x} + 1) + (0.5 * sin(pi() * {x}) + 0.02 * sin(2 * pi() * {x})) / (0.92 * pi()) end"""


@query(f"""with {PIX}, r as (select *, 2 * (4.0 - sqrt((x - 3.5) ** 2 + (y - 3.5) ** 2)) / 2.5 - 1 t, case when least(y, 7 - y) < 2 then 2 * (least(y, 7 - y) + 1) / 3.0::double - 1 else 1 end a, case when least(x, 7 - x) < 2 then 2 * (least(x, 7 - x) + 1) / 3.0::double - 1 else 1 end b from pix)
select vec_id, round(sum(v * {WINDOW.format(x='t')}), 6) inside, round(sum(v * ({WINDOW.format(x='a')}) * ({WINDOW.format(x='b')})), 6) cut from r group by vec_id""")
def blackman_planes(read):
    """Stamps under the radial window and under the window that falls off at the edges."""
    from ..functions import columns as C

    p = stamp_pixels(read)
    t = 2 * (4.0 - F.sqrt(F.pow(F.col("x") - 3.5, 2) + F.pow(F.col("y") - 3.5, 2))) / 2.5 - 1

    def edge(c: str):
        depth = F.least(F.col(c), 7 - F.col(c))
        return F.when(depth < 2, C.blackman_step(2 * (depth + 1) / 3.0 - 1)).otherwise(1.0)

    return p.groupBy("vec_id").agg(r6(F.sum(F.col("v") * C.blackman_step(t)), "inside"), r6(F.sum(F.col("v") * edge("y") * edge("x")), "cut"))


assert math.isclose(sum(w for a, b, _, _, w in TAPS if (a, b) == (0, 0)), 1.0)
