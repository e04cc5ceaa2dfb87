"""Systems of stamps from differing spots: planes by group, warps near them, correlations, and the kernels on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import spots as P
from .interp import TAPPED
from .registry import query, r6
from .solve import ACROSS, DEPTH, MOSAIC, RADIUS, SENT, SIDE, mosaic


def spots(read) -> DataFrame:
    """(img, spot): a Gaussian that each exposure's stamp modulates, of unit sum."""
    def value(v: Column, i: Column) -> Column:
        y, x = F.floor(i / P.SIDE) - P.MIDDLE, i % P.SIDE - P.MIDDLE
        return F.exp(-(y * y + x * x) / 3.38) * (1 + 0.4 * v.cast("double"))

    raw = read("embeddings").select(F.col("vec_id").alias("img"), F.transform("embedding", value).alias("raw"))
    summed = raw.select("img", "raw", F.aggregate("raw", F.lit(0.0), lambda s, w: s + w).alias("total"))  # once a spot, not once a pixel
    return summed.select("img", F.transform("raw", lambda v: v / F.col("total")).alias("spot"))


def mapped(y: Column, x: Column) -> tuple[Column, Column]:
    """The exposure's map: a shear and a turn of its own, and a quadratic part, around the corner of its block."""
    img, block = F.col("img"), F.expr(f"img div {DEPTH}")
    dy, dx = y - 8 * F.floor(block / ACROSS), x - 8 * (block % ACROSS)
    a, b, q = 0.02 * (img % 5 - 2), 0.01 * (img % 7 - 3), 0.002 * (img % 3)
    return (1 + a) * dy + b * dx + q * dx * dx, (1 - a) * dx - b * dy + q * dy * dx


def planes(read, linear: bool = True) -> DataFrame:
    return P.planes(mosaic(read), spots(read), SIDE, mapped, linear)


def _mapped(y: str, x: str) -> tuple[str, str]:
    """The same map in SQL; m0 has the exposure's numbers."""
    dy, dx = f"(({y}) - y0)", f"(({x}) - x0)"
    return f"((1 + ma) * {dy} + mb * {dx} + mq * {dx} * {dx})", f"((1 - ma) * {dx} - mb * {dy} + mq * {dy} * {dx})"


def _planes_sql(linear: bool) -> str:
    cy, cx = f"((2 * gj + 1) * {SIDE} - 0.5)", f"((2 * gi + 1) * {SIDE} - 0.5)"
    oy, ox = "(p // 8 - 3.5)", "(p % 8 - 3.5)"
    if linear:
        (uy, ux), (dy, dx), (ry, rx), (ly, lx) = (_mapped(f"{cy} + {a}", f"{cx} + {b}") for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)))
        y, x = f"({uy} - {dy}) / 2 * {oy} + ({ry} - {ly}) / 2 * {ox}", f"({ux} - {dx}) / 2 * {oy} + ({rx} - {lx}) / 2 * {ox}"
    else:
        (y, x), (y0, x0) = _mapped(f"{cy} + {oy}", f"{cx} + {ox}"), _mapped(cy, cx)
        y, x = f"{y} - {y0}", f"{x} - {x0}"
    return f"""{MOSAIC}, raw as (select vec_id as img, y as sy, x as sx, exp(-((y - 3.5) ** 2 + (x - 3.5) ** 2) / 3.38) * (1 + 0.4 * v) r from pix),
spot as (select img, sy, sx, r / sum(r) over (partition by img) r from raw),
used as (select distinct img, cast(floor(floor((py + 0.5) / {SIDE}) / 2) as bigint) gj, cast(floor(floor((px + 0.5) / {SIDE}) / 2) as bigint) gi from m),
m0 as (select *, 8 * ((img // {DEPTH}) // {ACROSS}) y0, 8 * ((img // {DEPTH}) % {ACROSS}) x0, 0.02::double * (img % 5 - 2) ma, 0.01::double * (img % 7 - 3) mb, 0.002::double * (img % 3) mq from used),
pt as (select img, gj, gi, p, 9.5 + {y} y, 9.5 + {x} x from m0, range(64) t(p)), {TAPPED},
plane as (select wx.img, wx.gj, wx.gi, wx.p, sum(wx.w * wy.w * r) v from wx join wy on wx.img = wy.img and wx.gj = wy.gj and wx.gi = wy.gi and wx.p = wy.p
  join spot on spot.img = wx.img and spot.sx + 6 = wx.ix and spot.sy + 6 = wy.iy group by all)"""


SUMMARY = "select gj, gi, img, round(sum(v), 6) total, round(sum(v * v), 6) power, round(sum(v * (p // 8 - 3.5)), 5) my, round(sum(v * (p % 8 - 3.5)), 5) mx from plane group by all"


def _summary(found: DataFrame) -> DataFrame:
    """Sum, power and first moments of each plane."""
    def total(of, places: int) -> Column:
        values = F.transform("plane", of)
        return F.round(F.aggregate(values, F.lit(0.0), lambda s, v: s + v), places)

    return found.select(
        "gj", "gi", "img", total(lambda v, i: v, 6).alias("total"), total(lambda v, i: v * v, 6).alias("power"),
        total(lambda v, i: v * (F.floor(i / 8) - P.MIDDLE), 5).alias("my"), total(lambda v, i: v * (i % 8 - P.MIDDLE), 5).alias("mx"),
    )


@query(f"with {_planes_sql(True)} {SUMMARY}")
def spot_planes(read):
    """The plane of each exposure in each group of two by two stamps, under the linear form of its map by four cardinal points."""
    return _summary(planes(read))


@query(f"with {_planes_sql(False)} {SUMMARY}")
def spot_planes_warped(read):
    """The same planes under the map itself, place by place."""
    return _summary(planes(read, False))


@query(f"""with {SENT} select j_st, i_st, count(distinct (img, floor(floor((py + 0.5) / {SIDE}) / 2), floor(floor((px + 0.5) / {SIDE}) / 2))) planes,
count(distinct (floor(floor((py + 0.5) / {SIDE}) / 2), floor(floor((px + 0.5) / {SIDE}) / 2))) as "groups" from sent group by all""")
def spot_lookup(read):
    """How many planes, of how many groups, each stamp looks up."""
    found = P.met(mosaic(read), SIDE, RADIUS).groupBy("j_st", "i_st", "spot.gj", "spot.gi").agg(F.count("*").alias("n"))
    return found.groupBy("j_st", "i_st").agg(F.sum("n").alias("planes"), F.count("*").alias("groups"))


@query(f"""with {SENT.replace(MOSAIC, _planes_sql(True))}, place as (select *, cast(floor(floor((py + 0.5) / {SIDE}) / 2) as bigint) gj, cast(floor(floor((px + 0.5) / {SIDE}) / 2) as bigint) gi from sent),
power as (select gj, gi, img, sum(v * v) e from plane group by all)
select j_st, i_st, count(*) n, round(sum(e), 5) trace from place join power using (gj, gi, img) group by all""")
def spot_system_trace(read):
    """Inputs and trace of each stamp's matrix A: every input's spot against itself."""
    pixels, found = mosaic(read), planes(read)
    own = P.correlations(found, found.select(F.struct(*P.KEY).alias("a"), F.struct(*P.KEY).alias("b")))
    nought = F.element_at("lags", (2 * P.REACH + 1) * P.REACH + P.REACH + 1)
    sent = P.systems.near_stamps(P.with_group(pixels, SIDE), SIDE, RADIUS).join(own.select("a.*", nought.alias("e")), list(P.KEY))
    return sent.groupBy("j_st", "i_st").agg(F.count("*").alias("n"), F.round(F.sum("e"), 5).alias("trace"))


def _solved(kernel: str, kappas: list[float], read) -> DataFrame:
    out = P.solve_stamps(mosaic(read), planes(read), SIDE, RADIUS, kernel, kappas, most_leak=1e-3)
    return out.select("j_st", "i_st", "oy", "ox", "inputs", *[r6(c, c) for c in ("kappa", "sigma", "leakage", "value", "constant", "neff")])


@query()
def spots_cholesky(read):
    """Every stamp's system from its exposures' own spots, by Cholesky factors at three kappa nodes."""
    return _solved("Cholesky", [1e-3, 1e-2, 1e-1], read)


@query()
def spots_eigen(read):
    """The same by eigenvalues, kappa bisected for every output."""
    return _solved("Eigen", [1e-3, 1e-1], read)


@query()
def spots_iterative(read):
    """The same by conjugate gradients on the inputs near each output, at two kappa nodes."""
    return _solved("Iterative", [1e-2, 1e-1], read)
