"""Coaddition kernels: systems of two inputs against closed forms, and systems of stamps on a growing mosaic."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kernels as K
from ..operators import systems as S
from .registry import PIX, long, query, r6, stamp_pixels

KAPPA, TARGET_SELF, NEAR = 0.01, 1.25, 1.2
LOW, HIGH, LEAK, NOISE = 1e-3, 0.1, 0.3, 0.45
SYSTEMS = """s as (select l_orderkey, cast(l_linenumber as bigint) l_linenumber, exp(-power(0.3 + (l_partkey % 40) / 20.0::double, 2) / 4) o,
(l_suppkey % 30) / 20.0::double d1, l_linenumber / 4.0::double + 0.07 d2 from lineitem),
e as (select *, exp(-d1 * d1 / 5) b1, exp(-d2 * d2 / 5) b2 from s)"""


def systems(read) -> DataFrame:
    """A system of two inputs and one output for each line item: their overlap, and the output's with either."""
    line = read("lineitem").select("l_orderkey", long("l_linenumber", "l_linenumber"), F.exp(-F.pow(0.3 + F.col("l_partkey") % 40 / 20.0, 2) / 4).alias("o"), (F.col("l_suppkey") % 30 / 20.0).alias("d1"), (F.col("l_linenumber") / 4.0 + 0.07).alias("d2"))
    return line.select("*", F.exp(-F.col("d1") * F.col("d1") / 5).alias("b1"), F.exp(-F.col("d2") * F.col("d2") / 5).alias("b2"))


def solved(read, kernel: Callable[[np.ndarray, np.ndarray, np.ndarray], K.Solution]) -> DataFrame:
    """Every system by `kernel` (A, B, distances), whole batches at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a = np.ones((len(pdf), 2, 2))
            a[:, 0, 1] = a[:, 1, 0] = pdf["o"]
            b, d = pdf[["b1", "b2"]].to_numpy()[:, None, :], pdf[["d1", "d2"]].to_numpy()[:, None, :]
            found = kernel(a, b, d)
            yield pd.DataFrame({"l_orderkey": pdf["l_orderkey"], "l_linenumber": pdf["l_linenumber"], "t1": found.t[:, 0, 0], "t2": found.t[:, 0, 1], "kappa": found.kappa[:, 0], "sigma": found.sigma[:, 0], "leakage": found.leakage[:, 0]})

    out = systems(read).mapInPandas(run, "l_orderkey long, l_linenumber long, t1 double, t2 double, kappa double, sigma double, leakage double")
    return out.select("l_orderkey", "l_linenumber", *[r6(c, c) for c in ("t1", "t2", "kappa", "sigma", "leakage")])


K0 = KAPPA * TARGET_SELF
DIRECT = f"""with {SYSTEMS}, t as (select *, ((1 + {K0}) * b1 - o * b2) / ((1 + {K0}) ** 2 - o * o) t1, ((1 + {K0}) * b2 - o * b1) / ((1 + {K0}) ** 2 - o * o) t2 from e)
select l_orderkey, l_linenumber, round(t1, 6) t1, round(t2, 6) t2, round({K0}::double, 6) kappa, round(t1 * t1 + t2 * t2, 6) sigma, round(1 - ({K0} * (t1 * t1 + t2 * t2) + b1 * t1 + b2 * t2) / {TARGET_SELF}, 6) leakage from t"""


@query(DIRECT)
def kernel_cholesky(read):
    """Cholesky factor, one kappa."""
    return solved(read, lambda a, b, d: K.cholesky(a, b, TARGET_SELF, KAPPA))


@query(DIRECT)
def kernel_eigen(read):
    """Eigenvalues, one kappa."""
    return solved(read, lambda a, b, d: K.eigen(a, b, TARGET_SELF, KAPPA))


@query(f"""with {SYSTEMS}, n as (select *, d1 < {NEAR} n1, d2 < {NEAR} n2 from e),
t as (select *, case when n1 and n2 then ((1 + {K0}) * b1 - o * b2) / ((1 + {K0}) ** 2 - o * o) when n1 then b1 / (1 + {K0}) else 0 end t1,
case when n1 and n2 then ((1 + {K0}) * b2 - o * b1) / ((1 + {K0}) ** 2 - o * o) when n2 then b2 / (1 + {K0}) else 0 end t2 from n)
select l_orderkey, l_linenumber, round(t1, 6) t1, round(t2, 6) t2, round({K0}::double, 6) kappa, round(greatest(t1 * t1 + t2 * t2, 1e-32), 6) sigma, round(greatest(1 + (t1 * t1 + t2 * t2 + 2 * o * t1 * t2 - 2 * (b1 * t1 + b2 * t2)) / {TARGET_SELF}, 1e-32), 6) leakage from t""")
def kernel_iterative(read):
    """Conjugate gradients on the inputs within each output's radius, leakage by the full form."""
    return solved(read, lambda a, b, d: K.iterated(a, b, TARGET_SELF, KAPPA, d < NEAR, 1e-10, 10, True))


def _bisected() -> str:
    """Closed forms of the two eigenvalues 1 + o and 1 - o, thirteen steps written out."""
    at = "p0 * p0 / (v0 + k) ** 2 + p1 * p1 / (v1 + k) ** 2 sigma", f"1 - ((v0 + 2 * k) * p0 * p0 / (v0 + k) ** 2 + (v1 + 2 * k) * p1 * p1 / (v1 + k) ** 2) / {TARGET_SELF} leakage"
    parts = [SYSTEMS, f"k0 as (select *, 1 + o v0, 1 - o v1, (b1 + b2) / sqrt(2) p0, (b1 - b2) / sqrt(2) p1, {TARGET_SELF} * sqrt({LOW} * {HIGH}) k, sqrt({HIGH} / {LOW}) f from e)"]
    for i in range(13):
        parts.append(f"m{i} as (select *, {at[0]}, {at[1]} from k{i})")
        parts.append(f"k{i + 1} as (select * exclude (k, f, sigma, leakage), case when leakage > {LEAK} and sigma < {NOISE} then k / sqrt(f) else k * sqrt(f) end k, sqrt(f) f from m{i})")
    parts.append(f"z as (select *, {at[0]}, {at[1]} from k13)")
    return f"""with {', '.join(parts)} select l_orderkey, l_linenumber, round((p0 / (v0 + k) + p1 / (v1 + k)) / sqrt(2), 6) t1, round((p0 / (v0 + k) - p1 / (v1 + k)) / sqrt(2), 6) t2, round(k, 6) kappa, round(sigma, 6) sigma, round(leakage, 6) leakage from z"""


@query(_bisected())
def kernel_eigen_bisected(read):
    """Kappa of every output by bisection on leakage and noise."""
    return solved(read, lambda a, b, d: K.eigen_bisected(a, b, TARGET_SELF, LOW, HIGH, LEAK, NOISE))


def _nodes() -> str:
    """Two nodes: their solutions, overlaps and twelve steps of the two-by-two system between them."""
    of = lambda k: (f"((1 + {k}) * b1 - o * b2) / ((1 + {k}) ** 2 - o * o)", f"((1 + {k}) * b2 - o * b1) / ((1 + {k}) ** 2 - o * o)")
    (p1, p2), (q1, q2) = of(LOW * TARGET_SELF), of(HIGH * TARGET_SELF)
    c = TARGET_SELF
    parts = [SYSTEMS, f"t as (select *, {p1} p1, {p2} p2, {q1} q1, {q2} q2 from e)"]
    parts.append("n as (select *, b1 * p1 + b2 * p2 dp, b1 * q1 + b2 * q2 dq, p1 * p1 + p2 * p2 npp, p1 * q1 + p2 * q2 npq, q1 * q1 + q2 * q2 nqq from t)")
    parts.append(f"s as (select *, (dp - {LOW * c} * npp) / {c} epp, (dp - {HIGH * c} * npq) / {c} epq, (dq - {HIGH * c} * nqq) / {c} eqq, dp / {c} xp, dq / {c} xq from n)")
    parts[0] = parts[0].replace("s as (", "s0 as (").replace("from s)", "from s0)")
    parts.append(f"k0 as (select *, sqrt({LOW} * {HIGH}) k, power({HIGH} / {LOW}, 0.25) f from s)")
    for i in range(12):
        parts.append(f"a{i} as (select *, epp + k * npp app, epq + k * npq apq, eqq + k * nqq aqq from k{i})")
        parts.append(f"w{i} as (select *, (aqq * xp - apq * xq) / (app * aqq - apq * apq) wp, (app * xq - apq * xp) / (app * aqq - apq * apq) wq from a{i})")
        parts.append(f"g{i} as (select *, npp * wp * wp + 2 * npq * wp * wq + nqq * wq * wq sigma from w{i})")
        parts.append(f"u{i} as (select *, 1 - k * sigma - xp * wp - xq * wq leakage from g{i})")
        last = i == 11
        parts.append(f"k{i + 1} as (select * exclude (k, f, app, apq, aqq{'' if last else ', wp, wq, sigma, leakage'}), case when leakage > {LEAK} and sigma < {NOISE} then k / f else k * f end k, sqrt(f) f from u{i})")
    return f"with {', '.join(parts)} select l_orderkey, l_linenumber, round(wp * p1 + wq * q1, 6) t1, round(wp * p2 + wq * q2, 6) t2, round(k * {c}, 6) kappa, round(sigma, 6) sigma, round(leakage, 6) leakage from k12"


@query(_nodes())
def kernel_cholesky_nodes(read):
    """Two kappa nodes solved by Cholesky factors, then weights within their span."""
    return solved(read, lambda a, b, d: K.cholesky_nodes(a, b, TARGET_SELF, [LOW, HIGH], LEAK, NOISE))


SIDE, RADIUS, DEPTH, ACROSS = 4, 1.5, 4, 64
MOSAIC = f"""{PIX}, m as (select vec_id as img, 8 * ((vec_id // {DEPTH}) // {ACROSS}) + y + (vec_id % {DEPTH}) * 0.31::double py, 8 * ((vec_id // {DEPTH}) % {ACROSS}) + x + (vec_id % {DEPTH}) * 0.23::double px, v from pix)"""


def mosaic(read) -> DataFrame:
    """Stamps laid out four deep on a mosaic that grows with their number."""
    pix, block, dither = stamp_pixels(read), F.expr(f"vec_id div {DEPTH}"), F.col("vec_id") % DEPTH
    py = 8 * F.floor(block / ACROSS) + F.col("y") + dither * 0.31
    px = 8 * (block % ACROSS) + F.col("x") + dither * 0.23
    return pix.select(F.col("vec_id").alias("img"), py.cast("double").alias("py"), px.cast("double").alias("px"), "v")


SENT = f"""{MOSAIC}, h as (select *, cast(floor((py + 0.5) / {SIDE}) as bigint) j, cast(floor((px + 0.5) / {SIDE}) as bigint) i from m),
a as (select h.*, j + dj as j_st, i + di as i_st, case when dj > 0 then (j + 1) * {SIDE} - 0.5 - py when dj < 0 then py - j * {SIDE} + 0.5 else 0 end ey, case when di > 0 then (i + 1) * {SIDE} - 0.5 - px when di < 0 then px - i * {SIDE} + 0.5 else 0 end ex, dj, di
  from h, range(-1, 2) u(dj), range(-1, 2) w(di)),
sent as (select img, py, px, v, j_st, i_st from a where (dj = 0 and di = 0) or ey * ey + ex * ex < {RADIUS * RADIUS}),
mine as (select distinct j as j_st, i as i_st from h),
o as (select mine.*, j_st * {SIDE} + y as oy, i_st * {SIDE} + x as ox from mine, range({SIDE}) u(y), range({SIDE}) w(x))"""


@query(f"with {SENT} select j_st, i_st, count(*) n, count(distinct img) images, round(sum(v), 6) total from sent group by all")
def stamp_selection(read):
    """Inputs that a stamp may use: its own, and those around it within the radius of its nearest edge or corner."""
    sent = S.near_stamps(mosaic(read), SIDE, RADIUS).groupBy("j_st", "i_st", "img").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    return sent.groupBy("j_st", "i_st").agg(F.sum("n").alias("n"), F.count("*").alias("images"), r6(F.sum("total"), "total"))


@query(f"""with {SENT}, b as (select o.oy, o.ox, exp(-((py - oy) ** 2 + (px - ox) ** 2) / 4.88) / (4.88 * pi()) w from o join sent using (j_st, i_st) where (py - oy) ** 2 + (px - ox) ** 2 < {RADIUS * RADIUS})
select cast(oy as bigint) oy, cast(ox as bigint) ox, count(*) n, round(sum(w), 6) overlap, round(max(w), 6) most from b group by all""")
def io_overlaps(read):
    """Overlaps of outputs with the inputs within the radius."""
    sent = S.near_stamps(mosaic(read), SIDE, RADIUS)
    own = mosaic(read).select(F.floor((F.col("py") + 0.5) / SIDE).cast("long").alias("j_st"), F.floor((F.col("px") + 0.5) / SIDE).cast("long").alias("i_st")).distinct()
    step = F.sequence(F.lit(0), F.lit(SIDE - 1))
    out = own.withColumn("y", F.explode(step)).withColumn("x", F.explode(step)).select("j_st", "i_st", (F.col("j_st") * SIDE + F.col("y")).alias("oy"), (F.col("i_st") * SIDE + F.col("x")).alias("ox"))
    d = F.expr("(py - oy) * (py - oy) + (px - ox) * (px - ox)")
    near = out.join(sent, ["j_st", "i_st"]).withColumn("d", d).where(F.col("d") < RADIUS * RADIUS).withColumn("w", F.exp(-F.col("d") / 4.88) / (4.88 * np.pi))
    return near.groupBy("oy", "ox").agg(F.count("*").alias("n"), r6(F.sum("w"), "overlap"), r6(F.max("w"), "most"))


@query(f"""with {SENT}, p as (select a.j, a.i, b.j - a.j dj, b.i - a.i di, exp(-((a.py - b.py) ** 2 + (a.px - b.px) ** 2) / 4) w
from h a, range(3) u(dj), range(-2, 3) w(di), h b where (u.dj > 0 or w.di >= 0) and b.j = a.j + u.dj and b.i = a.i + w.di and (u.dj > 0 or w.di > 0 or (a.img, a.py, a.px) <= (b.img, b.py, b.px)))
select j, i, cast(dj as bigint) dj, cast(di as bigint) di, count(*) n, round(sum(w), 4) overlap from p group by all""")
def ii_overlaps(read):
    """Overlaps of inputs with each other, unordered, at the thirteen distances within five by five stamps."""
    return S.stamp_overlaps(mosaic(read), SIDE).select("j", "i", "dj", "di", "n", F.round("overlap", 4).alias("overlap"))


@query(f"""with {SENT}, near as (select oy, ox, img, v, {RADIUS} - sqrt((py - oy) ** 2 + (px - ox) ** 2) w from o join sent using (j_st, i_st)),
w as (select oy, ox, img, sum(greatest(w, 0)) w, sum(greatest(w, 0) * v) s, sum(greatest(w, 0) ** 2) ww from near group by all),
t as (select oy, ox, sum(w) w, sum(s) s, sum(ww) ww, sum(w * w) im from w group by all)
select cast(oy as bigint) oy, cast(ox as bigint) ox, coalesce(round(s / nullif(w, 0), 6), 0) as value, coalesce(round(w / nullif(w, 0), 6), 0) constant, coalesce(round(ww / nullif(w * w, 0), 6), 0) sigma, coalesce(round(w * w / nullif(im, 0), 6), 0) neff from t""")
def mosaic_empirical(read):
    """The empirical kernel stamp by stamp."""
    out = S.solve_stamps(mosaic(read), SIDE, RADIUS, "Empirical", [0.0])
    return out.select("oy", "ox", r6("value", "value"), r6("constant", "constant"), r6("sigma", "sigma"), r6("neff", "neff"))


def _mosaic(kernel: str, kappas: list[float], read) -> DataFrame:
    out = S.solve_stamps(mosaic(read), SIDE, RADIUS, kernel, kappas, most_leak=1e-3)
    return out.select("j_st", "i_st", "oy", "ox", "inputs", *[r6(c, c) for c in ("kappa", "sigma", "leakage", "value", "constant", "neff")])


@query()
def mosaic_cholesky(read):
    """Every stamp's system by Cholesky factors at three kappa nodes."""
    return _mosaic("Cholesky", [1e-4, 1e-3, 1e-2], read)


@query()
def mosaic_eigen(read):
    """Every stamp's system by eigenvalues, kappa bisected for every output."""
    return _mosaic("Eigen", [1e-4, 1e-2], read)


@query()
def mosaic_iterative(read):
    """Every stamp's system by conjugate gradients on the inputs near each output, at two kappa nodes."""
    return _mosaic("Iterative", [1e-3, 1e-2], read)
