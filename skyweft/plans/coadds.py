"""Stamps, weights, coaddition, fading, solvers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import coadd as O
from ..operators import kernels as K
from ..operators import moments as S
from ..operators.interpolate import cubes
from ..operators.systems import gaussian_system
from .registry import PIX, long, query, r6, stamp_pixels

SIDE, EXTENT, RADIUS = 8, 40, 3.0
DITHER = f"""{PIX},
p as (select vec_id as img, x + (vec_id % 7) / 7.0::double + 8 * (vec_id % 5) as px, y + (vec_id % 11) / 11.0::double + 8 * ((vec_id // 5) % 5) as py, v from pix),
near as (select oy, ox, img, v, 3.0 - sqrt((px - ox) ** 2 + (py - oy) ** 2) as w from p, range(40) a(oy), range(40) b(ox)
  where abs(px - ox) < 3 and abs(py - oy) < 3 and sqrt((px - ox) ** 2 + (py - oy) ** 2) < 3.0),
t as (select *, w / sum(w) over (partition by oy, ox) as t from near)"""


def dithered(read) -> DataFrame:
    pix = stamp_pixels(read)
    px = F.col("x") + (F.col("vec_id") % 7) / F.lit(7.0) + 8 * (F.col("vec_id") % 5)
    py = F.col("y") + (F.col("vec_id") % 11) / F.lit(11.0) + 8 * (F.floor(F.col("vec_id") / 5) % 5)
    return pix.select(F.col("vec_id").alias("img"), px.cast("double").alias("px"), py.cast("double").alias("py"), "v")


def weights(read) -> DataFrame:
    """Sums by output pixel and image, weights not normalised."""
    return O.by_image(O.empirical_weights(dithered(read), SIDE, EXTENT, RADIUS))


@query(f"with {DITHER} select cast(oy as bigint) oy, cast(ox as bigint) ox, round(sum(t * v), 6) science, round(sum(t * v * v), 6) squared, round(sum(t), 6) constant from t group by oy, ox")
def coadd_empirical(read):
    return O.coadd(weights(read)).select(long("oy", "oy"), long("ox", "ox"), r6("science", "science"), r6("squared", "squared"), r6("constant", "constant"))


@query(f"""with {DITHER}, w as (select oy, ox, img, sum(t) w, sum(t * t) tt from t group by all)
select cast(oy as bigint) oy, cast(ox as bigint) ox, round(power(sum(abs(w)), 2) / sum(w * w), 6) neff, round(sum(tt), 6) sigma from w group by oy, ox""")
def weight_neff(read):
    return O.coadd(weights(read)).select(long("oy", "oy"), long("ox", "ox"), r6("neff", "neff"), r6("sigma", "sigma"))


@query(f"""with {DITHER} select img, cast(floor((oy + 8.5) / 8) as bigint) j_st, cast(floor((ox + 8.5) / 8) as bigint) i_st, round(sum(t) / 64, 6) weight from t group by all""")
def image_weights(read):
    w = O.normalised(weights(read)).groupBy("img", O.stamp_of(F.col("oy"), SIDE).alias("j_st"), O.stamp_of(F.col("ox"), SIDE).alias("i_st")).agg(F.sum("t").alias("s"))
    return w.select("img", long("j_st", "j_st"), long("i_st", "i_st"), r6(F.col("s") / SIDE**2, "weight"))


@query(f"""with {DITHER}, s as (select img, cast(floor((oy + 8.5) / 8) as int) j, cast(floor((ox + 8.5) / 8) as int) i, sum(t) w from t group by all),
c as (select j, i, count(*) filter (w <> 0) n from s group by j, i) select round(avg(n), 6) mean_coverage, count(*) stamps, max(n) most from c""")
def coverage_mean(read):
    w = O.normalised(weights(read)).groupBy("img", O.stamp_of(F.col("oy"), SIDE).alias("j"), O.stamp_of(F.col("ox"), SIDE).alias("i")).agg(F.sum("t").alias("w"))
    n = w.groupBy("j", "i").agg(F.sum((F.col("w") != 0).cast("long")).alias("n"))
    return n.agg(r6(F.avg("n"), "mean_coverage"), F.count("*").alias("stamps"), F.max("n").alias("most"))


@query(f"""with {DITHER} select cast(oy as bigint) oy, cast(ox as bigint) ox, arg_min(img, struct_pack(d := round(3.0 - w, 9), i := img)) nearest, round(3.0 - max(w), 6) distance from t group by oy, ox""")
def nearest_input(read):
    """Nearest input of every output pixel: inputs meet outputs in cells of four pixels."""
    pix = dithered(read)
    grid = pix.sparkSession.range(EXTENT * EXTENT).select((F.col("id") / EXTENT).cast("int").alias("oy"), (F.col("id") % EXTENT).cast("int").alias("ox"))
    cell = F.floor((F.col("py") + 0.5) / 4).cast("int"), F.floor((F.col("px") + 0.5) / 4).cast("int")
    around = F.sequence(F.lit(-1), F.lit(1))
    sent = pix.withColumn("cy", cell[0]).withColumn("cx", cell[1]).withColumn("a", F.explode(around)).withColumn("b", F.explode(around))
    sent = sent.select((F.col("cy") + F.col("a")).alias("cy"), (F.col("cx") + F.col("b")).alias("cx"), "img", "px", "py")
    grid = grid.withColumn("cy", F.floor((F.col("oy") + 0.5) / 4).cast("int")).withColumn("cx", F.floor((F.col("ox") + 0.5) / 4).cast("int"))
    d = F.sqrt(F.pow(F.col("px") - F.col("ox"), 2) + F.pow(F.col("py") - F.col("oy"), 2))
    near = grid.join(sent, ["cy", "cx"]).withColumn("d", d).where("d < 3.0")
    return near.groupBy("oy", "ox").agg(F.min(F.struct(F.round("d", 9).alias("d"), "img")).alias("m"), F.min("d").alias("least")).select(long("oy", "oy"), long("ox", "ox"), F.col("m.img").alias("nearest"), r6("least", "distance"))


POINTS = "pt as (select l_orderkey, l_linenumber as img, l_quantity + l_linenumber / 8.0::double as x, l_extendedprice / 1600.0 as y from lineitem)"
STAMPED = f"{POINTS}, st as (select *, cast(floor((y + 8.5) / 8) as bigint) j_st, cast(floor((x + 8.5) / 8) as bigint) i_st from pt where x > -8.5 and x < 47.5 and y > -8.5 and y < 47.5)"


def points(read) -> DataFrame:
    line = read("lineitem").select("l_orderkey", F.col("l_linenumber").alias("img"), (F.col("l_quantity") + F.col("l_linenumber") / 8.0).alias("x"), (F.col("l_extendedprice") / 1600.0).alias("y"))
    return O.stamps(line, "x", "y", SIDE, 5).withColumn("j_st", F.col("j_st").cast("long")).withColumn("i_st", F.col("i_st").cast("long"))


@query(f"with {STAMPED} select l_orderkey, cast(img as bigint) img, j_st, i_st from st")
def stamp_assign(read):
    return points(read).select("l_orderkey", long("img", "img"), "j_st", "i_st")


@query(f"with {STAMPED} select j_st, i_st, cast(img as bigint) img, count(*) n from st group by all")
def stamp_counts(read):
    return points(read).groupBy("j_st", "i_st", "img").agg(F.count("*").alias("n")).withColumn("img", F.col("img").cast("long"))


@query(f"""with {STAMPED}, c as (select j_st, i_st, cast(img as bigint) img, count(*) n from st group by all)
select *, cast(coalesce(sum(n) over (partition by j_st, i_st order by img rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from c""")
def stamp_offsets(read):
    counts = points(read).groupBy("j_st", "i_st", "img").agg(F.count("*").alias("n"))
    return O.offsets(counts, ["j_st", "i_st"], "img", "n").withColumn("img", F.col("img").cast("long"))


@query(f"with {STAMPED} select j_st, i_st, cast(img as bigint) img, l_orderkey, row_number() over (partition by j_st, i_st, img order by l_orderkey, x, y) - 1 slot from st")
def stamp_slots(read):
    window = Window.partitionBy("j_st", "i_st", "img").orderBy("l_orderkey", "x", "y")
    return points(read).select("j_st", "i_st", long("img", "img"), "l_orderkey", (F.row_number().over(window) - 1).cast("long").alias("slot"))


FADE = "case when {d} > 4 then 1.0 else {d} / 5.0 - sin(2 * pi() * {d} / 5.0) / (2 * pi()) end"
FADED = f"{PIX}, f as (select *, ({FADE.format(d='(y + 1)')}) * ({FADE.format(d='(8 - y)')}) * ({FADE.format(d='(x + 1)')}) * ({FADE.format(d='(8 - x)')}) as w from pix)"


def faded(read) -> DataFrame:
    return stamp_pixels(read).withColumn("w", C.fade(F.col("y"), 4, 2) * C.fade(F.col("x"), 4, 2))


@query(f"with {FADED} select vec_id, cast(y as bigint) y, cast(x as bigint) x, round(v * w, 6) faded, round(v * ({FADE.format(d='(8 - y)')}) * ({FADE.format(d='(8 - x)')}), 6) recovered from f")
def fade_trapezoid(read):
    """Fading from all sides, and its recovery at the bottom and left sides by division, as at the edge of a block."""
    f = faded(read).withColumn("faded", F.col("v") * F.col("w"))
    sides = C.fade_side(F.col("y"), 2) * C.fade_side(F.col("x"), 2)
    return f.select("vec_id", long("y", "y"), long("x", "x"), r6("faded", "faded"), r6(F.col("faded") / sides, "recovered"))


@query(f"""with {FADED} select cast(y + 4 * ((vec_id // 16) % 16) as bigint) y, cast(x + 4 * (vec_id % 16) as bigint) x, round(sum(v * w), 6) total, round(sum(w), 6) weight from f group by all""")
def fade_overlap_add(read):
    """Stamps of 8 pixels on a step of 4, added where they overlap."""
    f = faded(read).withColumn("oy", F.col("y") + 4 * (F.floor(F.col("vec_id") / 16) % 16)).withColumn("ox", F.col("x") + 4 * (F.col("vec_id") % 16))
    return f.groupBy("oy", "ox").agg(F.sum(F.col("v") * F.col("w")).alias("t"), F.sum("w").alias("s")).select(long("oy", "y"), long("ox", "x"), r6("t", "total"), r6("s", "weight"))


@query("""select vec_id, cast(i as bigint) pos_a, cast(i + 8 * dy + dx as bigint) pos_b, round(exp(-(dy * dy + dx * dx) / 9.0), 6) overlap
from embeddings, range(64) t(i), (values (0, 1), (1, -1), (1, 0), (1, 1)) d(dy, dx) where i // 8 + dy <= 7 and i % 8 + dx between 0 and 7""")
def pair_matrix(read):
    """Unordered input pairs of a stamp within two pixels and their overlap: each input names its later neighbours, no join."""
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])
    pairs = stamp_pixels(read).select("vec_id", "pos", "y", "x", F.explode(steps).alias("d")).where("y + d.dy <= 7 and x + d.dx between 0 and 7")
    square = F.expr("d.dy * d.dy + d.dx * d.dx")
    return pairs.select("vec_id", long("pos", "pos_a"), long(F.expr("pos + 8 * d.dy + d.dx"), "pos_b"), r6(F.exp(-square / 9.0), "overlap"))


@query(f"""with {PIX} select vec_id, label, cast(pos as bigint) pos, round(v, 6) v from pix where label = 1 and y >= 2 and y < 6 and x >= 2 and x < 6""")
def layer_crop(read):
    """One layer, cropped without resampling (the filter on the layer reaches the scan)."""
    pix = stamp_pixels(read).where((F.col("label") == 1) & (F.col("y") >= 2) & (F.col("y") < 6) & (F.col("x") >= 2) & (F.col("x") < 6))
    return pix.select("vec_id", "label", long("pos", "pos"), r6("v", "v"))


@query(f"""with {PIX}, p as (select vec_id, x, y, v from pix), w as (select p.vec_id, gx, gy, greatest(1 - abs(p.x - (gx + 0.25)), 0) * greatest(1 - abs(p.y - (gy + 0.5)), 0) w, v from p, range(7) a(gx), range(7) b(gy))
select vec_id, cast(gy as bigint) y, cast(gx as bigint) x, round(sum(w * v) / sum(w), 6) v from w where w > 0 group by vec_id, gy, gx""")
def affine_resample(read):
    """Taps of a small affine shift applied to every stamp: each output gathers its taps, weights normalised."""
    pix = stamp_pixels(read)
    taps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(w).alias("w")) for dy, dx, w in ((0, 0, 0.375), (0, 1, 0.125), (1, 0, 0.375), (1, 1, 0.125))])
    out = pix.withColumn("tap", F.explode(taps)).select("vec_id", (F.col("y") - F.col("tap.dy")).alias("gy"), (F.col("x") - F.col("tap.dx")).alias("gx"), F.col("tap.w").alias("w"), "v")
    out = out.where("gx between 0 and 6 and gy between 0 and 6").groupBy("vec_id", "gy", "gx").agg((F.sum(F.expr("w * v")) / F.sum("w")).alias("v"))
    return out.select("vec_id", long("gy", "y"), long("gx", "x"), r6("v", "v"))


@query()
def solve_kernels_check(read):
    """One system an order, of its few line items: noise and leakage by Cholesky factors, and how far the eigenvalue and
    conjugate-gradient kernels are from them. Systems of one size are solved together."""
    line = read("lineitem").select("l_orderkey", F.struct(((F.col("l_orderkey") * 13 + F.col("l_linenumber") * 5) % 800 / 100.0).alias("x"), ((F.col("l_partkey") * 31 + F.col("l_suppkey") * 3) % 800 / 100.0).alias("y")).alias("at"))
    orders = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("at")).alias("at"))
    outputs = np.array([[3.5, 3.5], [3.5, 4.5]])

    def run(batches):
        for pdf in batches:
            places = [np.array([(p["y"], p["x"]) for p in at]) for at in pdf["at"]]
            sizes = np.array([len(p) for p in places])
            for n in np.unique(sizes):
                some = np.flatnonzero(sizes == n)
                systems = [gaussian_system(outputs, places[i], 1.5, 1.8) for i in some]
                a, b, c = np.stack([s[0] for s in systems]), np.stack([s[1] for s in systems]), systems[0][2]
                one = K.cholesky(a, b, c, 1e-2)
                others = K.eigen(a, b, c, 1e-2), K.iterated(a, b, c, 1e-2, np.ones(b.shape, bool), 1e-12, 8 * int(n))
                apart = np.max([np.abs(o.t - one.t).max(axis=(1, 2)) for o in others], axis=0)
                yield pd.DataFrame({"l_orderkey": pdf["l_orderkey"].to_numpy()[some], "n": n, "sigma": one.sigma[:, 0], "leakage": one.leakage[:, 0], "apart": apart})

    out = orders.mapInPandas(run, "l_orderkey long, n long, sigma double, leakage double, apart double")
    return out.select("l_orderkey", "n", r6("sigma", "sigma"), r6("leakage", "leakage"), r6("apart", "apart"))


@query()
def adaptive_moments(read):
    """Adaptive Gaussian moments of every stamp, all stamps of a batch iterated together."""

    def run(batches):
        for pdf in batches:
            found = S.adaptive_moments(cubes(pdf["embedding"], 8, 0))
            yield pd.DataFrame({"vec_id": pdf["vec_id"], **found})

    return read("embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, sigma double, e1 double, e2 double, amplitude double, converged boolean")


@query()
def noise_white(read):
    """A white-noise frame of 64 pixels for every exposure, seeded by exposure and detector."""

    def run(batches):
        for pdf in batches:
            frames = [np.random.default_rng(1000000 * (18 * 1 + int(i) % 18) + int(i)).normal(size=64) for i in pdf["vec_id"]]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "mean": [float(f.mean()) for f in frames], "noise": [f.tolist() for f in frames]})

    return read("embeddings").select("vec_id").mapInPandas(run, "vec_id long, mean double, noise array<double>")
