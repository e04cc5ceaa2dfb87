"""Coordinate maps with their inverses, fits with residual maps, and codes along a raster of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distortion as D
from ..operators import rasters
from .codes import Q, quantised
from .registry import long, query, r6

SKY = """c as (select c_custkey k, (c_custkey * 7919 % 4088)::double + 0.25 x, (c_custkey * 104729 % 4088)::double + 0.5 y, c_nationkey n from customer),
d as (select *, x - 2043.5 u, y - 2043.5 v, 1e-6::double * (1 + n % 3) a20, -7e-7::double * (n % 5) a11, 2e-10::double * (n % 4) a03, 5e-7::double * (n % 7) b02, 4e-7::double b11, -3e-10::double b30,
  40 + 0.3::double * n ra0, -60 + 4.5::double * n dec0 from c),
w as (select *, u + a20 * u * u + a11 * u * v + a03 * v * v * v wu, v + b02 * v * v + b11 * u * v + b30 * u * u * u wv from d),
t as (select *, radians(-3e-5::double * wu + 1e-6::double * wv) tx, radians(2e-6::double * wu + 3.1e-5::double * wv) ty, radians(dec0) d0 from w)"""


@query(f"""with {SKY} select k, round(ra0 + degrees(atan2(tx, cos(d0) - ty * sin(d0))), 8) ra,
round(degrees(asin((sin(d0) + ty * cos(d0)) / sqrt(1 + tx * tx + ty * ty))), 8) "dec", round(x, 6) x, round(y, 6) y, true near from t""")
def sky_round_trip(read):
    """Pixels to the sky by a cubic distortion and the tangent plane, and back by Newton's steps; off by less than 1e-6 pixel."""
    c = read("customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") * 7919 % 4088 + 0.25).alias("x"), (F.col("c_custkey") * 104729 % 4088 + 0.5).alias("y"), F.col("c_nationkey").alias("n"))
    n = F.col("n")
    a = {(2, 0): 1e-6 * (1 + n % 3), (1, 1): -7e-7 * (n % 5), (0, 3): 2e-10 * (n % 4)}
    b = {(0, 2): 5e-7 * (n % 7), (1, 1): F.lit(4e-7), (3, 0): F.lit(-3e-10)}
    cd, ra0, dec0 = tuple(map(F.lit, (-3e-5, 1e-6, 2e-6, 3.1e-5))), 40 + 0.3 * n, -60 + 4.5 * n
    there = c.withColumn("w", D.distorted(a, b, F.col("x") - 2043.5, F.col("y") - 2043.5)).withColumn("sky", D.to_sky(F.col("w.u"), F.col("w.v"), cd, ra0, dec0))
    back = there.withColumn("t", D.from_sky(F.col("sky.ra"), F.col("sky.dec"), cd, ra0, dec0)).withColumn("p", D.restored(a, b, F.col("t.u"), F.col("t.v")))
    x, y = F.col("p.u") + 2043.5, F.col("p.v") + 2043.5
    near = (F.abs(x - F.col("x")) < 1e-6) & (F.abs(y - F.col("y")) < 1e-6)
    return back.select("k", F.round("sky.ra", 8).alias("ra"), F.round("sky.dec", 8).alias("dec"), r6(x, "x"), r6(y, "y"), near.alias("near"))


#: Nodes of a residual map: places -32 to 32 in steps of 4, and one more on every edge.
NODES, STEP, EDGE = 17, 4, 32
BASIS = ("1", "u", "v", "u * u", "u * v", "v * v")
TRUTH = "2e-3D * u * u - 1e-3D * u * v + 0.01D * u + (img % 5) * 1e-4D * u * u * u"
POINTS = """p as (select o_orderkey // 256 as img, o_orderkey k, (o_orderkey * 7919 % 720) / 10.0::double - 36 u, (o_custkey * 104729 % 720) / 10.0::double - 36 v from orders)"""


def residual_maps(images: DataFrame) -> DataFrame:
    """images(img) -> (img, c array<double>, map array<double>): a quadratic fit of the distortion at the nodes, and what it leaves
    there, padded. The sums of products are one aggregation; the solve is an image's own."""
    import numpy as np
    import pandas as pd

    every = F.sequence(F.lit(0), F.lit(NODES - 1))
    nodes = images.select("img", F.explode(every).alias("j")).select("img", "j", F.explode(every).alias("i"))
    nodes = nodes.select("img", "j", "i", (F.col("i") * STEP - EDGE).cast("double").alias("u"), (F.col("j") * STEP - EDGE).cast("double").alias("v")).withColumn("du", F.expr(TRUTH))
    basis = [F.expr(f"{b} / {EDGE ** (len(b) // 4 + (b != '1'))}D") for b in BASIS]
    sums = [F.sum(p * q) for k, p in enumerate(basis) for q in basis[k:]] + [F.sum(p * F.col("du")) for p in basis]
    raw = F.transform(F.sort_array(F.collect_list(F.struct("j", "i", "du"))), lambda x: x["du"])  # NODES squared rows an image
    totals = nodes.groupBy("img").agg(F.array(*sums).alias("s"), raw.alias("du"))
    upper = np.triu_indices(len(BASIS))
    v, u = (g.ravel() * float(STEP) - EDGE for g in np.mgrid[:NODES, :NODES])
    at_nodes = np.stack([np.ones_like(u), u, v, u * u, u * v, v * v])

    def solve(batches):
        for pdf in batches:
            found = []
            for s in pdf["s"]:
                m = np.zeros((len(BASIS), len(BASIS)))
                m[upper] = s[: len(upper[0])]
                m = m + np.triu(m, 1).T
                found.append(np.linalg.solve(m, np.asarray(s[len(upper[0]) :])) / [EDGE ** (len(b) // 4 + (b != "1")) for b in BASIS])
            left = [du - c @ at_nodes for du, c in zip(pdf["du"], found, strict=True)]
            yield pd.DataFrame({"img": pdf["img"], "c": [c.tolist() for c in found], "left": left})

    # what is left at the nodes goes along with the fit: a join of both by image would broadcast all nodes
    left = totals.mapInPandas(solve, "img long, c array<double>, left array<double>")
    return left.select("img", "c", D.padded(F.col("left"), NODES).alias("map"))


@query(f"""with {POINTS}, g as (select sum(pow({STEP} * i - {EDGE}, 4)) / sum(pow({STEP} * i - {EDGE}, 2)) k from range({NODES}) t(i)),
q as (select p.*, (img % 5) * 1e-4::double c3, g.k as slope, least(greatest(floor((u + {EDGE}) / {STEP}), -1), {NODES - 1}) cell from p, g),
e as (select *, {STEP} * cell - {EDGE} lo, {STEP} * (cell + 1) - {EDGE} hi from q),
r as (select *, case when cell = -1 then 2 * c3 * (pow(-{EDGE}, 3) + slope * {EDGE}) - c3 * (pow({STEP - EDGE}, 3) - slope * {STEP - EDGE}) else c3 * (pow(lo, 3) - slope * lo) end rl,
  case when cell = {NODES - 1} then 2 * c3 * (pow({EDGE}, 3) - slope * {EDGE}) - c3 * (pow({EDGE - STEP}, 3) - slope * {EDGE - STEP}) else c3 * (pow(hi, 3) - slope * hi) end rh from e)
select k, round(2e-3 * u * u - 1e-3 * u * v + (0.01 + c3 * slope) * u, 6) fitted, round(rl + (rh - rl) * (u - lo) / {STEP}, 6) residual, abs(u) > {EDGE} as beyond from r""")
def distortion_residuals(read):
    """A cubic distortion by a quadratic fit and a map of what it leaves, looked up between nodes and beyond the edge."""
    p = read("orders").select(F.expr("o_orderkey div 256").alias("img"), F.col("o_orderkey").alias("k"), (F.col("o_orderkey") * 7919 % 720 / 10.0 - 36).alias("u"), (F.col("o_custkey") * 104729 % 720 / 10.0 - 36).alias("v"))
    found = p.join(residual_maps(p.select("img").distinct()).hint("merge"), "img")  # as many maps as images: never broadcast
    fitted = F.expr("c[0] + c[1] * u + c[2] * v + c[3] * u * u + c[4] * u * v + c[5] * v * v")
    place = lambda c: (F.col(c) + EDGE) / STEP + 1
    residual = D.bilinear(F.col("map"), NODES + 2, place("v"), place("u"))
    nought = lambda x: F.round(x, 6) + 0.0
    return found.select("k", nought(fitted).alias("fitted"), nought(residual).alias("residual"), (F.abs("u") > EDGE).alias("beyond"))


#: One raster of all stamps, a row each; blocks of so many rows.
ROWS = 256


def raster(read) -> DataFrame:
    return quantised(read).select(F.lit(0).alias("raster"), F.expr(f"vec_id div {ROWS}").alias("block"), F.col("vec_id").alias("row"), long("pos", "pos"), "code")


LAGGED = "(code - lag(code, 1, 0) over (order by vec_id, pos)) % 4096"


@query(f"with {Q} select vec_id as row, cast(pos as bigint) pos, cast(({LAGGED} + 4096) % 4096 as bigint) diff from q")
def raster_diff(read):
    """Differences along one raster that all stamps make, without a window over it."""
    return rasters.differences(raster(read), ["raster"], ["block", "row", "pos"], "code", 12).select("row", "pos", long("diff", "diff"))


@query(f"with {Q} select vec_id as row, cast(pos as bigint) pos, code from q")
def raster_undiff(read):
    """Differences along the raster and their running sums give the codes back."""
    found = rasters.differences(raster(read), ["raster"], ["block", "row", "pos"], "code", 12).drop("code")
    return rasters.running_sums(found, ["raster"], ["block", "row", "pos"], "diff", 12).select("row", "pos", long("code", "code"))
