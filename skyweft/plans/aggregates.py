"""Aggregates, profiles, spectra and catalogues."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import coadd as O
from ..operators import fourier
from ..operators.quantiles import quantiles
from .registry import PIX, long, query, r6, stamp_pixels


@query(f"""with {PIX}, r as (select *, sqrt((x - 3.5) ** 2 + (y - 3.5) ** 2) rad from pix), b as (select label, cast(floor(4 * rad / sqrt(24.5)) as bigint) ring, v from r)
select label, ring, count(*) n, round(avg(v), 6) mean, round(stddev_pop(v), 6) std, round(stddev_pop(v) / sqrt(count(*)), 6) err from b where ring >= 1 group by label, ring""")
def ring_average(read):
    pix = stamp_pixels(read)
    radius = F.sqrt(F.pow(F.col("x") - 3.5, 2) + F.pow(F.col("y") - 3.5, 2))
    out = O.ring_average(pix, ["label"], radius, F.col("v"), 4, math.sqrt(24.5))
    return out.select("label", long("ring", "ring"), "n", r6("mean", "mean"), r6("std", "std"), r6("err", "err"))


@query(f"with {PIX} select vec_id, cast(y // 4 as bigint) y, cast(x // 4 as bigint) x, round(avg(v), 6) v from pix group by all")
def rebin(read):
    return stamp_pixels(read).groupBy("vec_id", long(F.floor(F.col("y") / 4), "y"), long(F.floor(F.col("x") / 4), "x")).agg(r6(F.avg("v"), "v"))


@query("""with g as (select i as bin from range(100) t(i)), h as (select cast(floor(sqrt(l_discount + l_tax) / 0.005) as bigint) bin, count(*) n from lineitem group by 1), o as (select 100.0 * count(*) filter (where sqrt(l_discount + l_tax) >= 0.4) / count(*) pct from lineitem)
select cast(g.bin as bigint) bin, coalesce(n, 0) n, round(pct, 6) overflow from g left join h on g.bin = h.bin, o""")
def hist_overflow(read):
    """Fixed-width histogram with empty bins, and the share beyond a limit."""
    root = F.sqrt(F.col("l_discount") + F.col("l_tax"))
    line = read("lineitem").groupBy(F.floor(root / 0.005).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.sum((root >= 0.4).cast("long")).alias("over"))
    share = line.agg((100.0 * F.sum("over") / F.sum("n")).alias("pct"))
    bins = line.sparkSession.range(100).withColumnRenamed("id", "bin")
    return bins.join(line, "bin", "left").join(F.broadcast(share)).select("bin", F.coalesce("n", F.lit(0)).alias("n"), r6("pct", "overflow"))


@query("""with h as (select cast(floor(o_totalprice / 10000) as bigint) bin, count(*) n from orders group by 1)
select bin, n, round(sum(n) over (order by bin) / sum(n) over (), 6) fraction from h where bin between 0 and 80""")
def hist_cumulative(read):
    """Histogram and cumulative fraction; the window sees one row a bin, at most 81."""
    h = read("orders").where("floor(o_totalprice / 10000) between 0 and 80").groupBy(F.floor(F.col("o_totalprice") / 10000).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1)).orderBy("bin")
    return h.select("bin", "n", r6(F.sum("n").over(w) / F.sum("n").over(Window.partitionBy(F.lit(1))), "fraction"))


RADIAL = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


@query(f"""with {PIX} select cast(floor(sqrt((x - 3.5) ** 2 + (y - 3.5) ** 2)) as bigint) r, {', '.join(f'round(quantile_cont(v, {q}), 6) {n}' for n, q in RADIAL.items())} from pix group by 1""")
def radial_percentiles(read):
    """Seven percentiles by whole radius; the groups are few, so values are binned before they are ranked."""
    r = F.floor(F.sqrt(F.pow(F.col("x") - 3.5, 2) + F.pow(F.col("y") - 3.5, 2)))
    p = quantiles(stamp_pixels(read).select(long(r, "r"), "v"), "r", "v", RADIAL)
    return p.select("r", *[r6(n, n) for n in RADIAL])


MAP = {"p50": 0.5, "p90": 0.9, "p98": 0.98, "p99": 0.99}


@query(f"select l_returnflag, {', '.join(f'round(quantile_cont(sqrt(l_tax), {q}), 6) {n}' for n, q in MAP.items())} from lineitem group by 1")
def map_percentiles(read):
    p = quantiles(read("lineitem").select("l_returnflag", F.sqrt("l_tax").alias("v")), "l_returnflag", "v", MAP)
    return p.select("l_returnflag", *[r6(n, n) for n in MAP])


@query("""with m as (select min(o_totalprice) - 1e-12 lo, max(o_totalprice) + 1e-12 hi from orders), b as (select least(cast(floor(5 * (o_totalprice - lo) / (hi - lo)) as bigint), 4) bin, o_totalprice v from orders, m)
select bin, count(*) n, round(avg(v), 4) mean from b group by bin""")
def coverage_bins(read):
    """Equal-width bins between the extremes."""
    orders = read("orders")
    ends = orders.agg((F.min("o_totalprice") - 1e-12).alias("lo"), (F.max("o_totalprice") + 1e-12).alias("hi"))
    b = orders.join(F.broadcast(ends)).select(F.least(F.floor(5 * (F.col("o_totalprice") - F.col("lo")) / (F.col("hi") - F.col("lo"))), F.lit(4)).cast("long").alias("bin"), "o_totalprice")
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


MOMENTS = f"""{PIX}, w as (select vec_id, label, greatest(v, 0.0) * exp(-((x - 3.5) ** 2 + (y - 3.5) ** 2) / 8.0) w, x - 3.5 dx, y - 3.5 dy from pix),
m as (select vec_id, label, sum(w) s, sum(w * (dx * dx - dy * dy)) / sum(w) / 4.0 e1, sum(w * 2 * dx * dy) / sum(w) / 4.0 e2, sum(w * (dx * dx + dy * dy)) / sum(w) size from w group by all having sum(w) > 0)"""


def moments(read):
    dx, dy = F.col("x") - 3.5, F.col("y") - 3.5
    p = stamp_pixels(read).withColumn("w", F.greatest("v", F.lit(0.0)) * F.exp(-(dx * dx + dy * dy) / 8.0))
    w = F.col("w")
    sums = p.groupBy("vec_id", "label").agg(F.sum("w").alias("s"), F.sum(w * (dx * dx - dy * dy)).alias("a"), F.sum(w * 2 * dx * dy).alias("b"), F.sum(w * (dx * dx + dy * dy)).alias("c")).where("s > 0")
    return sums.select("vec_id", "label", "s", F.expr("a / s / 4.0").alias("e1"), F.expr("b / s / 4.0").alias("e2"), F.expr("c / s").alias("size"))


@query(f"with {MOMENTS} select vec_id, round(s, 6) s, round(e1, 6) e1, round(e2, 6) e2, round(size, 6) size from m")
def moments_forced(read):
    return moments(read).select("vec_id", r6("s", "s"), r6("e1", "e1"), r6("e2", "e2"), r6("size", "size"))


@query(f"with {MOMENTS} select label, count(*) n, round(sqrt(avg(e1 * e1 + e2 * e2)), 6) rms, round(median(size), 6) median_size, round(avg(s), 6) mean, round(stddev_pop(s) / sqrt(count(*)), 6) err from m group by label")
def star_summary(read):
    m = moments(read)
    sums = m.groupBy("label").agg(F.count("*").alias("n"), r6(F.sqrt(F.avg(F.expr("e1 * e1 + e2 * e2"))), "rms"), r6(F.avg("s"), "mean"), r6(F.stddev_pop("s") / F.sqrt(F.count("*")), "err"))
    middle = quantiles(m.select("label", "size"), "label", "size", {"median_size": 0.5})
    return sums.join(middle, "label").select("label", "n", "rms", r6("median_size", "median_size"), "mean", "err")


@query(f"""with {MOMENTS}, b as (select vec_id % 40 as block, avg(size) size, avg(e1) g1, avg(e2) g2, 100.0 * count(*) filter (where s <= 1) / count(*) bare from m group by 1)
select cast(block as bigint) block, round(size, 6) size, round(sqrt(g1 * g1 + g2 * g2), 6) ellipticity, round(bare, 6) bare from b""")
def block_star_stats(read):
    b = moments(read).groupBy(long(F.col("vec_id") % 40, "block")).agg(F.avg("size").alias("size"), F.avg("e1").alias("g1"), F.avg("e2").alias("g2"), (100.0 * F.sum((F.col("s") <= 1).cast("int")) / F.count("*")).alias("bare"))
    return b.select("block", r6("size", "size"), r6(F.expr("sqrt(g1 * g1 + g2 * g2)"), "ellipticity"), r6("bare", "bare"))


@query(f"with {PIX} select vec_id, round(min(v), 6) least, round(max(v), 6) most, bool_or(v > 2.0) any_high from pix group by vec_id")
def map_extrema(read):
    return stamp_pixels(read).groupBy("vec_id").agg(r6(F.min("v"), "least"), r6(F.max("v"), "most"), F.bool_or(F.col("v") > 2.0).alias("any_high"))


@query(f"""with {PIX}, t as (select vec_id, label, ky, kx, sum(v * cos(2 * pi() * (ky * y + kx * x) / 8)) re, sum(v * sin(2 * pi() * (ky * y + kx * x) / 8)) im from pix, range(8) a(ky), range(8) b(kx) group by all)
select label, cast(ky as bigint) ky, cast(kx as bigint) kx, round(avg((re * re + im * im) / 64), 4) power from t group by all""")
def dft_power(read):
    """Mean power spectrum by label: stamps are transformed batch by batch and summed by label before anything is shuffled."""
    out = fourier.power_by(read("embeddings"), "label", "embedding", 8)
    return out.groupBy("label", "ky", "kx").agg(F.round(F.sum("total") / F.sum("n") / 64, 4).alias("power"))


@query(f"with {PIX} select label, round(avg(v * v) / 0.0121, 6) variance from pix group by label")
def layer_variance(read):
    return stamp_pixels(read).groupBy("label").agg(r6(F.avg(F.col("v") * F.col("v")) / 0.0121, "variance"))


@query("""with s as (select s_suppkey as id, (s_suppkey * 37) % 1000 / 10.0::double x, (s_suppkey * 91) % 997 / 10.0::double y, (s_suppkey % 10) / 50.0::double g1, (s_suppkey % 7) / 50.0::double g2 from supplier),
p as (select sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) sep, a.g1 * b.g1 + a.g2 * b.g2 xi from s a join s b on a.id < b.id)
select cast(floor(10 * ln(sep / 0.5) / ln(20.0)) as bigint) bin, count(*) n, round(sum(xi), 6) xi, round(avg(sep), 6) sep from p where sep >= 0.5 and sep < 10 group by 1""")
def two_point_pairs(read):
    k = F.col("s_suppkey")
    s = read("supplier").select(k.alias("id"), (k * 37 % 1000 / 10.0).alias("x"), (k * 91 % 997 / 10.0).alias("y"), (k % 10 / 50.0).alias("g1"), (k % 7 / 50.0).alias("g2"))
    out = O.pairs_by_separation(s, 5.0, 0.5, 10.0, 10)
    return out.select(long("bin", "bin"), "n", r6("xi", "xi"), r6("sep", "sep"))
