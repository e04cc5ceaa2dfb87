"""Shear, distortion fits, detector maps, wavenumbers, spherical grids, array operations and further cuts."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import columns as C
from .registry import PIX, long, query, r6, stamp_pixels

SHEARS = """s as (select s_suppkey k, 0.3 * sin(s_suppkey) g1, 0.3 * cos(s_suppkey * 2) g2, 0.1 * cos(s_suppkey * 3) e1, 0.1 * sin(s_suppkey * 5) e2 from supplier)"""


def shears(read):
    k = F.col("s_suppkey")
    return read("supplier").select(k.alias("k"), (0.3 * F.sin(k)).alias("g1"), (0.3 * F.cos(k * 2)).alias("g2"), (0.1 * F.cos(k * 3)).alias("e1"), (0.1 * F.sin(k * 5)).alias("e2"))


@query(f"""with {SHEARS}, d as (select *, 1 + e1 * g1 + e2 * g2 re, e1 * g2 - e2 * g1 im from s), n as (select *, re * re + im * im den, sqrt(e1 * e1 + e2 * e2) e, sqrt(g1 * g1 + g2 * g2) g from d)
select k, round(((g1 + e1) * re + (g2 + e2) * im) / den, 6) f1, round(((g2 + e2) * re - (g1 + e1) * im) / den, 6) f2, round(sqrt((1 - e) / (1 + e) / ((1 - g) / (1 + g))), 6) radius,
round(cosh(e) + case when e = 0 then 0 else sinh(e) / e * e1 end, 6) xx, round(case when e = 0 then 0 else sinh(e) / e * e2 end, 6) xy, round(cosh(e) - case when e = 0 then 0 else sinh(e) / e * e1 end, 6) yy from n""")
def shear_compose(read):
    """Reduced shears added as complex numbers, the change of radius, and the matrix exponential of a traceless symmetric shear."""
    s = shears(read)
    re, im = F.expr("1 + e1 * g1 + e2 * g2"), F.expr("e1 * g2 - e2 * g1")
    den, e, g = re * re + im * im, F.hypot("e1", "e2"), F.hypot("g1", "g2")
    a, b = F.col("g1") + F.col("e1"), F.col("g2") + F.col("e2")
    along = F.when(e == 0, 0.0).otherwise(F.sinh(e) / e)
    out = {"f1": (a * re + b * im) / den, "f2": (b * re - a * im) / den, "radius": F.sqrt((1 - e) / (1 + e) / ((1 - g) / (1 + g)))}
    out |= {"xx": F.cosh(e) + along * F.col("e1"), "xy": along * F.col("e2"), "yy": F.cosh(e) - along * F.col("e1")}
    return s.select("k", *[r6(v, n) for n, v in out.items()])


RINGS = "k as (select i, j, sqrt(power((i - 8) / 16.0::double, 2) + power((j - 8) / 16.0::double, 2)) f, cast(floor(4 * sqrt((i - 8) ** 2 + (j - 8) ** 2) / sqrt(128)) as bigint) ring from range(16) a(i), range(16) b(j))"


@query(f"with {RINGS}, l as (select distinct label from embeddings) select label, ring, count(*) n, round(avg(f), 6) wavenumber from k, l where ring >= 1 group by all")
def ring_wavenumbers(read):
    """Mean wavenumber of each ring of a spectrum of 16 by 16 modes, for every label's spectrum."""
    mode = F.sequence(F.lit(0), F.lit(15))
    k = read("embeddings").select("label").distinct().withColumn("i", F.explode(mode)).withColumn("j", F.explode(mode))
    f = F.hypot((F.col("i") - 8) / 16.0, (F.col("j") - 8) / 16.0)
    ring = F.floor(4 * F.hypot(F.col("i") - 8, F.col("j") - 8) / math.sqrt(128)).cast("long")
    return k.withColumn("ring", ring).where("ring >= 1").groupBy("label", "ring").agg(F.count("*").alias("n"), r6(F.avg(f), "wavenumber"))


@query("""with l as (select p_partkey, case p_size % 4 when 0 then 'whitenoise1' when 1 then '1fnoise2' when 2 then 'labnoise' else 'truth' end as layer, p_size + 8.0::double as side from part)
select p_partkey, layer, round(case when layer like 'white%' or layer like '1f%' then power(side / 0.0390625, 2) when layer like 'lab%' then 139.8 * 5.5e4 * 25.37 * 0.0390625 ** 2 / 1e6 end, 4) norm from l""")
def power_norm(read):
    """Normalisation of a noise spectrum by the kind of its layer; other layers have none."""
    kind = F.col("p_size") % 4
    layer = F.when(kind == 0, "whitenoise1").when(kind == 1, "1fnoise2").when(kind == 2, "labnoise").otherwise("truth")
    p = read("part").select("p_partkey", layer.alias("layer"), (F.col("p_size") + 8.0).alias("side"))
    norm = F.when(F.col("layer").startswith("white") | F.col("layer").startswith("1f"), F.pow(F.col("side") / 0.0390625, F.lit(2))).when(F.col("layer").startswith("lab"), F.lit(139.8 * 5.5e4 * 25.37 * 0.0390625**2 / 1e6))
    return p.select("p_partkey", "layer", F.round(norm, 4).alias("norm"))


#: A distortion to be fitted on an image of 64 pixels: what a detector's own map adds to a straight one.
FIT = """p as (select o_orderkey // 256 as img, (o_orderkey * 7919 % 640) / 10.0::double - 32 u, (o_custkey * 104729 % 640) / 10.0::double - 32 v from orders),
d as (select *, 2e-3 * u * u - 1e-3 * u * v + 0.01 * u + (img % 5) * 1e-3 * v * v as du from p)"""


@query(f"""with {FIT}, g as (select img, count(*) n from d group by img) select img, n, 0.01::double as c_u, 0.0::double as c_v, 0.002::double as c_uu, -0.001::double as c_uv, round((img % 5) * 0.001::double, 6) as c_vv, 0.0::double as worst from g where n >= 12""")
def distortion_fit(read):
    """Quadratic distortion of every image by least squares: sums of products in one aggregation, a small solve an image, and the
    largest error of the fit. Images with fewer than twelve points are left out, as the fit needs."""
    import numpy as np
    import pandas as pd

    o = read("orders").select(F.expr("o_orderkey div 256").alias("img"), (F.col("o_orderkey") * 7919 % 640 / 10.0 - 32).alias("u"), (F.col("o_custkey") * 104729 % 640 / 10.0 - 32).alias("v"))
    d = o.withColumn("du", F.expr("2e-3D * u * u - 1e-3D * u * v + 0.01D * u + (img % 5) * 1e-3D * v * v"))
    basis = [F.lit(1.0), F.col("u") / 32, F.col("v") / 32, F.expr("u * u / 1024"), F.expr("u * v / 1024"), F.expr("v * v / 1024")]
    sums = [F.sum(a * b) for i, a in enumerate(basis) for b in basis[i:]] + [F.sum(a * F.col("du")) for a in basis]
    totals = d.groupBy("img").agg(F.count("*").alias("n"), F.array(*sums).alias("s")).where("n >= 12")
    upper = np.triu_indices(6)

    def solve(batches):
        for pdf in batches:
            rows = []
            for img, n, s in zip(pdf["img"], pdf["n"], pdf["s"], strict=True):
                m = np.zeros((6, 6))
                m[upper] = s[:21]
                m = m + np.triu(m, 1).T
                rows.append((img, n, (np.linalg.lstsq(m, np.asarray(s[21:]), rcond=None)[0] / [1, 32, 32, 1024, 1024, 1024]).tolist()))
            yield pd.DataFrame(rows, columns=["img", "n", "c"])

    fit = totals.mapInPandas(solve, "img long, n long, c array<double>")
    model = F.expr("c[0] + c[1] * u + c[2] * v + c[3] * u * u + c[4] * u * v + c[5] * v * v")
    worst = d.join(fit, "img").groupBy("img").agg(F.max(F.abs(F.col("du") - model)).alias("worst"))
    zero = lambda c: F.round(c, 5) + 0.0
    return fit.join(worst, "img").select("img", "n", *[zero(F.col("c")[i]).alias(f"c_{n}") for i, n in enumerate(("u", "v", "uu", "uv", "vv"), 1)], zero(F.col("worst")).alias("worst"))


TAN = """{x} as (select *, cos(d0) * sin(d) - sin(d0) * cos(d) * cos(a) yy, sin(d0) * sin(d) + cos(d0) * cos(d) * cos(a) zz, cos(d) * sin(a) xx from {p})"""


@query("""with c as (select c_custkey k, (c_custkey * 37 % 64)::double x, (c_custkey * 91 % 64)::double y, 0.002 * (c_custkey % 7) dra, 0.003 * (c_custkey % 5) ddec from customer),
w as (select *, 53.0 + (x - 31.5) * 1e-4 / cos(radians(-40.0)) ra, -40.0 + (y - 31.5) * 1e-4 de from c), r as (select *, (ra - 53.0 - dra) * cos(radians(-40.0)) / 1e-4 + 31.5 xr, (de + 40.0 - ddec) / 1e-4 + 31.5 yr from w)
select k, round(xr, 5) xr, round(yr, 5) yr, (xr > -2.5 and xr < 65.5 and yr > -2.5 and yr <= 65.5) as inside from r""")
def detector_map(read):
    """Pixels of one detector on another exposure's pixels by way of the sky, and whether they are inside it, with padding."""
    k = F.col("c_custkey")
    c = read("customer").select(k.alias("k"), (k * 37 % 64).cast("double").alias("x"), (k * 91 % 64).cast("double").alias("y"), (0.002 * (k % 7)).alias("dra"), (0.003 * (k % 5)).alias("ddec"))
    scale = F.cos(F.radians(F.lit(-40.0)))
    ra, de = 53.0 + (F.col("x") - 31.5) * 1e-4 / scale, -40.0 + (F.col("y") - 31.5) * 1e-4
    r = c.withColumn("xr", (ra - 53.0 - F.col("dra")) * scale / 1e-4 + 31.5).withColumn("yr", (de + 40.0 - F.col("ddec")) / 1e-4 + 31.5)
    inside = (F.col("xr") > -2.5) & (F.col("xr") < 65.5) & (F.col("yr") > -2.5) & (F.col("yr") <= 65.5)
    return r.select("k", F.round("xr", 5).alias("xr"), F.round("yr", 5).alias("yr"), inside.alias("inside"))


#: Equal-area rings of the sphere: nside; rings from the north, pixels of a ring, height of a ring.
NSIDE = 64
RING = f"""r as (select i as ring, case when i < {NSIDE} then 4 * i when i <= {3 * NSIDE} then {4 * NSIDE} else 4 * ({4 * NSIDE} - i) end many,
case when i < {NSIDE} then 2 * i * (i - 1) when i <= {3 * NSIDE} then {2 * NSIDE * (NSIDE - 1)} + {4 * NSIDE} * (i - {NSIDE}) else {12 * NSIDE**2} - 2 * ({4 * NSIDE} - i) * ({4 * NSIDE} - i + 1) end first,
case when i < {NSIDE} then 1 - i * i / {3 * NSIDE**2}.0::double when i <= {3 * NSIDE} then 4 / 3.0::double - 2 * i / {3 * NSIDE}.0::double else -1 + power({4 * NSIDE} - i, 2) / {3 * NSIDE**2}.0::double end z,
case when i < {NSIDE} or i > {3 * NSIDE} then 0.5 when (i - {NSIDE}) % 2 = 0 then 0.5 else 0 end shift from range(1, {4 * NSIDE}) t(i)),
px as (select first + j as ipix, z, (j + shift) * 2 * pi() / many phi from r, range({4 * NSIDE}) t(j) where j < many)"""
FIELDS = """f as (select s_suppkey k, radians((s_suppkey * 37 % 3600) / 10.0::double) ra, radians((s_suppkey * 91 % 1700) / 10.0::double - 85) dec from supplier)"""


def cap_pixels(read):
    """(k, ipix, z, phi): pixels of an equal-area ring grid within two degrees of each field. The rings that a field reaches are
    generated from its declination, and of each ring only the pixels near its right ascension, so the work follows the cap and
    not the sphere."""
    k, n = F.col("s_suppkey"), NSIDE
    f = read("supplier").select(k.alias("k"), F.radians(k * 37 % 3600 / 10.0).alias("ra"), F.radians(k * 91 % 1700 / 10.0 - 85).alias("dec"))
    reach = math.radians(2.0)

    def ring_at(z):
        """The ring at a height, not rounded."""
        cap = n * F.sqrt(3 * (1 - F.abs(z)))
        return F.when(F.abs(z) <= 2 / 3, (4 / 3 - z) * 1.5 * n).when(z > 0, cap).otherwise(4 * n - cap)

    high, low = F.least(F.col("dec") + reach, F.lit(math.pi / 2)), F.greatest(F.col("dec") - reach, F.lit(-math.pi / 2))
    rings = F.sequence(F.greatest(F.floor(ring_at(F.sin(high))) - 1, F.lit(1)), F.least(F.ceil(ring_at(F.sin(low))) + 1, F.lit(4 * n - 1)))
    i = F.col("i")
    polar, south = i < n, i > 3 * n
    up = 4 * n - i
    r = f.withColumn("i", F.explode(rings))
    r = r.withColumn("many", F.when(polar, 4 * i).when(south, 4 * up).otherwise(4 * n))
    r = r.withColumn("first", F.when(polar, 2 * i * (i - 1)).when(south, 12 * n * n - 2 * up * (up + 1)).otherwise(2 * n * (n - 1) + 4 * n * (i - n)))
    r = r.withColumn("z", F.when(polar, 1 - i * i / (3.0 * n * n)).when(south, -1 + up * up / (3.0 * n * n)).otherwise(4 / 3 - 2 * i / (3.0 * n)))
    r = r.withColumn("shift", F.when(polar | south | ((i - n) % 2 == 0), 0.5).otherwise(0.0))
    # half the width of the cap in right ascension at this height; all of the ring where the cap holds a pole
    cosine = (math.cos(reach) - F.col("z") * F.sin("dec")) / (F.sqrt(1 - F.col("z") * F.col("z")) * F.cos("dec"))
    half = F.when(cosine <= -1, math.pi).when(cosine > 1, -1.0).otherwise(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))
    step = 2 * math.pi / F.col("many")
    start, end = F.ceil((F.col("ra") - half) / step - F.col("shift")).cast("long") - 1, F.floor((F.col("ra") + half) / step - F.col("shift")).cast("long") + 1
    r = r.where(half >= 0).withColumn("j", F.explode(F.sequence(start, F.least(end, start + F.col("many") - 1))))
    p = r.withColumn("j", F.pmod("j", "many")).withColumn("phi", (F.col("j") + F.col("shift")) * step)
    mu = F.col("z") * F.sin("dec") + F.sqrt(1 - F.col("z") * F.col("z")) * F.cos("dec") * F.cos(F.col("ra") - F.col("phi"))
    return p.where(mu >= math.cos(reach)).select("k", long(F.col("first") + F.col("j"), "ipix"), "z", "phi")


@query(f"""with {RING}, {FIELDS}, m as (select k, ipix, z, phi, z * sin(dec) + sqrt(1 - z * z) * cos(dec) * cos(ra - phi) mu from f, px)
select k, cast(ipix as bigint) ipix, round(degrees(phi), 6) ra, round(degrees(asin(z)), 6) dec from m where mu >= cos(radians(2.0))""")
def sphere_grid(read):
    """Places of the grid's pixels near each field."""
    return cap_pixels(read).select("k", "ipix", r6(F.degrees("phi"), "ra"), r6(F.degrees(F.asin("z")), "dec"))


@query(f"""with {RING}, {FIELDS}, m as (select k, ipix, z, phi, ra, dec, z * sin(dec) + sqrt(1 - z * z) * cos(dec) * cos(ra - phi) mu from f, px), t as (select *, degrees(2 * cos(asin(z)) * sin(phi - ra) / (1 + mu)) x, degrees(2 * (cos(dec) * z - sin(dec) * cos(asin(z)) * cos(phi - ra)) / (1 + mu)) y from m where mu >= cos(radians(2.0)))
select k, cast(ipix as bigint) ipix, cast(round_even(x * 100, 0) as bigint) xi, cast(round_even(y * 100, 0) as bigint) yi, round(x * 100 - round_even(x * 100, 0), 4) dx, round(y * 100 - round_even(y * 100, 0), 4) dy from t where round_even(x * 100, 0) between -150 and 149 and round_even(y * 100, 0) between -150 and 149""")
def truth_table(read):
    """Truth positions of the grid's objects in each field's image: whole pixels, and what is left, inside a border."""
    g = cap_pixels(read).withColumn("ra", F.degrees("phi")).withColumn("dec", F.degrees(F.asin("z")))
    k = F.col("k")
    ra0, dec0 = k * 37 % 3600 / 10.0, k * 91 % 1700 / 10.0 - 85
    x, y = C.stereographic(F.col("ra"), F.col("dec"), ra0, dec0)
    t = g.withColumn("x", x * 100).withColumn("y", y * 100).withColumn("xi", F.rint("x")).withColumn("yi", F.rint("y")).where("xi between -150 and 149 and yi between -150 and 149")
    return t.select("k", "ipix", long("xi", "xi"), long("yi", "yi"), F.round(F.col("x") - F.col("xi"), 4).alias("dx"), F.round(F.col("y") - F.col("yi"), 4).alias("dy"))


@query(f"""with {PIX}, a as (select vec_id, y, x, v from pix) select vec_id, cast(x as bigint) y, cast(7 - y as bigint) x, round(v, 6) v from a where vec_id % 2 = 0 union all select vec_id, cast(y + 1 as bigint), cast(x + 1 as bigint), round(v, 6) from a where vec_id % 2 = 1""")
def array_moves(read):
    """Stamps turned by transposing and flipping, and stamps padded by one, inside their arrays; no shuffle."""
    e = read("embeddings")
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    turned = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.reverse(F.col("rows")), lambda r: F.element_at(r, i + 1)))
    even = e.where("vec_id % 2 = 0").withColumn("rows", rows).select("vec_id", F.posexplode(F.flatten(turned)).alias("pos", "v")).select("vec_id", F.expr("pos div 8").alias("y"), (F.col("pos") % 8).alias("x"), "v")
    odd = e.where("vec_id % 2 = 1").select("vec_id", F.posexplode("embedding").alias("pos", "v")).select("vec_id", (F.expr("pos div 8") + 1).alias("y"), (F.col("pos") % 8 + 1).alias("x"), "v")
    return even.union(odd).select("vec_id", long("y", "y"), long("x", "x"), r6("v", "v"))


@query("""select l_orderkey, cast(l_linenumber as bigint) l_linenumber, cast(l_suppkey - coalesce(lag(l_suppkey) over (partition by l_orderkey order by l_suppkey, l_linenumber), -1) - 1 as bigint) skip from lineitem""")
def draw_gaps(read):
    """How many draws lie between one place that is drawn and the next one of its image."""
    from pyspark.sql import Window

    before = F.lag("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_suppkey", "l_linenumber"))
    return read("lineitem").select("l_orderkey", long("l_linenumber", "l_linenumber"), long(F.col("l_suppkey") - F.coalesce(before, F.lit(-1)) - 1, "skip"))


@query("""with used as (select distinct l_suppkey from lineitem where l_quantity > 49 and l_discount > 0.05) select s_suppkey, s_suppkey in (select l_suppkey from used) relevant from supplier""")
def relevant_images(read):
    """Images that give any pixel stay, the others are dropped: a semi-join and an anti-join."""
    used = read("lineitem").where("l_quantity > 49 and l_discount > 0.05").select(F.col("l_suppkey").alias("s_suppkey"))
    s = read("supplier").select("s_suppkey")
    return s.join(used, "s_suppkey", "left_semi").withColumn("relevant", F.lit(True)).union(s.join(used, "s_suppkey", "left_anti").withColumn("relevant", F.lit(False)))


@query("""select l_orderkey, cast(l_linenumber as bigint) l_linenumber from lineitem where abs(l_discount - 0.05) < 0.03 and not (l_orderkey * 7 + l_linenumber) % 23 = 0""")
def noise_cut(read):
    """Pixels whose laboratory noise is under a threshold and that no cosmic ray hits."""
    hits = read("lineitem").where("(l_orderkey * 7 + l_linenumber) % 23 = 0").select("l_orderkey", "l_linenumber")
    kept = read("lineitem").where("abs(l_discount - 0.05D) < 0.03D").select("l_orderkey", "l_linenumber").join(hits, ["l_orderkey", "l_linenumber"], "left_anti")
    return kept.select("l_orderkey", long("l_linenumber", "l_linenumber"))


@query("""with c as (select l_returnflag f, l_quantity q, l_tax t from lineitem) select f, cast(cut as bigint) cut, count(*) n, round(avg(t), 6) mean from c, (values (40), (45), (50)) k(cut) where q >= cut group by all""")
def nested_cuts(read):
    """Cuts that each take what the one before has left, all counted in one pass."""
    c = read("lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_quantity").alias("q"), F.col("l_tax").alias("t"))
    passed = F.filter(F.array(*[F.lit(x).cast("long") for x in (40, 45, 50)]), lambda k: F.col("q") >= k)
    return c.withColumn("cut", F.explode(passed)).groupBy("f", "cut").agg(F.count("*").alias("n"), r6(F.avg("t"), "mean"))


@query(f"""with {PIX}, w as (select vec_id, pos, v, y, x, 0.5 * (1 - cos(pi() * (least(y, 7 - y) + 0.5) / 2)) wy, 0.5 * (1 - cos(pi() * (least(x, 7 - x) + 0.5) / 2)) wx from pix),
t as (select vec_id, y, x, v * case when least(y, 7 - y) < 2 then wy else 1 end * case when least(x, 7 - x) < 2 then wx else 1 end v from w),
k as (select vec_id, ky, kx, sum(v * cos(2 * pi() * (ky * y + kx * x) / 8)) re, sum(v * sin(2 * pi() * (ky * y + kx * x) / 8)) im from t, range(8) a(ky), range(5) b(kx) group by all),
n as (select avg(power(case when d < 2 then 0.5 * (1 - cos(pi() * (d + 0.5) / 2)) else 1 end, 2)) m from (select least(i, 7 - i) d from range(8) r(i)))
select label, cast(ky as bigint) ky, cast(kx as bigint) kx, round(avg((re * re + im * im) / 64 / (m * m)), 4) power from k join embeddings using (vec_id), n group by all""")
def windowed_power(read):
    """Mean power spectrum by label under a window with cosine edges, renormalised; stamps are transformed batch by batch and summed
    in the task, so what is shuffled is one row a label, mode and batch."""
    import numpy as np
    import pandas as pd

    depth = np.minimum(np.arange(8), np.arange(8)[::-1])
    side = np.where(depth < 2, 0.5 * (1 - np.cos(np.pi * (depth + 0.5) / 2)), 1.0)
    window, norm = np.outer(side, side), (side**2).mean() ** 2

    def run(batches):
        from ..operators.interpolate import cubes

        for pdf in batches:
            power = np.abs(np.fft.rfft2(cubes(pdf["embedding"], 8, 0) * window)) ** 2 / 64 / norm
            for label, rows in pdf.groupby("label").indices.items():
                ky, kx = np.indices((8, 5))
                yield pd.DataFrame({"label": label, "ky": ky.ravel(), "kx": kx.ravel(), "total": power[rows].sum(axis=0).ravel(), "n": len(rows)})

    sums = read("embeddings").select("label", "embedding").mapInPandas(run, "label int, ky long, kx long, total double, n long")
    return sums.groupBy("label", "ky", "kx").agg(F.round(F.sum("total") / F.sum("n"), 4).alias("power"))
