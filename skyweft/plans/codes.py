"""Log codes, integer compression, units, scalar profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import coadd as O
from .registry import PIX, long, query, r6, stamp_pixels

CODE = "cast(least(greatest(floor({c} * log10(greatest({v}, 1e-32)) + 0.5), {lo}), {hi}) as bigint)"
CODES = f"""c as (select l_orderkey, l_linenumber, {CODE.format(c=-5000, v="l_discount", lo=0, hi=65535)} fidelity, {CODE.format(c=-10000, v="l_tax", lo=-32768, hi=32767)} sigma,
{CODE.format(c=200000, v="1 + l_discount", lo=-32768, hi=32767)} inwtsum, {CODE.format(c=50000, v="l_quantity", lo=0, hi=65535)} effcover from lineitem)"""


def coded(read):
    line = read("lineitem")
    return line.select("l_orderkey", long("l_linenumber", "l_linenumber"), long(C.log_code(F.col("l_discount"), "FIDELITY"), "fidelity"), long(C.log_code(F.col("l_tax"), "SIGMA"), "sigma"), long(C.log_code(1 + F.col("l_discount"), "INWTSUM"), "inwtsum"), long(C.log_code(F.col("l_quantity"), "EFFCOVER"), "effcover"))


@query(f"with {CODES} select l_orderkey, cast(l_linenumber as bigint) l_linenumber, fidelity, sigma, inwtsum, effcover from c")
def log_quantise(read):
    return coded(read)


@query(f"""with {CODES} select l_orderkey, cast(l_linenumber as bigint) l_linenumber, round(case when fidelity = 65535 then 0 else 10 ** (fidelity / -5000.0::double) end, 6) fidelity,
round(case when sigma = 32767 then 0 else 10 ** (sigma / -10000.0::double) end, 6) sigma, round(case when effcover = 0 then 0 else 10 ** (effcover / 50000.0::double) end, 6) effcover from c""")
def log_decode(read):
    c = coded(read)
    return c.select("l_orderkey", "l_linenumber", *[r6(C.log_decode(F.col(n), n.upper()), n) for n in ("fidelity", "sigma", "effcover")])


@query("""with u as (select p_partkey, case p_size % 5 when 0 then p_size || 'B' when 1 then (p_size / 10.0) || 'mB' when 2 then p_size || 'uB' when 3 then '-' || p_size || 'nB' else 'x' || p_brand end unit from part),
m as (select *, regexp_extract(unit, '^([0-9.\\-+eE]+)([mun]?)B', 1) a, regexp_extract(unit, '^([0-9.\\-+eE]+)([mun]?)B', 2) b from u)
select p_partkey, round(try_cast(a as double) * case b when 'm' then 1e-3 when 'u' then 1e-6 when 'n' then 1e-9 else 1.0 end * 1e6, 6) microbels from m""")
def unit_to_bels(read):
    n = F.col("p_size")
    unit = F.when(n % 5 == 0, F.concat(n.cast("string"), F.lit("B"))).when(n % 5 == 1, F.concat((n / 10.0).cast("string"), F.lit("mB"))).when(n % 5 == 2, F.concat(n.cast("string"), F.lit("uB")))
    unit = unit.when(n % 5 == 3, F.concat(F.lit("-"), n.cast("string"), F.lit("nB"))).otherwise(F.concat(F.lit("x"), "p_brand"))
    return read("part").select("p_partkey", r6(C.bels(unit) * 1e6, "microbels"))


Q = f"{PIX}, q as (select *, cast(least(greatest(floor(4096 * (least(greatest(v, -0.25), 0.25) + 0.25) / 0.5), 0), 4095) as bigint) as code from pix)"


def quantised(read):
    return stamp_pixels(read).withColumn("code", C.quantise(F.col("v"), -0.25, 0.25, 12))


@query(f"with {Q} select vec_id, cast(pos as bigint) pos, code from q")
def i24_quantise(read):
    return quantised(read).select("vec_id", long("pos", "pos"), "code")


@query(f"with {Q} select vec_id, cast(y as bigint) y, cast(x as bigint) x, round(v, 6) v from q where v < -0.25 or v > 0.25")
def i24_overflow(read):
    return stamp_pixels(read).where("v < -0.25 or v > 0.25").select("vec_id", long("y", "y"), long("x", "x"), r6("v", "v"))


@query(f"with {Q} select vec_id, cast(pos as bigint) pos, ((code - lag(code, 1, 0) over (partition by vec_id order by pos)) % 4096 + 4096) % 4096 diff from q")
def i24_diff(read):
    return O.conjugated_difference(quantised(read), ["vec_id"], "pos", "code", 12).select("vec_id", long("pos", "pos"), "diff")


@query(f"with {Q} select vec_id, cast(pos as bigint) pos, code from q")
def i24_undiff(read):
    """Difference and running sum give the codes back."""
    d = O.conjugated_difference(quantised(read), ["vec_id"], "pos", "code", 12)
    return O.running_sum(d.drop("code"), ["vec_id"], "pos", "diff", 12).select("vec_id", long("pos", "pos"), "code")


@query(f"""with {Q}, d as (select vec_id, pos, ((code - lag(code, 1, 0) over (partition by vec_id order by pos)) % 4096 + 4096) % 4096 diff from q)
select vec_id, cast(pos as bigint) pos, case when diff >= 2048 then 2 * (4096 - diff) - 1 else 2 * diff end zig from d""")
def i24_zigzag(read):
    d = O.conjugated_difference(quantised(read), ["vec_id"], "pos", "code", 12)
    return d.select("vec_id", long("pos", "pos"), long(C.zigzag(F.col("diff"), 12), "zig"))


@query(f"with {Q} select vec_id, count(*) n, round(max(case when v between -0.25 and 0.25 then abs(-0.25 + 0.5 * (code + 0.5) / 4096 - v) else 0 end), 6) error from q group by vec_id")
def i24_roundtrip(read):
    """Error of each stamp after decoding, with what overflowed put back from its own table."""
    q = quantised(read).select("vec_id", "pos", "v", C.dequantise(F.col("code"), -0.25, 0.25, 12).alias("back"))
    over = stamp_pixels(read).where("v < -0.25 or v > 0.25").select("vec_id", "pos", F.col("v").alias("kept"))
    whole = q.join(over, ["vec_id", "pos"], "left").withColumn("back", F.coalesce("kept", "back"))
    return whole.groupBy("vec_id").agg(F.count("*").alias("n"), r6(F.max(F.abs(F.col("back") - F.col("v"))), "error"))


@query(f"with {Q} select vec_id, cast(b as bigint) plane, cast(pos // 8 as bigint) byte, cast(sum(((code >> b) & 1) << (pos % 8)) as bigint) value from q, range(12) t(b) group by all")
def bitplane(read):
    """Bit planes of the codes, lowest bit first, packed to bytes: pixels are packed before anything is shuffled."""
    q = quantised(read).withColumn("plane", F.explode(F.sequence(F.lit(0), F.lit(11))))
    bit = F.expr("shiftleft(shiftright(code, plane) & 1, pos % 8)")
    return q.groupBy("vec_id", long("plane", "plane"), long(F.floor(F.col("pos") / 8), "byte")).agg(long(F.sum(bit), "value"))


@query(f"""with {PIX}, l as (select *, (x - 3.5) / 4 u, (y - 3.5) / 4 w from pix)
select vec_id, round(sum(v), 6) c00, round(sum(v * u), 6) c10, round(sum(v * w), 6) c01, round(sum(v * u * w), 6) c11, round(sum(v * (1.5 * u * u - 0.5)), 6) c20 from l group by vec_id""")
def legendre_eval(read):
    """Legendre coefficients of each stamp, one pass over its array."""
    p = stamp_pixels(read).withColumn("u", (F.col("x") - 3.5) / 4).withColumn("w", (F.col("y") - 3.5) / 4)
    u, w = C.legendre(F.col("u"), 2), C.legendre(F.col("w"), 1)
    terms = {"c00": u[0] * w[0], "c10": u[1] * w[0], "c01": u[0] * w[1], "c11": u[1] * w[1], "c20": u[2] * w[0]}
    return p.groupBy("vec_id").agg(*[r6(F.sum(F.col("v") * t), n) for n, t in terms.items()])


@query(f"""with {PIX} select vec_id, round(sum(v * exp(-0.5 * ((x - 3.5) ** 2 / 2.25 + (y - 3.5) ** 2 / 4.0)) / (2 * pi() * 3.0)), 6) matched from pix group by vec_id""")
def psf_gaussian(read):
    """Each stamp against a Gaussian profile."""
    return stamp_pixels(read).groupBy("vec_id").agg(r6(F.sum(F.col("v") * C.gaussian(F.col("x") - 3.5, F.col("y") - 3.5, 1.5, 2.0)), "matched"))


@query("""with b as (select o_orderkey, (o_totalprice % 4000) / 1000 - 2 as x from orders)
select o_orderkey, round(case when x >= 1 then 1.0 when x <= -1 then 0.0 else 0.5 * (x + 1) + (0.5 * sin(pi() * x) + 0.02 * sin(2 * pi() * x)) / (0.92 * pi()) end, 6) w from b""")
def blackman_window(read):
    x = (F.col("o_totalprice") % 4000) / 1000 - 2
    return read("orders").select("o_orderkey", r6(C.blackman_step(x), "w"))


@query("select o_orderkey, cast(least(greatest(round_even(255 * (asinh(o_totalprice / 1000) - asinh(-8.0)) / (asinh(600.0) - asinh(-8.0)), 0), 0), 255) as bigint) grey from orders")
def asinh_stretch(read):
    low, high = F.asinh(F.lit(-8.0)), F.asinh(F.lit(600.0))
    grey = F.rint(255 * (F.asinh(F.col("o_totalprice") / 1000) - low) / (high - low))
    return read("orders").select("o_orderkey", long(F.least(F.greatest(grey, F.lit(0.0)), F.lit(255.0)), "grey"))


@query("""with s as (select s_suppkey, (s_acctbal % 10) / 25 g1, (s_suppkey % 10) / 40.0::double g2, ((s_suppkey * 37) % 360)::double pa from supplier)
select s_suppkey, round(g1 * cos(2 * radians(pa)) + g2 * sin(2 * radians(pa)), 6) e1, round(g2 * cos(2 * radians(pa)) - g1 * sin(2 * radians(pa)), 6) e2 from s""")
def ellipticity_rotate(read):
    """Spin-2 rotation by a position angle."""
    s = read("supplier").select("s_suppkey", ((F.col("s_acctbal") % 10) / 25).alias("g1"), ((F.col("s_suppkey") % 10) / 40.0).alias("g2"), (F.col("s_suppkey") * 37 % 360).cast("double").alias("pa"))
    c, n = F.cos(2 * F.radians("pa")), F.sin(2 * F.radians("pa"))
    return s.select("s_suppkey", r6(F.col("g1") * c + F.col("g2") * n, "e1"), r6(F.col("g2") * c - F.col("g1") * n, "e2"))


@query("""with s as (select s_suppkey, 1 + (s_suppkey % 7) / 50.0::double a, (s_suppkey % 5) / 60.0::double b, (s_suppkey % 3) / 70.0::double c, 1 + (s_suppkey % 11) / 80.0::double d from supplier)
select s_suppkey, round(a * d - b * c, 6) det, round(sqrt((a + d) ** 2 + (c - b) ** 2) / 2, 6) mean_scale, round(sqrt((a - d) ** 2 + (b + c) ** 2) / 2, 6) shear, round(atan2(c - b, a + d), 6) rotation from s""")
def shear_svd(read):
    """Scale, shear and rotation of 2 x 2 matrices."""
    k = F.col("s_suppkey")
    s = read("supplier").select("s_suppkey", (1 + k % 7 / 50.0).alias("a"), (k % 5 / 60.0).alias("b"), (k % 3 / 70.0).alias("c"), (1 + k % 11 / 80.0).alias("d"))
    return s.select("s_suppkey", r6(F.expr("a * d - b * c"), "det"), r6(F.expr("sqrt((a + d) * (a + d) + (c - b) * (c - b)) / 2"), "mean_scale"), r6(F.expr("sqrt((a - d) * (a - d) + (b + c) * (b + c)) / 2"), "shear"), r6(F.expr("atan2(c - b, a + d)"), "rotation"))
