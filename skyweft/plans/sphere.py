"""Sky geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import copies
from .registry import long, query, r6

SKY = "sky as (select c_custkey as obsid, c_nationkey as filter, 53.0 + (c_custkey * 37 % 4000) / 1000.0::double - 2 as ra, -40.0 + (c_custkey * 91 % 4000) / 1000.0::double - 2 as dec, (c_custkey * 17 % 360)::double as pa from customer)"
DETECTORS = "det as (select * from (values " + ", ".join(f"({i + 1}, {x}::double, {y}::double)" for i, (x, y) in enumerate(C.DETECTOR_SKY)) + ") t(sca, xs, ys))"
PLANE = "fp as (select * from (values " + ", ".join(f"({i + 1}, {x}::double, {y}::double, {1 if i % 3 == 2 else -1})" for i, (x, y) in enumerate(C.DETECTOR_PLANE)) + ") t(sca, xf, yf, o))"


def sky(read):
    k = F.col("c_custkey")
    return read("customer").select(k.alias("obsid"), F.col("c_nationkey").alias("filter"), (53.0 + k * 37 % 4000 / 1000.0 - 2).alias("ra"), (-40.0 + k * 91 % 4000 / 1000.0 - 2).alias("dec"), (k * 17 % 360).cast("double").alias("pa"))


def detectors():
    """The 18 detector centres as an array to explode: no join is needed."""
    return F.array(*[F.struct(F.lit(i + 1).alias("sca"), F.lit(x).alias("xs"), F.lit(y).alias("ys")) for i, (x, y) in enumerate(C.DETECTOR_SKY)])


@query(f"""with {SKY}, {DETECTORS}, u as (select *, radians(ra) r, radians(dec) d, radians(pa) p, cos(radians(-40.0)) * cos(radians(53.0)) vx, cos(radians(-40.0)) * sin(radians(53.0)) vy, sin(radians(-40.0)) vz from sky where filter % 5 = 1),
w as (select *, vx * cos(d) * cos(r) + vy * cos(d) * sin(r) + vz * sin(d) front, vz * cos(d) - vx * sin(d) * cos(r) - vy * sin(d) * sin(r) north, vy * cos(r) - vx * sin(r) east from u),
f as (select *, degrees(sin(p) * north - cos(p) * east) fx, degrees(cos(p) * north + sin(p) * east) fy from w where front > 0)
select obsid, cast(sca as bigint) sca from f, det where sqrt((fx - xs) ** 2 + (fy - ys) ** 2) < 0.3""")
def obs_cone_search(read):
    """Exposure and detector pairs that see the block; the filter is applied at the scan."""
    x, y, front = C.field_position(F.lit(53.0), F.lit(-40.0), F.col("ra"), F.col("dec"), F.col("pa"))
    seen = sky(read).where("filter % 5 = 1").where(front).withColumn("fx", x).withColumn("fy", y).withColumn("det", F.explode(detectors()))
    return seen.where(F.sqrt(F.pow(F.col("fx") - F.col("det.xs"), 2) + F.pow(F.col("fy") - F.col("det.ys"), 2)) < 0.3).select("obsid", long("det.sca", "sca"))


@query(f"with {SKY} select obsid, round(ra, 6) ra, round(dec, 6) dec from sky")
def stg_roundtrip(read):
    """Sky to stereographic plane and back."""
    s = sky(read)
    x, y = C.stereographic(F.col("ra"), F.col("dec"), F.lit(53.0), F.lit(-40.0))
    s = s.withColumn("px", x).withColumn("py", y)
    ra, dec = C.stereographic_inverse(F.col("px"), F.col("py"), F.lit(53.0), F.lit(-40.0))
    return s.select("obsid", r6(ra, "ra"), r6(dec, "dec"))


@query(f"""with {SKY}, p as (select obsid, radians(ra - 53.0) a, radians(dec) d, radians(-40.0) d0 from sky), q as (select *, 2 / (1 + sin(d0) * sin(d) + cos(d0) * cos(d) * cos(a)) k from p)
select obsid, round(degrees(k * cos(d) * sin(a)), 6) x, round(degrees(k * (cos(d0) * sin(d) - sin(d0) * cos(d) * cos(a))), 6) y from q""")
def stg_project(read):
    x, y = C.stereographic(F.col("ra"), F.col("dec"), F.lit(53.0), F.lit(-40.0))
    return sky(read).select("obsid", r6(x, "x"), r6(y, "y"))


@query("""with p as (select c_custkey, (c_custkey % 100)::double x, (c_custkey % 37)::double y from customer)
select c_custkey, round(1 + 2e-5 * x, 6) jxx, round(-1e-5 * y, 6) jxy, round(1e-5 * y, 6) jyx, round(1 + 1e-5 * x, 6) jyy from p""")
def local_jacobian(read):
    """Four-point derivatives (steps 1 and 3) of a distortion; exact for its quadratic terms."""
    p = read("customer").select("c_custkey", (F.col("c_custkey") % 100).cast("double").alias("x"), (F.col("c_custkey") % 37).cast("double").alias("y"))

    def u(x, y):
        return x + 1e-5 * x * x - 5e-6 * y * y

    def v(x, y):
        return y + 1e-5 * x * y

    def slope(f, dx, dy):
        at = lambda h: f(F.col("x") + h * dx, F.col("y") + h * dy)
        return 27 / 48 * (at(1) - at(-1)) - 1 / 48 * (at(3) - at(-3))

    return p.select("c_custkey", r6(slope(u, 1, 0), "jxx"), r6(slope(u, 0, 1), "jxy"), r6(slope(v, 1, 0), "jyx"), r6(slope(v, 0, 1), "jyy"))


@query(f"""with {PLANE}, l as (select l_orderkey, l_linenumber, cast(l_partkey % 18 + 1 as int) sca, l_quantity * 80 px, l_discount * 40000 py from lineitem)
select l_orderkey, cast(l_linenumber as bigint) l_linenumber, round(xf + 0.01 * (px - 2043.5) * o, 6) x, round(yf + 0.01 * (py - 2043.5) * o, 6) y from l join fp on l.sca = fp.sca""")
def sca_focal_plane(read):
    """Detector pixels on the focal plane; the 18 detectors are a literal array."""
    table = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(1 if i % 3 == 2 else -1).alias("o")) for i, (x, y) in enumerate(C.DETECTOR_PLANE)])
    line = read("lineitem").withColumn("d", F.element_at(table, (F.col("l_partkey") % 18 + 1).cast("int")))
    x = F.col("d.x") + 0.01 * (F.col("l_quantity") * 80 - 2043.5) * F.col("d.o")
    y = F.col("d.y") + 0.01 * (F.col("l_discount") * 40000 - 2043.5) * F.col("d.o")
    return line.select("l_orderkey", long("l_linenumber", "l_linenumber"), r6(x, "x"), r6(y, "y"))


@query("""select l_orderkey, cast(l_linenumber as bigint) l_linenumber, case when l_partkey % 3 = 0 then 4087 - cast(l_quantity as bigint) else cast(l_quantity as bigint) end x, case when l_partkey % 3 = 0 then cast(l_suppkey as bigint) else 4087 - l_suppkey end y from lineitem""")
def orientation_flip(read):
    flip = F.col("l_partkey") % 3 == 0
    q = F.col("l_quantity").cast("long")
    return read("lineitem").select("l_orderkey", long("l_linenumber", "l_linenumber"), F.when(flip, 4087 - q).otherwise(q).alias("x"), F.when(flip, F.col("l_suppkey")).otherwise(4087 - F.col("l_suppkey")).alias("y"))


CAPS = """c as (select c_custkey id, radians((c_custkey * 37 % 3600) / 10.0::double) ra, radians((c_custkey * 91 % 1700) / 10.0::double - 85) dec, 1 - cos(radians(0.5 + c_custkey % 4)) p from customer),
v as (select id, p, cos(dec) * cos(ra) x, cos(dec) * sin(ra) y, sin(dec) z from c)"""


@query(f"""with {CAPS} select a.id id_a, b.id id_b, round(2 * ((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) / 2, 6) chord2 from v a join v b on a.id < b.id
and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 < 2 * (a.p + b.p - a.p * b.p + sqrt(a.p * b.p * (2 - a.p) * (2 - b.p)))""")
def sphere_overlap(read):
    """Pairs of overlapping caps: unit vectors meet by cells no smaller than two of the largest caps' reach, equal caps as one."""
    k = F.col("c_custkey")
    ra, dec = F.radians(k * 37 % 3600 / 10.0), F.radians(k * 91 % 1700 / 10.0 - 85)
    caps = read("customer").select(k.alias("id"), (1 - F.cos(F.radians(0.5 + k % 4))).alias("p"), (F.cos(dec) * F.cos(ra)).alias("x"), (F.cos(dec) * F.sin(ra)).alias("y"), F.sin(dec).alias("z"))
    v = copies.kinds(caps)
    cell = 0.125
    cells = [F.floor(F.col(c) / cell).alias(f"c{c}") for c in "xyz"]
    home = v.select("*", *cells)
    around = F.sequence(F.lit(-1), F.lit(1))
    sent = home
    for c in "xyz":
        sent = sent.withColumn(f"d{c}", F.explode(around)).withColumn(f"c{c}", F.col(f"c{c}") + F.col(f"d{c}"))
    sent = sent.select("cx", "cy", "cz", *[F.col(c).alias(f"{c}_b") for c in ("ids", "p", "x", "y", "z")])
    chord = F.expr("(x - x_b) * (x - x_b) + (y - y_b) * (y - y_b) + (z - z_b) * (z - z_b)")
    pairs = home.join(sent.hint("merge"), ["cx", "cy", "cz"]).where(copies.some_rise("ids", "ids_b")).withColumn("chord2", chord)
    met = pairs.where("chord2 < 2 * (p + p_b - p * p_b + sqrt(p * p_b * (2 - p) * (2 - p_b)))").select("ids", "ids_b", r6("chord2", "chord2"))
    return copies.members(met, "ids", "ids_b", "chord2")


@query("""with o as (select o_orderkey, (o_custkey % 400) / 10.0::double x, (o_orderkey % 300) / 10.0::double y from orders)
select o_orderkey, cast(i as bigint) ix, cast(j as bigint) iy from o, range(40) a(i), range(30) b(j) where sqrt((x - i) ** 2 + (y - j) ** 2) <= 1.2""")
def sca_block_candidates(read):
    """Blocks within reach of each detector: the few around it are generated, no join."""
    o = read("orders").select("o_orderkey", (F.col("o_custkey") % 400 / 10.0).alias("x"), (F.col("o_orderkey") % 300 / 10.0).alias("y"))
    near = lambda c: F.sequence(F.ceil(F.col(c) - 1.2).cast("int"), F.floor(F.col(c) + 1.2).cast("int"))
    out = o.withColumn("i", F.explode(near("x"))).withColumn("j", F.explode(near("y"))).where("i between 0 and 39 and j between 0 and 29")
    return out.where(F.sqrt(F.pow(F.col("x") - F.col("i"), 2) + F.pow(F.col("y") - F.col("j"), 2)) <= 1.2).select("o_orderkey", long("i", "ix"), long("j", "iy"))
