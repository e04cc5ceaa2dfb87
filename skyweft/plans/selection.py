"""Masks, cuts, set operations, order and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import PIX, long, query, r6, stamp_pixels

#: Line items before this day are what zone_prefilter looks around.
DATE = "1995-01-08"


@query(f"with {PIX} select vec_id, cast(pos as bigint) pos, round(v, 6) v from pix where not (pos % 13 = 5) and not ((vec_id * 7 + pos) % 31 = 0) and not (label = 2 and y = 3)")
def mask_anti(read):
    """Permanent, cosmic-ray and file masks as anti-joins of bad-pixel tables."""
    pix = stamp_pixels(read)
    permanent = pix.where("pos % 13 = 5").select("pos").distinct()
    hits = pix.where("(vec_id * 7 + pos) % 31 = 0").select("vec_id", "pos")
    file = pix.where("label = 2 and y = 3").select("vec_id", "pos")
    good = pix.join(permanent, "pos", "left_anti").join(hits.union(file), ["vec_id", "pos"], "left_anti")
    return good.select("vec_id", long("pos", "pos"), r6("v", "v"))


@query(f"""with {PIX}, h as (select vec_id, y, x from pix where (vec_id * 11 + pos * 3) % 101 = 0),
d as (select distinct vec_id, y + a as y, x + b as x from h, (values (-1), (0), (1)) a(a), (values (-1), (0), (1)) b(b))
select p.vec_id, count(*) kept, round(sum(v), 6) total from pix p where not exists (select 1 from d where d.vec_id = p.vec_id and d.y = p.y and d.x = p.x) group by p.vec_id""")
def cr_dilate(read):
    """Hits grown by one pixel each way, then taken out."""
    pix = stamp_pixels(read)
    around = F.sequence(F.lit(-1), F.lit(1))
    hits = pix.where("(vec_id * 11 + pos * 3) % 101 = 0").withColumn("a", F.explode(around)).withColumn("b", F.explode(around))
    grown = hits.select("vec_id", (F.col("y") + F.col("a")).cast("int").alias("y"), (F.col("x") + F.col("b")).cast("int").alias("x"))
    return pix.join(grown, ["vec_id", "y", "x"], "left_anti").groupBy("vec_id").agg(F.count("*").alias("kept"), r6(F.sum("v"), "total"))


@query("select l_orderkey, cast(l_linenumber as bigint) l_linenumber, (l_returnflag = 'R' or l_quantity < 10 or l_discount < 0.02) masked from lineitem")
def quality_cut(read):
    """A mask extended by fidelity and noise cuts."""
    masked = (F.col("l_returnflag") == "R") | (F.col("l_quantity") < 10) | (F.col("l_discount") < 0.02)
    return read("lineitem").select("l_orderkey", long("l_linenumber", "l_linenumber"), masked.alias("masked"))


@query("""with s as (select s_suppkey, (s_suppkey * 37) % 1000 / 20.0::double cx, (s_suppkey * 91) % 1000 / 20.0::double cy, 0.3 + (s_suppkey % 5) / 10.0::double r from supplier),
c as (select c_custkey, (c_custkey * 53) % 1000 / 20.0::double x, (c_custkey * 29) % 997 / 20.0::double y from customer)
select c_custkey, exists (select 1 from s where (x - cx) ** 2 + (y - cy) ** 2 < r * r) masked from c""")
def mask_caps(read):
    """Circular masks of each object's own radius: a range join by cells of the largest radius, then a semi-join. Of circles about
    one place the largest masks all that the others do, and points of one place are looked up once."""
    s = read("supplier").select((F.col("s_suppkey") * 37 % 1000 / 20.0).alias("cx"), (F.col("s_suppkey") * 91 % 1000 / 20.0).alias("cy"), (0.3 + F.col("s_suppkey") % 5 / 10.0).alias("r"))
    c = read("customer").select("c_custkey", (F.col("c_custkey") * 53 % 1000 / 20.0).alias("x"), (F.col("c_custkey") * 29 % 997 / 20.0).alias("y"))
    around = F.sequence(F.lit(-1), F.lit(1))
    s = s.groupBy("cx", "cy").agg(F.max("r").alias("r"))
    s = s.withColumn("a", F.explode(around)).withColumn("b", F.explode(around)).withColumn("i", F.floor("cx") + F.col("a")).withColumn("j", F.floor("cy") + F.col("b"))
    places = c.select("x", "y").distinct().withColumn("i", F.floor("x")).withColumn("j", F.floor("y"))
    hit = places.join(s, ["i", "j"]).where("(x - cx) * (x - cx) + (y - cy) * (y - cy) < r * r").select("x", "y").distinct().withColumn("masked", F.lit(True))
    return c.join(hit, ["x", "y"], "left").select("c_custkey", F.coalesce("masked", F.lit(False)).alias("masked"))


@query(f"""with c as (select distinct cast(floor(l_extendedprice / 5000) as bigint) + d as cell from lineitem, (values (-1), (0), (1)) t(d) where l_shipdate < timestamp '{DATE}')
select o_orderkey, cast(floor(o_totalprice / 5000) as bigint) cell from orders where cast(floor(o_totalprice / 5000) as bigint) in (select cell from c)""")
def zone_prefilter(read):
    """Coarse cells that are relevant, dilated, as a semi-join before finer tests."""
    cells = read("lineitem").where(f"l_shipdate < timestamp '{DATE}'").select(F.floor(F.col("l_extendedprice") / 5000).alias("c")).distinct()
    cells = cells.select(F.explode(F.array(*[(F.col("c") + d).cast("long") for d in (-1, 0, 1)])).alias("cell")).distinct()
    return read("orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 5000).cast("long").alias("cell")).join(cells, "cell", "left_semi").select("o_orderkey", "cell")


@query("select l_orderkey, cast(l_linenumber as bigint) l_linenumber, cast(round_even(l_extendedprice / 100, 0) as bigint) place from lineitem where round_even(l_extendedprice / 100, 0) >= 40 and round_even(l_extendedprice / 100, 0) < 600")
def boundary_filter(read):
    """Positions rounded half to even and kept inside a border."""
    place = F.rint(F.col("l_extendedprice") / 100)
    return read("lineitem").where((place >= 40) & (place < 600)).select("l_orderkey", long("l_linenumber", "l_linenumber"), long(place, "place"))


@query("select * from (select c_nationkey as obsid, 'x' as dummy from customer where c_mktsegment = 'BUILDING' intersect select s_nationkey, 'x' from supplier) order by obsid")
def idsca_intersect(read):
    a = read("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("obsid"), F.lit("x").alias("dummy"))
    return a.intersect(read("supplier").select(F.col("s_nationkey").alias("obsid"), F.lit("x").alias("dummy")))


@query("select n_nationkey as id, n_name as name, n_regionkey as region, cast(null as varchar) as brand from nation union all select p_partkey, p_name, null, p_brand from part")
def truth_union(read):
    """Tables of different columns under one another."""
    n = read("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return n.unionByName(read("part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand")), allowMissingColumns=True)


@query("""with g as (select i as ix, j as iy from range(10) a(i), range(10) b(j)), b as (select p_size % 10 as ix, cast(floor(p_size / 10) as int) iy, count(*) n, round(avg(p_retailprice), 4) mean from part group by 1, 2)
select cast(g.ix as bigint) ix, cast(g.iy as bigint) iy, coalesce(n, 0) n, mean from g left join b on g.ix = b.ix and g.iy = b.iy""")
def block_grid_union(read):
    """Blocks set in their grid; missing ones stay blank."""
    part = read("part")
    grid = part.sparkSession.range(100).select(long(F.col("id") % 10, "ix"), long(F.floor(F.col("id") / 10), "iy"))
    b = part.groupBy(long(F.col("p_size") % 10, "ix"), long(F.floor(F.col("p_size") / 10), "iy")).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean"))
    return grid.join(b, ["ix", "iy"], "left").select("ix", "iy", F.coalesce("n", F.lit(0)).alias("n"), "mean")


@query("""select cast(floor(l_suppkey / 2) as bigint) grp, count(distinct l_linenumber) images, bool_or(l_returnflag = 'R') any_masked from lineitem group by 1""")
def used_images(read):
    """Images used by any stamp of a group, and the OR of their masks."""
    line = read("lineitem").groupBy(long(F.floor(F.col("l_suppkey") / 2), "grp"), "l_linenumber").agg(F.bool_or(F.col("l_returnflag") == "R").alias("m"))
    return line.groupBy("grp").agg(F.count("*").alias("images"), F.bool_or("m").alias("any_masked"))


@query("select o_orderkey, (o_orderkey * 691) % 4096 as block, ((o_orderkey * 691) % 4096) // 64 as iy, ((o_orderkey * 691) % 4096) % 64 as ix from orders")
def prime_stride(read):
    block = F.col("o_orderkey") * 691 % 4096
    return read("orders").select("o_orderkey", block.alias("block"), F.expr("(o_orderkey * 691 % 4096) div 64").alias("iy"), (block % 64).alias("ix"))


@query("""with s as (select distinct cast(l_suppkey % 12 as bigint) j, cast(l_partkey % 12 as bigint) i from lineitem), o as (select j, i, (j // 2) * 24 + (i // 2) * 4 + (j % 2) * 2 + i % 2 as k from s order by k limit 10)
select distinct j + a as j, i + b as i from o, (values (-1), (0), (1)) a(a), (values (-1), (0), (1)) b(b)""")
def first_n_stamps(read):
    """The first stamps in two-by-two order and the input stamps that they need."""
    s = read("lineitem").select(long(F.col("l_suppkey") % 12, "j"), long(F.col("l_partkey") % 12, "i")).distinct()
    first = s.withColumn("k", F.expr("(j div 2) * 24 + (i div 2) * 4 + (j % 2) * 2 + i % 2")).orderBy("k").limit(10)
    around = F.sequence(F.lit(-1), F.lit(1))
    return first.withColumn("a", F.explode(around)).withColumn("b", F.explode(around)).select((F.col("j") + F.col("a")).alias("j"), (F.col("i") + F.col("b")).alias("i")).distinct()


@query("select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) - 1 as rank, count(*) filter (where true) over (partition by o_custkey order by o_totalprice, o_orderkey rows between unbounded preceding and current row) as upto from orders")
def order_permutation(read):
    """Rank of each row in its group: the permutation that sorts it."""
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return read("orders").select("o_custkey", "o_orderkey", (F.row_number().over(w) - 1).cast("long").alias("rank"), F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))


@query("select o_orderpriority, count(*) filter (where o_totalprice < 50000) below, count(*) n from orders group by 1")
def search_boundary(read):
    """How many of a group's sorted values lie under a cut."""
    return read("orders").groupBy("o_orderpriority").agg(F.sum((F.col("o_totalprice") < 50000).cast("long")).alias("below"), F.count("*").alias("n"))


@query("""with r as (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as n, count(*) over (partition by o_custkey) > 1 as repeated from orders)
select o_custkey, o_orderkey as first_order, round(o_totalprice, 6) price, repeated from r where n = 1""")
def first_instance(read):
    """The instance that comes first, by falling date and then key, with what it holds, and whether there were more."""
    latest = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct(F.col("o_orderdate"), -F.col("o_orderkey")))
    out = read("orders").groupBy("o_custkey").agg(latest.alias("m"), (F.count("*") > 1).alias("repeated"))
    return out.select("o_custkey", F.col("m.o_orderkey").alias("first_order"), r6("m.o_totalprice", "price"), "repeated")


@query("""with b as (select cast(p_partkey % 20 as bigint) ix, cast(p_size as bigint) obs, sum(p_retailprice) v from part group by 1, 2)
select a.ix, a.obs, round(a.v + coalesce(r.v, 0), 4) v from b a left join b r on r.ix = a.ix + 1 and r.obs = a.obs""")
def neighbour_padding(read):
    """A block takes up what its right neighbour has for the same exposure."""
    b = read("part").groupBy(long(F.col("p_partkey") % 20, "ix"), long("p_size", "obs")).agg(F.sum("p_retailprice").alias("v"))
    right = b.select((F.col("ix") - 1).alias("ix"), "obs", F.col("v").alias("more"))
    return b.join(right, ["ix", "obs"], "left").select("ix", "obs", F.round(F.col("v") + F.coalesce("more", F.lit(0.0)), 4).alias("v"))
