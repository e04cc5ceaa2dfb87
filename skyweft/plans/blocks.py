"""Sources and sinks: block tables, compressed layers, observation scans, paths, settings, catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources import blocks as B
from .registry import PIX, long, query, r6, stamp_pixels

BLOCKS = f"{PIX}, b as (select cast(vec_id % 10 as bigint) ix, cast((vec_id // 10) % 7 as bigint) iy, vec_id, y, x, v from pix)"


def blocks(read) -> DataFrame:
    p = stamp_pixels(read)
    return p.select(long(F.col("vec_id") % 10, "ix"), long(F.expr("vec_id div 10 % 7"), "iy"), "vec_id", "y", "x", "v")


FIDELITY = "cast(least(greatest(floor(-5000 * log10(greatest(v * v, 1e-32)) + 0.5), 0), 65535) as bigint)"


@query(f"""with {BLOCKS} select ix, iy, vec_id, cast(y as bigint) y, cast(x as bigint) x, round(v, 6) science, case when {FIDELITY} = 65535 then 0 else round(10 ** ({FIDELITY} / -5000.0::double), 6) end fidelity
from b where ix between 2 and 4 and iy = 3""")
def block_tables(read):
    """Cube and quality map of every block written as tables by ix and iy; three blocks read again by pruning, the map decoded."""
    b = blocks(read)
    place = B.folder(b.sparkSession)
    B.write({"coadd": b, "maps": b.select("ix", "iy", "vec_id", "y", "x", C.log_code(F.col("v") * F.col("v"), "FIDELITY").alias("fidelity"))}, place)
    some = (F.col("ix").between(2, 4)) & (F.col("iy") == 3)
    cube, maps = (B.read(b.sparkSession, place, name).where(some) for name in ("coadd", "maps"))
    out = cube.join(maps, ["ix", "iy", "vec_id", "y", "x"])
    return out.select(long("ix", "ix"), long("iy", "iy"), "vec_id", long("y", "y"), long("x", "x"), r6("v", "science"), r6(C.log_decode(F.col("fidelity"), "FIDELITY"), "fidelity"))


@query(f"""with {BLOCKS}, s as (select ix, iy, y, x, sum(v) v from b group by all), m as (select y + (iy - 3) * 8 y, x + (ix - 9) * 8 x, v from s where ix between 8 and 10 and iy between 2 and 4)
select cast(y as bigint) y, cast(x as bigint) x, round(v, 6) v from m where y >= -3 and y < 11 and x >= -3 and x < 11""")
def block_neighbourhood(read):
    """A block with a margin of its neighbours, cropped; it lies at the edge, where neighbours are missing."""
    s = blocks(read).groupBy("ix", "iy", "y", "x").agg(F.sum("v").alias("v"))
    return B.neighbourhood(s, 9, 3, 8, (-3, 11, -3, 11)).select(long("y", "y"), long("x", "x"), r6("v", "v"))


LOW, HIGH, BITS = -0.25, 0.25, 12


@query(f"""with {PIX}, q as (select *, least(greatest(floor(4096 * (least(greatest(v, {LOW}), {HIGH}) + 0.25) / 0.5), 0), 4095) as code from pix)
select vec_id, cast(pos as bigint) pos, round(case when v < {LOW} or v > {HIGH} then v else {LOW} + 0.5 * (code + 0.5) / 4096 end, 6) v from q""")
def compressed_layers(read):
    """Layers compressed, written, read and expanded again: differences, zig-zag, bit planes and their inverses, overflow put back."""
    p = stamp_pixels(read).select("vec_id", F.col("pos").cast("long").alias("pos"), "v")
    place, spark = B.folder(p.sparkSession, "layers"), p.sparkSession
    for name, table in B.compress(p, ["vec_id"], "pos", "v", LOW, HIGH, BITS).items():
        table.write.option("compression", "zstd").parquet(f"{place}/{name}")
    planes, overflow = (spark.read.parquet(f"{place}/{name}") for name in ("planes", "overflow"))
    return B.decompress(planes, overflow, ["vec_id"], "pos", "v", LOW, HIGH, BITS).select("vec_id", "pos", r6("v", "v"))


@query(f"""with {PIX}, q as (select *, least(greatest(floor(4096 * (least(greatest(v, {LOW}), {HIGH}) + 0.25) / 0.5), 0), 4095) as code from pix)
select vec_id, count(*) n, round(max(abs(case when v < {LOW} or v > {HIGH} then 0 else {LOW} + 0.5 * (code + 0.5) / 4096 - v end)), 6) error, count(*) filter (where v < {LOW} or v > {HIGH}) overflow from q group by vec_id""")
def compressed_error(read):
    """Largest error of each expanded layer over all its pixels, overflow included."""
    p = stamp_pixels(read).select("vec_id", F.col("pos").cast("long").alias("pos"), "v")
    tables = B.compress(p, ["vec_id"], "pos", "v", LOW, HIGH, BITS)
    back = B.decompress(tables["planes"], tables["overflow"], ["vec_id"], "pos", "v", LOW, HIGH, BITS).withColumnRenamed("v", "back")
    out = (F.col("v") < LOW) | (F.col("v") > HIGH)
    return p.join(back, ["vec_id", "pos"]).groupBy("vec_id").agg(F.count("*").alias("n"), r6(F.max(F.abs(F.col("back") - F.col("v"))), "error"), F.sum(out.cast("long")).alias("overflow"))


#: Filter names in the order of their codes.
FILTERS = ("W146", "F184", "H158", "J129", "Y106", "Z087", "R062", "PRSM", "DARK", "GRSM", "K213")
NAMED = f"case c_nationkey % 13 {' '.join(f'when {i} then {chr(39)}{n}{chr(39)}' for i, n in enumerate(FILTERS))} else 'X' || c_nationkey end"
CODED = f"coalesce(list_position({list(FILTERS)}, name) - 1, 0)"


def observations(read) -> DataFrame:
    """Exposures whose filter is given by name; names that aren't known get code 0."""
    names = F.array(*[F.lit(n) for n in FILTERS])
    k = (F.col("c_nationkey") % 13).cast("int")
    name = F.when(k < len(FILTERS), F.element_at(names, F.least(k, F.lit(len(FILTERS) - 1)) + 1)).otherwise(F.concat(F.lit("X"), F.col("c_nationkey").cast("string")))
    rows = read("customer").select(F.col("c_custkey").alias("obs_row"), name.alias("name"), F.col("c_acctbal").alias("exptime"))
    return rows.withColumn("filter", F.greatest(F.array_position(names, F.col("name")) - 1, F.lit(0)).cast("long"))


@query(f"with o as (select c_custkey obs_row, {NAMED} as name, c_acctbal exptime from customer) select obs_row, name, cast({CODED} as bigint) as filter, round(exptime, 6) exptime from o")
def observation_scan(read):
    return observations(read).select("obs_row", "name", "filter", r6("exptime", "exptime"))


@query(f"""with o as (select c_custkey obs_row, {NAMED} as name from customer), s as (select obs_row, cast(1 + (obs_row * 7 + k) % 18 as bigint) sca from o, range(3) t(k) where {CODED} = 2)
select obs_row, sca, row_number() over (order by obs_row, sca) - 1 as place from s""")
def observation_order(read):
    """Exposure and detector pairs of one filter in the order of exposure, then detector, with their place in it.

    A range exchange sorts the pairs; places come from the counts of the parts before, one row a part.
    """
    o = observations(read).where("filter = 2").select("obs_row", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    s = o.select("obs_row", (1 + (F.col("obs_row") * 7 + F.col("k")) % 18).alias("sca")).orderBy("obs_row", "sca").withColumn("part", F.spark_partition_id())
    from pyspark.sql import Window

    place, spark = B.folder(s.sparkSession, "order"), s.sparkSession
    s.write.parquet(place)
    s = spark.read.parquet(place)
    counts = s.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("part").orderBy("obs_row", "sca")) - 1
    return s.withColumn("within", within).join(before, "part").select("obs_row", "sca", (F.col("before") + F.col("within")).cast("long").alias("place"))


def _path(kind: str, band: str, sca: str) -> str:
    return f"'in/' || case o_orderkey % 4 when 0 then 'simple/dc2_' || {band} || '_' || o_custkey || '_' || {sca} || '.fits' when 1 then 'labnoise/slope_' || o_custkey || '_' || {sca} || '.fits' when 2 then 'sim_L2_' || {band} || '_' || o_custkey || '_' || {sca} || '_mask.fits' else 'truth/Roman_WAS_truth_' || {band} || '_' || o_custkey || '_' || {sca} || '.fits' end"


@query(f"""with n as (select o_orderkey, o_custkey, 1 + o_orderkey % 18 sca, list_extract({list(FILTERS)}, cast(1 + o_custkey % 11 as int)) band from orders) select o_orderkey, {_path('', 'band', 'sca')} as path from n""")
def image_paths(read):
    """Names of files by format and type."""
    o, s = F.col("o_custkey").cast("string"), (1 + F.col("o_orderkey") % 18).cast("string")
    band = F.element_at(F.array(*[F.lit(n) for n in FILTERS]), (1 + F.col("o_custkey") % 11).cast("int"))
    kind, tail = F.col("o_orderkey") % 4, F.concat(F.lit("_"), o, F.lit("_"), s)
    path = F.when(kind == 0, F.concat(F.lit("in/simple/dc2_"), band, tail, F.lit(".fits"))).when(kind == 1, F.concat(F.lit("in/labnoise/slope"), tail, F.lit(".fits")))
    path = path.when(kind == 2, F.concat(F.lit("in/sim_L2_"), band, tail, F.lit("_mask.fits"))).otherwise(F.concat(F.lit("in/truth/Roman_WAS_truth_"), band, tail, F.lit(".fits")))
    return read("orders").select("o_orderkey", path.alias("path"))


@query("""with f as (select distinct o_custkey obsid, o_orderkey % 18 sca from orders where o_orderstatus <> 'P'), p as (select c_custkey obsid, s as sca from customer, range(18) t(s))
select p.obsid, cast(p.sca as bigint) sca from p where exists (select 1 from f where f.obsid = p.obsid and f.sca = p.sca)""")
def existence_probe(read):
    """Which exposure and detector pairs have a file: the pairs semi-joined to the listing, no probe a pair."""
    files = read("orders").where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("obsid"), (F.col("o_orderkey") % 18).alias("sca")).distinct()
    pairs = read("customer").select(F.col("c_custkey").alias("obsid"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(17).cast("long"))).alias("sca"))
    return pairs.join(files, ["obsid", "sca"], "left_semi")


@query("""with f as (select distinct 'out_' || lpad((p_partkey % 40)::varchar, 2, '0') || '_' || lpad((p_size % 40)::varchar, 2, '0') || case when p_partkey % 3 = 0 then '_map' else '' end as name from part),
g as (select i as n, i % 40 ix, i // 40 iy from range(1600) t(i)), m as (select ix, iy, 'out_' || lpad(ix::varchar, 2, '0') || '_' || lpad(iy::varchar, 2, '0') as name from g)
select cast(ix as bigint) ix, cast(iy as bigint) iy, exists (select 1 from f where f.name = m.name) plain, exists (select 1 from f where f.name = m.name || '_map') legacy from m""")
def block_walk(read):
    """Every place of the block grid against the listing of files, new and legacy names."""
    name = F.format_string("out_%02d_%02d", F.col("p_partkey") % 40, F.col("p_size") % 40)
    files = read("part").select(name.alias("name"), (F.col("p_partkey") % 3 == 0).alias("old")).groupBy("name").agg(F.bool_or(~F.col("old")).alias("plain"), F.bool_or("old").alias("legacy"))
    grid = files.sparkSession.range(1600).select((F.col("id") % 40).alias("ix"), F.expr("id div 40").alias("iy"))
    out = grid.withColumn("name", F.format_string("out_%02d_%02d", "ix", "iy")).join(files, "name", "left")
    return out.select("ix", "iy", F.coalesce("plain", F.lit(False)).alias("plain"), F.coalesce("legacy", F.lit(False)).alias("legacy"))


@query("select s_suppkey, round(s_acctbal, 6) flux, cast(s_nationkey as bigint) band from supplier")
def text_catalogue(read):
    """A catalogue written as text columns and read with a schema, then kept as Parquet."""
    s = read("supplier").select("s_suppkey", F.col("s_acctbal").alias("flux"), F.col("s_nationkey").alias("band"))
    place, spark = B.folder(s.sparkSession, "text"), s.sparkSession
    s.write.option("sep", " ").csv(f"{place}/csv")
    rows = spark.read.schema("s_suppkey long, flux double, band long").option("sep", " ").csv(f"{place}/csv")
    rows.write.mode("ignore").parquet(f"{place}/kept")
    rows.limit(1).write.mode("ignore").parquet(f"{place}/kept")  # what is there already stays
    return spark.read.parquet(f"{place}/kept").select("s_suppkey", r6("flux", "flux"), "band")


@query("""select p_partkey, '{"FILTER":' || p_size || ',"LAKERNEL":"' || case when p_size % 2 = 0 then 'Cholesky' else 'Iterative' end || '","OUTSIZE":[' || p_size || ',' || p_size * 2 || '],"FADE":' || case when p_size % 3 = 0 then p_size else 3 end || '}' as text, case when p_size % 3 = 0 then p_size else 3 end::bigint fade from part""")
def settings_json(read):
    """Settings written as JSON and read with a schema; what is missing gets its default."""
    n = F.col("p_size")
    given = F.struct(n.alias("FILTER"), F.when(n % 2 == 0, "Cholesky").otherwise("Iterative").alias("LAKERNEL"), F.array(n, n * 2).alias("OUTSIZE"), F.when(n % 3 == 0, n).alias("FADE"))
    back = F.from_json(F.to_json(given), "FILTER long, LAKERNEL string, OUTSIZE array<long>, FADE long")
    full = read("part").withColumn("s", back).withColumn("s", F.col("s").withField("FADE", F.coalesce("s.FADE", F.lit(3).cast("long"))))
    return full.select("p_partkey", F.to_json("s").alias("text"), F.col("s.FADE").alias("fade"))


@query(f"""with {PIX}, l as (select vec_id, pos, 'SCI' as layer, v from pix union all select vec_id, pos, 'SQ', v * v from pix union all select vec_id, pos, 'ONE', 1.0::double from pix where label % 2 = 0)
select vec_id, cast(pos as bigint) pos, round(max(v) filter (where layer = 'SCI'), 6) sci, round(max(v) filter (where layer = 'SQ'), 6) sq, round(coalesce(max(v) filter (where layer = 'ONE'), 0), 6) one from l where (vec_id * 5 + pos) % 9 = 0 group by all""")
def layer_gather(read):
    """Values of all layers at selected pixels: one join, then a pivot; a layer without a file counts as zero."""
    p = stamp_pixels(read)
    layers = p.select("vec_id", "pos", F.lit("sci").alias("layer"), "v").union(p.select("vec_id", "pos", F.lit("sq"), F.col("v") * F.col("v"))).union(p.where("label % 2 = 0").select("vec_id", "pos", F.lit("one"), F.lit(1.0)))
    chosen = p.where("(vec_id * 5 + pos) % 9 = 0").select("vec_id", "pos")
    out = layers.join(chosen, ["vec_id", "pos"]).groupBy("vec_id", "pos").pivot("layer", ["sci", "sq", "one"]).agg(F.max("v"))
    return out.select("vec_id", long("pos", "pos"), r6("sci", "sci"), r6("sq", "sq"), r6(F.coalesce("one", F.lit(0.0)), "one"))


@query("""with l as (select user_id % 8 ix, (user_id // 8) % 6 iy, event_id, case when event_id % 3 = 0 then 'finished at t = ' || event_id || '.5 s' else 'working' end line from events), t as (select ix, iy, arg_max(line, event_id) filter (where line like 'finished%') as last from l group by all),
g as (select i % 8 ix, i // 8 iy from range(64) r(i)) select cast(g.ix as bigint) ix, cast(g.iy as bigint) iy, round(coalesce(try_cast(regexp_extract(last, 'finished at t = ([0-9.]+) s', 1) as double), 0), 6) as seconds from g left join t on g.ix = t.ix and g.iy = t.iy""")
def consumption_map(read):
    """Seconds that each block took, by the last line of its log that says so; blocks without a log are zero."""
    done = F.col("event_id") % 3 == 0
    log = read("events").where(done).groupBy((F.col("user_id") % 8).alias("ix"), F.expr("user_id div 8 % 6").alias("iy")).agg(F.max_by(F.concat(F.lit("finished at t = "), F.col("event_id").cast("string"), F.lit(".5 s")), "event_id").alias("last"))
    grid = log.sparkSession.range(64).select((F.col("id") % 8).alias("ix"), F.expr("id div 8").alias("iy"))
    seconds = F.regexp_extract("last", "finished at t = ([0-9.]+) s", 1).try_cast("double")
    return grid.join(log, ["ix", "iy"], "left").select("ix", "iy", r6(F.coalesce(seconds, F.lit(0.0)), "seconds"))


@query(f"""with {PIX}, bad as (select distinct pos from pix where pos % 13 = 5), flags as (select vec_id, pos, case when (vec_id + pos) % 17 = 0 then 1 else 0 end flag from pix)
select vec_id, cast(p.pos as bigint) pos, round(v, 6) v from pix p join flags f using (vec_id, pos) where p.pos not in (select pos from bad) and flag = 0""")
def mask_scans(read):
    """A permanent mask whose good value is zero and a mask of each image whose zeros are good, both as anti-joins of the bad pixels."""
    p = stamp_pixels(read)
    permanent = p.select("pos", F.when(F.col("pos") % 13 == 5, 1).otherwise(0).alias("value"), F.lit(0).alias("goodval")).distinct()
    bad = permanent.where(~F.when(F.col("goodval") == 0, F.col("value") == 0).otherwise(F.col("value") != 0)).select("pos")
    flagged = p.select("vec_id", "pos", F.when((F.col("vec_id") + F.col("pos")) % 17 == 0, 1).otherwise(0).alias("flag")).where("flag <> 0").select("vec_id", "pos")
    return p.join(bad, "pos", "left_anti").join(flagged, ["vec_id", "pos"], "left_anti").select("vec_id", long("pos", "pos"), r6("v", "v"))
