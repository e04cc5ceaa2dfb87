"""Strings: layer grammar, paths, ids, logs, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import long, query

LAYER = "case p_size % 6 when 0 then 'gsstar' || p_size when 1 then 'whitenoise' || p_size when 2 then '1fnoise' || p_size when 3 then 'gsext' || p_size || ',Seed=' || p_partkey || ',shear=0.02:0.0' when 4 then 'truth' else 'labnoise' end"


@query(f"""with l as (select p_partkey, {LAYER} as layer from part)
select p_partkey, regexp_extract(lower(layer), '^(truth|whitenoise|1fnoise|labnoise|skyerr|cstar|nstar|gsstar|gstrstar|gsfdstar|gsext|noise)', 1) kind,
coalesce(try_cast(regexp_extract(layer, '^(?:gsstar|whitenoise|1fnoise|gsext)([0-9]+)', 1) as bigint), -1) number, coalesce(try_cast(regexp_extract(lower(layer), 'seed=([0-9]+)', 1) as bigint), -1) seed, regexp_extract(lower(layer), 'shear=([^,]+)', 1) shear from l""")
def layer_grammar(read):
    n = F.col("p_size").cast("string")
    m = F.col("p_size") % 6
    layer = F.when(m == 0, F.concat(F.lit("gsstar"), n)).when(m == 1, F.concat(F.lit("whitenoise"), n)).when(m == 2, F.concat(F.lit("1fnoise"), n))
    layer = layer.when(m == 3, F.concat(F.lit("gsext"), n, F.lit(",Seed="), F.col("p_partkey").cast("string"), F.lit(",shear=0.02:0.0"))).when(m == 4, "truth").otherwise("labnoise")
    low = F.lower(layer)
    kind = F.regexp_extract(low, "^(truth|whitenoise|1fnoise|labnoise|skyerr|cstar|nstar|gsstar|gstrstar|gsfdstar|gsext|noise)", 1)
    number = F.regexp_extract(low, "^(?:gsstar|whitenoise|1fnoise|gsext)([0-9]+)", 1).try_cast("long")
    return read("part").select("p_partkey", kind.alias("kind"), F.coalesce(number, F.lit(-1)).cast("long").alias("number"), F.coalesce(F.regexp_extract(low, "seed=([0-9]+)", 1).try_cast("long"), F.lit(-1)).cast("long").alias("seed"), F.regexp_extract(low, "shear=([^,]+)", 1).alias("shear"))


@query("""with p as (select o_orderkey, 'row' || lpad((o_custkey % 100)::varchar, 2, '0') || '/q_' || lpad((o_orderkey % 100)::varchar, 2, '0') || '_' || lpad((o_custkey % 100)::varchar, 2, '0') || '.fits.gz' path from orders)
select o_orderkey, path, regexp_extract(path, '^(.*/)?([^/]*)$', 1) dir, regexp_extract(path, '_([0-9]{2})_([0-9]{2})\\.', 1)::bigint ix from p""")
def path_template(read):
    """Block names from coordinates, and the parts of a path."""
    path = F.format_string("row%02d/q_%02d_%02d.fits.gz", F.col("o_custkey") % 100, F.col("o_orderkey") % 100, F.col("o_custkey") % 100)
    p = read("orders").select("o_orderkey", path.alias("path"))
    return p.select("o_orderkey", "path", F.regexp_extract("path", "^(.*/)?([^/]*)$", 1).alias("dir"), F.regexp_extract("path", r"_([0-9]{2})_([0-9]{2})\.", 1).cast("long").alias("ix"))


@query("select s_suppkey, 'HSHX' || lpad(upper(to_hex(s_suppkey % 65536)), 4, '0') id, s_suppkey % 65536 as back from supplier")
def hex_layer_id(read):
    name = F.concat(F.lit("HSHX"), F.lpad(F.hex(F.col("s_suppkey") % 65536), 4, "0"))
    return read("supplier").select("s_suppkey", name.alias("id"), F.conv(F.substring(name, 5, 4), 16, 10).cast("long").alias("back"))


@query("""with l as (select user_id, event_id, case when event_id % 3 = 0 then 'finished at t = ' || event_id || ' s' else 'working ' || event_id end line from events)
select user_id, max(event_id) as lines_to, try_cast(regexp_extract(arg_max(line, event_id), 'finished at t = ([0-9.]+) s', 1) as bigint) as seconds from l group by user_id""")
def log_tail_time(read):
    """The time in each log's last line, if it says one."""
    e = F.col("event_id").cast("string")
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("finished at t = "), e, F.lit(" s"))).otherwise(F.concat(F.lit("working "), e))
    log = read("events").groupBy("user_id").agg(F.max("event_id").alias("lines_to"), F.max_by(line, "event_id").alias("last"))
    return log.select("user_id", "lines_to", F.regexp_extract("last", "finished at t = ([0-9.]+) s", 1).try_cast("long").alias("seconds"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) k, json_extract_string(props, '$.k') is null as missing from events")
def config_json(read):
    """A keyword from JSON settings."""
    props = F.from_json("props", "k long")
    return read("events").select("event_id", props["k"].alias("k"), props["k"].isNull().alias("missing"))


@query("""with w as (select p_partkey, string_split(p_name, ' ') words from part) select p_partkey, cast(coalesce(list_position(words, words[cast(1 + p_partkey % len(words) as int)]), 0) as bigint) first_at, cast(coalesce(list_position(words, 'steel'), 0) as bigint) other, cast(len(words) as bigint) n from w""")
def layer_lookup(read):
    """Index of a name in a list; the first match wins."""
    words = F.split("p_name", " ", -1)
    name = F.element_at(words, (1 + F.col("p_partkey") % F.size(words)).cast("int"))
    return read("part").select("p_partkey", F.array_position(words, name).cast("long").alias("first_at"), F.array_position(words, "steel").cast("long").alias("other"), F.size(words).cast("long").alias("n"))


@query("""with f as (select unnest(['U', 'S', 'K', 'T', 'N']) flag) select f.flag, count(*) n from f join part on contains(upper(p_type), f.flag) group by 1""")
def map_flags(read):
    """Parts whose type carries each output-map letter."""
    flags = F.array(*[F.lit(x) for x in "USKTN"])
    out = read("part").select(F.explode(F.filter(flags, lambda f: F.contains(F.upper("p_type"), f))).alias("flag"))
    return out.groupBy("flag").agg(F.count("*").alias("n"))


@query("select o_orderdate as day, strftime(o_orderdate, '%Y%m%d%H%M%S') stamp, count(*) n from orders group by 1, 2")
def timestamp_names(read):
    return read("orders").groupBy(F.col("o_orderdate").alias("day"), F.date_format("o_orderdate", "yyyyMMddHHmmss").alias("stamp")).agg(F.count("*").alias("n"))
