"""How five filters act on each other in every order, from counts of the 32 ways to fail them.

A document fails some of the filters A to E; documents are counted by source and by that set of filters. In an order a
set is removed at the first of its filters. All orders that begin with one prefix are neighbours among the 120 orders
in lexicographic rank (their Lehmer codes begin alike), so the orders that remove a set at a step are a few intervals
of ranks: one for each prefix that ends in a filter of the set and has none before it. Each count is added at the
beginning of its intervals and taken off at their ends, and sums along the ranks give every order's figures.

Copies are told by a SHA-256 of the whole text. No text is shuffled, and the rows of one text are brought together
only as minimums of each task.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import durable

FILTERS = "ABCDE"
STEPS = len(FILTERS)
#: In lexicographic order, so a place in the list is a rank.
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTED = ("n", "good", "toxic")


def rank_of(prefix: str) -> int:
    """The smallest rank of an order that begins with prefix: its Lehmer code in factorial base."""
    rank, left = 0, list(FILTERS)
    for letter in prefix:
        rank += left.index(letter) * factorial(len(left) - 1)
        left.remove(letter)
    return rank


def intervals() -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last) of the orders that remove a mask's documents at a step."""
    out = []
    for step in range(1, STEPS + 1):
        for prefix in map("".join, permutations(FILTERS, step)):
            first = rank_of(prefix)
            for mask in range(1, 1 << STEPS):
                failed = [x for x in FILTERS if mask >> FILTERS.index(x) & 1]
                if prefix[-1] in failed and not {*prefix[:-1]} & {*failed}:
                    out.append((mask, step, first, first + factorial(STEPS - step)))
    return out


def failures(text: Column) -> Column:
    """Bits 0 to 3: whether a text, which isn't null, fails A to D."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    tests = (F.size(words) < 50, 100 * F.size(F.array_distinct(words)) < 65 * F.size(words), 100 * capitals > 5 * F.length(text), text.rlike(r"[#$%&*|]"))
    return sum((x.cast("int") * (1 << i) for i, x in enumerate(tests)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each source by the filters that they fail.

    Null texts count as empty and null sources as the empty string. A row without an id is no copy of another, nor is
    another its copy. Repeated rows count as often as they occur and aren't copies of each other. Of several labels of
    an id, any 1 counts.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"), failures(text).alias("mask"))
    seen = durable(rows.groupBy("key", "doc_id", "part", "mask").agg(F.count("*").alias("n")))
    named, nameless = seen.where("doc_id is not null"), seen.where("doc_id is null")
    first = named.groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))  # one row a text
    copy = F.when(F.col("first").isNull(), F.lit(1 << FILTERS.index("E"))).otherwise(0)
    named = named.join(first, ["key", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + copy).alias("mask"), "n")
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = named.join(marked, "doc_id", "left").select("part", "mask", "n", *[(F.col("n") * F.coalesce(x, F.lit(0))).alias(x) for x in COUNTED[1:]])
    known = known.unionByName(nameless.select("part", "mask", "n", *[F.lit(0).cast("long").alias(x) for x in COUNTED[1:]]))
    return known.groupBy("part", "mask").agg(*[F.sum(x).alias(x) for x in COUNTED])


def by_rank(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """(part, step, rank, n, good, toxic): what each order removes at each step, by sums of differences along the ranks."""
    steps = F.broadcast(spark.createDataFrame(intervals(), "mask int, step int, first int, after int"))  # 840 rows, whatever the input
    ends = F.array(*[F.struct(F.col(at).alias("rank"), *[(sign * F.col(x)).alias(x) for x in COUNTED]) for at, sign in (("first", 1), ("after", -1))])
    differences = counts.join(steps, "mask").select("part", "step", F.explode(ends).alias("e")).select("part", "step", "e.*").where(F.col("rank") < len(ORDERS))
    every = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("step"))
    every = every.select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) - 1))).alias("rank"), *[F.lit(0).cast("long").alias(x) for x in COUNTED])
    sums = differences.unionByName(every).groupBy("part", "step", "rank").agg(*[F.sum(x).alias(x) for x in COUNTED])
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return sums.select("part", "step", "rank", *[F.sum(x).over(along).alias(x) for x in COUNTED])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text, source), labels(doc_id, quality, toxic) -> the figures of every source, order and step.

    For nulls and repeated rows see masks(); an empty table gives no rows, as it has no source. Other columns are left alone.
    """
    counts = durable(masks(docs, labels))
    bit = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) > 0
    failing = F.array(*[F.coalesce(F.sum(F.when(bit(i), F.col("n"))), F.lit(0)) for i in range(STEPS)])
    alone = F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == 1 << i, F.col("n"))), F.lit(0)) for i in range(STEPS)])
    parts = counts.groupBy("part").agg(F.sum("n").alias("documents"), failing.alias("failing"), alone.alias("alone"))
    rows = by_rank(docs.sparkSession, counts).join(parts, "part").withColumn("filter_order", F.element_at(F.array(*map(F.lit, ORDERS)), F.col("rank") + 1))
    rows = rows.withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    place = F.instr(F.lit(FILTERS), F.col("letter"))
    so_far = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "part", "filter_order", "step",
        (F.col("documents") - F.sum("n").over(so_far)).alias("kept"),
        F.col("n").alias("removed"),
        (F.element_at("failing", place) - F.col("n")).alias("redundant"),
        F.element_at("alone", place).alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "letter")).alias("shapley"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT doc_id, part,
    CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM x a, x b, x c, x d, x e
    WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
s AS (SELECT filter_order, CAST(step AS INT) AS step, substr(filter_order, CAST(step AS INT), 1) AS letter FROM o, range(1, 6) t(step)),
r AS (SELECT part, filter_order, step, letter,
    sum(n) FILTER (translate(substr(filter_order, 1, step), fails, '') = substr(filter_order, 1, step)) AS kept,
    sum(n) FILTER (contains(fails, letter)) AS failing, sum(n) FILTER (fails = letter) AS alone,
    sum(n) FILTER (here) AS removed, sum(good) FILTER (here) AS good_lost, sum(toxic) FILTER (here) AS toxic_lost
    FROM (SELECT *, contains(fails, letter) AND translate(substr(filter_order, 1, step - 1), fails, '') = substr(filter_order, 1, step - 1) AS here FROM c, s)
    GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
    CAST(coalesce(failing, 0) - coalesce(removed, 0) AS BIGINT) AS redundant, CAST(coalesce(alone, 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
    CAST(coalesce(sum(removed) OVER (PARTITION BY part, letter), 0) AS BIGINT) AS shapley FROM r
"""
