"""Jaccard join of word n-grams by prefixes that are adapted to each document and matched several times.

With the n-grams of all sets in one common order, two sets of m and n n-grams that are alike share l of the first
n - ceil(part n) + l of either, for any l: what lies behind that in one of them is too little to hold the rest. So a
set may take any number l of matches that it asks for, and a pair is a candidate if it shares as many n-grams of both
prefixes as the smaller of its two numbers. A longer prefix costs more postings and leaves fewer candidates.

The number is chosen for each set from the postings of its own n-grams, which are counted with the longest prefixes:
every other posting is a row to join, and a candidate for l matches needs l of them, so there are at most an l-th as
many. N-grams of one set alone can't match and are dropped when they have been counted.

N-grams with many postings don't make pairs: their sets are linked along their sizes and to one centre, whatever else
they share, and what those links leave apart is compared in tiles of bounded size. Pairs that share such an n-gram
need no count, and all others share only counted ones, so no link is missed. Verification is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import broadcast_if_small, discard, durable, merged, parts_for, small_batches
from .components import with_least
from .near_copies import SIZE_BITS, Rule, common_shingles, groups_of, hashed, known, possible, prefixes, settled, verified

#: Three words, nine tenths.
CLOSE = Rule(3, 9, 10)
#: Matches that a set asks for at most.
LONGEST = 4
#: What verifying a candidate costs against joining a posting, for a set of no and of a thousand n-grams.
CANDIDATE, THOUSAND = 4.0, 20.0


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, id, size_place) -> the same rows, once each, with the number of sets of their key, if there are two or more."""
    for key, ident, sp in groups_of(batches, 1):
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (ident[1:] != ident[:-1])])
        key, ident, sp = key[new], ident[new], sp[new]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(starts, len(key)))
        sets = np.repeat(count, count)
        some = sets > 1
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (key, ident, sp, sets)], ["key", "id", "size_place", "sets"])


def matches_asked(posted: DataFrame, rule: Rule, longest: int) -> DataFrame:
    """(id, need): how many matches each set asks for, the cheapest by the postings (key, id, size_place, sets) of its prefixes."""
    size = F.shiftright("size_place", SIZE_BITS)
    place = F.col("size_place").bitwiseAND(F.lit((1 << SIZE_BITS) - 1))
    first = size - F.ceil(rule.part * size / rule.whole) + 1
    kept = F.ceil(rule.part * F.col("size") / rule.whole)  # a prefix can't be longer than the set
    sums = [F.sum(F.when(place < first + more, F.col("sets") - 1).otherwise(0)).alias(f"others{more}") for more in range(longest)]
    costs = posted.groupBy("id").agg(F.max(size).alias("size"), *sums)

    def cost(need: int) -> Column:
        others = F.col(f"others{need - 1}").cast("double")
        return others + others / need * (CANDIDATE + THOUSAND * F.col("size") / 1000)

    options = [F.struct(cost(need).alias("cost"), F.lit(need).alias("need")) for need in range(1, longest + 1)]
    choices = F.array(*[F.when(F.lit(need) <= F.greatest(kept, F.lit(1)), option) for need, option in enumerate(options, 1)])
    return costs.select("id", F.array_min(F.filter(choices, lambda x: x.isNotNull()))["need"].alias("need"))


def _pairs(most: int, rule: Rule) -> Callable:
    """Sorted (key, id, size_place, need) -> matches (a, b, need), and the rows of keys with more than `most` sets, b null.

    Need is zero for links along a frequent key, which are candidates without more matches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ident, sp, need in groups_of(batches, 1):
            order = np.lexsort((ident, sp, key))
            key, ident, sp, need = key[order], ident[order], sp[order], need[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.append(starts, len(key)))
            group = np.repeat(np.arange(len(starts)), count)
            large = (count > most)[group]
            left, right, asked = [], [], []
            for lag in range(1, min(int(count.max()), most)):
                at = np.flatnonzero((group[lag:] == group[:-lag]) & ~large[lag:])
                left.append(at)
                right.append(at + lag)
                asked.append(np.minimum(need[at], need[at + lag]))
            along = np.flatnonzero((group[1:] == group[:-1]) & large[1:])
            rest = np.flatnonzero(large)
            centre = np.lexsort((ident, group))[starts]  # the smallest number, which keys of one group of copies have in common
            left += [along, rest]
            right += [along + 1, centre[group[rest]]]
            asked += [np.zeros(len(along), np.int64), np.zeros(len(rest), np.int64)]
            a, b, asked = (np.concatenate(x).astype(np.int64) for x in (left, right, asked))
            good = (ident[a] != ident[b]) & possible(sp[a], sp[b], rule, np.where(asked == 0, LONGEST, asked) - 1)
            a, b, asked = ident[a[good]], ident[b[good]], asked[good]
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(np.minimum(a, b)), none, pa.array(np.maximum(a, b)), pa.array(asked)], ["key", "id", "size_place", "other", "need"])
            none = pa.nulls(len(rest), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(key[rest]), pa.array(ident[rest]), pa.array(sp[rest]), none, none], ["key", "id", "size_place", "other", "need"])

    return run


def components(docs: DataFrame, most: int = 48, tile: int = 2048, rule: Rule = CLOSE) -> tuple[DataFrame, DataFrame]:
    """docs(text) -> (th, id, size) of each different text, and (a, b): the id of each set that isn't its component's
    smallest, and that smallest id.

    `most`, the sets of an n-gram beyond which it counts as frequent, and `tile` affect speed only.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts, parts = hashed(docs), int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = parts_for(docs)
    seen, marks = known(texts, rule, prints=False, parts=few)
    common = spark.sparkContext.broadcast(common_shingles(texts, rule))
    rows = texts.select("text").mapInArrow(prefixes(common, rule, LONGEST - 1), "key long, id long, size_place long")
    posted = durable(merged(rows.repartition(parts, "key").sortWithinPartitions("key", "id"), few).mapInArrow(_counted, "key long, id long, size_place long, sets long"))
    place = F.col("size_place").bitwiseAND(F.lit((1 << SIZE_BITS) - 1))
    size = F.shiftright("size_place", SIZE_BITS)
    taken = merged(posted.join(merged(matches_asked(posted, rule, LONGEST), few), "id"), few).where(place < size - F.ceil(rule.part * size / rule.whole) + F.col("need"))
    dealt = taken.select("key", "id", "size_place", F.col("need").cast("long").alias("need")).repartition(parts, "key").sortWithinPartitions("key", "id")
    found = durable(merged(dealt, few).mapInArrow(_pairs(most, rule), "key long, id long, size_place long, other long, need long"))
    met = found.where("other is not null").groupBy("id", "other").agg(F.count("*").alias("met"), F.min("need").alias("need")).transform(merged, few)
    pairs = met.where("met >= need").select(F.col("id").alias("a"), F.col("other").alias("b"))
    links = verified(texts, marks, pairs, rule, few)
    out = settled(texts, marks, links, found.where("other is null").select("key", "id", "size_place"), tile, rule, LONGEST - 1, few)
    discard(posted)
    return seen.select("th", "id", "size"), out


def join(docs: DataFrame, rule: Rule = CLOSE) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_shingles, component_id), a row for each row of docs.

    component_id is the smallest doc_id reachable over links. Null texts count as empty; sets without an n-gram are linked
    with nothing, so their component is their own id. Rows of equal texts are linked whatever their ids; a row without an
    id gets its component's smallest id, null if there is none. Repeated rows stay; an empty table gives no rows.
    """
    seen, up = components(docs, rule=rule)
    rows = hashed(docs, F.col("doc_id").cast("long").alias("doc_id")).select("doc_id", "th")
    few = parts_for(docs)
    least = merged(rows.groupBy("th").agg(F.min("doc_id").alias("least")), few)  # one row a text
    roots = seen.join(up, seen.id == up.a, "left").select("th", "size", F.coalesce("b", "id").alias("root"))
    placed = durable(merged(least.join(roots, "th"), few))
    of = with_least(placed.where("size > 0"), "root", "least", "component_id", few).select("th", "size", "component_id")
    of = of.unionByName(placed.where("size = 0").select("th", "size", F.lit(None).cast("long").alias("component_id")))
    linked = rows.join(broadcast_if_small(durable(of)), "th")
    return linked.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
w AS (SELECT rid, len(l) AS n, unnest(l) AS word, generate_subscripts(l, 1) AS pos FROM d),
t AS (SELECT rid, n, pos, CASE WHEN n >= 3 THEN word || ' ' || lead(word) OVER win || ' ' || lead(word, 2) OVER win
    ELSE word || coalesce(' ' || lead(word) OVER win, '') END AS shingle FROM w WINDOW win AS (PARTITION BY rid ORDER BY pos)),
s AS (SELECT DISTINCT rid, shingle FROM t WHERE shingle IS NOT NULL AND (n >= 3 OR pos = 1)),
g AS (SELECT rid, count(*) AS n, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS same FROM s GROUP BY rid),
k AS (SELECT same, n, min(rid) AS rid FROM g GROUP BY same, n),
u AS (SELECT k.rid, k.n, s.shingle FROM k JOIN s ON s.rid = k.rid),
p AS (SELECT a.rid AS a, b.rid AS b FROM u a JOIN u b ON a.shingle = b.shingle AND a.rid < b.rid AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
    GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT rid, rid AS root FROM k UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.rid),
c AS (SELECT g.rid, g.n, min(r.root) AS root FROM g JOIN k USING (same, n) JOIN r ON r.rid = k.rid GROUP BY g.rid, g.n),
m AS (SELECT c.root, min(d.doc_id) AS least FROM c JOIN d USING (rid) GROUP BY c.root)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, CASE WHEN c.n IS NULL THEN d.doc_id ELSE m.least END AS component_id
FROM d LEFT JOIN c USING (rid) LEFT JOIN m USING (root)
"""
