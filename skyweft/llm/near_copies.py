"""Near copies: SimHash fingerprints by anchor-point covering, and exact Jaccard similarity of five-word shingles.

Two texts are near copies if their sets of shingles agree in at least four fifths of their union. Fingerprints of
those shingles link most of them (see simhash): what the covering code brings together is verified on the sets and
joined into components. As a similarity of 0.8 may leave fingerprints many bits apart, the rest is found by prefixes:
with the shingles of every set in one common order, two such sets share one of their first n - ceil(0.8 n) + 1, so no
pair is missed. The order puts shingles that a sample found in many texts last; the sample decides speed only. Pairs
that the fingerprints have joined already are left out.

Candidates are verified in two steps: by counts of shingles in a few buckets, which bound the intersection from above
and are small to shuffle, and then by the whole sets. Texts of equal sets are folded before any of this.

Pairs of a shingle with many texts are taken in three steps: each text with its neighbours by size and with one
centre, then with the texts that share most frequent shingles with others, then, in tiles of bounded size, only texts
that these steps left in different components.

Each text is known by a 64-bit hash of it, so whole sets are made again only of the texts that a candidate pair asks for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .base import broadcast_if_small, discard, durable, free_name, hashed_words, merged, parts_for, small_batches, text_chunks
from .components import roots


class Rule(NamedTuple):
    """Words of a shingle, and the Jaccard similarity from which two texts are alike, as a fraction."""

    shingle: int
    part: int
    whole: int

    def alike(self, both: np.ndarray | int, m: np.ndarray | int, n: np.ndarray | int):
        """Whether sets of m and n shingles with so many in common are similar enough."""
        return (self.part + self.whole) * both >= self.part * (m + n)

    def first(self, size: np.ndarray | int):
        """Shingles of a set, in the common order, of which two sets that are alike share one."""
        return size - -(-self.part * size // self.whole) + 1


NEAR = Rule(5, 4, 5)
#: One text in so many is asked for frequent shingles: those in at least COMMON of them, MOST at most.
SAMPLE, COMMON, MOST = 16, 8, 1 << 17
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: A set's size and a place in it are one number.
SIZE_BITS = 32


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _MIX[1]
    x = (x ^ x >> np.uint64(27)) * _MIX[2]
    return x ^ x >> np.uint64(31)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = NEAR.shingle) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles text by text, ends of the texts' shares, number of each set). A text of fewer words than a shingle is one shingle."""
    n = len(offsets) - 1
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    code, doc, _ = hashed_words(lower, offsets)
    padded = np.concatenate([_mixed(code), np.zeros(shingle, np.uint64)])
    owner = np.concatenate([doc, np.full(shingle, -1)])
    mixed = np.zeros(len(code), np.uint64)
    for k in range(shingle):
        mixed = mixed * _MIX[0] + np.where(owner[k : k + len(code)] == doc, padded[k : k + len(code)], np.uint64(0))
    first = np.searchsorted(doc, np.arange(n))
    whole = (owner[shingle - 1 : shingle - 1 + len(code)] == doc) | (np.arange(len(code)) == first[doc])
    mixed, doc = _mixed(mixed[whole]), doc[whole]
    order = np.lexsort((mixed, doc))
    mixed, doc = mixed[order], doc[order]
    new = np.concatenate([[True], (mixed[1:] != mixed[:-1]) | (doc[1:] != doc[:-1])])[: len(mixed)]
    mixed, doc = mixed[new], doc[new]
    ends = np.searchsorted(doc, np.arange(n + 1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(mixed + _MIX[0]), dtype=np.uint64)])
    number = _mixed((total[ends[1:]] - total[ends[:-1]]) * _MIX[0] + np.diff(ends).astype(np.uint64))
    return mixed, ends, number.view(np.int64)


def hashed(docs: DataFrame, *columns) -> DataFrame:
    """docs(text) -> the columns given, text, and th, the hash by which it is known. A null text counts as empty."""
    return docs.select(*columns, F.col("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))


def common_shingles(texts: DataFrame, rule: Rule) -> np.ndarray:
    """Shingles in many sets of a sample of the texts, by falling count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in text_chunks(batches):
            codes, ends, number = shingle_sets(data, offsets, rule.shingle)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(number, np.diff(ends))), pa.array(codes.view(np.int64))], ["id", "key"])

    some = texts.where(F.pmod("th", F.lit(SAMPLE)) == 0).select("text")
    found = some.mapInArrow(run, "id long, key long").distinct().groupBy("key").count().where(F.col("count") >= COMMON)
    return np.array([r[0] for r in found.orderBy(F.desc("count"), "key").limit(MOST).collect()], np.int64)


def prefixes(common, rule: Rule, more: int = 0) -> Callable:
    """Texts -> (key, id, size_place) of the first shingles of their sets, and of `more` after those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = common.value.view(np.uint64)
        order = np.argsort(late)
        late = late[order]
        for _, data, offsets in text_chunks(batches):
            codes, ends, number = shingle_sets(data, offsets, rule.shingle)
            size = np.diff(ends)
            _, once = np.unique(number, return_index=True)
            taken = np.zeros(len(size), bool)
            taken[once] = True
            doc = np.repeat(np.arange(len(size)), size)
            rank = np.zeros(len(codes), np.int64)
            if len(late):
                at = np.minimum(np.searchsorted(late, codes), len(late) - 1)
                rank = np.where(late[at] == codes, len(late) - order[at], 0)  # the most frequent last
            codes = codes[np.lexsort((codes, rank, doc))]
            place = np.arange(len(codes)) - ends[doc]
            some = taken[doc] & (place < rule.first(size)[doc] + more)
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes[some].view(np.int64)), pa.array(number[doc[some]]), pa.array(size[doc[some]] << SIZE_BITS | place[some])], ["key", "id", "size_place"]
            )

    return run


def possible(a: np.ndarray, b: np.ndarray, rule: Rule, before: int | np.ndarray = 0) -> np.ndarray:
    """Whether two sets can be alike if they share this shingle and at most `before` earlier ones; a, b: size and place."""
    (m, i), (n, j) = ((x >> SIZE_BITS, x & ((1 << SIZE_BITS) - 1)) for x in (a, b))
    return rule.alike(np.minimum(m - i, n - j) + before, m, n)


def groups_of(batches: Iterator[pa.RecordBatch], names: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches again, cut only where the first `names` columns change."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        now = [np.asarray(x) for x in batch.columns]
        if not len(now[0]):
            continue
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        other = np.flatnonzero(np.any([c != c[-1] for c in held[:names]], axis=0))
        if len(other):
            cut = int(other[-1]) + 1
            yield [x[:cut] for x in held]
            held = [x[cut:] for x in held]
    if held is not None:
        yield held


def _candidates(most: int, rule: Rule) -> Callable:
    """Sorted (key, id, size_place) -> pairs (id, other), and the rows of keys with more than `most` sets, other null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ident, sp in groups_of(batches, 1):
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (ident[1:] != ident[:-1])])
            key, ident, sp = key[new], ident[new], sp[new]
            order = np.lexsort((ident, sp, key))
            key, ident, sp = key[order], ident[order], sp[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.append(starts, len(key)))
            group = np.repeat(np.arange(len(starts)), count)
            large = (count > most)[group]
            ends: list[tuple[np.ndarray, np.ndarray]] = []
            for lag in range(1, min(int(count.max()), most)):
                at = np.flatnonzero((group[lag:] == group[:-lag]) & ~large[lag:]) if lag > 1 else np.flatnonzero(group[1:] == group[:-1])
                ends.append((at, at + lag))
            centre = np.lexsort((ident, group))[starts]  # the smallest number, which keys of one group of copies have in common
            rest = np.flatnonzero(large)
            ends.append((rest, centre[group[rest]]))
            a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
            good = possible(sp[a], sp[b], rule) & (ident[a] != ident[b])
            a, b = ident[a[good]], ident[b[good]]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0]), pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 1])], ["key", "id", "size_place", "other"])
            yield pa.RecordBatch.from_arrays([pa.array(key[rest]), pa.array(ident[rest]), pa.array(sp[rest]), pa.nulls(len(rest), pa.int64())], ["key", "id", "size_place", "other"])

    return run


def _across(rule: Rule, before: int, nearest: int | None = None) -> Callable:
    """Sorted (key, tile, id, size_place, root, counts) -> the pairs of each tile that are in different components and may be
    similar by place, size and counts, if at most `before` shingles that they share come before this one.

    With `nearest`, only so many likeliest ones of each set, and a row of its key alone for a set that had more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, tile, ident, sp, root, counts in groups_of(batches, 2):
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])]))
            few, full = np.zeros((len(key), BUCKETS), np.int64), np.zeros(len(key), bool)
            for i, raw in enumerate(counts):
                x = np.frombuffer(raw, np.uint8)
                few[i], full[i] = x.reshape(-1, BUCKETS).sum(axis=0, dtype=np.int64), (x == 255).any()
            size = sp >> SIZE_BITS
            for s, e in zip(starts, [*starts[1:], len(key)], strict=True):
                for i in range(s, e):
                    some = i + 1 + np.flatnonzero((root[i + 1 : e] != root[i]) & possible(sp[i], sp[i + 1 : e], rule, before))
                    if len(some):
                        both = np.minimum(few[some], few[i]).sum(axis=1)
                        may = rule.alike(both, size[some], size[i]) | full[some] | full[i]
                        some = some[may]
                        both = _most_shared(counts[i], counts[some].tolist())
                        may = rule.alike(both, size[some], size[i])
                        some, both = some[may], both[may]
                        more = nearest is not None and len(some) > nearest
                        if more:
                            some = some[np.argsort(-both / (size[some] + size[i]), kind="stable")[:nearest]]
                        ends = pa.array(np.minimum(ident[some], ident[i])), pa.array(np.maximum(ident[some], ident[i]))
                        yield pa.RecordBatch.from_arrays([*ends, pa.nulls(len(some), pa.int64())], ["a", "b", "key"])
                        if more:
                            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([key[i]])], ["a", "b", "key"])

    return run


#: Buckets of the smallest count of shingles; a larger set has one to two buckets for each of its shingles.
BUCKETS = 64
#: Sets whose counts are compared at once.
RUN = 256
#: Hashes of texts, of eight bytes each, that go to all tasks at once.
ASKED = 1 << 20


def bucket_counts(codes: np.ndarray) -> np.ndarray:
    """How many shingles of a set fall in each bucket (at most 255 are counted); the buckets are a power of two."""
    many = max(BUCKETS, 1 << len(codes).bit_length())
    return np.minimum(np.bincount((codes >> np.uint64(40)).astype(np.int64) & (many - 1), minlength=many), 255).astype(np.uint8)


def may_agree(x: np.ndarray, y: np.ndarray, m: int, n: int, rule: Rule = NEAR) -> bool:
    """Whether sets of m and n shingles with these counts can be similar enough. Never false for a pair that is."""
    return bool(rule.alike(_shared(x, y), m, n))


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """The most shingles that sets with these counts can have in common."""
    if (x == 255).any() or (y == 255).any():
        return 1 << SIZE_BITS
    while len(x) > len(y):
        x = x.reshape(2, -1).sum(axis=0, dtype=np.int64)
    while len(y) > len(x):
        y = y.reshape(2, -1).sum(axis=0, dtype=np.int64)
    return int(np.minimum(x, y).sum(dtype=np.int64))


def _most_shared(one: bytes, others: list[bytes]) -> np.ndarray:
    """_shared() of one set's counts with each of the others'."""
    x, out = np.frombuffer(one, np.uint8), np.zeros(len(others), np.int64)
    alike = [k for k, y in enumerate(others) if len(y) == len(one)]
    for start in range(0, len(alike), RUN):
        run = alike[start : start + RUN]
        y = np.frombuffer(b"".join([others[k] for k in run]), np.uint8).reshape(len(run), -1)
        out[run] = np.where((y == 255).any(axis=1) | (x == 255).any(), 1 << SIZE_BITS, np.minimum(x, y).sum(axis=1, dtype=np.int64))
    for k in set(range(len(others))).difference(alike):
        out[k] = _shared(x, np.frombuffer(others[k], np.uint8))
    return out


def marks_of(rule: Rule, prints: bool = True) -> Callable:
    """Texts (text, th) -> (th, id, size, counts, fp) of the different ones of a run; fp is null if it isn't asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches):
            th = np.asarray(rows.column(1))
            _, once = np.unique(th, return_index=True)
            codes, ends, number = shingle_sets(data, offsets, rule.shingle)
            counts = [bucket_counts(codes[ends[i] : ends[i + 1]]).tobytes() for i in once]
            fp = pa.nulls(len(once), pa.int64())
            if prints:
                raw = data.tobytes()
                fp = pa.array(np.array([simhash.fingerprint(raw[offsets[i] : offsets[i + 1]], rule.shingle) for i in once], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(th[once]), pa.array(number[once]), pa.array(np.diff(ends)[once]), pa.array(counts, pa.binary()), fp], ["th", "id", "size", "counts", "fp"])

    return run


def known(texts: DataFrame, rule: Rule, prints: bool = True, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(th, id, size, ...) of each different text, and the same of one text of each set; both durable."""
    seen = texts.mapInArrow(marks_of(rule, prints), "th long, id long, size long, counts binary, fp long").dropDuplicates(["th"])
    seen = durable(merged(seen, parts))
    return seen, durable(merged(seen.dropDuplicates(["id"]), parts))


def _sift(rule: Rule) -> Callable:
    """(a, b, m, x, n, y) -> the pairs that may be similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = (np.asarray(batch.column(i)) for i in (2, 4))
            keep = rule.alike(np.minimum(m, n), m, n)
            for i in np.flatnonzero(keep).tolist():
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint8) for c in (3, 5))
                keep[i] = may_agree(x, y, int(m[i]), int(n[i]), rule)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return run


def _verify(rule: Rule) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                keep.append(bool(rule.alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(rule: Rule) -> Callable:
    """(id, codes) of the sets of a run of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in text_chunks(batches):
            codes, ends, number = shingle_sets(data, offsets, rule.shingle)
            _, once = np.unique(number, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(number[once]), pa.array([codes[ends[i] : ends[i + 1]].tobytes() for i in once], pa.binary())], ["id", "codes"])

    return run


def _ends(table: DataFrame, pairs: DataFrame, *columns: str, parts: int | None) -> DataFrame:
    """pairs (a, b) with `columns` of either end, of a table with one row an id."""
    left = table.select(F.col("id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    right = table.select(F.col("id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    met = merged(merged(pairs.join(left, "a"), parts).join(right, "b"), parts)
    return met.select("a", "b", *[f"{c}_a" for c in columns], *[f"{c}_b" for c in columns])


def verified(texts: DataFrame, marks: DataFrame, pairs: DataFrame, rule: Rule, parts: int | None = None) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. Sets are made of the texts that marks name for them."""
    sifted = durable(_ends(marks, merged(pairs.distinct(), parts), "size", "counts", parts=parts).mapInArrow(_sift(rule), "a long, b long"))
    asked = sifted.select(F.col("a").alias("id")).union(sifted.select("b")).distinct().transform(merged, parts)
    asked = durable(merged(marks.join(asked, "id").select("th"), parts))
    found = texts.join(broadcast_if_small(asked, ASKED), "th", "left_semi").select("text").mapInArrow(_sets(rule), "id long, codes binary")
    sets = durable(merged(found.dropDuplicates(["id"]), parts))
    out = durable(_ends(sets, sifted, "codes", parts=parts).mapInArrow(_verify(rule), "a long, b long"))
    discard(sets, sifted, asked)
    return out


def _by_fingerprint(marks: DataFrame) -> DataFrame:
    """Candidate pairs of sets: those whose fingerprints the covering code links, and those of one fingerprint."""
    first = durable(marks.groupBy("fp").agg(F.min("id").alias("least")))
    near = simhash.links(first.select("fp"))
    ends = near.join(first.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    same = marks.select("fp", "id").join(first, "fp").where("id <> least").select(F.col("id").alias("x"), F.col("least").alias("y"))
    return ends.select("x", "y").union(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def components(docs: DataFrame, most: int = 16, tile: int = 2048, rule: Rule = NEAR) -> tuple[DataFrame, DataFrame]:
    """docs(text) -> (th, id) of each different text, and (a, b): the id of each set that isn't its component's smallest,
    and that smallest id.

    Null texts count as empty; texts without a word are one set. `most` and `tile` affect speed only.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = hashed(docs)
    few = parts_for(docs)
    seen, marks = known(texts, rule, parts=few)
    near = verified(texts, marks, _by_fingerprint(marks), rule, few)
    common = spark.sparkContext.broadcast(common_shingles(texts, rule))
    rows = texts.select("text").mapInArrow(prefixes(common, rule), "key long, id long, size_place long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = durable(merged(rows.repartition(parts, "key").sortWithinPartitions("key", "id"), few).mapInArrow(_candidates(most, rule), "key long, id long, size_place long, other long"))
    up = roots(near, parts=few)
    pairs = _apart(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct().transform(merged, few), up, few)
    links = up.union(verified(texts, marks, pairs, rule, few))
    up = settled(texts, marks, links, found.where("other is null").select("key", "id", "size_place"), tile, rule, parts=few)
    return seen.select("th", "id"), up


#: Sets of a frequent shingle that all others of it are compared with before tiles are.
CENTRES = 4
#: Likeliest partners of a set in a tile that are verified before all others that are still in different components.
NEAREST = 4


def _apart_at(hot: DataFrame, links: DataFrame, parts: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Components of the links, hot rows of the keys whose sets are in several (with their root), and (key, n) of those keys."""
    up = roots(links, parts=parts)
    placed = hot.join(up.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").select("key", "id", "size_place", F.coalesce("root", "id").alias("root"))
    placed = durable(merged(placed, parts))
    mixed = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    keys = durable(merged(mixed.select("key", "n"), parts))
    return up, merged(placed.join(broadcast_if_small(keys), "key"), parts), keys


def settled(texts: DataFrame, marks: DataFrame, links: DataFrame, hot: DataFrame, tile: int, rule: Rule, before: int = 0, parts: int | None = None) -> DataFrame:
    """Components of links and of what is alike among the sets (key, id, size_place) that share a frequent shingle.

    Sets are first compared with a few centres of each shingle, which share most frequent shingles with other sets, and
    then in tiles of bounded size, but for those that are in one component by then. A tile gives the likeliest partners of
    each set first, which join a dense group by a few links a set and not by all of its pairs; where sets had more of
    them, what is still in different components is compared in full. `before`: how many shingles two sets may share, in
    the common order, before the first frequent one without being linked yet. `parts`: see parts_for.
    """
    up, placed, keys = _apart_at(hot, links, parts)
    if keys.isEmpty():
        return up
    central = merged(placed.groupBy("id").agg(F.sum("n").alias("weight")), parts)
    by_weight = Window.partitionBy("key").orderBy(F.desc("weight"), "id")
    top = merged(placed.join(central, "id"), parts).withColumn("nth", F.row_number().over(by_weight)).where(F.col("nth") <= CENTRES)
    top = durable(merged(top.select("key", F.col("id").alias("centre"), F.col("root").alias("other"), F.shiftright("size_place", SIZE_BITS).alias("wide")), parts))
    size = F.shiftright("size_place", SIZE_BITS)
    wanted = (placed.key == top.key) & (F.col("root") != F.col("other")) & rule.alike(F.least(size, "wide"), size, F.col("wide"))
    pairs = placed.join(broadcast_if_small(top), wanted).select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"))
    up, placed, keys = _apart_at(hot, up.union(verified(texts, marks, pairs, rule, parts)), parts)  # stars take fewer rounds than the links they stand for
    if keys.isEmpty():
        return up
    first = durable(_in_tiles(placed, marks, tile, parts).mapInArrow(_across(rule, before, NEAREST), "a long, b long, key long"))
    links = up.union(verified(texts, marks, first.where("a is not null").select("a", "b"), rule, parts))
    crowded = durable(merged(first.where("a is null").select("key").distinct(), parts))
    if crowded.isEmpty():
        return roots(links, parts=parts)
    up, placed, keys = _apart_at(hot.join(broadcast_if_small(crowded), "key", "left_semi"), links, parts)
    if keys.isEmpty():
        return up
    pairs = _in_tiles(placed, marks, tile, parts).mapInArrow(_across(rule, before), "a long, b long, key long").select("a", "b")
    return roots(up.union(verified(texts, marks, pairs, rule, parts)), parts=parts)


def _in_tiles(placed: DataFrame, marks: DataFrame, tile: int, parts: int | None) -> DataFrame:
    """(key, id, size_place, root, n) -> (key, tile, id, size_place, root, counts), sorted: any two sets of a key meet in a tile."""
    dealt_in = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.withColumn("blocks", F.ceil(F.col("n") / tile).cast("int")).join(marks.select("id", "counts"), "id").transform(merged, parts)
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(block, j) * F.col("blocks") + F.greatest(block, j))
    dealt = placed.select("key", F.explode(tiles).alias("tile"), "id", "size_place", "root", "counts").repartition(dealt_in, "key", "tile").sortWithinPartitions("key", "tile")
    return merged(dealt, parts)


def _apart(pairs: DataFrame, up: DataFrame, parts: int | None) -> DataFrame:
    """The pairs whose ends aren't in one component yet."""
    for end in ("a", "b"):
        root = up.select(F.col("a").alias(end), F.col("b").alias(f"_{end}"))
        pairs = merged(pairs.join(root, end, "left"), parts).withColumn(f"_{end}", F.coalesce(f"_{end}", end))
    return pairs.where("_a <> _b").select("a", "b")


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each component of near copies: the smallest id, nulls last, then the smallest hash of the row.

    Rows of equal or no ids are told apart by their texts and other columns; nothing is dropped for its id alone.
    Columns of any name and type come back as they were.
    """
    seen, up = components(docs)
    of = seen.join(up, seen.id == up.a, "left").select("th", F.coalesce("b", "id").alias("root"))
    row, th = free_name(docs, "_row"), free_name(docs, "_th")
    column = lambda f: F.col(f"`{f.name}`").cast("string") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    marked = docs.withColumn(row, F.xxhash64(*map(column, docs.schema.fields))).withColumn(th, F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("row"), F.col(th).alias("th"))
    placed = rows.join(broadcast_if_small(durable(of)), "th")
    least = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "th")).alias("least")).select(F.col("least.row").alias(row), F.col("least.th").alias(th))
    return marked.join(broadcast_if_small(durable(least)), [row, th], "left_semi").dropDuplicates([row, th]).drop(row, th)
