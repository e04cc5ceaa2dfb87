"""SimHash near-duplicates found by anchor-point covering.

A 64-bit fingerprint is cut into three parts. Two fingerprints that differ in at most four bits differ in
at most one bit of some part. On each part the anchors are the words of a covering code: the perfect
[15,11] Hamming code on fifteen bits (covering radius one) times all words of the remaining bits. A
fingerprint lives at the anchor that its part decodes to and is replicated to every other anchor to which a
word one bit away (the threshold left for the part) decodes, so one of any two linked fingerprints visits
the other's home. Of the two only the visit to the smaller anchor is made, about 23 rows a fingerprint.

Fingerprints are compared per anchor, in tiles: an anchor with more than `tile` rows is cut into blocks,
every pair of blocks is a task's work of bounded size, and each tile returns a spanning forest only. Exact
copies share a fingerprint and are folded before any of this.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import broadcast_if_small, durable, small_batches, text_chunks
from .components import roots, with_least

SHINGLE = 4
SEED = 42
#: (lowest bit, width) of each part.
PARTS = ((0, 21), (21, 21), (42, 22))
CODE_BITS = 15


#: Bytes of a text whose words are held together; it affects memory only.
RUN = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _word_runs(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in runs of about RUN bytes."""
    at = 0
    while len(text) - at > RUN:
        space = _SPACE.search(text, at + RUN)
        if not space:
            break
        yield text[at : space.start()].split()
        at = space.start()
    yield text[at:].split()


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority of the bits of the XXH64 of word shingles; text without a word gives zero."""
    of, ones, count, kept = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for words in _word_runs(text.lower()):  # bytes: A-Z only, ASCII white space only
        words = kept + words
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends = list(accumulate(len(w) + 1 for w in words))
            starts = [0, *ends[:-1]]
            hashes = np.array([of(joined[s : e - 1], SEED) for s, e in zip(starts, ends[shingle - 1 :], strict=False)], np.uint64)
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            count += len(hashes)
        kept = words[max(0, len(words) - shingle + 1) :] if shingle > 1 else []
    if not count:
        return of(b" ".join(kept), SEED) if kept else 0
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_chunks(batches):
        raw = data.tobytes()
        out = [fingerprint(raw[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp long). Null text counts as empty; every row gives a row."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _home(word: Column) -> Column:
    """The covering code's word nearest to `word`: the syndrome names the bit to flip, zero none."""
    syndrome = F.lit(0)
    for j in range(4):
        check = sum(1 << i for i in range(CODE_BITS) if (i + 1) >> j & 1)
        syndrome = syndrome + F.bit_count(word.bitwiseAND(F.lit(check).cast("long"))).bitwiseAND(F.lit(1)) * (1 << j)
    flip = F.element_at(F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(CODE_BITS)]), syndrome.cast("int") + 1)
    return word.bitwiseXOR(flip)


def anchors(fp: str = "fp") -> Column:
    """The anchors of a fingerprint as array<long>: its homes and the smaller ones within reach."""
    def within(part: int, low: int, width: int) -> Column:
        word = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        flips = F.array(*[F.lit(m).cast("long") for m in [0, *(1 << i for i in range(width))]])
        reach = F.array_distinct(F.transform(flips, lambda m: _home(word.bitwiseXOR(m))))
        home = _home(word)
        return F.transform(F.filter(reach, lambda a: a <= home), lambda a: a + F.lit(part << 32).cast("long"))

    return F.concat(*[within(part, low, width) for part, (low, width) in enumerate(PARTS)])


def spanning(words: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """(smallest, member) for members of each component of more than one word, by search over unseen words."""
    signed, out = words.view(np.int64), []
    unseen = np.argsort(signed, kind="stable")
    while unseen.size:
        root, unseen = unseen[:1], unseen[1:]
        frontier = root
        while frontier.size and unseen.size:
            now, frontier = frontier[:64], frontier[64:]
            near = (np.bitwise_count(words[now][:, None] ^ words[unseen][None, :]) <= distance).any(axis=0)
            new, unseen = unseen[near], unseen[~near]
            frontier = np.concatenate([frontier, new])
            out += [(int(signed[root[0]]), int(x)) for x in signed[new]]
    return out


def _small(group: np.ndarray, words: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of many small groups at once, comparing rows at equal lags."""
    found = set()
    signed = words.view(np.int64)
    lag = 1
    while lag < len(words):
        same = group[lag:] == group[:-lag]
        if not same.any():
            break
        at = np.flatnonzero(same)
        at = at[np.bitwise_count(words[at] ^ words[at + lag]) <= distance]
        found.update(zip(signed[at].tolist(), signed[at + lag].tolist(), strict=True))
        lag += 1
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for a, b in found:
        a, b = sorted((root(a), root(b)))
        if a != b:
            parent[b] = a
    return [(root(x), x) for x in parent if root(x) != x]


def _linker(distance: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(key: np.ndarray, tile: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])])
            group = np.cumsum(new) - 1
            sizes = np.bincount(group)
            big = sizes[group] > 64
            out = _small(group[~big], words[~big], distance)
            starts = np.flatnonzero(new)
            for g in np.flatnonzero(sizes > 64):
                out += spanning(words[starts[g] : starts[g] + sizes[g]], distance)
            ends = np.array(out, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 1]), pa.array(ends[:, 0])], ["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [np.asarray(batch.column(i)) for i in range(3)]
            if not len(now[0]):
                continue
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            key, tile, _ = held
            cut = int(np.flatnonzero((key != key[-1]) | (tile != tile[-1]))[-1]) + 1 if key[0] != key[-1] or tile[0] != tile[-1] else 0
            if cut:
                yield links(key[:cut], tile[:cut], held[2][:cut].view(np.uint64))
                held = [x[cut:] for x in held]
        if held is not None:
            yield links(held[0], held[1], np.ascontiguousarray(held[2]).view(np.uint64))

    return link


def links(words: DataFrame, distance: int = 4, tile: int = 4096) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that join all that are within `distance` bits (at most 5)."""
    if not 0 <= distance < 2 * len(PARTS):
        raise ValueError("three parts of radius one cover distances up to 5")
    spark = words.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a fingerprint is a few bytes but makes some seventy rows here, so few partitions of them would be long tasks
    rows = words.select("fp").repartition(parts, "fp").select("fp", F.explode(anchors()).alias("key"))
    hot = durable(rows.groupBy("key").count().where(F.col("count") > tile).select("key", F.ceil(F.col("count") / tile).cast("int").alias("blocks")))
    rows = rows.join(broadcast_if_small(hot), "key", "left")
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    tiles = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(block, j) * F.col("blocks") + F.greatest(block, j))
    )
    rows = rows.select("key", F.explode(tiles).alias("tile"), "fp")
    dealt = rows.repartition(parts, "key", "tile").sortWithinPartitions("key", "tile")
    return dealt.mapInArrow(_linker(distance), "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 4) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp long, component_id long), one row for each row of docs.

    component_id is the smallest doc_id reachable over links of at most `distance` differing bits. Empty and
    null texts share fingerprint zero, which links like any other; rows with a null doc_id get their
    component's smallest id (null if it has none); repeated rows are kept; an empty table gives no rows.
    """
    marked = durable(fingerprints(docs))
    words = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    up = roots(links(words.select("fp"), distance))
    placed = words.join(up, words.fp == up.a, "left").select("fp", "least", F.coalesce("b", "fp").alias("root"))
    of = with_least(placed, "root", "least", "component_id").select("fp", "component_id")
    return marked.join(of, "fp", "left").select("doc_id", "fp", "component_id")


def hexed(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
