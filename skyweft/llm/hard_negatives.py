"""Hard negatives by an inverted multi-index over two halves of the vectors.

Each half of a quantised vector goes to the nearest word of its codebook; the two words are a row's cell. An anchor's
inner product with a row of a cell is at most the sum of two bounds, one a half: the product with the word plus the
anchor's length times the word's radius, the largest distance of a row of that word. A multi-sequence heap pops the
cells in falling order of that sum. Rounds of growing size look up the rows of popped cells, until an anchor is
certified: no cell is left whose bound reaches the scores that it would have to beat.

This is done twice: for the best positives of each anchor, then for the best rows of other labels in the window of
scores that each positive opens. What a window still needs is its third score so far, or its lower end.

Rows of one label and one vector are folded into their smallest ids, as many as can be in a result. Cells are packed
into blocks of bounded size and the anchors that ask for a cell into chunks, so a joined row is one matrix product.
Codebooks are fitted on a bounded sample, which affects speed only: every row is indexed, and results are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import discard, durable, small_batches

#: Rows that the codebooks are fitted on; words of a codebook at most (their square bounds the number of cells).
SAMPLE, MOST_WORDS = 4096, 1024
#: Rows of a block and of a cell aimed at, and anchors of a chunk.
BLOCK, CHUNK = 512, 256
#: Rows that an anchor looks up in its first round, and how often as many in each round after it.
FIRST, GROWTH, ROUNDS = 2048, 16, 12
#: A window is 50 to 95 hundredths of a positive's score.
LOW, HIGH = 50, 95


def codebook(rows: np.ndarray, words: int, steps: int = 6) -> np.ndarray:
    """Centres of `words` groups of rows by Lloyd's steps; the first centres are spread over the rows as they come."""
    centres = rows[np.linspace(0, len(rows) - 1, words).astype(int)].astype(np.float64) if len(rows) else np.zeros((1, rows.shape[1]))
    for _ in range(steps):
        of = nearest(rows, centres)
        count = np.bincount(of, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, of, rows)
        some = count > 0
        centres[some] = total[some] / count[some, None]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1)[None, :] - 2 * rows @ centres.T, axis=1)


def cells_by_bound(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(i, j, first[i] + second[j]) of all pairs in falling order of the sum, by a heap of at most one place an i."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap = [(-(first[a[0]] + second[b[0]]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j]), -bound
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(first[a[i + 1]] + second[b[0]]), i + 1, 0))
        if j + 1 < len(b):
            heapq.heappush(heap, (-(first[a[i]] + second[b[j + 1]]), i, j + 1))


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Rows of packed 32-bit integers as float64, which holds inner products below 2**53 exactly."""
    if not len(column):
        return np.zeros((0, width))
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, width).astype(np.float64)


def _usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, q): the rows that take part, q the floors of 256 times their components."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), moved.cast("long").alias("label"), F.transform(x, lambda v: F.floor(v * 256).cast("int")).alias("q")).distinct()


def _packed(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for q in batch.column(2).to_pylist():
                row = np.zeros(width, "<i4")
                row[: len(q)] = q
                out.append(row.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "q"])

    return run


def _placed(width: int, books) -> Callable:
    """Adds the words of both halves and the distances to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = width // 2
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(batch.schema.get_field_index("q")), width)
            columns, names = [*batch.columns], [*batch.schema.names]
            for side, part in enumerate((x[:, :half], x[:, half:])):
                word = nearest(part, books.value[side])
                columns += [pa.array(word.astype(np.int32)), pa.array(np.sqrt(((part - books.value[side][word]) ** 2).sum(axis=1)))]
                names += [f"w{side}", f"r{side}"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


class Index:
    """Blocks of rows by cell, and what a task needs to bound them."""

    def __init__(self, rows: DataFrame, width: int, copies: int):
        """rows(vec_id, label, q packed), distinct; of rows of one label and vector the `copies` smallest ids stay."""
        spark = rows.sparkSession
        alike = Window.partitionBy("label", "q").orderBy("vec_id")
        folded = rows.withColumn("_place", F.row_number().over(alike)).where(F.col("_place") <= copies).drop("_place")
        groups = durable(folded.groupBy("label", "q").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))  # at most `copies` ids a row
        count = groups.count()
        self.width = width
        words = int(min(MOST_WORDS, max(1, np.ceil(np.sqrt(count / BLOCK)))))
        sample = groups.orderBy(F.xxhash64("label", "q"), "label", "q").limit(SAMPLE).select("q").toArrow().column("q").combine_chunks()
        x, half = _vectors(sample, width), width // 2
        self.books = spark.sparkContext.broadcast((codebook(x[:, :half], words), codebook(x[:, half:], words)))
        names = "label long, q binary, ids array<long>, w0 int, r0 double, w1 int, r1 double"
        placed = durable(groups.mapInArrow(_placed(width, self.books), names))
        radii = []
        for side in (0, 1):
            r = np.full(words, -1.0)
            for word, radius in placed.groupBy(f"w{side}").agg(F.max(f"r{side}")).collect():  # at most MOST_WORDS rows
                r[word] = radius
            radii.append(r)
        sizes = np.zeros((words, words), np.int64)
        for i, j, n in placed.groupBy("w0", "w1").count().collect():  # at most MOST_WORDS squared
            sizes[i, j] = n
        self.directory = spark.sparkContext.broadcast((*radii, sizes))
        blocks = F.pmod(F.xxhash64("label", "q"), F.greatest(F.lit(1), F.ceil(F.col("count") / BLOCK)).cast("int"))
        counted = placed.join(F.broadcast(placed.groupBy("w0", "w1").count()), ["w0", "w1"])
        cell = (F.col("w0") * words + F.col("w1")).alias("cell")
        packed = counted.select(cell, blocks.alias("block"), "label", "q", "ids").groupBy("cell", "block").agg(F.collect_list(F.struct("label", "q", "ids")).alias("rows"))
        self.blocks, self.words = durable(packed), words
        discard(groups, placed)


def _popped(index: Index, rows_to_see: int) -> Callable:
    """(key, q, done, least, most, ...) -> the anchor's next cells, and how many it has popped then.

    A cell that can't reach `least` ends the search. One that surely exceeds `most` is passed over.
    """
    books, directory, width = index.books, index.directory, index.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (c0, c1), (r0, r1, sizes) = books.value, directory.value
        half = width // 2
        for batch in batches:
            out: dict[str, list] = {"key": [], "cells": [], "popped": [], "over": []}
            q = _vectors(batch.column(1), width)
            for key, x, done, least, most in zip(batch.column(0).to_pylist(), q, *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                centre = [c0 @ x[:half], c1 @ x[half:]]
                reach = [np.linalg.norm(x[:half]) * r0, np.linalg.norm(x[half:]) * r1]
                first, second = (np.where(r < 0, -np.inf, c + w) for c, w, r in zip(centre, reach, (r0, r1), strict=True))
                slack = 1 + 1e-9 * (np.abs(x) @ np.abs(x) + max(abs(c).max() for c in centre))  # rounding never hides a row
                cells, popped, seen, over = [], 0, 0, True
                for i, j, bound in cells_by_bound(first, second):
                    if bound == -np.inf or least is not None and bound + slack < least:
                        break
                    popped += 1
                    if popped <= done or not sizes[i, j]:
                        continue
                    if most is not None and centre[0][i] + centre[1][j] - reach[0][i] - reach[1][j] - slack > most:
                        continue
                    if seen >= rows_to_see:
                        popped, over = popped - 1, False
                        break
                    cells.append(i * len(r1) + j)
                    seen += int(sizes[i, j])
                for name, value in zip(out, (key, cells, popped, over), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("key", pa.int64()), ("cells", pa.list_(pa.int32())), ("popped", pa.int64()), ("over", pa.bool_())]))

    return run


def _best(score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` highest scores, ties by smaller id."""
    if len(score) > 8 * most:
        some = np.flatnonzero(score >= np.partition(score, len(score) - most)[len(score) - most])
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))[:most]]


def _scored(width: int, positives: bool, most: int) -> Callable:
    """Joined blocks and chunks -> (key, slot, score, vec_id): the best rows of a block for each anchor, window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, asked in zip(batch.column(0), batch.column(1), strict=True):
                rows, asked = rows.values, asked.values
                x, a = (_vectors(part.field("q"), width) for part in (rows, asked))
                lists = rows.field("ids")
                of = np.repeat(np.arange(len(rows)), np.diff(np.asarray(lists.offsets)))
                ids, label = np.asarray(lists.flatten()), np.asarray(rows.field("label"))
                scores = np.rint(a @ x.T).astype(np.int64)
                out: list[list] = [[], [], [], []]
                for k, anchor in enumerate(asked.to_pylist()):
                    same = label == anchor["label"]
                    mine = scores[k]
                    for slot, window in enumerate(anchor["windows"]):
                        good = (same if positives else ~same) & (mine >= window["low"]) & (mine <= window["high"])
                        at = np.flatnonzero(good[of])
                        if positives:
                            at = at[ids[at] != anchor["vec_id"]]
                        if len(at):
                            at = at[_best(mine[of[at]], ids[at], most)]
                            for o, v in zip(out, (np.full(len(at), anchor["key"]), np.full(len(at), slot), mine[of[at]], ids[at]), strict=True):
                                o.append(v)
                if out[0]:
                    key, slot, score, vec_id = (np.concatenate(o) for o in out)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(slot.astype(np.int32)), pa.array(score), pa.array(vec_id)], ["key", "slot", "score", "vec_id"])

    return run


#: Beyond any inner product of 64-bit sums; an open end of a window.
FAR = 1 << 62


def search(index: Index, anchors: DataFrame, positives: bool, most: int) -> DataFrame:
    """anchors(key, vec_id, label, q, windows array<struct<low, high>>) -> (key, slot, place, score, vec_id).

    The `most` best rows of each window (slot), of the anchor's label and without its own id, or of all other labels.
    """
    found = None
    state = durable(anchors.select("*", F.lit(0).cast("long").alias("done")))
    width, see = index.width, FIRST
    for number in range(ROUNDS):
        asked = state.select("key", "q", "done", F.array_min("windows.low").alias("least"), F.array_max("windows.high").alias("most"))
        last = number == ROUNDS - 1
        next_cells = durable(asked.mapInArrow(_popped(index, FAR if last else see), "key long, cells array<int>, popped long, over boolean"))
        rows = next_cells.select("key", F.explode("cells").alias("cell")).join(state.drop("done"), "key")
        sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
        chunk = F.pmod(F.xxhash64("key"), F.col("chunks"))
        chunks = rows.join(sizes, "cell").groupBy("cell", chunk.alias("chunk")).agg(F.collect_list(F.struct("key", "vec_id", "label", "q", "windows")).alias("asked"))
        met = index.blocks.join(chunks, "cell").select("rows", "asked").mapInArrow(_scored(width, positives, most), "key long, slot int, score long, vec_id long")
        if found is not None:
            met = met.union(found.select(met.columns))
        ranked = met.withColumn("place", F.row_number().over(Window.partitionBy("key", "slot").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= most)
        found = durable(ranked.select("key", "slot", "place", "score", "vec_id"))
        full = found.groupBy("key", "slot").agg(F.count("*").alias("n"), F.min("score").alias("lowest")).where(F.col("n") == most)
        full = full.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("slot", "lowest"))).alias("reached"))  # a window is one entry
        raised = F.transform("windows", lambda w, i: F.struct(F.coalesce(F.element_at("reached", i.cast("int")), w.low).alias("low"), w.high.alias("high")))
        left = state.join(next_cells.where("not over").select("key", "popped"), "key").join(full, "key", "left")
        left = left.withColumn("windows", F.when(F.col("reached").isNull(), F.col("windows")).otherwise(raised)).withColumn("done", F.col("popped"))
        old, state = state, durable(left.select(*state.columns))
        discard(old, next_cells)
        if last or state.isEmpty():
            return found
        see *= GROWTH
    return found


def mine(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3) -> DataFrame:
    """rows(vec_id, label, embedding) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the ids divisible by `every`. Rows without an id, a label or a vector, and those with a component that is
    null or not finite, take no part. Rows that agree in id, label and vector count once; a row with the anchor's id is no
    positive of it; several different rows of an anchor's id are an anchor each. Vectors of unequal lengths are filled up
    with zeros. Scores are exact up to 2**53. Ties go to the smaller id; an empty table gives no rows.
    """
    small_batches(rows.sparkSession)
    usable = durable(_usable(rows.select("vec_id", "label", "embedding")))
    width = 2 * -(-max(1, usable.agg(F.max(F.size("q"))).first()[0] or 1) // 2)
    packed = durable(usable.mapInArrow(_packed(width), "vec_id long, label long, q binary"))
    index = Index(packed, width, positives + 1)
    window = lambda low, high: F.array(F.struct(low.cast("long").alias("low"), high.cast("long").alias("high")))
    anchors = durable(packed.where(F.col("vec_id") % every == 0).select(F.monotonically_increasing_id().alias("key"), "*"))
    near = search(index, anchors.select("*", window(F.lit(-FAR), F.lit(FAR)).alias("windows")), True, positives)
    near = near.select("key", (F.col("place") - 1).alias("slot"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id"))
    score: Column = F.col("positive_score")
    windows = near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("slot", F.ceil(LOW * score / 100).alias("low"), F.floor(HIGH * score / 100).alias("high")))).alias("w"))
    windows = windows.select("key", F.transform("w", lambda w: F.struct(w.low.cast("long").alias("low"), w.high.cast("long").alias("high"))).alias("windows"))
    found = search(index, anchors.join(windows, "key"), False, negatives)
    named = near.join(anchors.select("key", F.col("vec_id").alias("anchor_id")), "key")
    return found.join(named, ["key", "slot"]).select(
        "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
