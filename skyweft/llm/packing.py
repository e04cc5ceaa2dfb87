"""Cost-balanced packing of token ids into sequences.

Documents are packed in groups of bounded size, where they lie: no shuffle, one pass, and a group's result
depends on its rows alone. Full sequences are cut from the front of long documents. The rests go, by
descending estimated cost, to the sequence of lowest cost that still has room; those for which no sequence
has room are cut over the room that is left. A group opens as many full sequences as its rests fill and, for
what is left over, sequences of the powers of two that add up to it, which need no padding either.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import small_batches, text_chunks
from .word_ids import word_ids

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
END = 0


def cost(length, linear: float = 1.0, quadratic: float = 1 / 512):
    """Estimated cost of `length` tokens attended together: linear layers plus quadratic attention."""
    return linear * length + quadratic * length * length


def plan(lengths: list[int], room: int = 1024) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that place every token once; sequences count from 0."""
    out, made, rests = [], 0, []
    for i, n in enumerate(lengths):
        for k in range(n // room):
            out.append((i, k * room, room, made, 0))
            made += 1
        if n % room:
            rests.append((n % room, i))
    total = sum(n for n, _ in rests)
    rooms = np.array([room] * (total // room) + [1 << b for b in range(room.bit_length() - 1, -1, -1) if total % room >> b & 1], np.int64)
    left, spent = rooms.copy(), np.zeros(len(rooms))
    cut = []

    def put(i: int, start: int, n: int, at: int) -> None:
        out.append((i, start, n, made + at, int(rooms[at] - left[at])))
        left[at] -= n
        spent[at] += cost(n)

    for n, i in sorted(rests, key=lambda x: (-x[0], x[1])):
        at = int(np.argmin(np.where(left >= n, spent, np.inf)))
        if left[at] >= n:
            put(i, lengths[i] - n, n, at)
        else:
            cut.append((n, i))
    open_ = [int(x) for x in np.argsort(left, kind="stable") if left[x]]
    for n, i in cut:
        while n:
            at = open_[-1]
            take = min(n, int(left[at]))
            put(i, lengths[i] - n, take, at)
            n -= take
            if not left[at]:
                open_.pop()
    return out


def _packer(path: str, room: int, docs_a_group: int, tokens_a_group: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = word_ids(path)
        base, ids, tokens = TaskContext.get().partitionId() << 40, [], []

        def flush() -> pa.RecordBatch:
            nonlocal base
            rows = plan([len(x) for x in tokens], room)
            made = 1 + max((r[3] for r in rows), default=-1)
            crcs = [zlib.crc32(tokens[i][s : s + n].tobytes()) for i, s, n, _, _ in rows]
            columns = np.array(rows, np.int64).reshape(-1, 5)
            out = pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in columns[:, 0]], pa.int64()), pa.array(columns[:, 1]), pa.array(columns[:, 2]), pa.array(crcs, pa.int64()), pa.array([len(tokens[i]) for i in columns[:, 0]], pa.int64()), pa.array(columns[:, 3] + base), pa.array(columns[:, 4])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            base += made
            ids.clear()
            tokens.clear()
            return out

        held = 0
        for rows, data, offsets in text_chunks(batches):
            found, places = of.ids(data, offsets)
            found = np.insert(found, places[1:], END)
            places = (places + np.arange(len(places))).tolist()
            for doc_id, s, e in zip(rows.column(0).to_pylist(), places, places[1:], strict=False):
                now = found[s:e]
                if tokens and (held + len(now) > tokens_a_group or len(tokens) >= docs_a_group):
                    yield flush()
                    held = 0
                ids.append(doc_id)
                tokens.append(now)
                held += len(now)
        if tokens:
            yield flush()

    return pack


def pack(docs: DataFrame, tokenizer: str, room: int = 1024, docs_a_group: int = 4096, tokens_a_group: int = 4_000_000) -> DataFrame:
    """docs(doc_id, text) -> pieces of sequences of at most `room` tokens (a power of two).

    A document's tokens are its ids and an end id 0; a null or empty text is that end id alone. Rows with a
    null or repeated doc_id are packed like others. An empty table gives no pieces.
    """
    if room & (room - 1):
        raise ValueError("room must be a power of two")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_packer(tokenizer, room, docs_a_group, tokens_a_group), SCHEMA)
