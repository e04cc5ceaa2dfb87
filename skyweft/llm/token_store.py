"""Token ids of documents, written in doc_id order as range-coded segments and read back.

Rows are dealt out by ranges of doc_id and sorted within; a task encodes its documents into segments of
about two million ids, each a row with its place and its bytes. Segments go to a table in a folder that the
caller names. Positions come from the segments' id counts: a running sum within each part, and the parts'
totals (one row a part) before it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import range_coder
from .base import small_batches, text_chunks
from .word_ids import word_ids

END = 0
#: Bytes of texts whose pieces are looked up together, each distinct one once; it affects speed and memory only.
RUN = 1 << 22
SEGMENT = "part int, segment int, n_docs long, n_ids long, body binary"


def _segment(ids: list, tokens: list[np.ndarray]) -> bytes:
    """Documents, blocks (uint32), then doc ids (null as the smallest long), lengths, block sizes, blocks."""
    stream = np.concatenate(tokens)
    blocks = range_coder.encode(np.array_split(stream, -(-len(stream) // range_coder.BLOCK)))
    head = struct.pack("<II", len(ids), len(blocks))
    names = np.array([-(2**63) if x is None else x for x in ids], "<i8").tobytes()
    return b"".join([head, names, np.array([len(x) for x in tokens], "<i8").tobytes(), np.array([len(x) for x in blocks], "<i8").tobytes(), *blocks])


def _opened(body: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc ids, lengths, ids) of a segment."""
    docs, count = struct.unpack("<II", body[:8])
    names = np.frombuffer(body, "<i8", docs, 8)
    lengths = np.frombuffer(body, "<i8", docs, 8 + 8 * docs)
    sizes = np.frombuffer(body, "<i8", count, 8 + 16 * docs)
    ends = 8 + 16 * docs + 8 * count + np.cumsum(sizes)
    blocks = range_coder.decode([body[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)])
    return [None if x == -(2**63) else x for x in names.tolist()], lengths, np.concatenate(blocks)


def _writer(path: str, ids_a_segment: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = word_ids(path)
        if of.library.get_vocab_size() > 1 << 16:
            raise ValueError("blocks hold ids of 16 bits; this vocabulary has more")
        part, made, ids, tokens, held = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            row = [[part], [made], [len(ids)], [held], [_segment(ids, tokens)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "segment", "n_docs", "n_ids", "body"])

        for rows, data, offsets in text_chunks(batches, RUN):
            found, places = of.ids(data, offsets)
            found = np.insert(found.astype(np.uint16), places[1:], END)
            places = (places + np.arange(len(places))).tolist()
            for doc_id, s, e in zip(rows.column(0).to_pylist(), places, places[1:], strict=False):
                ids.append(doc_id)
                tokens.append(found[s:e])
                held += len(tokens[-1])
                if held >= ids_a_segment:
                    yield flush()
                    made, ids, tokens, held = made + 1, [], [], 0
        if ids:
            yield flush()

    return write


def write(docs: DataFrame, tokenizer: str, folder: str, ids_a_segment: int = 2_000_000) -> None:
    """Encode docs(doc_id, text) into `folder`. A null or empty text is the end id alone; a null doc_id sorts
    first; rows with equal doc_id are kept, in order of their text, and may lie in several parts; an empty table gives
    no segments. Raises ValueError for a vocabulary of more than 65536 ids."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(parts, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_writer(tokenizer, ids_a_segment), SEGMENT).write.option("compression", "none").parquet(folder)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, lengths, tokens = _opened(batch.column("body")[i].as_py())
            ends = np.cumsum(lengths)
            raw = tokens.astype("<u4")
            crcs = [zlib.crc32(raw[e - n : e].tobytes()) for n, e in zip(lengths.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(batch.column("before")[i].as_py() + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in `folder`, decoded and verified."""
    segments = spark.read.schema(SEGMENT).parquet(folder)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row a part
    before, starts = 0, []
    for part, n in totals:
        starts.append((part, before))
        before += n
    starts = spark.createDataFrame(starts, "part int, first long")
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids")
    places = segments.select("part", "segment", within.alias("within")).join(starts, "part").select("part", "segment", (F.col("first") + F.col("within")).alias("before"))
    small_batches(spark)
    return segments.join(places, ["part", "segment"]).select("before", "body").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
