"""Shared helpers: reading, Arrow text access, durable intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Most rows and bytes of an Arrow batch, the same for every operator.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2048, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def small_batches(spark: SparkSession) -> None:
    """Bound what one Python worker holds at once, by rows and by bytes. Smaller settings of the session stay."""
    for key, most in BATCH.items():
        now = spark.conf.get(key, None)
        if now is None or not str(now).isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, only a local session gets a temporary one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="skyweft-")
        context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it again: later steps survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


#: Rows of a table for which a partition is worth a task of its own.
WORTH = 1 << 13


def parts_for(table: DataFrame) -> int:
    """How many partitions tables of about as many rows as this one are worth: a multiple of the cores."""
    cores = max(1, table.sparkSession.sparkContext.defaultParallelism)
    return cores * max(1, -(-table.count() // (WORTH * cores)))


def merged(table: DataFrame, parts: int | None) -> DataFrame:
    """table in at most so many tasks (None: as it is). Rows stay in their partitions' order; no key is split."""
    return table if parts is None else table.coalesce(parts)


def discard(*tables: DataFrame) -> None:
    """Delete tables that durable() wrote, once nothing that is still to run reads them."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.durable_path)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def broadcast_if_small(table: DataFrame, most: int = 100_000) -> DataFrame:
    """table, which durable() wrote, with a broadcast hint if it has at most `most` rows; beyond that Spark's own choice."""
    from pyspark.sql import functions as F

    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def free_name(docs: DataFrame, name: str) -> str:
    """name, with underscores after it until docs has no column of that name in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, UTF-8 bytes of their texts, offsets) for runs of rows of about `limit` bytes.

    A null text counts as empty. A text is never cut: one beyond the limit makes a run of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index("text"))
        texts = pc.fill_null(texts.cast(pa.string()), "")
        n = len(texts)
        _, places, data = texts.buffers()
        offsets = np.frombuffer(places, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        start = 0
        while start < n:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            stop = min(stop, n)
            low, high = offsets[start], offsets[stop]
            yield batch.slice(start, stop - start), data[low:high], offsets[start : stop + 1] - low
            start = stop


def fold(doc_id) -> int:
    """crc32 of the id's text; the split into labelled and held-out rows is made on it."""
    return zlib.crc32(str(doc_id).encode())


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values in each [offsets[i], offsets[i+1]), zero where empty; offsets begin at 0."""
    out = np.zeros(len(offsets) - 1)
    some = np.flatnonzero(np.diff(offsets) > 0)
    if len(some):
        out[some] = np.add.reduceat(values[: offsets[-1]], offsets[some], dtype=np.float64)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, limit: int, longest: int = 1 << 16) -> list:
    """At most `limit` labelled texts as (text, label), none from the held-out fold and none of more than `longest` bytes.

    The bounded sample takes the rows with the smallest hash of doc_id, so it is the same on every run; of rows with one
    doc_id it takes one. What the driver gets is bounded by both numbers.
    """
    from pyspark.sql import functions as F

    known = labels.select("doc_id", F.col(label).cast("int").alias("_label")).where("_label in (0, 1) and doc_id is not null").dropDuplicates(["doc_id"])
    known = known.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) != held_out)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).where(F.octet_length("_text") <= longest)
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_label").agg(F.min("_text").alias("_text"))  # at most `limit` narrow rows
    return [(r[1].encode(), int(r[2])) for r in sorted(rows.select("doc_id", "_text", "_label").collect())]


def held_out(modulus: int, kept: int):
    """Whether a row is in the held-out fold; null for a null doc_id."""
    from pyspark.sql import functions as F

    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == kept


def platt(scores: np.ndarray, labels: np.ndarray, steps: int = 30) -> tuple[float, float]:
    """Slope and intercept of a logistic fit of labels on scores (Newton's method, lightly damped)."""
    x = np.stack([scores, np.ones_like(scores)], axis=1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w -= np.clip(np.linalg.solve(h, x.T @ (p - labels) + 1e-3 * w), -5, 5)
    return float(w[0]), float(w[1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LETTER = np.random.default_rng(1).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.random.default_rng(2).integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Bytes of text that are worked on together where a text is longer; it affects memory only.
WINDOW = 8 << 20


def hashed_words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash of each word, its text, its first place); `between` marks bytes that are in no word.

    Long texts go through windows that end between words, so memory follows the number of words.
    """
    if len(data) <= WINDOW:
        code, words = _hashed(data, offsets[:-1][np.diff(offsets) > 0], between)
        return code, np.searchsorted(offsets, words, "right") - 1, words
    parts, at = [], 0
    while at < len(data):
        stop = min(at + WINDOW, len(data))
        while stop < len(data) and not between[data[stop]]:
            gaps = np.flatnonzero(between[data[stop : stop + 4096]])
            stop += int(gaps[0]) if len(gaps) else 4096
        stop = min(stop, len(data))
        inside = offsets[(offsets >= at) & (offsets < stop)] - at
        code, words = _hashed(data[at:stop], inside, between)
        parts.append((code, words + at))
        at = stop
    code, words = (np.concatenate(x) for x in zip(*parts, strict=True))
    return code, np.searchsorted(offsets, words, "right") - 1, words


def _hashed(data: np.ndarray, firsts: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first place) of each word of a window; firsts: where texts begin."""
    gap = between[data]
    start = ~gap & np.concatenate([[True], gap[:-1]])[: len(data)]
    start[firsts] = ~gap[firsts]
    words = np.flatnonzero(start)
    if not len(words):
        return np.zeros(0, np.uint64), words
    place = np.arange(len(data)) - np.maximum.accumulate(np.where(start, np.arange(len(data)), 0))
    at = _PLACE[place & 4095]
    if (long := place > 4095).any():
        at = at + np.where(long, place >> 12, 0).astype(np.uint64) * _PLACE[17]
    mixed = np.where(gap, np.uint64(0), _LETTER[data] * at)
    code = np.add.reduceat(mixed, words)
    return code ^ code >> np.uint64(29), words
