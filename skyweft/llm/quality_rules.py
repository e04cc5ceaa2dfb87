"""Quality rules: text statistics and n-gram perplexity bands.

The language model is modified Kneser-Ney over n-grams of five characters (whole code points, any script). Tasks add up
the n-grams of their texts and Spark adds up the tasks' counts; lower orders count the characters met before an
n-gram, and probabilities are interpolated order by order in joins, keyed by language, so any number of languages
shares the tables and nothing of them is capped. Texts are dealt into two folds by a hash of the text; a text is
scored by the model counted on the other fold, so junk doesn't vouch for itself and exact copies don't for each other.

For scoring, the n-grams met most often (a fixed number, so of bounded size) go to all tasks as sorted arrays of
64-bit hashes with log losses, found by the hash's first bits. The n-grams of a text that aren't among them are
joined to the whole model and their losses are added by text: every n-gram of every text counts.

A document outside its language's band is rejected: above if its mean loss a word (ideographs and kana are words by
themselves here) is over the upper quartile by `width` times that quartile's distance from the median, below
likewise. Equal texts count once in the quartiles.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import broadcast_if_small, discard, durable, hashed_words, row_sums, small_batches, text_chunks

ORDER = 5
#: n-grams that every task holds when it scores (16 bytes each), and n-grams that a task holds while it counts.
CORE, HELD = 1 << 18, 1 << 21
#: Positions that are worked on together; it affects memory only.
SLICE = 1 << 20
#: Least distance of a quartile from the median in a band, as a share of the median.
LEAST_SPREAD = 0.005
#: Discounts fitted to few n-grams could be zero and leave nothing to the lower orders.
LEAST_DISCOUNT = 0.1
_C = np.arange(256)
_SYMBOL = np.isin(_C, [*b"#*$%&|<>"])
_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Characters as the model sees them below U+3001: ASCII case folded, digits alike, white space and controls a space.
_SEEN = np.arange(0x3001, dtype=np.uint32)
_SEEN[:33] = _SEEN[[0x7F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 32
_SEEN[65:91] += 32
_SEEN[48:58] = 48


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    n = len(offsets) - 1
    code, doc, _ = hashed_words(data, offsets)
    space = np.isin(_C, [9, 10, 11, 12, 13, 32])
    chars = ((_C & 0xC0) != 0x80) & ~space
    out = {"n_words": np.bincount(doc, minlength=n), "word_chars": row_sums(chars[data], offsets).astype(np.int64), "n_symbols": row_sums(_SYMBOL[data], offsets).astype(np.int64)}
    raw, dup = data.tobytes(), []
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        lines = [x for x in raw[s:e].split(b"\n") if x.strip()]
        dup.append(len(lines) - len(set(lines)))
    out["n_dup_lines"] = np.array(dup, np.int64)
    covered = np.zeros(len(code), bool)
    if len(code) >= 8:
        windows = len(code) - 7
        mixed = np.zeros(windows, np.uint64)
        for k in range(8):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + code[k : k + windows]
        whole = np.flatnonzero(doc[:windows] == doc[7:])
        order = whole[np.lexsort((mixed[whole], doc[whole]))]
        same = (mixed[order[1:]] == mixed[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
        again = np.zeros(len(order), bool)
        again[1:] |= same
        again[:-1] |= same
        edge = np.zeros(len(code) + 1, np.int64)
        np.add.at(edge, order[again], 1)
        np.add.at(edge, order[again] + 8, -1)
        covered = np.cumsum(edge[:-1]) > 0
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)
    return out


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts as the model sees them, offsets of the texts). Bytes that are no UTF-8 count as U+FFFD."""
    raw = data.tobytes()
    try:
        text = raw.decode()
        ends = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets] if len(data) else np.zeros(len(offsets), np.int64)
    except UnicodeDecodeError:
        texts = [raw[s:e].decode("utf-8", "replace") for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        text, ends = "".join(texts), np.cumsum([0, *map(len, texts)])
    letters = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.where(letters < len(_SEEN), _SEEN[np.minimum(letters, len(_SEEN) - 1)], letters), ends


def grams(letters: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text of each position, the n-gram that ends there as rows of ORDER code points), by slices; a text follows spaces."""
    sizes = np.diff(offsets)
    padded = np.concatenate([np.full(ORDER - 1, 32, np.uint32), letters])
    windows = np.lib.stride_tricks.sliding_window_view(padded, ORDER) if len(letters) else np.zeros((0, ORDER), np.uint32)
    for at in range(0, len(letters), SLICE):
        here = np.arange(at, min(at + SLICE, len(letters)))
        doc = np.searchsorted(offsets, here, "right") - 1
        rows = windows[here[0] : here[-1] + 1].copy()
        place = here - offsets[doc]
        early = np.flatnonzero(place < ORDER - 1)
        if len(early):
            mask = place[early][:, None] + np.arange(ORDER)[None, :] < ORDER - 1
            rows[early] = np.where(mask, np.uint32(32), rows[early])
        yield doc, rows
    assert sizes.sum() == len(letters)


def hashed(rows: np.ndarray, language: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams and their languages' hashes."""
    x = language.copy()
    for k in range(ORDER):
        x = (x ^ x >> np.uint64(31)) * _GOLD + rows[:, k]
    x = (x ^ x >> np.uint64(30)) * _M1
    x = (x ^ x >> np.uint64(27)) * _M2
    return x ^ x >> np.uint64(31)


def _language_hashes(languages: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x.encode(), 6) for x in languages], np.uint64)


def _strings(rows: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(rows, np.uint32).view(f"<U{ORDER}").ravel().astype(object), pa.string())


def _folds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    raw = data.tobytes()
    return np.array([zlib.crc32(raw[s:e]) & 1 for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64)


def _added(parts: list[tuple]) -> tuple:
    """(keys, n of fold 0, n of fold 1, n-grams, languages) with equal keys added up."""
    key, n0, n1, rows, language = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key)
    sorted_ = key[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])[: len(key)])
    if not len(first):
        return key, n0, n1, rows, language
    return sorted_[first], np.add.reduceat(n0[order], first), np.add.reduceat(n1[order], first), rows[order[first]], language[order[first]]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, gram, n0, n1): how often the n-grams of a task's texts occur in texts of either fold."""
    held: list[tuple] = []
    names: dict[str, int] = {}

    def out() -> Iterator[pa.RecordBatch]:
        _, n0, n1, rows, language = _added(held)
        known = pa.array(list(names), pa.string())
        for at in range(0, len(n0), 1 << 16):
            some = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([known.take(pa.array(language[some])), _strings(rows[some]), pa.array(n0[some]), pa.array(n1[some])], ["language", "gram", "n0", "n1"])

    for batch, data, offsets in text_chunks(batches):
        languages = batch.column(batch.schema.get_field_index("language")).to_pylist()
        number = np.array([names.setdefault(x, len(names)) for x in languages], np.int64)
        code, fold = _language_hashes(languages), _folds(data, offsets)
        for doc, rows in grams(*characters(data, offsets)):
            key = hashed(rows, code[doc])
            order = np.argsort(key)
            first = np.flatnonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]]]))
            n1 = np.add.reduceat(fold[doc[order]], first)
            n = np.diff(np.append(first, len(key)))
            held.append((key[order[first]], n - n1, n1, rows[order[first]], number[doc[order[first]]]))
        if sum(len(x[0]) for x in held) > HELD:
            held = [_added(held)]
            if len(held[0][0]) > HELD // 2:
                yield from out()
                held = []
    if held:
        yield from out()


def counted(docs: DataFrame) -> DataFrame:
    """docs(text, language) -> (language, gram, c0, c1): counts of every n-gram in the texts of either fold."""
    found = docs.select("text", "language").mapInArrow(_counts, "language string, gram string, n0 long, n1 long")
    return durable(found.groupBy("language", "gram").agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1")))


def _discounts(table: DataFrame, order: int) -> DataFrame:
    """(language, and for each fold the discounts of counts 1, 2 and 3 or more), from how many n-grams occur once to four times."""
    seen = table.groupBy("language").agg(*[F.greatest(F.sum((F.col(f"c{f}") == i).cast("long")), F.lit(1)).alias(f"t{f}_{i}") for f in (0, 1) for i in (1, 2, 3, 4)])

    def discount(f: int, i: int) -> Column:
        t = [F.col(f"t{f}_{k}") for k in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1])
        return F.greatest(F.lit(LEAST_DISCOUNT), F.least(F.lit(float(i)), i - (i + 1) * y * t[i] / t[i - 1])).alias(f"d{f}_{i}")

    return durable(seen.select("language", *[discount(f, i) for f in (0, 1) for i in (1, 2, 3)]))


def model(top: DataFrame) -> DataFrame:
    """counted() -> (language, gram, n, p0, p1): chances of an n-gram's last character by the counts of either fold.

    p0 is for texts of fold 0 and rests on the counts of fold 1, p1 the other way round.
    """
    tables = {ORDER: top}
    for k in range(ORDER - 1, 0, -1):
        before = [F.sum((F.col(f"c{f}") > 0).cast("long")).alias(f"c{f}") for f in (0, 1)]
        tables[k] = durable(tables[k + 1].groupBy("language", F.substring("gram", 2, k).alias("gram")).agg(*before))
    letters = durable(tables[1].groupBy("language").agg(F.count("*").alias("letters")))
    chances = None
    for k in range(1, ORDER + 1):
        table = tables[k].withColumn("context", F.substring("gram", 1, k - 1)) if k > 1 else tables[k].withColumn("context", F.lit(""))
        sums = [F.sum(f"c{f}").alias(f"total{f}") for f in (0, 1)]
        sums += [F.sum((F.col(f"c{f}") >= 3 if i == 3 else F.col(f"c{f}") == i).cast("long")).alias(f"s{f}_{i}") for f in (0, 1) for i in (1, 2, 3)]
        contexts = table.groupBy("language", "context").agg(*sums)
        rows = table.join(contexts, ["language", "context"]).join(broadcast_if_small(_discounts(tables[k], k)), "language")
        if k == 1:
            rows = rows.join(broadcast_if_small(letters), "language").withColumns({f"q{f}": 1 / (F.col("letters") + 1) for f in (0, 1)})
        else:
            rows = rows.withColumn("end", F.substring("gram", 2, k)).join(chances.select("language", F.col("gram").alias("end"), F.col("p0").alias("q0"), F.col("p1").alias("q1")), ["language", "end"])

        def chance(f: int) -> Column:
            c, total = F.col(f"c{f}"), F.col(f"total{f}")
            own = F.when(c == 0, 0.0).when(c == 1, F.col(f"d{f}_1")).when(c == 2, F.col(f"d{f}_2")).otherwise(F.col(f"d{f}_3"))
            left = sum((F.col(f"d{f}_{i}") * F.col(f"s{f}_{i}") for i in (1, 2, 3)), F.lit(0.0))
            return F.when(total > 0, (c - own + left * F.col(f"q{f}")) / total).otherwise(F.col(f"q{f}"))

        # texts of a fold meet the other fold's counts: what is computed from c1 is p0 from here on only in the last step
        chances = rows.select("language", "gram", (F.col("c0") + F.col("c1")).alias("n"), chance(0).alias("p0"), chance(1).alias("p1"))
    out = durable(chances.select("language", "gram", "n", F.col("p1").alias("p0"), F.col("p0").alias("p1")))
    discard(*(tables[k] for k in range(1, ORDER)))
    return out


@dataclass
class Core:
    """Sorted hashes of the commonest n-grams and their log losses for texts of either fold; first: where hashes with the same
    leading bits begin."""

    keys: np.ndarray
    losses: np.ndarray
    first: np.ndarray
    shift: int

    @classmethod
    def of(cls, table: pa.Table) -> Core:
        texts = table.column("gram").to_pylist()
        rows = np.array(texts, f"<U{ORDER}").reshape(-1, 1).view(np.uint32) if texts else np.zeros((0, ORDER), np.uint32)
        names = table.column("language").to_pylist()
        known = dict(zip(set(names), _language_hashes(list(set(names))), strict=True))
        keys = hashed(rows, np.array([known[x] for x in names], np.uint64))
        losses = -np.log(np.stack([table.column(c).to_numpy() for c in ("p0", "p1")])).astype(np.float32)
        order = np.argsort(keys)
        bits = max(1, len(keys).bit_length() + 1)
        keys, shift = keys[order], 64 - bits
        return cls(keys, np.ascontiguousarray(losses[:, order]), np.searchsorted(keys >> np.uint64(shift), np.arange((1 << bits) + 1, dtype=np.uint64)), shift)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it isn't there."""
        lead = (keys >> np.uint64(self.shift)).astype(np.int64)
        at, end = self.first[lead], self.first[lead + 1]
        out = np.full(len(keys), -1)
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.keys[at[left]] == keys[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


def _alone(letters: np.ndarray) -> np.ndarray:
    """Ideographs and kana."""
    return (letters >= 0x3041) & (letters < 0xA000) | (letters >= 0x20000) & (letters < 0x32000)


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _scorer(core):
    """Statistics of texts, their losses by the core's n-grams, and their other n-grams with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 40, 0
        for batch, data, offsets in text_chunks(batches):
            n = batch.num_rows
            names = batch.column(batch.schema.get_field_index("language"))
            code, fold = _language_hashes(names.to_pylist()), _folds(data, offsets)
            letters, ends = characters(data, offsets)
            loss, owners, others, counts = np.zeros(n), [np.zeros(0, np.int64)], [np.zeros((0, ORDER), np.uint32)], [np.zeros(0, np.int64)]
            for doc, rows in grams(letters, ends):
                key = hashed(rows, code[doc])
                at = core.value.find(key)
                known = at >= 0
                loss += np.bincount(doc[known], core.value.losses[fold[doc[known]], at[known]], n)
                rest = np.flatnonzero(~known)
                rest = rest[np.lexsort((key[rest], doc[rest]))]
                new = np.flatnonzero(np.concatenate([[True], (key[rest[1:]] != key[rest[:-1]]) | (doc[rest[1:]] != doc[rest[:-1]])])[: len(rest)])
                owners.append(doc[rest[new]])
                others.append(rows[rest[new]])
                counts.append(np.diff(np.append(new, len(rest))))
            owner = np.concatenate(owners)
            places = pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32))
            rest = pa.StructArray.from_arrays([_strings(np.concatenate(others)), pa.array(np.concatenate(counts))], ["gram", "n"])
            stats = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(task + made + np.arange(n)), batch.column(batch.schema.get_field_index("doc_id")), names, *(pa.array(stats[x].astype(np.int64)) for x in FIELDS), pa.array(np.diff(ends)), pa.array(stats["n_words"] + row_sums(_alone(letters), ends).astype(np.int64)), pa.array(fold), pa.array(loss), pa.ListArray.from_arrays(places, rest)],
                ["row", "doc_id", "language", *FIELDS, "n_chars", "units", "fold", "loss", "rest"],
            )
            made += n

    return run


def _scores(docs: DataFrame, chances: DataFrame) -> DataFrame:
    """docs(doc_id, text, language) -> a row each with statistics and log_perplexity, null without a word."""
    spark = docs.sparkSession
    core = spark.sparkContext.broadcast(Core.of(chances.orderBy(F.desc("n"), "language", "gram").limit(CORE).toArrow()))
    schema = "row long, doc_id long, language string, " + "".join(f"{x} long, " for x in FIELDS) + "n_chars long, units long, fold long, loss double, rest array<struct<gram:string,n:long>>"
    rows = durable(docs.mapInArrow(_scorer(core), schema))
    rest = rows.select("row", "language", "fold", F.explode("rest").alias("x")).select("row", "language", "fold", "x.gram", F.col("x.n").alias("times"))
    lost = -F.log(F.when(F.col("fold") == 0, F.col("p0")).otherwise(F.col("p1"))) * F.col("times")
    more = rest.join(chances.select("language", "gram", "p0", "p1"), ["language", "gram"]).groupBy("row").agg(F.sum(lost).alias("more"))
    total = F.col("loss") + F.coalesce("more", F.lit(0.0))
    return rows.drop("rest").join(more, "row", "left").withColumn("log_perplexity", F.when(F.col("units") > 0, total / F.col("units")))


def judge(docs: DataFrame, width: float = 3.0) -> DataFrame:
    """docs(doc_id, text, lang) -> (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    log_perplexity, kept).

    A document passes the band if log_perplexity, its mean log loss a word, is at most its language's upper quartile plus
    `width` times that quartile's distance from the median, and at least the lower quartile less as much; more for short
    texts (by 1 + 20 / sqrt(characters)). The quartiles are of the language's distinct texts that pass the base rules. A null
    text counts as empty and fails the base rules; a null language is a language of its own; every row gives a row,
    repeated ones too, and an empty table gives none.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("lang"), F.lit("")).alias("language"))
    top = counted(rows)
    scored = durable(_scores(rows, model(top)))
    discard(top)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    distinct = scored.where("not base_failed").select("language", "n_chars", "n_words", F.round("log_perplexity", 9).alias("x")).distinct()
    ends = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    bands = broadcast_if_small(durable(distinct.groupBy("language").agg(F.percentile_approx("x", ends, 10000).alias("q"))))
    q, more = F.col("q"), width * (1 + 20 / F.sqrt(F.greatest("n_chars", F.lit(1))))
    over, under = (F.greatest(d, LEAST_SPREAD * q[1]) * more for d in (q[2] - q[1], q[1] - q[0]))
    inside = (F.col("log_perplexity") >= q[0] - under) & (F.col("log_perplexity") <= q[2] + over)
    return scored.join(bands, "language", "left").select("doc_id", *FIELDS, "base_failed", "log_perplexity", (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"))
