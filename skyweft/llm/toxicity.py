"""Toxicity from subword bags: character n-gram embeddings averaged into a linear softmax.

Words are split into hashed character 3- to 5-grams (word ends included), so an unseen misspelling shares
most of its vectors with the word it stands for. A document is scored over windows of 32 words and takes its
most toxic window, so one insult in a long text isn't averaged away. Embeddings and softmax are trained
jointly in numpy on a bounded sample of labelled rows; embeddings start from smoothed document log-odds.
Since average and softmax are linear, scoring needs one number an n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import SPACES, labelled_sample, platt, row_sums, sigmoid, small_batches, text_chunks

SLOT_BITS = 18
DIMENSIONS = 8
WINDOW = 32
ORDERS = (3, 4, 5)
#: Bytes of windows that are scored together; it affects memory only.
PIECE = 8 << 20
#: Smaller bags are averaged as if filled up with zero vectors, so a short text isn't judged on a few n-grams; up to which
#: size is learned with the rest, among these.
FILLED = (1, 40, 80, 160, 320)


def _joined(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts with a space before each and after the last; where each one's space stands."""
    lower = data.copy()
    upper = (lower >= 65) & (lower <= 90)
    lower[upper] += 32
    lower[SPACES[lower]] = 32
    return np.insert(lower, offsets, 32), offsets + np.arange(len(offsets))


def _grams(text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the slot of the n-gram at each place, and whether it lies within a word and its ends."""
    n = len(text)
    wide = np.concatenate([text, np.full(8, 32, np.uint8)]).astype(np.uint32)
    space = wide == 32
    code = np.zeros(n, np.uint32)
    inner = np.ones(n, bool)
    for i in range(max(ORDERS)):
        code += wide[i : n + i] * np.uint32((0x9E3779B1 * (2 * i + 3)) & 0xFFFFFFFF | 1)
        if i >= 2:
            inner &= ~space[i - 1 : n + i - 1]
        if i + 1 in ORDERS:
            mixed = (code ^ code >> np.uint32(15)) * np.uint32(0x85EBCA6B)
            yield mixed >> np.uint32(32 - SLOT_BITS), inner & ~(space[:n] & space[i : n + i] & (i < 2))


def _windows(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each window and the end, the document of each window): every WINDOW words of a document."""
    words = np.flatnonzero((text[:-1] == 32) & (text[1:] != 32))
    if not len(words):
        return np.array([len(text)]), np.zeros(0, np.int64)
    doc = np.searchsorted(starts, words, "right") - 1
    first = np.searchsorted(words, starts[:-1])
    begin = (np.arange(len(words)) - first[doc]) % WINDOW == 0
    return np.append(words[begin], len(text)), doc[begin]


@dataclass
class Model:
    """slot: softmax margin of each n-gram slot, already times embeddings; bias: margin of an empty bag; filled: size up
    to which bags are filled with zero vectors; share: of toxic texts in training, 1/2 if it had one label only."""

    slot: np.ndarray
    bias: float
    filled: int = FILLED[0]
    share: float = 0.5

    def sums(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sum of the margins of each window's n-grams, their number, its document, its first place)."""
        text, starts = _joined(data, offsets)
        edges, doc = _windows(text, starts)
        if not len(doc):
            return np.zeros(0), np.zeros(0), doc, edges
        sums, counts, first = [], [], 0
        while first < len(doc):  # a long text by pieces of whole windows
            last = max(first + 1, int(np.searchsorted(edges, edges[first] + PIECE, "right")) - 1)
            part = text[edges[first] : edges[last]]
            total, count = np.zeros(len(part), np.float32), np.zeros(len(part), np.float32)
            for slots, valid in _grams(part):
                total += np.where(valid, self.slot[slots], np.float32(0))
                count += valid
            here = edges[first : last + 1] - edges[first]
            sums.append(row_sums(total, here))
            counts.append(row_sums(count, here))
            first = last
        return np.concatenate(sums), np.concatenate(counts), doc, edges

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, count, doc, _ = self.sums(data, offsets)
        margin = total / np.maximum(count, self.filled)
        best = np.full(len(offsets) - 1, -np.inf)
        np.maximum.at(best, doc, margin)
        return sigmoid(np.where(np.isfinite(best), best, 0) + self.bias)


def _flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def train(rows: list[tuple[bytes, int]], rounds: int = 3, epochs: int = 2, rate: float = 0.05, seed: int = 7) -> Model:
    """Fit on (text, label) rows. Without both labels the model is a constant."""
    labels = np.array([y for _, y in rows], np.float64)
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    slots = 1 << SLOT_BITS
    if not n1 or not n0:
        return Model(np.zeros(slots, np.float32), 0.0 if not len(labels) else 4.0 if n1 else -4.0)
    groups = [rows[i : i + 100] for i in range(0, len(rows), 100)]
    seen = np.zeros((2, slots))
    for text, y in rows:
        bag = np.unique(np.concatenate([s[v] for s, v in _grams(_joined(*_flat([text]))[0])]))
        seen[y, bag] += 1
    prior = 10.0
    odds = np.log((seen[1] + prior * n1 / len(rows)) / (n1 + prior * n1 / len(rows))) - np.log((seen[0] + prior * n0 / len(rows)) / (n0 + prior * n0 / len(rows)))
    random = np.random.default_rng(seed)
    along = np.full(DIMENSIONS, DIMENSIONS**-0.5)
    embedding = odds[:, None] * along + random.normal(0, 0.01, (slots, DIMENSIONS))
    softmax = np.stack([-along, along], axis=1) * 10
    bias = np.zeros(2)
    squares = np.full(slots, 1e-3)
    model = Model(np.zeros(slots, np.float32), 0.0, share=float(n1 / len(rows)))
    for turn in range(rounds + 1):
        # Sums of every window under the model so far; the filling, scale and bias that fit the labels best.
        model.slot = (embedding @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32)
        found = [model.sums(*_flat([t for t, _ in group])) for group in groups]
        fits = []
        for filled in FILLED:
            best = np.zeros(len(rows))
            for g, (total, count, doc, _) in enumerate(found):
                if len(doc):
                    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                    best[100 * g + doc[first]] = np.maximum.reduceat(total / np.maximum(count, filled), first)
            scale, shift = platt(best, labels)
            p = sigmoid(scale * best + shift)
            fits.append((-(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean(), filled, scale, shift))
        _, filled, scale, shift = min(fits)
        model.filled = filled
        bags = []
        for g, (total, count, doc, edges) in enumerate(found if turn < rounds else []):
            # the most toxic window of every document
            order = np.lexsort((-total / np.maximum(count, filled), doc))
            at = np.searchsorted(doc[order], np.arange(len(groups[g])))
            grams = list(_grams(_joined(*_flat([t for t, _ in groups[g]]))[0]))
            for i in range(len(groups[g])):
                has = at[i] < len(doc) and doc[order[at[i]]] == i
                low, high = (edges[order[at[i]]], edges[order[at[i]] + 1]) if has else (0, 0)
                bags.append(np.concatenate([s[low:high][v[low:high]] for s, v in grams]))
        softmax *= max(scale, 1e-3)
        bias = np.array([-shift / 2, shift / 2])
        if turn == rounds:
            break
        for _ in range(epochs):
            order = random.permutation(len(rows))
            for at in range(0, len(order), 64):
                batch = order[at : at + 64]
                sizes = np.array([len(bags[i]) for i in batch])
                flat = np.concatenate([bags[i] for i in batch])
                owner = np.repeat(np.arange(len(batch)), sizes)
                mean = np.zeros((len(batch), DIMENSIONS))
                np.add.at(mean, owner, embedding[flat])
                mean /= np.maximum(sizes, filled)[:, None]
                logits = mean @ softmax + bias
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(batch)), labels[batch].astype(int)] -= 1
                down = (p @ softmax.T) / np.maximum(sizes, filled)[:, None]
                squares_now = np.zeros(slots)
                np.add.at(squares_now, flat, (down**2).sum(axis=1)[owner])
                squares += squares_now
                np.add.at(embedding, flat, -rate * down[owner] / np.sqrt(squares[flat])[:, None])
                softmax -= rate * (mean.T @ p) / len(batch) * 10
                bias -= rate * p.mean(axis=0)
    model.slot = (embedding @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32)
    model.bias = float(bias[1] - bias[0])
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held_out: int = 0, sample: int = 6000) -> Model:
    """Train on at most `sample` labelled rows outside the held-out fold."""
    return train(labelled_sample(docs, labels, label, modulus, held_out, sample))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, score). Null and empty texts get the empty bag's score; every row gives a row,
    repeated ones and null ids too; an empty table gives none."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one float a slot: 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(shared.value.scores(data, offsets))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def even(model: Model) -> float:
    """The score from which a text speaks more for toxic than for clean, however rare toxic texts are: their share in training, one
    half at most. At one half, a rare label needs that much more evidence."""
    return min(model.share, 0.5)


def keep(docs: DataFrame, model: Model, below: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is under `below`; null texts score as empty ones. An empty table stays
    empty."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches):
            yield rows.filter(pa.array(shared.value.scores(data, offsets) < below))

    return docs.mapInArrow(run, docs.schema)
