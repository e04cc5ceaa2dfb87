"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's score sums weights of binned features of the line and of the
lines before and after it; a two-by-two table scores neighbouring labels. Training maximises the conditional
likelihood of the lines of a bounded sample of labelled documents, whose lines take the document's label.
A document's quality is the length-weighted mean of its lines' forward-backward marginals, put through a
logistic fit so that one half is the boundary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import hashed_words, labelled_sample, platt, row_sums, sigmoid, small_batches, text_chunks
from .toxicity import _flat

BINS = 8
_CODES = np.arange(256)
#: Byte classes whose share of a line is a feature.
CLASSES = (
    _CODES >= 128,
    (_CODES >= 97) & (_CODES <= 122),
    (_CODES >= 65) & (_CODES <= 90),
    (_CODES >= 48) & (_CODES <= 57),
    np.isin(_CODES, [*b"#*$%&<>"]),
    np.isin(_CODES, [*b"|"]),
    np.isin(_CODES, [*b"!?"]),
    np.isin(_CODES, [*b".,;:"]),
    np.isin(_CODES, [9, 11, 12, 13, 32]),
)


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by line, document of each line, its length). A text has one line more than line feeds."""
    breaks = np.flatnonzero(data == 10)
    # The text after a break starts behind it; a break belongs to the line that it ends.
    edges = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    doc = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    doc = np.sort(doc, kind="stable")
    edges = np.append(edges, len(data))
    size = np.diff(edges)
    length = np.maximum(size, 1).astype(np.float64)
    columns = [np.log1p(size)]
    for marks in CLASSES:
        columns.append(row_sums(marks[data], edges) / length)
    code, owner, words = hashed_words(data, offsets)
    line = np.searchsorted(edges, words, "right") - 1
    n_words = np.bincount(line, minlength=len(size))
    columns.append(length / np.maximum(n_words, 1))
    if len(words):
        again = np.concatenate([[False], (code[1:] == code[:-1]) & (line[1:] == line[:-1])])
        columns.append(np.bincount(line[again], minlength=len(size)) / np.maximum(n_words, 1))
        order = np.lexsort((code, owner))
        old = np.zeros(len(words), bool)
        old[order[1:]] = (code[order[1:]] == code[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
        columns.append(np.bincount(line[old], minlength=len(size)) / np.maximum(n_words, 1))
    else:
        columns += [np.zeros(len(size)), np.zeros(len(size))]
    return np.stack(columns, axis=1), doc, length


def _with_neighbours(bins: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Feature numbers of each line: its own bins, and those of the lines before and after it in its document."""
    lines, kinds = bins.shape
    edge = np.full((1, kinds), BINS)
    before, after = np.concatenate([edge, bins[:-1]]), np.concatenate([bins[1:], edge])
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    before[first], after[np.concatenate([first[1:], [True]])] = BINS, BINS
    numbers = np.concatenate([bins, before, after], axis=1)
    return numbers + (BINS + 1) * np.arange(3 * kinds)


def _chain(unary: np.ndarray, doc: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(chance of good by line, expected label pairs, sum of log partition functions); all documents in step.

    unary: score of good against bad. Messages are ratios kept as logarithms of two columns.
    """
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    sizes = np.diff(np.append(starts, len(doc)))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    score = np.stack([np.zeros(len(unary)), unary], axis=1)
    forward, backward = np.zeros((len(unary), 2)), np.zeros((len(unary), 2))
    forward[starts] = score[starts]
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")  # documents of at least t lines
    for t in range(1, int(sizes[0])):
        at = starts[: active[t]] + t
        m = forward[at - 1][:, :, None] + table
        forward[at] = np.logaddexp(m[:, 0], m[:, 1]) + score[at]
    for t in range(int(sizes[0]) - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        m = table + (score[at + 1] + backward[at + 1])[:, None, :]
        backward[at] = np.logaddexp(m[:, :, 0], m[:, :, 1])
    whole = np.logaddexp(*(forward[starts + sizes - 1].T))
    both = forward + backward
    good = sigmoid(both[:, 1] - both[:, 0])
    norm = np.zeros(len(unary))
    norm[starts] = whole
    norm = norm[np.maximum.accumulate(np.where(np.concatenate([[True], doc[1:] != doc[:-1]]), np.arange(len(doc)), 0))]
    inner = np.flatnonzero(np.concatenate([[False], doc[1:] == doc[:-1]]))
    pairs = np.exp(forward[inner - 1][:, :, None] + table + (score[inner] + backward[inner])[:, None, :] - norm[inner][:, None, None])
    return good, pairs, float(whole.sum())


@dataclass
class Model:
    cuts: np.ndarray
    weights: np.ndarray
    bias: float
    table: np.ndarray
    slope: float
    shift: float

    def _bins(self, features: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, f, "left") for c, f in zip(self.cuts, features.T, strict=True)], axis=1)

    def lines(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chance that a line is good, its document, its length)."""
        features, doc, length = line_features(data, offsets)
        numbers = _with_neighbours(self._bins(features), doc)
        good, _, _ = _chain(self.weights[numbers].sum(axis=1) + self.bias, doc, self.table)
        return good, doc, length

    def raw(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        good, doc, length = self.lines(data, offsets)
        mean = np.clip(np.bincount(doc, good * length) / np.bincount(doc, length), 1e-4, 1 - 1e-4)
        return np.log(mean / (1 - mean))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.raw(data, offsets) + self.shift)


def train(rows: list[tuple[bytes, int]], steps: int = 60, rate: float = 0.1) -> Model:
    """Fit on (text, label) rows by Adam on the conditional likelihood, each document weighing the same."""
    labels = np.array([y for _, y in rows], np.float64)
    kinds = 4 + len(CLASSES)
    if not len(rows) or labels.min() == labels.max():
        sure = 0.0 if not len(rows) else 4.0 if labels[0] else -4.0
        return Model(np.zeros((kinds, BINS - 1)), np.zeros(3 * kinds * (BINS + 1)), 0.0, np.zeros((2, 2)), 0.0, sure)
    groups = [_flat([t for t, _ in rows[i : i + 100]]) for i in range(0, len(rows), 100)]
    found = [line_features(*g)[:2] for g in groups]
    features = np.concatenate([f for f, _ in found])
    doc = np.concatenate([d + 100 * g for g, (_, d) in enumerate(found)])
    cuts = np.quantile(features, np.arange(1, BINS) / BINS, axis=0).T
    model = Model(cuts, np.zeros(3 * kinds * (BINS + 1)), 0.0, np.zeros((2, 2)), 1.0, 0.0)
    numbers = _with_neighbours(model._bins(features), doc)
    truth = labels[doc]
    share = 1 / np.bincount(doc)[doc]
    inner = np.flatnonzero(np.concatenate([[False], doc[1:] == doc[:-1]]))
    seen = np.zeros((len(inner), 2, 2))
    seen[np.arange(len(inner)), truth[inner].astype(int), truth[inner].astype(int)] = 1
    size = len(model.weights)
    theta = np.zeros(size + 5)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    n = len(rows)
    for step in range(1, steps + 1):
        model.weights, model.bias, model.table = theta[:size], theta[size], theta[size + 1 :].reshape(2, 2)
        good, pairs, _ = _chain(model.weights[numbers].sum(axis=1) + model.bias, doc, model.table)
        up = (truth - good) * share / n
        gradient = np.concatenate([np.bincount(numbers.ravel(), np.repeat(up, numbers.shape[1]), size), [up.sum()], ((seen - pairs) * share[inner][:, None, None] / n).sum(axis=0).ravel()])
        gradient -= 1e-4 * theta
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        theta[size + 1 :] = np.clip(theta[size + 1 :], -1.5, 1.5)  # neighbours inform a line, they don't decide it
    model.weights, model.bias, model.table = theta[:size].copy(), float(theta[size]), theta[size + 1 :].reshape(2, 2).copy()
    model.slope, model.shift = platt(np.concatenate([model.raw(*g) for g in groups]), labels)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held_out: int = 1, sample: int = 4000) -> Model:
    """Train on at most `sample` labelled rows outside the held-out fold."""
    return train(labelled_sample(docs, labels, label, modulus, held_out, sample))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, score). A null or empty text is one empty line; every row gives a row,
    repeated ones and null ids too; an empty table gives none."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches, 2 << 20):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(shared.value.scores(data, offsets))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def line_labels(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, line, length, good): the chance that each line is good."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches, 2 << 20):
            good, doc, length = shared.value.lines(data, offsets)
            first = np.searchsorted(doc, doc)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(doc)), pa.array(np.arange(len(doc)) - first), pa.array(length.astype(np.int64)), pa.array(good)], ["doc_id", "line", "length", "good"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, line long, length long, good double")


def keep(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least `least`; a null text counts as one empty line. An empty table
    stays empty."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches, 2 << 20):
            yield rows.filter(pa.array(shared.value.scores(data, offsets) >= least))

    return docs.mapInArrow(run, docs.schema)
