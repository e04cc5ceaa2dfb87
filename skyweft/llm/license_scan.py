"""License scans with a positional index of rare tokens.

Templates are short licence notices. Spark counts in how many documents each of their words occurs; words
with a higher inverse document frequency are rarer. In a file, the rarest words of each template are looked up in the
index of template postings; every hit proposes a template at an alignment (word place less template place),
alignments on which enough rare words agree are candidates, and a candidate becomes a label if the template's
mandatory key phrases stand at their places, give or take a few words. The phrases of the base contract are
templates whose words are all mandatory; their rarest word is always looked up, so none of their places is missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import hashed_words, small_batches, text_chunks

#: Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label, notice, and key phrases of which each must stand in the notice's place.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the license", ("except in compliance with the license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge", "obtaining a copy")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "gnu affero general public license", ("affero general public license",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc0", "to the extent possible under law the author has waived all copyright", ("waived all copyright",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ("permission to use copy modify and or distribute",)),
)
#: Bytes that are in no word: all ASCII but digits and lower-case letters.
BETWEEN = (np.arange(256) < 128) & ~((np.arange(256) >= 48) & (np.arange(256) <= 57)) & ~((np.arange(256) >= 97) & (np.arange(256) <= 122))
VOTES = 2
SLACK = 3
RARE_WORDS = 24
COLUMNS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def _words_of(text: str) -> list[str]:
    return re.findall("[0-9a-z]+", text)


@dataclass
class Index:
    """vocabulary: word -> number, by falling inverse document frequency; postings: number -> (template, place)."""

    frequencies: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.templates = [(label, _words_of(text), [_words_of(k) for k in keys]) for label, text, keys in TEMPLATES]
        self.base = [(label, _words_of(phrase)) for phrase, label in BASE]
        words = {w for _, t, _ in self.templates for w in t} | {w for _, t in self.base for w in t}
        self.vocabulary = {w: i for i, w in enumerate(sorted(words, key=lambda w: (self.frequencies.get(w, 0), w)))}
        self.words = list(self.vocabulary)
        joined = np.frombuffer("".join(self.words).encode(), np.uint8)
        codes, _, _ = hashed_words(joined, np.cumsum([0, *map(len, self.words)]), BETWEEN)
        order = np.argsort(codes)
        self.codes, self.numbers = codes[order], order
        postings = [(self.vocabulary[w], t, q) for t, (_, text, _) in enumerate(self.templates) for q, w in enumerate(text)]
        postings.sort()
        self.postings = np.array(postings, np.int64)
        self.first = np.searchsorted(self.postings[:, 0], np.arange(len(self.words) + 1))
        self.need = [min(VOTES, len(set(t))) for _, t, _ in self.templates]
        self.text = [np.array([self.vocabulary[w] for w in t]) for _, t, _ in self.templates]
        self.keys = [[(_find(t, k), np.array([self.vocabulary[w] for w in k])) for k in keys] for _, t, keys in self.templates]

    def numbered(self, codes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for words of no template."""
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.numbers[at], -1)

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, list]:
        n = len(offsets) - 1
        codes, doc, _ = hashed_words(lowered(data), offsets, BETWEEN)
        number = self.numbered(codes)
        first = np.searchsorted(doc, np.arange(n + 1))
        padded = np.concatenate([number, np.full(64, -1)])
        owner = np.concatenate([doc, np.full(64, -1)])
        n_base, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        base, labels, score = [set() for _ in range(n)], [set() for _ in range(n)], np.zeros(n)
        for label, phrase in self.base:
            want = [self.vocabulary[w] for w in phrase]
            rarest = int(np.argmin(want))  # the lowest number is the rarest word
            at = np.flatnonzero(number == want[rarest]) - rarest
            at = at[at >= 0]
            for i, w in enumerate(want):
                at = at[(padded[at + i] == w) & (owner[at + i] == owner[at])]
            np.add.at(n_base, doc[at], 1)
            np.minimum.at(low, doc[at], at - first[doc[at]])
            np.maximum.at(high, doc[at], at - first[doc[at]])
            for d in np.unique(doc[at]).tolist():
                base[d].add(label)
                labels[d].add(label)
                score[d] = 1.0
        # The rarest words of each file and template, and all their places.
        hits = np.flatnonzero(number >= 0)
        pairs = np.unique(doc[hits] * len(self.words) + number[hits])
        of, word = pairs // len(self.words), pairs % len(self.words)
        chosen = np.zeros((len(pairs), len(self.templates)), bool)
        for t, text in enumerate(self.text):
            mine = np.flatnonzero(np.isin(word, text))
            rank = np.arange(len(mine)) - np.searchsorted(of[mine], of[mine])
            chosen[mine[rank < RARE_WORDS], t] = True
        sizes = (self.first[1:] - self.first[:-1])[number[hits]]
        row = np.repeat(hits, sizes)
        post = np.repeat(self.first[number[hits]] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        looked_up = chosen[np.searchsorted(pairs, doc[row] * len(self.words) + number[row]), self.postings[post, 1]]
        row, post = row[looked_up], post[looked_up]
        template, start = self.postings[post, 1], row - self.postings[post, 2]
        votes = np.unique(np.stack([start, template, number[row], doc[row]], axis=1), axis=0) if len(row) else np.zeros((0, 4), np.int64)
        places, agreed = np.unique(votes[:, [0, 1, 3]], axis=0, return_counts=True)
        for (at, t, d), count in zip(places.tolist(), agreed.tolist(), strict=True):
            if count >= self.need[t]:
                share = self._verified(padded, at, t, int(first[d]), int(first[d + 1]))
                if share:
                    labels[d].add(self.templates[t][0])
                    score[d] = max(score[d], share)
        return {
            "n_words": np.diff(first),
            "n_base": n_base,
            "first_word": [int(x) if y >= 0 else None for x, y in zip(low, high, strict=True)],
            "last_word": [int(y) if y >= 0 else None for y in high],
            "base_labels": [",".join(sorted(x)) for x in base],
            "labels": [",".join(sorted(x)) for x in labels],
            "score": score,
        }

    def _verified(self, number: np.ndarray, at: int, t: int, low: int, high: int) -> float:
        """Share of the template's words found at their places if its key phrases stand, else zero."""
        for q, key in self.keys[t]:
            for slip in sorted(range(-SLACK, SLACK + 1), key=abs):
                s = at + q + slip
                if s >= low and s + len(key) <= high and (number[s : s + len(key)] == key).all():
                    break
            else:
                return 0.0
        inside = np.arange(at, at + len(self.text[t]))
        ok = (inside >= low) & (inside < high)
        return float((ok & (number[np.clip(inside, 0, len(number) - 1)] == self.text[t])).mean())


def _find(text: list[str], key: list[str]) -> int:
    return next(i for i in range(len(text)) if text[i : i + len(key)] == key)


def frequencies(docs: DataFrame) -> dict[str, int]:
    """In how many documents each word of the templates occurs."""
    index = Index()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.words), np.int64)
        for _, data, offsets in text_chunks(batches):
            codes, doc, _ = hashed_words(lowered(data), offsets, BETWEEN)
            number = index.numbered(codes)
            hit = number >= 0
            total += np.bincount(np.unique(doc[hit] * len(total) + number[hit]) % len(total), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(index.words), pa.array(total)], ["word", "n"])

    small_batches(docs.sparkSession)
    found = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r[0]: r[1] for r in found.collect()}  # a row for each word of the templates


def scan(docs: DataFrame, index: Index | None = None) -> DataFrame:
    """docs(doc_id, text) -> COLUMNS. Null and empty texts have no words, no labels and null places; every row
    gives a row, whatever its doc_id."""
    index = index or Index(frequencies(docs))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches):
            found = index.scan(data, offsets)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, t) for c, t in zip(found.values(), kinds, strict=True))], ["doc_id", *found])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COLUMNS)
