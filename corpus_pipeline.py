"""Corpus pipeline: quality, toxicity, near duplicates, personal data, packing.

Each stage works on all documents that the one before kept, and its decisions take effect. run() writes each
stage's rows as Parquet in the shared folder and reads them again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skyweft.llm import near_copies, packing, pii, quality_crf, toxicity
from skyweft.llm.base import durable, read
from skyweft.llm.queries import TOKENIZER


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least one half, in the order they came; nulls count as empty texts, repeated
    rows are judged alike, an empty table gives no rows. Trained on the labelled documents of the input."""
    return quality_crf.keep(docs, quality_crf.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the share of toxic texts in training; nulls count as empty texts, repeated rows are judged alike, an
    empty table gives no rows. Trained on the labelled documents of the input, those too that the stage before rejects."""
    model = toxicity.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity.keep(docs, model, toxicity.even(model))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity of at least 0.8. Null and empty
    texts are one group; rows of equal or no ids are told apart by their texts."""
    return near_copies.first_of_each(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced; null texts stay null, every row stays."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens; a null or empty text is its end id alone."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", quality), ("toxicity", harmless), ("near-dedup", deduplicated), ("pii", redacted), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
