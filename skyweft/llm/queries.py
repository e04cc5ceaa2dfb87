"""Registered queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_automaton, filter_audit, flac, hard_negatives, license_scan, ngram_join, packing, pii, quality_crf, quality_rules, simhash, token_store, toxicity
from .base import durable, held_out, read, shared_dir

TOKENIZER = "byte_bpe_50k.json"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document; null and empty texts have none, an empty table gives no rows."""
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and smallest linked doc_id of every document; null and empty texts have fingerprint zero and are linked."""
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"), distance=4)
    return out.select("doc_id", simhash.hexed().alias("fingerprint"), "component_id")


def _scored(scores: DataFrame, modulus: int, fold: int) -> DataFrame:
    return scores.select("doc_id", held_out(modulus, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model fitted outside the held-out fold; null texts score as empty ones."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return _scored(toxicity.score(docs, model), 5, 0)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of sequences; a null or empty text is its end id alone, an empty table gives none."""
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document; null texts count as empty, repeated rows are kept."""
    return pii.report(read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document; null and empty texts fail the base rules."""
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op7_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document's FLAC stream holds when it is read back; a null text is 64 zero bytes."""
    return flac.features(durable(flac.store(read(spark, sf_dir, "documents"))))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's ids, read back from segments in a new shared folder."""
    folder = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    token_store.write(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), folder)
    return token_store.read(spark, folder)


def op9_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a model fitted outside the held-out fold; null and empty texts are one empty line."""
    docs = read(spark, sf_dir, "documents")
    model = quality_crf.fit(docs, read(spark, sf_dir, "labels"))
    return _scored(quality_crf.score(docs, model), 3, 1)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and hashes of every document's ids and decoded text; null texts count as empty."""
    return bpe_automaton.encode_and_decode(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and smallest linked doc_id of every document; null and empty texts have no shingle and no link."""
    return ngram_join.join(read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the five filters in every order, by source; null texts count as empty, null sources as the empty string."""
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best negatives in the window of every anchor's positives; rows without label or whole vector take no part."""
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline applied to documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    named = (
        op1_license_scan, op2_simhash, op3_toxicity, op4_packing, op5_pii, op6_quality_rules, op7_flac, op8_token_store, op9_quality_crf, op10_bpe,
        op11_ngram_join, op12_filter_audit, op13_hard_negatives, pipeline,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    """SQL of the three whose rows DuckDB can have from whole tables. The others rest on trained models, XXH64 with a seed,
    tokenizer ids or media bytes; tests/llm holds them against brute-force versions."""
    return {"op11_ngram_join": ngram_join.ORACLE, "op12_filter_audit": filter_audit.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}
