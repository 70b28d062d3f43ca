"""The corpus pipeline: documents to packed training sequences.

Each stage works on all that the one before it kept, and is written as Parquet before the next one reads it. All but the
last return the columns of `documents`. Tables that are empty, or become empty at a stage, pass through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import lines, minhash, mixing, packing, quality
from codeloom.llm.shared import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the full policy go."""
    return quality.filtered(docs, ("full", 1))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, or are within two edits of it, go; so do documents without a word left."""
    return lines.deduplicated(docs, short=1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: of shingles of five words, at a similarity of 0.8 or more."""
    return minhash.deduplicated(docs, 80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources take the shares of their weights; a document comes as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, with their sequence, their place in it, their ids and a number that tells copies of a document apart."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 0, keep_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the draw of the mix nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
