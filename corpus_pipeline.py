"""A corpus from raw documents in five stages, each over all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read again as the next
stage's input. All but the last return the columns of `documents`; the last returns the digests of the encoded texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from clusterlens.llm import exact_dedup, line_quality, mixing, near_dedup, pieces
from clusterlens.llm.shared import Scratch, table

PIECES = "piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and hold enough content lines."""
    return line_quality.keep_good(spark, docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.deduplicate(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id."""
    return near_dedup.deduplicate(spark, docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(spark, docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return pieces.digests(docs, public_tokenizers.path(PIECES))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mixture), ("pieces", encoded)]

# Training, Viterbi decoding and tokenization have no SQL form; a test computes the rows anew from those of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to `documents`; tables between stages are written to the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
