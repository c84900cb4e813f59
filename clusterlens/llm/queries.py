"""The registered queries of the operators here: one per operator, over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from clusterlens.llm import (
    conversations,
    exact_dedup,
    filter_audit,
    line_quality,
    mixing,
    near_dedup,
    neighbours,
    pieces,
    repeats,
    token_files,
    toxicity,
    urls,
    warc,
)
from clusterlens.llm.oracle import ORACLES
from clusterlens.llm.shared import table

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.summary(spark, table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_quality.judge(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.drop("content_share")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(spark, table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.classes(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", "class_size", "kept")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(spark, table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(spark, docs, table(spark, sf_dir, "labels")))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damage_and_repair(spark, table(spark, sf_dir, "conversations"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(spark, table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_url_filter,
        op3_token_files,
        op4_warc,
        op5_line_quality,
        op6_exact_dedup,
        op7_near_dedup,
        op8_pieces,
        op9_repeats,
        op10_toxicity,
        op11_conversations,
        op12_filter_audit,
        op13_neighbours,
    )
}
__all__ = ["ORACLES", "QUERIES"]
