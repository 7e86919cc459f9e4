"""The queries of this subpackage, as ``__spark_entry__`` adds them, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import hilbert_sharding, line_dedup, quality_classifier, quality_rules, sentencepiece_codec, simhash_dedup, source_mixing, suffix_dedup, topk_hamming, url_rules
from .shared import read_table

SENTENCEPIECE_MODEL = os.environ.get("DEALGRAIN_SENTENCEPIECE", "/opt/tokenizers/piece_bpe_32k.model")
Query = Callable[[SparkSession, str], DataFrame]


def op1_topk_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_hamming.topk_hamming(read_table(spark, sf_dir, "embeddings"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_dedup(read_table(spark, sf_dir, "documents"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.url_filter(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_classifier(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.sentencepiece_encode(read_table(spark, sf_dir, "documents"), SENTENCEPIECE_MODEL)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(read_table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.source_mixing(read_table(spark, sf_dir, "documents"))


def op8_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_sharding.hilbert_sharding(read_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(read_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_topk_hamming, op2_simhash_dedup, op3_url_rules, op4_quality_classifier, op5_sentencepiece, op6_line_dedup, op7_source_mixing, op8_hilbert_sharding, op9_suffix_dedup, op10_quality_rules)}
ORACLES: dict[str, str] = {"op1_topk_hamming": topk_hamming.oracle(), "op6_line_dedup": line_dedup.oracle(), "op7_source_mixing": source_mixing.oracle(), "op8_hilbert_sharding": hilbert_sharding.oracle(), "op10_quality_rules": quality_rules.oracle()}
