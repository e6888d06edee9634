"""One query for each operator, with production parameters, over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barline.llm import (
    bpe,
    collocations,
    hard_negatives,
    html_extract,
    license_scan,
    mixing,
    parity_join,
    quality_ranker,
    quality_rules,
    sharding,
    simhash,
    topk,
    url_filter,
)
from barline.llm.common import table

#: Rank file and pattern of the encoding queries.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.report(table(spark, sf_dir, "embeddings"))


def op3_quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ranker.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.report(table(spark, sf_dir, "pages"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.report(table(spark, sf_dir, "pages"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.report(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.report(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_topk": op2_topk,
    "op3_quality_ranker": op3_quality_ranker,
    "op4_simhash": op4_simhash,
    "op5_license_scan": op5_license_scan,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_sharding": op7_sharding,
    "op8_mixing": op8_mixing,
    "op9_url_filter": op9_url_filter,
    "op10_html_extract": op10_html_extract,
    "op11_ngram_join": op11_ngram_join,
    "op12_collocations": op12_collocations,
    "op13_hard_negatives": op13_hard_negatives,
}

#: DuckDB SQL for the same rows, where SQL can express them.
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op2_topk": topk.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
