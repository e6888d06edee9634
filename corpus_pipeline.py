"""From raw documents to token digests: clean, judge, de-duplicate, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from barline.llm import bpe, mixing, near_copies, quality_ranker, quality_rules
from barline.llm.common import remove, shared_folder, stored, table
from barline.llm.queries import PATTERN, RANKS


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes failing lines, and the documents that the rules reject."""
    return quality_rules.clean(docs)


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents predicted good by a ranker learnt from the labelled raw documents."""
    ranker = quality_ranker.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_ranker.keep_good(docs, ranker)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: candidates by SimHash through op4's tree and by band keys, links by whole sets."""
    return near_copies.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents so that sources meet their targets."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document of the mix."""
    return bpe.digests(docs, RANKS, PATTERN)


STAGES = [
    ("quality rules", clean),
    ("quality classifier", judge),
    ("near-dedup", deduplicate),
    ("mixing", mix),
    ("byte-level BPE", encode),
]

#: Near-dedup and BPE can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. A stage's table is removed as soon as the next one is written; the last one, which the result reads, stays.

    Null and empty texts go with the quality rules; of documents without a doc_id, and of rows that share one, as many stay as
    near_copies.keep_one says. Extra columns are carried to the last stage, whatever their names. An empty corpus gives no rows.
    """
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
