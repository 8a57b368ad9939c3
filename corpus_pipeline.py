"""From raw documents to encoded training text: five stages, each on all its predecessor kept.

STAGES: (name, function(spark, docs, sf_dir) -> DataFrame). Each result is written as Parquet and read again as the next
stage's docs; all but the last have the columns of documents.

Every stage takes null ids, texts and sources, empty and very long texts, repeated rows and further columns of any type
and name, and gives no rows for no rows; what becomes of each case is said with the stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from litloom.llm import bpe, exact, mixing, neardup, quality
from litloom.llm.common import settle, table
from litloom.llm.queries import MULTI


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or repeat themselves too much go; so do null, empty and wordless texts. Rows are
    judged one by one, so repeated rows stay or go together."""
    return quality.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) one row stays: the longest, then the least id, null last; of rows that repeat id and
    text the first by its other columns. Null and empty texts are equal, and one stays."""
    return exact.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the least id, null last. Null and wordless texts are like no other and
    stay; rows that repeat id and text count as one."""
    return neardup.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes their first word; null and wordless texts are never taken. A null source is a
    source, the last; rows that repeat id, source and text share what is theirs."""
    return mixing.mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of the mixture; a null text has no tokens."""
    return bpe.round_trip(docs, public_tokenizers.path(MULTI), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("source mix", source_mix), ("byte-level BPE", byte_bpe)]

#: Weighted sampling and byte-pair merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), "stage")
    return docs
