"""Corpus pipeline: documents to a deduplicated, clean, mixed and sharded training corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of documents.

Defined cases, beyond those of each stage: an empty table gives an empty table with the
same columns, further columns travel along whatever their names (the last stage replaces
those named like its results), and rows are never told apart by order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curatrix.llm import decontaminate, language_id, mixing, near_dedup, sharding
from curatrix.llm.common import materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or far from every language profile, go; so do null and empty
    texts. Repeated rows are judged each; a null doc_id or lang is no reason to go."""
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the least doc_id. Null and empty
    texts and rows with a null doc_id stay; of rows that share a doc_id one stays."""
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts and rows with a null doc_id
    stay; rows that share a doc_id go together; an empty benchmark drops nothing."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks, none to three times. A null
    source is a source; null and empty texts have no words and count as size 0; repeated
    rows are rows of their own."""
    return mixing.emit(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot in it. A null text has the size of an empty one;
    copies from the mix keep to one shard as equal texts do, each with a slot of its own."""
    return sharding.assign_shards(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL can't express rank-order profiles, minhash classes or sampled splitters.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
