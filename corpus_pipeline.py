"""The corpus pipeline: quality, near-duplicates, benchmark contamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; stages but
the last return the columns of ``documents``. The result of a stage is written to the shared folder
and read again as the next one's input.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from narrata.llm import decontaminate, mixing, nearcopies, quality, sharding
from narrata.llm.common import removed, shared_folder, table

#: Shares of all tokens by domain that the mix aims at.
TARGETS = {"en": 0.55, "de": 0.15, "es": 0.15, "fr": 0.15}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with five-word similarity of 0.8 or more one row stays: the least id's, null ids last."""
    return nearcopies.near_copies_removed(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out as their rates say."""
    return mixing.mixed_documents(docs, table(spark, sf_dir, "labels"), TARGETS)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: shard and slot."""
    return sharding.rendezvous_shards(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL can't express the fitted stages; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{n}-{name}")
            docs = spark.read.parquet(f"{folder}/{n}-{name}")
            if n:  # nothing reads what the stage before has written any more
                removed(spark, f"{folder}/{n - 1}-{STAGES[n - 1][0]}")
    return docs
