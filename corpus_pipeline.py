"""A corpus pipeline of five stages over documents, each one operator of lodestar.llm.

Every stage takes all rows that its predecessor kept. Rows reach the next stage through a Parquet table in the shared
checkpoint folder, so a lost executor costs one stage's tasks and never an earlier stage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.common import in_small_batches, table, written
from lodestar.llm.mixing import mixed_documents
from lodestar.llm.quality_rules import quality_filter
from lodestar.llm.secret_scan import secret_scan
from lodestar.llm.sentencepiece_codec import sp_digests
from lodestar.llm.simhash_dedup import simhash_dedup


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    """The stage, whose Python workers get a few MB of rows at once."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        in_small_batches(spark)
        return f(spark, docs, sf_dir)

    return run


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_filter(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: groups by linked fingerprints, completed by shared shingles."""
    return simhash_dedup(docs)


@stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by their kind; every document stays."""
    return secret_scan(docs, redacted=True)


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document of the mix."""
    return sp_digests(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixture", mixture), ("tokens", tokens)]

#: Fingerprints, compression, apportionment and the tokenizer have no SQL form; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
