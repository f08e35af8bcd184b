"""A corpus from raw documents to shards: quality rules, near-duplicate removal, decontamination,
mixing, sharding.  Each stage works on all that the one before it kept; all but the last return
the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedgeway.llm import common, decontaminate, mixing, ngram_jaccard, quality_rules, sharding

SHARDS = 8


def quality_stage(spark: SparkSession, docs: DataFrame | None, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    docs = common.table(spark, sf_dir, "documents") if docs is None else docs
    return quality_rules.keep_quality(docs, labels=common.table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of linked ones."""
    return ngram_jaccard.representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_benchmark(docs, common.table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, those of small sources more than once, so that sources have their target weights."""
    return mixing.mixed(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return sharding.kd_shards(docs, shards=SHARDS)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("k-d tree sharding", sharding_stage),
]

#: The language model of the first stage can't be expressed in SQL; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if before is not None:
            common.discard(before)  # the stage that read it is written
        before = docs
    return docs
