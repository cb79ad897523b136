"""From raw documents to shards of a training mixture, in five stages.

Each stage reads all that the one before kept, from the table it was written to. All but the
last return the columns of `documents`. Quality rules drop rejected texts, near-dedup keeps one
document of each group, decontamination drops texts that hold a benchmark item, mixing repeats
documents of scarce sources, sharding gives every row its shard and place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lendlens.llm import decontamination, mixing, near_dedup, outliers, slots
from lendlens.llm.scratch import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return outliers.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.kept_rows(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.kept_rows(docs, items)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return slots.sharded(docs)[0]


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("mixing", mixture),
    ("sharding", shards),
]

#: Estimates, signatures and fingerprints are not SQL; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
