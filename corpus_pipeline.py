"""A training-data pipeline: every stage works on all that its predecessor kept.

Quality classifier, exact duplicates, near duplicates, benchmark passages, mixing to target weights. Each
stage is written as Parquet to the shared checkpoint folder and read again by the next one, so a lost
executor costs at most the stage at work. A run's folder stays until the caller removes it: its last stage is the result.

Defined cases, as in the stages' modules: a null text is empty; empty texts are judged like others, one of equal ones
stays; rows without id are told apart by their text; of ties the smallest id stays; an empty table gives an empty one;
extra columns go through all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ruleharbor.llm import decontaminate, exact_dedup, mixing, quality, simhash
from ruleharbor.llm.common import table
from ruleharbor.session import shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the row with the smallest id."""
    return simhash.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight and its draw say, in shuffled order."""
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("mix", mixing_stage),
]

# The quality network cannot be expressed in SQL; tests/llm holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
