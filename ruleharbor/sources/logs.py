"""Append-only parquet logs: violations, reviews, explanations, decisions, rule catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleharbor.operators.predicates import RULE_SCHEMA

VIOLATION_PARTITIONS = ("scan_id", "table_name")


def append_violations(violations: DataFrame, path: str) -> None:
    """Add the rows of a scan. Readers of one scan or table touch only its folders."""
    violations.write.mode("append").partitionBy(*VIOLATION_PARTITIONS).parquet(path)


def replace_scan(violations: DataFrame, path: str) -> None:
    """Write a scan again: its own folders are replaced, all others stay."""
    (
        violations.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*VIOLATION_PARTITIONS)
        .parquet(path)
    )


def append_rows(rows: DataFrame, path: str, *partitions: str) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule catalogue: files of JSON objects, one per line, or files of one JSON list.

    A file is read as lines unless its first character that is no white space opens a list.
    """
    lines = spark.read.text(path, wholetext=False).select("_metadata.file_path", F.col("value"))
    lists = spark.read.text(path, wholetext=True).where(F.col("value").rlike(r"^\s*\["))
    rule = f"struct<{RULE_SCHEMA}>"
    of_lists = lists.select("_metadata.file_path", F.explode(F.from_json("value", f"array<{rule}>")).alias("rule"))
    of_lines = lines.where(F.trim("value") != "").join(
        lists.select("_metadata.file_path"), "file_path", "left_anti").select(
        F.from_json("value", RULE_SCHEMA).alias("rule"))
    return of_lines.unionByName(of_lists.select("rule")).select("rule.*")


def new_rows_only(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet, each key once."""
    return rows.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def find_by_id(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.where(rows[key] == value)
