"""Text files as documents: read whole, known by path and modification time, unreadable ones listed with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleharbor.functions.ids import content_key

MOST_BYTES = 1 << 30  # of a file; a cell cannot hold two gigabytes


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, modified, length) of the files below a folder; their content is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.col("modificationTime").alias("modified"), "length")


def read_files(spark: SparkSession, folder: str, pattern: str = "*", most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Documents (path, modified, length, text) and rejects (path, modified, length, reason) of a folder.

    A file is rejected that is blank, larger than ``most_bytes`` or no UTF-8; the rest of the folder is read all the same.
    Files of no bytes at all are not listed: Spark leaves them out.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    about = ("path", F.col("modificationTime").alias("modified"), "length")
    # The source skips the content of files that a condition on their length leaves out.
    texts = found.where(F.col("length") <= most_bytes).select(*about, F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    large = found.where(F.col("length") > most_bytes).select(*about, F.lit("too large").alias("reason"))
    reason = F.when(F.col("text").isNull(), "not UTF-8").when(~F.col("text").rlike(r"\S"), "blank")
    told = texts.withColumn("reason", reason)
    return told.where("reason IS NULL").drop("reason"), large.unionByName(told.where("reason IS NOT NULL").drop("text"))


def work_key(path: Column, modified: Column, *settings: object) -> Column:
    """Names a piece of work: a file as it was at that time, processed with these settings."""
    return content_key(path, modified.cast("string"), *[F.lit(str(s)) for s in settings])


def still_to_do(documents: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    """Documents whose work is not among that done."""
    return documents.join(done.select(key), key, "left_anti")
