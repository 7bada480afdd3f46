"""Exact duplicates by content hash, confirmed by the bytes of the texts. Native: DataFrame functions only.

A row's content is its text after each run of white space became one space. Rows are grouped
by (128-bit hash, content), with the smallest id and the count as the only aggregates: map
tasks combine copies before the shuffle, so a group that holds a third of all rows sends one
row per task, and equal hashes of different contents stay apart because the content itself is
part of the key. The table of groups is written once and joined back by hash alone; only
hashes that several contents share (none in practice) are looked up by content as well.

Defined cases: a null text is empty; repeated rows (same id and text) are rows of one group; a
null id loses against every other id; a group without any id keeps a null id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleharbor.llm.common import cut

# Runs of white space that are not already one plain space.
ODD_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def content(text: Column) -> Column:
    """The text with each run of the six ASCII white-space characters replaced by one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), ODD_SPACE, " ")


def digest128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def keepers(documents: DataFrame, digest=digest128) -> tuple[DataFrame, DataFrame | None]:
    """(hash, keep_id, group_size, contents) per hash, and per content of shared hashes where there are any."""
    text = content(F.col("text"))
    rows = documents.select("doc_id", text.alias("content"))
    groups = rows.groupBy(digest(F.col("content")).alias("hash"), "content").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    by_hash = cut(groups.groupBy("hash").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"),
        F.count(F.lit(1)).alias("contents")))
    shared = by_hash.where("contents > 1").select("hash")
    if shared.isEmpty():
        return by_hash, None
    return by_hash, groups.join(shared, "hash", "left_semi")


def decide(documents: DataFrame, digest=digest128) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept and the SHA-256 of the content."""
    by_hash, by_content = keepers(documents, digest)
    rows = documents.select("doc_id", content(F.col("text")).alias("content"))
    rows = rows.withColumn("hash", digest(F.col("content")))
    plain = rows.select("doc_id", "hash", F.sha2(F.col("content").cast("binary"), 256).alias("text_sha256")).join(
        by_hash.where("contents = 1"), "hash")
    columns = ["doc_id", "keep_id", "group_size", "text_sha256"]
    found = plain.select(*columns)
    if by_content is not None:
        odd = rows.join(by_content, ["hash", "content"])
        found = found.unionByName(
            odd.withColumn("text_sha256", F.sha2(F.col("content").cast("binary"), 256)).select(*columns))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                        "text_sha256")


def drop_copies(documents: DataFrame, digest=digest128) -> DataFrame:
    """The documents that stay, with their columns. Of rows that repeat an id and a text, one stays."""
    def key(sha: Column) -> Column:
        return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), sha))

    stay = decide(documents.select("doc_id", "text"), digest).where("kept").select(
        key(F.col("text_sha256")).alias("__stay")).distinct()
    rows = documents.withColumn("__key", key(F.sha2(content(F.col("text")).cast("binary"), 256)))
    first = Window.partitionBy("__key").orderBy(F.lit(1))
    return rows.join(stay, rows["__key"] == stay["__stay"], "left_semi").withColumn(
        "__n", F.row_number().over(first)).where("__n = 1").select(*documents.columns)
