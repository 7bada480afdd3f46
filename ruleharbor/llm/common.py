"""Helpers shared by the operators: durable cut points, size-checked broadcasts, learning rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleharbor.session import cut_lineage

BROADCAST_ROWS = 100_000


cut = cut_lineage


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcasts ``df``, a table of narrow rows already cut, if it is counted to hold at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def learning_sample(documents: DataFrame, ids: DataFrame, most: int, columns: list[str]) -> DataFrame:
    """The texts of at most ``most`` ids of ``ids`` (doc_id and ``columns``), chosen by the hash of the id.

    ``ids`` must hold an id once. The chosen ids are few by ``most``, so they are broadcast.
    """
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return documents.select("doc_id", F.col("text").cast("binary").alias("text")).join(
        F.broadcast(chosen.select("doc_id", *columns)), "doc_id")


def bytes_of(column: pa.Array) -> list[bytes]:
    """The cells of a binary column; a null is an empty text."""
    return [x or b"" for x in column.to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds about ``most`` bytes or one row, to bound the memory of a task."""
    for batch in batches:
        start, held = 0, 0
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_binary(column.type) or pa.types.is_string(column.type):
                lengths = pa.compute.binary_length(column).fill_null(0)
                sizes += lengths.to_numpy(zero_copy_only=False)
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def per_text(documents: DataFrame, work: Callable[[list[bytes]], dict[str, pa.Array]], schema: str,
             keep: list[str]) -> DataFrame:
    """Runs ``work`` over the whole texts of batches of documents; returns ``keep`` and its columns."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = work(bytes_of(batch.column("__text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keep] + [found[n] for n in names], names=[*keep, *names])

    kept = documents.select(*keep, F.col("text").cast("binary").alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "__text"]
    return kept.mapInArrow(run, ", ".join([*fields, schema]))
