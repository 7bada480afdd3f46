"""Micro-batches written so that a replay adds nothing and no other stream is touched."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_id(checkpoint: str) -> str:
    """A stream is known by its checkpoint: a new checkpoint counts batches anew and is another stream."""
    return sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def write_batch(rows: DataFrame, batch_id: int, path: str, checkpoint: str, *partitions: str) -> None:
    """Replaces the folder of this stream's batch and leaves all others."""
    (
        rows.withColumns({"stream_id": F.lit(stream_id(checkpoint)), "batch_id": F.lit(batch_id)})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions, "stream_id", "batch_id")
        .parquet(path)
    )
