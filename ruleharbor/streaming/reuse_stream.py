"""Decision reuse, fresh decisions and audit logging on a stream of requests.

Entries live in a log partitioned by the day of their creation and the day of their end (days since 1970, UTC), stream
and batch. A micro-batch reads only the days from which an entry can answer one of its requests, whatever its lifetime.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ruleharbor.operators.reuse import reuse_cascade, store_decisions, with_key
from ruleharbor.streaming.batches import stream_id, write_batch

DAY_MICROS = 86_400_000_000
ENTRY_SCHEMA = (
    "entry_id string, key string, normalised_query string, user_role string, decision string, "
    "embedding array<double>, created_at timestamp, ttl_seconds long"
)
_GIVEN = "given"  # stands for the checkpoint of entries that no stream stored


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def _day(at: Column) -> Column:
    return F.floor(_micros(at) / F.lit(DAY_MICROS)).cast("int")


def _write_entries(entries: DataFrame, batch_id: int, path: str, checkpoint: str) -> None:
    kinds = [part.strip().split(" ") for part in ENTRY_SCHEMA.split(",")]
    rows = entries.select(*[F.col(name).cast(kind).alias(name) for name, kind in kinds])
    end = F.floor((_micros(F.col("created_at")) + F.col("ttl_seconds") * 1_000_000) / F.lit(DAY_MICROS)).cast("int")
    write_batch(rows.withColumns({"day": _day(F.col("created_at")), "until": end}), batch_id, path, checkpoint, "day", "until")


def start_entry_log(entries: DataFrame, path: str) -> None:
    """Lays down a log of entries with those known so far, which may be none."""
    _write_entries(entries, 0, path, _GIVEN)


def read_entry_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{ENTRY_SCHEMA}, day int, until int, stream_id string, batch_id long").parquet(path)


def able_to_answer(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """Entries of a log that can answer one of the requests, or end the life of one that could.

    Days are read from the first one that holds an entry whose lifetime reaches the first request. Older entries died
    before it; a short-lived one that was stored later still counts, as it replaced what was stored before.
    """
    span = requests.agg(F.min(_micros(F.col("ts"))).alias("first"), F.max(_micros(F.col("ts"))).alias("last")).first()
    if span["first"] is None:
        return entries.where("false")
    first, last = span["first"] // DAY_MICROS, span["last"] // DAY_MICROS
    lasting = entries.where((F.col("until") >= first) & (F.col("day") <= last)).agg(F.min("day").alias("since")).first()
    if lasting["since"] is None:
        return entries.where("false")
    return entries.where(F.col("day").between(lasting["since"], last))


def reuse_stream(
    requests: DataFrame, entries: Callable[[], DataFrame], out_path: str, checkpoint: str
) -> DataStreamWriter:
    """Answers arriving requests from stored decisions, layer by layer.

    ``entries`` is called per micro-batch, so decisions stored meanwhile count. A micro-batch
    overwrites its own folder: a replay adds nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(reuse_cascade(with_key(batch), entries()), batch_id, out_path, checkpoint)

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def decision_stream(
    requests: DataFrame,
    decide: Callable[[DataFrame], DataFrame],
    entry_log: str,
    out_path: str,
    checkpoint: str,
) -> DataStreamWriter:
    """Answers requests from the log of entries; what nothing answers is decided and stored for later batches.

    ``decide`` gets the requests of a micro-batch that no entry answers (with key) and returns them with
    ``final_decision``; approvals and blocks become entries. Answers carry ``final_decision`` and ``layer``.
    A batch never reads what it or a later batch of its stream stored, so a replay decides the same
    requests and overwrites the same folders. The log must exist (``start_entry_log``).
    """
    own = stream_id(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        asked = with_key(batch).persist()
        try:
            known = read_entry_log(batch.sparkSession, entry_log).where(
                (F.col("stream_id") != own) | (F.col("batch_id") < batch_id))
            found = reuse_cascade(asked, able_to_answer(known, asked)).persist()
            missed = asked.join(found.where("layer = 'miss'").select("query_id"), "query_id", "left_semi")
            fresh = decide(missed).persist()
            answers = found.join(fresh.select("query_id", F.col("final_decision").alias("fresh")), "query_id", "left")
            write_batch(answers.select("query_id", "entry_id", "layer", F.coalesce("decision", "fresh").alias(
                "final_decision")), batch_id, out_path, checkpoint)
            stored = store_decisions(fresh.withColumn("cache_layer", F.lit(None).cast("string")), with_vectors=True)
            _write_entries(stored, batch_id, entry_log, checkpoint)
            fresh.unpersist()
            found.unpersist()
        finally:
            asked.unpersist()

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def audit_stream(
    decided: DataFrame, to_rows: Callable[[DataFrame], DataFrame], out_path: str, checkpoint: str
) -> DataStreamWriter:
    """Appends one audit row per decided request, exactly once per micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(to_rows(batch), batch_id, out_path, checkpoint)

    return decided.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
