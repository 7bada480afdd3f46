"""Continuous rule scan: arriving rows are checked with the same Columns as a batch scan."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ruleharbor.operators.predicates import Rule, Setting
from ruleharbor.operators.scan import Source, as_violations, hits, plan_pairs, rules_frame
from ruleharbor.streaming.batches import write_batch


def scan_stream(
    rows: DataFrame,
    table: str,
    key: tuple[str, ...],
    rules: Iterable[Rule],
    as_of: datetime,
    scan_id: str,
    log_path: str,
    checkpoint: str,
) -> DataStreamWriter:
    """Writer for the violations of a streaming table, to be started by the caller.

    A micro-batch overwrites its own folder (stream and batch), so a replayed batch adds nothing and a
    stream with another checkpoint adds to the same log.
    """
    rules = list(rules)

    def write(batch: DataFrame, batch_id: int) -> None:
        source = {table: Source(batch, key)}
        pairs = plan_pairs(rules, source, Setting(as_of))
        found = as_violations(hits(source, pairs, payload=True), rules_frame(batch.sparkSession, rules), scan_id, as_of)
        write_batch(found, batch_id, log_path, checkpoint, "scan_id", "table_name")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
