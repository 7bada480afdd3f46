"""Running violation counters of a stream of rows, kept by stateful aggregation.

Rows that arrive twice count once, as long as the second comes within the watermark of the first. Counters are held per
window of event time until the watermark has passed it, so the state is bounded; each micro-batch writes the windows
that it changed to a folder of its own, and the last state of every window counts.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ruleharbor.operators.predicates import Rule, Setting
from ruleharbor.operators.scan import Source, conditional_counts, plan_pairs
from ruleharbor.streaming.batches import write_batch


def counter_stream(
    rows: DataFrame, table: str, key: tuple[str, ...], rules: Iterable[Rule], as_of: datetime, event_time: str, lateness: str,
    path: str, checkpoint: str, window: str = "1 day",
) -> DataStreamWriter:
    """Writer of the counters of a streaming table, to be started by the caller.

    ``event_time`` names the time of a row; rows more than ``lateness`` behind the latest one, or whose window is
    closed by that, no longer count.
    """
    once = rows.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(list(key))
    pairs = [p for p in plan_pairs(rules, {table: Source(once, key)}, Setting(as_of)) if p.violates is not None]
    counted = conditional_counts(Source(once, key), pairs, F.window(event_time, window).alias("window"))
    flat = counted.select(F.col("window.start").alias("start"), "rows", F.inline("counts"))

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, path, checkpoint)

    return flat.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """(rule_id, violation_count, rows): the counters of a log that one or more streams write to."""
    latest = Window.partitionBy("stream_id", "start", "rule_id").orderBy(F.desc("batch_id"))
    last = spark.read.parquet(path).withColumn("place", F.row_number().over(latest)).where("place = 1")
    return last.groupBy("rule_id").agg(F.sum("violation_count").alias("violation_count"), F.sum("rows").alias("rows"))
