import pytest
from pyspark.sql import functions as F

from ruleharbor.operators import report


@pytest.mark.parametrize("listed, order", [
    (lambda v: report.by_scan(v, "s"), [-1, 1]), (lambda v: report.by_scan_and_table(v, "s", "t"), [-1, 1]),
    (report.needs_review, [1, 1]),
])
def test_violations_of_one_confidence_are_sorted_by_many_tasks(spark, listed, order):
    found = spark.range(4000).select(
        F.sha2(F.col("id").cast("string"), 256).alias("violation_id"), F.lit("s").alias("scan_id"), F.lit("t").alias("table_name"),
        F.lit("pending").alias("review_status"), F.lit("2024-01-01").cast("timestamp_ntz").alias("detected_at"),
        F.when(F.col("id") < 10, 0.5).otherwise(0.6).alias("confidence"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = listed(found).select("violation_id", "confidence", F.spark_partition_id().alias("part")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    keys = [(order[0] * r["confidence"], r["violation_id"]) for r in out]
    assert len(out) == 4000 and keys == sorted(keys)
    sizes = [sum(r["part"] == p for r in out) for p in {r["part"] for r in out}]
    assert max(sizes) < 2000
