"""Cut points: written rows stay, shuffle files of the steps before them go."""

import os
import time

from pyspark.sql import functions as F

from ruleharbor.session import CLEANUP_KEY, cut_lineage


def shuffle_bytes(folders, most=None):
    """Bytes of shuffle files; with ``most`` once they are that few, or after some seconds. Spark deletes beside its work."""
    found = _shuffle_bytes(folders)
    for _ in range(50):
        if most is None or found <= most:
            break
        time.sleep(0.2)
        found = _shuffle_bytes(folders)
    return found


def _shuffle_bytes(folders):
    return sum(os.path.getsize(os.path.join(at, f)) for folder in folders for at, _, files in os.walk(folder) for f in files if f.startswith("shuffle_"))


def test_a_cut_leaves_no_shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [str(d) for d in manager.localDirs()]
    setting, before = spark.conf.get(CLEANUP_KEY), shuffle_bytes(folders)
    rows = spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    written = cut_lineage(rows.repartition(5, "text").groupBy("text").agg(F.max("id").alias("id")))
    assert shuffle_bytes(folders, before + 1_000_000) < before + 1_000_000  # 200,000 rows of 64 characters were shuffled
    assert spark.conf.get(CLEANUP_KEY) == setting
    assert written.columns == ["text", "id"] and written.count() == 200_000 and written.join(rows, ["id", "text"]).count() == 200_000


def test_a_cut_keeps_repeated_names_and_columns_of_the_frame(spark):
    rows = spark.createDataFrame([(1, None), (2, "b")], "id long, text string")
    written = cut_lineage(rows.select("id", "id", "text"))
    assert written.columns == ["id", "id", "text"] and sorted(map(tuple, written.collect())) == [(1, 1, None), (2, 2, "b")]
    own = cut_lineage(rows)
    assert own.join(rows.select(F.col("id").alias("other")), own["id"] == F.col("other")).select(own["text"]).count() == 2
