"""Folders of text files: what is read, what is rejected, and which work is still to do."""

import os

from pyspark.sql import functions as F

from ruleharbor.sources import files


def keyed(spark, folder, *settings):
    return files.list_files(spark, folder).withColumn("key", files.work_key(F.col("path"), F.col("modified"), *settings))


def names(df):
    return sorted(os.path.basename(r.path) for r in df.collect())


def test_documents_and_rejects(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("größe\nline two")
    (tmp_path / "sub" / "b.txt").write_text("b" * 50)
    (tmp_path / "blank.txt").write_text(" \n\n")
    (tmp_path / "large.txt").write_text("x" * 1000)
    (tmp_path / "bad.txt").write_bytes(b"ok \xff\xfe")
    (tmp_path / "other.bin").write_text("left out")
    kept, rejected = files.read_files(spark, str(tmp_path), "*.txt", most_bytes=100)
    assert {os.path.basename(r.path): r.text for r in kept.collect()} == {"a.txt": "größe\nline two", "b.txt": "b" * 50}
    assert {os.path.basename(r.path): r.reason for r in rejected.collect()} == {
        "blank.txt": "blank", "large.txt": "too large", "bad.txt": "not UTF-8"}
    assert names(files.list_files(spark, str(tmp_path), "*.bin")) == ["other.bin"]


def test_a_touched_file_comes_again_and_others_do_not(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.txt").write_text(name)
        os.utime(tmp_path / f"{name}.txt", (1_700_000_000, 1_700_000_000))
    done = keyed(spark, str(tmp_path), 1000, 200).select("key").collect()
    log = spark.createDataFrame(done, "key string")
    assert names(files.still_to_do(keyed(spark, str(tmp_path), 1000, 200), log)) == []
    os.utime(tmp_path / "b.txt", (1_700_000_060, 1_700_000_060))
    (tmp_path / "d.txt").write_text("new")
    assert names(files.still_to_do(keyed(spark, str(tmp_path), 1000, 200), log)) == ["b.txt", "d.txt"]
    # Other settings are other work.
    assert names(files.still_to_do(keyed(spark, str(tmp_path), 500, 0), log)) == ["a.txt", "b.txt", "c.txt", "d.txt"]
