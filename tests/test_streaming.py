from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ruleharbor.operators import reuse as R
from ruleharbor.operators import scan as S
from ruleharbor.operators.predicates import Rule
from ruleharbor.streaming.counter_stream import counter_stream, read_counters
from ruleharbor.streaming.keyed_reuse import Decisions, exact_answers
from ruleharbor.streaming.reuse_stream import (
    ENTRY_SCHEMA,
    able_to_answer,
    audit_stream,
    decision_stream,
    read_entry_log,
    reuse_stream,
    start_entry_log,
)
from ruleharbor.streaming.scan_stream import scan_stream
from tests.test_reuse import make

AS_OF = datetime(2024, 1, 1)
RULES = [Rule("big", "t", "v", ">", "50", data_type="number"), Rule("odd", "t", "name", "LIKE", "%7")]


def rows(spark, first, last):
    return spark.range(first, last).select(
        "id", (F.col("id") % 100).cast("double").alias("v"), F.concat(F.lit("n"), F.col("id")).alias("name"))


def test_scan_stream_equals_batch_and_survives_a_restart(spark, tmp_path):
    inbox, log, state = (str(tmp_path / p) for p in ("in", "log", "state"))
    rows(spark, 0, 120).write.parquet(inbox)

    def drain():
        stream = spark.readStream.schema(rows(spark, 0, 1).schema).parquet(inbox)
        query = scan_stream(stream, "t", ("id",), RULES, AS_OF, "s", log, state).trigger(availableNow=True).start()
        query.awaitTermination(120)

    drain()
    rows(spark, 120, 300).write.mode("append").parquet(inbox)
    drain()
    drain()
    batch = S.scan(spark, {"t": S.Source(rows(spark, 0, 300), ("id",))}, RULES, AS_OF, "s").violations
    ids = lambda df: sorted(r[0] for r in df.select("violation_id").collect())
    assert ids(spark.read.parquet(log)) == ids(batch)


def test_reuse_stream_equals_batch(spark, tmp_path):
    _, requests, entries = make(spark, 60, 8)
    log = requests.drop("key", "normalised_query").withColumn("query", F.lit("SELECT count(*) FROM orders;"))
    inbox, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    log.write.parquet(inbox)
    stream = spark.readStream.schema(log.schema).parquet(inbox)
    query = reuse_stream(stream, lambda: entries, out, state).trigger(availableNow=True).start()
    query.awaitTermination(300)
    key = lambda df: sorted((r["query_id"], r["layer"], r["entry_id"]) for r in df.collect())
    assert key(spark.read.parquet(out)) == key(R.reuse_cascade(R.with_key(log), entries))


def test_audit_stream_writes_each_request_once(spark, tmp_path):
    inbox, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    rows(spark, 0, 10).write.parquet(inbox)
    stream = spark.readStream.schema(rows(spark, 0, 1).schema).parquet(inbox)
    for _ in range(2):
        audit_stream(stream, lambda b: b.select("id"), out, state).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(out).count() == 10


def test_streams_with_other_checkpoints_add_to_one_log(spark, tmp_path):
    log = str(tmp_path / "log")
    for k in range(2):
        inbox = str(tmp_path / f"in{k}")
        rows(spark, 100 * k + 51, 100 * k + 61).write.parquet(inbox)
        stream = spark.readStream.schema(rows(spark, 0, 1).schema).parquet(inbox)
        query = scan_stream(stream, "t", ("id",), RULES[:1], AS_OF, "s", log, str(tmp_path / f"state{k}"))
        query.trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(log).count() == 20


def test_fresh_decisions_answer_later_batches_and_other_streams(spark, tmp_path):
    inbox, log, out = (str(tmp_path / p) for p in ("in", "log", "out"))
    shape = "query_id string, query string, user_role string, embedding array<double>, ts timestamp"

    def ask(name, query, at):
        row = (name, query, "analyst", None, datetime.fromisoformat(at))
        spark.createDataFrame([row], shape).write.mode("append").parquet(inbox)

    def drain(state, out=out):
        stream = spark.readStream.schema(shape).parquet(inbox)
        query = decision_stream(stream, lambda m: m.withColumn("final_decision", F.lit("APPROVE")), log, out, str(tmp_path / state))
        query.trigger(availableNow=True).start().awaitTermination(300)
        return {r.query_id: (r.layer, r.entry_id, r.final_decision) for r in spark.read.parquet(out).collect()}

    start_entry_log(spark.createDataFrame([], ENTRY_SCHEMA), log)
    ask("a", "SELECT count(*) FROM orders", "2024-01-01 10:00:00")
    assert drain("s") == {"a": ("miss", None, "APPROVE")}
    ask("b", "select  count(*) from orders;", "2024-01-01 10:00:20")
    ask("c", "SELECT count(*) FROM orders", "2030-01-01 10:00:00")  # long after the entry's end
    found = drain("s")
    assert found["b"] == ("exact", "a", "APPROVE") and found["c"] == ("miss", None, "APPROVE")
    assert sorted(r.entry_id for r in read_entry_log(spark, log).collect()) == ["a", "c"]
    other = drain("t", str(tmp_path / "out2"))  # another stream over the same requests
    assert other["b"][:2] == ("exact", "a") and other["a"][0] == "miss"


def given_entries(spark, *rows):
    """Entries from (entry_id, key, created_at, ttl_seconds)."""
    return spark.createDataFrame(
        [(i, k, "q", "r", "APPROVE", None, datetime.fromisoformat(at), ttl) for i, k, at, ttl in rows],
        "entry_id string, key string, normalised_query string, user_role string, decision string, embedding array<double>, "
        "created_at timestamp, ttl_seconds long")


def test_entries_of_other_days_are_not_read(spark, tmp_path):
    log = str(tmp_path / "log")
    start_entry_log(given_entries(spark, *[(str(i), f"k{i}", f"2024-01-{i + 1:02} 12:00:00", 86_400) for i in range(30)]), log)
    asked = spark.sql("SELECT timestamp'2024-01-11 06:00:00' AS ts")
    near = able_to_answer(read_entry_log(spark, log), asked)
    assert sorted(int(r.entry_id) for r in near.collect()) == [9, 10]
    assert "PartitionFilters: [isnotnull(day" in near._jdf.queryExecution().executedPlan().toString()
    assert able_to_answer(read_entry_log(spark, log), asked.where("false")).count() == 0


def test_long_lifetimes_and_what_replaced_them_are_read(spark, tmp_path):
    log = str(tmp_path / "log")
    start_entry_log(given_entries(
        spark, ("long", "k", "2024-01-01 00:00:00", 30 * 86_400), ("short", "k", "2024-01-05 00:00:00", 60),
        ("lasting", "l", "2024-01-02 00:00:00", 30 * 86_400), ("dead", "m", "2023-12-01 00:00:00", 60)), log)
    asked = spark.createDataFrame([("1", "k", datetime(2024, 1, 20)), ("2", "l", datetime(2024, 1, 20))], "query_id string, key string, ts timestamp")
    asked = asked.withColumns({"user_role": F.lit("r"), "normalised_query": F.lit("q")})
    near = able_to_answer(read_entry_log(spark, log), asked)
    assert {r.entry_id for r in near.collect()} == {"long", "short", "lasting"}
    # The long one was replaced by the short one, which is over.
    assert [(r.query_id, r.entry_id) for r in R.exact_hits(asked, R.lifetimes(near)).collect()] == [("2", "lasting")]


@pytest.fixture
def keyed_state(spark):
    """State in RocksDB, and no batches without rows, so that a stream over what is there comes to an end."""
    names = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
             "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_keyed_state_answers_by_each_entrys_own_lifetime(spark, tmp_path, keyed_state):
    """An entry of 30 days answers after weeks, one that is over or replaced does not; so after a restart too."""
    stored, asked, out, state = (str(tmp_path / p) for p in ("entries", "asked", "out", "state"))
    shape = "query_id string, key string, ts timestamp"

    def ask(*rows):
        spark.createDataFrame([(q, k, datetime.fromisoformat(at)) for q, k, at in rows], shape).write.mode("append").parquet(asked)

    def store(*rows):
        given_entries(spark, *rows).write.mode("append").parquet(stored)

    def drain():
        requests = spark.readStream.schema(shape).parquet(asked)
        entries = spark.readStream.schema(given_entries(spark).schema).parquet(stored)
        query = exact_answers(requests, entries).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
        return {r.query_id: r.entry_id for r in spark.read.parquet(out).collect()}

    store(("long", "k", "2024-01-01 00:00:00", 30 * 86_400), ("hour", "l", "2024-01-01 00:00:00", 3600),
          ("ever", "m", "2024-01-01 00:00:00", 10**9))
    ask(("a", "k", "2024-01-01 00:00:01"), ("b", "l", "2024-01-01 01:00:00"), ("c", "l", "2024-01-01 01:00:01"),
        ("d", "k", "2024-01-01 00:00:00"), ("e", "none", "2024-01-01 00:00:01"))
    assert drain() == {"a": "long", "b": "hour", "c": None, "d": None, "e": None}
    ask(("f", "k", "2024-01-29 00:00:00"), ("g", "k", "2024-02-01 00:00:00"), ("h", "l", "2024-01-29 00:00:00"), ("i", "m", "2030-01-01 00:00:00"))
    found = drain()
    assert (found["f"], found["g"], found["h"], found["i"]) == ("long", None, None, "ever")
    store(("new", "k", "2024-01-10 00:00:00", 60), ("again", "l", "2024-03-01 00:00:00", 60))
    ask(("j", "k", "2024-01-10 00:01:00"), ("n", "k", "2024-01-11 00:00:00"), ("o", "l", "2024-03-01 00:00:30"), ("p", "k", "2024-01-09 00:00:00"))
    found = drain()
    # An entry that is replaced ends, though its own lifetime goes on; what was asked before that keeps it.
    assert (found["j"], found["n"], found["o"], found["p"]) == ("new", None, "again", "long")


def test_keyed_state_equals_the_exact_layer(spark, tmp_path, keyed_state):
    _, requests, entries = make(spark, 200, 5)
    asked, stored, out, state = (str(tmp_path / p) for p in ("asked", "entries", "out", "state"))
    requests.select(F.col("query_id").cast("string").alias("query_id"), "key", F.col("ts").cast("timestamp").alias("ts")).write.parquet(asked)
    given = entries.select(F.col("entry_id").cast("string").alias("entry_id"), "key", "decision", F.col("created_at").cast("timestamp").alias("created_at"),
                           F.col("ttl_seconds").cast("long").alias("ttl_seconds"))
    given.write.parquet(stored)
    stream = exact_answers(spark.readStream.schema(spark.read.parquet(asked).schema).parquet(asked),
                           spark.readStream.schema(given.schema).parquet(stored))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(
        availableNow=True).start().awaitTermination(240)
    found = {int(r.query_id): (r.entry_id, r.decision) for r in spark.read.parquet(out).where("entry_id IS NOT NULL").collect()}
    want = {r.query_id: (str(r.entry_id), r.decision) for r in R.exact_hits(requests, R.lifetimes(entries)).collect()}
    assert found == want and spark.read.parquet(out).count() == 200


def test_replaced_entries_leave_the_state():
    kept = Decisions(slack_seconds=100).kept
    rows = [("a", "d", 0, 10**9), ("b", "d", 50, 10**9), ("c", "d", 200, 250), ("e", "d", 900, 10**9)]
    micros = [(i, d, born * 10**6, dies * 10**6) for i, d, born, dies in rows]
    assert [r[0] for r in kept(micros, 0)] == ["a", "b", "c", "e"]
    assert [r[0] for r in kept(micros, 151 * 10**6)] == ["b", "c", "e"]  # a was replaced at 50
    assert [r[0] for r in kept(micros, 351 * 10**6)] == ["c", "e"]  # dead, but what came before it stays replaced
    assert [r[0] for r in kept(micros, 5000 * 10**6)] == ["e"]


def test_running_counters_with_late_and_repeated_rows_and_restarts(spark, tmp_path):
    inbox, log, state = (str(tmp_path / p) for p in ("in", "log", "state"))
    shape = "id long, v double, name string, at timestamp"

    def arrive(*rows):
        spark.createDataFrame([(i, v, n, datetime(2024, 1, day, hour)) for i, v, n, day, hour in rows], shape).coalesce(1).write.mode("append").parquet(inbox)

    def drain():
        stream = spark.readStream.schema(shape).parquet(inbox)
        counter_stream(stream, "t", ("id",), RULES, AS_OF, "at", "2 days", log, state).trigger(availableNow=True).start().awaitTermination(240)
        return {r.rule_id: (r.violation_count, r.rows) for r in read_counters(spark, log).collect()}

    arrive((1, 60.0, "n7", 1, 0), (2, 10.0, "n7", 1, 1), (3, 99.0, "x", 2, 0), (1, 60.0, "n7", 1, 0))
    assert drain() == {"big": (2, 3), "odd": (2, 3)}
    # Rows of an earlier day, a row that was there before, and a new day.
    arrive((4, 70.0, "x", 1, 5), (3, 99.0, "x", 2, 0), (5, 1.0, "m7", 3, 0))
    assert drain() == {"big": (3, 5), "odd": (3, 5)}
    assert drain() == {"big": (3, 5), "odd": (3, 5)}
    arrive((6, 80.0, "x", 20, 0))
    drain()
    arrive((7, 90.0, "x", 1, 0), (8, 90.0, "x", 19, 0))  # 7 is far too late
    found = drain()
    counted = [(1, 60.0, "n7"), (2, 10.0, "n7"), (3, 99.0, "x"), (4, 70.0, "x"), (5, 1.0, "m7"), (6, 80.0, "x"), (8, 90.0, "x")]
    src = {"t": S.Source(spark.createDataFrame(counted, "id long, v double, name string"), ("id",))}
    batch = {r.rule_id: (r.violation_count, 7) for r in S.count_violations(src, S.plan_pairs(RULES, src, S.Setting(AS_OF))).collect()}
    assert found == batch
