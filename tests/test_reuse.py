import random
import uuid
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ruleharbor.operators import reuse as R
from ruleharbor.operators import screening

START = datetime(2024, 1, 1)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def make(spark, n, seed):
    """A log in which one text holds a third of all rows and the rest are near copies and others."""
    rnd = random.Random(seed)
    bases = ["select name, balance from customer where customer_id = ", "select total_price from orders where region = "]
    rows = []
    for i in range(n):
        text = "select count(*) from orders" if rnd.random() < 0.33 else rnd.choice(bases) + str(rnd.randint(0, 30))
        at = START + timedelta(seconds=rnd.randint(0, 9 * 3600), microseconds=i)
        vec = [float(x) for x in np.eye(4)[rnd.randrange(4)] + rnd.random() * 0.2]
        rows.append((i, text, rnd.choice(["analyst", "viewer"]), at, vec, rnd.choice([3600, 21600]), f"d{i}"))
    ddl = ("query_id long, query string, user_role string, ts timestamp_ntz, embedding array<double>, "
           "ttl_seconds int, decision string")
    log = R.with_key(spark.createDataFrame(rows, ddl))
    entries = log.select(F.col("query_id").alias("entry_id"), "key", "normalised_query", "user_role", "embedding",
                         F.col("ts").alias("created_at"), "ttl_seconds", "decision")
    return rows, log.select("query_id", "key", "normalised_query", "user_role", "embedding", "ts"), entries


def alive_at(rows, t):
    """Entries that answer at ``t``: the last stored of each key, if not expired."""
    last = {}
    for r in sorted(rows, key=lambda r: r[3]):
        if r[3] < t:
            last[(r[1], r[2])] = r
    return [r for r in last.values() if t <= r[3] + timedelta(seconds=r[5])]


@pytest.fixture(scope="module")
def log(spark):
    rows, requests, entries = make(spark, 240, 3)
    return rows, requests.cache(), entries.cache()


def answers(df):
    return {r["query_id"]: r["entry_id"] for r in df.collect()}


def test_exact(log):
    rows, requests, entries = log
    want = {r[0]: e[0] for r in rows for e in alive_at(rows, r[3]) if (e[1], e[2]) == (r[1], r[2])}
    assert answers(R.exact_hits(requests, R.lifetimes(entries))) == want


@pytest.mark.parametrize("rows_of_a_slice", [10, 1_000_000])
def test_exact_whatever_the_slices(log, rows_of_a_slice, monkeypatch):
    rows, requests, entries = log
    monkeypatch.setattr(R, "SLICE_ROWS", rows_of_a_slice)
    want = {r[0]: e[0] for r in rows for e in alive_at(rows, r[3]) if (e[1], e[2]) == (r[1], r[2])}
    assert answers(R.exact_hits(requests, R.lifetimes(entries))) == want


@pytest.mark.parametrize("ratio, spread", [(0.95, 3), (0.95, 1), (0.8, 2), (0.5, 3)])
def test_fuzzy(log, ratio, spread):
    rows, requests, entries = log
    want = {}
    for r in rows:
        fits = [e for e in alive_at(rows, r[3]) if e[2] == r[2]
                and 1 - distance(e[1], r[1]) / max(len(e[1]), len(r[1])) >= ratio]
        if fits:
            want[r[0]] = min(fits, key=lambda e: e[3])[0]
    assert answers(R.fuzzy_hits(requests, R.lifetimes(entries), ratio, spread)) == want


@pytest.mark.parametrize("hits", [R.fuzzy_hits, R.semantic_hits])
def test_requests_are_not_multiplied_by_the_keys_they_match(log, hits, monkeypatch):
    rows, requests, entries = log
    sent = []
    running = R.living
    monkeypatch.setattr(R, "living", lambda asked, *more: sent.append(asked.count()) or running(asked, *more))
    hits(requests, R.lifetimes(entries)).collect()
    assert sum(sent) <= len(rows)


@pytest.mark.parametrize("hits", [R.fuzzy_hits, R.semantic_hits])
@pytest.mark.parametrize("of_a_slice, of_a_group", [(20, 1_000_000), (1_000_000, 3), (20, 3)])
def test_matches_whatever_the_groups(log, hits, of_a_slice, of_a_group, monkeypatch):
    _, requests, entries = log
    alive = R.lifetimes(entries)
    want = answers(hits(requests, alive))
    monkeypatch.setattr(R, "GROUP_SLICE_ROWS", of_a_slice)
    monkeypatch.setattr(R, "GROUP_ROWS", of_a_group)
    assert want and answers(hits(requests, alive)) == want


def small_groups(monkeypatch, folder):
    """Groups take few entries from now on; the function returned gives the entries of each group so far."""
    monkeypatch.setattr(R, "GROUP_SLICE_ROWS", 30)
    monkeypatch.setattr(R, "GROUP_ENTRIES", 25)
    searched, told = R._nearest_living, str(folder)

    def watched(left, right, oldest):
        with open(f"{told}/{uuid.uuid4()}", "w") as f:
            f.write(str(right.num_rows - right.column("born").null_count))
        return searched(left, right, oldest)

    monkeypatch.setattr(R, "_nearest_living", watched)
    return lambda: [int(f.read_text()) for f in folder.iterdir()]


@pytest.mark.parametrize("hits", [R.fuzzy_hits, R.semantic_hits])
def test_few_requests_meet_many_entries_in_groups_of_bounded_size(log, hits, monkeypatch, tmp_path):
    rows, requests, entries = log
    few, alive = requests.where("query_id % 40 = 0"), R.lifetimes(entries)
    want = answers(hits(few, alive))
    sizes = small_groups(monkeypatch, tmp_path)
    assert want and answers(hits(few, alive)) == want
    assert 0 < max(sizes()) < len(rows) / 4


def test_the_gate_meets_entries_in_groups_of_bounded_size(log, monkeypatch, tmp_path):
    """The step that decisions, escalations and the audit log share."""
    rows, requests, entries = log
    given = screening.GateInputs(catalog=None, policies=None, embeddings=None, replies=None, entries=entries)
    reused = lambda: sorted(tuple(r) for r in screening.with_reuse(requests.select("query_id"), requests, given).select(
        "query_id", F.coalesce("cache_layer", F.lit("")), F.coalesce("cached_decision", F.lit(""))).collect())
    want = reused()
    sizes = small_groups(monkeypatch, tmp_path)
    assert len(want) == len(rows) and reused() == want
    assert 0 < max(sizes()) < len(rows) / 4


def in_slices(slices, rows):
    """Of each time in microseconds the number of its slice."""
    return [r[0] for r in rows.select(slices.number(F.col("at"))).collect()]


def test_slices_hold_as_many_requests_or_births(spark):
    at = lambda df, *c: df.select(*[F.col("id").alias(x) for x in c])
    # A burst of births in one thousandth of the time, few requests.
    asked = at(spark.range(0, 1_000_000, 10_000), "at")
    alive = at(spark.range(500_000, 501_000), "born").withColumn("dies", F.col("born") + 5)
    found = R.time_slices(asked, alive, 300)
    numbers = in_slices(found, at(spark.range(0, 1_000_000, 1000), "at"))
    assert numbers == sorted(numbers) and 4 <= len(set(found.numbers)) <= 8
    births = Counter(in_slices(found, alive.select(F.col("born").alias("at"))))
    assert max(births.values()) <= 300 and max(births.values()) <= found.entries
    # Times outside go to the ends.
    assert in_slices(found, spark.createDataFrame([(-5,), (10**17,)], "at long")) == [numbers[0], max(found.numbers)]


def test_slices_of_entries_that_live_on(spark):
    asked = spark.range(0, 4000).select(F.col("id").alias("at"))
    alive = spark.range(0, 4000).select(F.col("id").alias("born"), F.lit(10_000).cast("long").alias("dies"))
    found = R.time_slices(asked, alive, 50)
    # Slices grow with the entries they carry on, so copies stay a few times the rows.
    assert sum(found.numbers.index(n) for n in set(found.numbers)) < 2 * 4000
    assert found.entries == 3999


def test_slices_without_requests(spark):
    none = spark.range(0).select(F.col("id").alias("at"))
    alive = spark.range(10).select(F.col("id").alias("born"), (F.col("id") + 1).alias("dies"))
    assert set(R.time_slices(none, alive, 5).numbers) == {0}


@pytest.mark.parametrize("step", [1, 7, 1_000_000])
@pytest.mark.parametrize("oldest", [True, False])
def test_best_living_entry_of_a_group(step, oldest, monkeypatch):
    monkeypatch.setattr(R, "STEP_PAIRS", step)
    rnd = random.Random(5)
    entries = []
    for n, key in enumerate("abcdef"):
        at = rnd.randint(0, 5)
        while at < 60:
            born, at = at, at + rnd.randint(1, 12)
            entries.append({"object": rnd.choice("xyz"), "key": key, "born": born, "dies": rnd.randint(born + 1, at), "entry_id": 100 * n + born, "decision": "d"})
    pairs = [{"subject": s, "object": o, "score": rnd.choice([0.5, 0.75])} for s in "pqr" for o in "xyz" if rnd.random() < 0.7]
    asked = [{"query_id": i, "at": rnd.randint(0, 70), "subject": rnd.choice("pqrs")} for i in range(200)]
    shape = pa.schema([("subject", pa.string()), ("object", pa.string()), ("score", pa.float64()), ("key", pa.string()), ("born", pa.int64()),
                       ("dies", pa.int64()), ("entry_id", pa.int64()), ("decision", pa.string())])
    found = R._nearest_living(pa.Table.from_pylist(asked), pa.Table.from_pylist(pairs + entries, shape), oldest)
    want = {}
    for r in asked:
        fits = [(e, p["score"]) for p in pairs if p["subject"] == r["subject"] for e in entries
                if e["object"] == p["object"] and e["born"] < r["at"] <= e["dies"]]
        if fits:
            e, score = min(fits, key=lambda f: (f[0]["born"], f[0]["key"]) if oldest else (-f[1], f[0]["key"]))
            want[r["query_id"]] = (e["entry_id"], score)
    assert {r["query_id"]: (r["entry_id"], r["score"]) for r in found.to_pylist()} == want
    none = R._nearest_living(pa.Table.from_pylist(asked), pa.Table.from_pylist(pairs, shape), oldest)
    assert none.num_rows == 0


@pytest.mark.parametrize("block", [2048, 5])
def test_semantic(log, block):
    rows, requests, entries = log
    found = {r["query_id"]: r["score"] for r in R.semantic_hits(requests, R.lifetimes(entries), block=block).collect()}
    want = {}
    for r in rows:
        q = np.array(r[4])
        scores = [float(np.array(e[4]) @ q / np.linalg.norm(e[4]) / np.linalg.norm(q))
                  for e in alive_at(rows, r[3]) if e[2] == r[2]]
        if scores and max(scores) >= 0.92:
            want[r[0]] = max(scores)
    assert found.keys() == want.keys()
    assert all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_lifetimes_of_names_carry_no_vectors(log):
    _, requests, entries = log
    alive = R.lifetimes(R.with_names(entries))
    assert "embedding" not in alive.columns
    found = R.semantic_hits(requests, alive, stored=entries)
    assert sorted(found.collect()) == sorted(R.semantic_hits(requests, R.lifetimes(entries)).collect())


def test_cascade_answers_every_request_once(log):
    rows, requests, entries = log
    out = R.reuse_cascade(requests, entries)
    layers = {r["query_id"]: r["layer"] for r in out.collect()}
    assert len(layers) == out.count() == len(rows)
    exact = answers(R.exact_hits(requests, R.lifetimes(entries)))
    assert {q for q, layer in layers.items() if layer == "exact"} == exact.keys()
    stats = R.reuse_stats(out).first()
    assert stats["total_lookups"] == len(rows)
    assert stats["exact_hits"] + stats["fuzzy_hits"] + stats["semantic_hits"] + stats["misses"] == len(rows)


def test_cascade_without_vectors(log):
    rows, requests, entries = log
    found = R.reuse_cascade(requests.drop("embedding"), entries.drop("embedding"))
    with_vectors = R.reuse_cascade(requests, entries, layers=("exact", "fuzzy"))
    key = lambda df: sorted((r["query_id"], r["layer"], r["entry_id"]) for r in df.collect())
    assert key(found) == key(with_vectors)
