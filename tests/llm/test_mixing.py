import hashlib
import math
import re

from pyspark.sql import functions as F

from ruleharbor.llm import mixing
from tests.llm.conftest import SHAPE


def unit(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / float(1 << 52)


def count_by_hand(u, rate):
    total, k, term = 0.0, 0, math.exp(-rate)
    while True:
        total += term
        if u < total or k > rate + 200:
            return k
        k += 1
        term *= rate / k


def test_counts_invert_the_poisson_distribution(spark):
    rows = [(i, "x" * (i % 7), "en", "ab"[i % 3 == 0], 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, SHAPE)
    weights = {"a": 3.0, "b": 1.0}
    found = {(r.doc_id): r.n for r in mixing.replicate(docs, weights, 2.0).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    size = {s: sum(len(r[1]) + 1 for r in rows if r[3] == s) for s in "ab"}
    for doc_id, _, _, source, _ in rows:
        rate = weights[source] / 4 * sum(size.values()) / size[source] * 2
        assert found.get(doc_id, 0) == count_by_hand(unit(f"{mixing.SEED}:{doc_id}"), rate)
    got = {s: sum((len(r[1]) + 1) * found.get(r[0], 0) for r in rows if r[3] == s) for s in "ab"}
    assert abs(got["a"] / sum(got.values()) - 0.75) < 0.04 and abs(sum(got.values()) / sum(size.values()) - 2) < 0.15


def test_high_rates_and_a_fixed_order(spark):
    docs = spark.createDataFrame([(i, "ab", "en", "rare" if i < 20 else "big", 2) for i in range(2000)], SHAPE)
    first = mixing.replicate(docs, {"rare": 9.0, "big": 1.0})
    counts = first.where("source = 'rare'").groupBy("doc_id").count().collect()
    assert len(counts) == 20 and all(40 < r["count"] < 150 for r in counts)
    again = mixing.replicate(docs.repartition(7), {"rare": 9.0, "big": 1.0})
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    for part in first.rdd.glom().collect():
        assert [r["__order"] for r in part] == sorted(r["__order"] for r in part)


def test_odd_rows(odd, none):
    mixed = mixing.mix(odd, epochs=8.0)
    assert mixed.columns == odd.columns
    assert {r.source for r in mixed.collect()} <= {"a", "b", "", None}
    counts = mixing.replicate(odd, epochs=8.0).where("doc_id = 2").groupBy("__copy").count().collect()
    assert counts and all(r["count"] == 2 for r in counts)  # equal ids draw alike
    assert mixing.mix(none).count() == 0
    assert mixing.mix(odd, {"no such source": 1.0}).count() == 0
    assert re.fullmatch(r"[0-9a-f]{32}", mixing.replicate(odd, epochs=8.0).first()["__order"])
