"""The segment index against all pairs, and how few pairs it compares."""

import random

import pytest
from pyspark.sql import functions as F

from ruleharbor.operators import near_text as N
from tests.test_reuse import distance


def texts(seed, n, alphabet="abcd ", longest=60):
    rnd = random.Random(seed)
    out = ["", "a", "ab", "é", "漢字"]
    for _ in range(n):
        if len(out) > 8 and rnd.random() < 0.7:
            t = list(rnd.choice(out[5:]))
            for _ in range(rnd.randrange(0, 4)):
                at = rnd.randrange(len(t) + 1)
                how = rnd.random()
                if how < 0.4:
                    t.insert(at, rnd.choice(alphabet))
                elif how < 0.7 and at < len(t):
                    del t[at]
                elif at < len(t):
                    t[at] = rnd.choice(alphabet)
            out.append("".join(t))
        else:
            out.append("".join(rnd.choices(alphabet, k=rnd.randrange(1, longest))))
    return out


@pytest.mark.parametrize("ratio, spread", [(0.95, 3), (0.95, 1), (0.9, 2), (0.7, 3), (0.5, 2)])
def test_all_pairs_and_no_others(spark, ratio, spread):
    stored, asked = texts(1, 130, longest=120), texts(2, 60) + texts(1, 130, longest=120)[::3]
    s = spark.createDataFrame([("ab"[i % 2], str(i), t) for i, t in enumerate(stored)] + [(None, "n", "a"), ("a", "x", None)],
                              "group string, key string, text string")
    a = spark.createDataFrame([("ab"[i % 2], t) for i, t in enumerate(asked)] + [(None, "a"), ("a", None), ("c", "a")], "group string, text string")
    want = set()
    for i, t in enumerate(asked):
        for j, u in enumerate(stored):
            longest = max(len(t), len(u))
            if i % 2 == j % 2 and (t == u or abs(len(t) - len(u)) <= longest * (1 - ratio) + 1
                                   and 1 - distance(t, u) / longest >= ratio):
                want.add(("ab"[i % 2], t, str(j)))
    found = N.near_texts(a, s, ratio, spread).collect()
    assert len(found) == len(set(found)) and set(map(tuple, found)) == want


def test_few_pairs_of_many_texts_of_one_length_are_compared(spark):
    """100,000 stored texts of one role and length; three fifths of each are the same in all."""
    rnd = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz_ "
    head = "select name, balance, region from customer where accounts ="
    stored = [head + "".join(rnd.choices(letters, k=40)) for _ in range(100_000)]
    asked, near = [], 0
    for _ in range(1500):
        t = list(rnd.choice(stored))
        changes = rnd.randrange(0, 8)
        for at in rnd.sample(range(len(t)), changes):
            t[at] = "#"
        asked.append("".join(t))
        near += changes <= 4  # of 99 characters
    s = spark.createDataFrame([("r", str(i), t) for i, t in enumerate(stored)], "group string, key string, text string")
    a = spark.createDataFrame([("r", t) for t in asked], "group string, text string").distinct()
    pairs = N.candidates(a.withColumn("id", F.xxhash64("group", "text")), s, 0.95).count()
    assert near <= pairs < 3 * 1500  # of 150 million
    assert N.near_texts(a, s, 0.95).select("text").distinct().count() == near == N.near_texts(a, s, 0.95).count()
