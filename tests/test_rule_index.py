"""The rule index against rule by rule, on cells and thresholds around every edge, and its single read."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ruleharbor.operators import rule_index as I
from ruleharbor.operators import scan as S
from ruleharbor.operators.predicates import Rule, Setting
from tests.test_scan import AS_OF

BIG = 2**53
SHAPE = ("id int, small int, wide long, amount decimal(12,2), huge decimal(38,4), real double, single float, day date, at timestamp, "
         "moment timestamp_ntz, text string, numbers string, days string, flag boolean")
REALS = [0.0, -0.0, 1.0, 1.5, 2.0, 2.5, -3.0, 1e18, float("inf"), float("-inf"), float("nan"), 0.1, None]
WIDES = [0, 1, 2, 3, BIG, BIG + 1, BIG + 2, -BIG - 1, 2**63 - 1, -(2**63), None]
AMOUNTS = [Decimal(x) for x in ("0", "1.50", "1.51", "-2.25", "9999999999.99", "2")] + [None]
HUGES = [Decimal(x) for x in ("12345678901234567890.1234", "12345678901234567890.1235", "1.5", "-1", "2")] + [None]
DAYS = [datetime(2023, 12, 31), datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 0, 1), datetime(2020, 2, 29, 12), None]
TEXTS = ["", "a", "b", "B", "it's", "1", "1.0", "2", None]
NUMBERS = ["1", "1.0", "1,5", "2.5", "nan", "inf", "x", "-3", " 2 ", None]
DATES = ["2024-01-01", "2023-12-31 23:59:59", "31/12/2023", "x", None]


def rows(seed, n=240):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        pick = rnd.choice
        day = pick(DAYS)
        out.append((i, pick([0, 1, 2, 3, None]), pick(WIDES), pick(AMOUNTS), pick(HUGES), pick(REALS), pick([0.5, 0.1, 2.0, None]),
                    day and day.date(), pick(DAYS), pick(DAYS), pick(TEXTS), pick(NUMBERS), pick(DATES), pick([True, False, None])))
    return out


def rules(seed, n):
    rnd = random.Random(seed)
    numbers = ["0", "1", "1.5", "1.505", "2", "2.5", "-3", str(BIG), str(BIG + 1), str(BIG + 2), "9223372036854775807", "-9223372036854775808",
               "1e30", "12345678901234567890.1234", "12345678901234567890.12345", "nan", "inf", "0.1", "-0", "10000000000", "abc"]
    moments = ["NOW()", "2024-01-01", "NOW() - 1 day", "2020-02-29 12:00:00", "1900-01-01"]
    lists = ["1, 2, 03, x", "[1.5, '2']", "a, b, it's", "'it''s', ''", "nothing", "1.0, 9007199254740993", "true", ","]
    out = []
    for i in range(n):
        column = rnd.choice(["small", "wide", "amount", "huge", "real", "single", "text", "numbers", "day", "at", "moment", "days", "flag"])
        how = rnd.random()
        dated = column in ("day", "at", "moment", "days")
        value = rnd.choice(moments if dated and rnd.random() < 0.8 else numbers)
        kind = "datetime" if dated else "number" if column != "text" or rnd.random() < 0.3 else "string"
        if how < 0.6:
            out.append(Rule(f"r{i}", "t", column, rnd.choice(["=", "!=", "<", "<=", ">", ">="]), value, data_type=kind))
        elif how < 0.75:
            out.append(Rule(f"r{i}", "t", column, rnd.choice(["IN", "NOT IN"]), rnd.choice(lists)))
        elif how < 0.87:
            out.append(Rule(f"r{i}", "t", column, "BETWEEN", f"{rnd.choice(numbers)},{rnd.choice(numbers)}", rule_complexity="between"))
        elif how < 0.92:
            out.append(Rule(f"r{i}", "t", column, rnd.choice(["<", ">="]), rnd.choice(moments), rule_complexity="date_math"))
        else:
            out.append(rnd.choice([Rule(f"r{i}", "t", column, "IS NULL"), Rule(f"r{i}", "t", "text", "NOT LIKE", "%a%"),
                                   Rule(f"r{i}", "t", "small", "<=", "wide", rule_complexity="cross_field", second_column="wide"),
                                   Rule(f"r{i}", "t", "text", "REGEX", "^[a-z]", rule_complexity="regex")]))
    return out


@pytest.mark.parametrize("seed, most, mapped", [(1, 50, 100), (2, 3, 100), (3, 50, 4)])
def test_index_equals_rule_by_rule(spark, seed, most, mapped, monkeypatch):
    monkeypatch.setattr(I, "MOST_MAPPED", mapped)
    df = spark.createDataFrame(rows(seed), SHAPE).repartition(3).cache()
    src = {"t": S.Source(df, ("id",))}
    pairs = S.plan_pairs(rules(seed, 170), src, Setting(AS_OF))
    able = [p for p in pairs if p.violates is not None]
    assert len(able) > 120
    monkeypatch.setattr(S, "RULES_PER_PASS", 10**6)
    monkeypatch.setattr(S, "PASS_LENGTH", 10**9)
    want = []
    for start in range(0, len(able), 40):
        want += [tuple(r) for r in S.hits(src, able[start:start + 40]).collect()]
    monkeypatch.setattr(S, "RULES_PER_PASS", most)
    monkeypatch.setattr(S, "PASS_LENGTH", 4_000)
    found = [tuple(r) for r in S.hits(src, pairs).collect()]
    assert sorted(found) == sorted(want) and len(set(found)) == len(found)
    counted = {r.rule_id: r.violation_count for r in S.count_violations(src, pairs).collect()}
    assert counted == {p.rule.rule_id: sum(1 for h in want if h[0] == p.rule.rule_id) for p in able}
    df.unpersist()


def thousand():
    out = [Rule(f"t{i}", "t", "v", (">", "<", ">=", "<=")[i % 4], str(i * 7 % 1000), data_type="number") for i in range(600)]
    out += [Rule(f"d{i}", "t", "at", "<", f"NOW() - {i} days", rule_complexity="date_math") for i in range(150)]
    out += [Rule(f"e{i}", "t", "kind", ("=", "IN")[i % 2], f"k{i}") for i in range(150)]
    out += [Rule(f"b{i}", "t", "v", "BETWEEN", f"{i}, {1000 - i}", rule_complexity="between") for i in range(100)]
    return out


def test_a_thousand_rules_in_one_read(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3000).select(
        "id", (F.col("id") % 1009).cast("double").alias("v"), F.concat(F.lit("k"), F.col("id") % 200).alias("kind"),
        (F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(days=F.col("id") % 200)).alias("at"), F.lit("x").alias("unused")).write.parquet(path)
    src = {"t": S.Source(spark.read.parquet(path), ("id",))}
    pairs = S.plan_pairs(thousand(), src, Setting(AS_OF))
    assert len(pairs) == 1000 and all(p.violates is not None for p in pairs)
    for made in (S.hits(src, pairs), S.count_violations(src, pairs)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "unused" not in plan and "PushedFilters: [Or" in plan.replace("IsNotNull(id), ", "")
    counts = {r.rule_id: r.violation_count for r in S.count_violations(src, pairs).collect()}
    data = [(i % 1009, f"k{i % 200}", AS_OF - timedelta(days=i % 200)) for i in range(3000)]
    compare = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}
    for p in pairs[::37]:
        r = p.rule
        if r.rule_id[0] == "t":
            want = sum(compare[r.operator](v, float(r.value)) for v, _, _ in data)
        elif r.rule_id[0] == "d":
            want = sum(at < AS_OF - timedelta(days=int(r.value.split()[2])) for _, _, at in data)
        elif r.rule_id[0] == "e":
            want = sum(k == r.value for _, k, _ in data)
        else:
            low, high = map(float, r.value.split(","))
            want = sum(not low <= v <= high for v, _, _ in data)
        assert counts[r.rule_id] == want
    found = S.hits(src, pairs).groupBy("rule_id").count().collect()
    assert {r.rule_id: r["count"] for r in found} == {k: n for k, n in counts.items() if n}


def test_counters_come_from_the_job_that_writes_the_log(spark, tmp_path):
    src = {"t": S.Source(spark.createDataFrame([(i, float(i % 7), f"k{i % 3}") for i in range(100)], "id int, v double, kind string"), ("id",)),
           "u": S.Source(spark.createDataFrame([(1, 9.0)], "id int, v double"), ("id",))}
    found = [Rule("a", "t", "v", ">", "3", data_type="number"), Rule("b", "t", "kind", "=", "k1"), Rule("none", "t", "v", ">", "99", data_type="number"),
             Rule("lost", "t", "ghost", "=", "1")]
    path, tracker = str(tmp_path / "log"), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("logged", "one job")
    try:
        counters = S.scan_to_log(spark, src, found, AS_OF, "s1", path)
        jobs = tracker.getJobIdsForGroup("logged")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    row = counters.first()
    log = spark.read.parquet(path)
    assert row["violations_by_rule"] == {"a": 43, "b": 33, "none": 0} and row["violations_by_table"] == {"t": 75, "u": 1}
    assert row["total_violations"] == log.count() == 76 and (row["rules_processed"], row["rules_failed"]) == (3, 1)
    # Beside the write itself at most the small table of rules is sent to the tasks.
    assert sum(len(tracker.getJobInfo(j).stageIds) for j in jobs) <= 3
    S.scan_to_log(spark, src, found[:1], AS_OF, "s1", path)
    assert spark.read.parquet(path).where("table_name = 't'").count() == 42
    nothing = S.scan_to_log(spark, src, found[3:], AS_OF, "s2", path).first()
    assert nothing["total_violations"] == 0 and nothing["rules_failed"] == 1
