from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ruleharbor.operators import report
from ruleharbor.operators import scan as S
from ruleharbor.operators.predicates import Rule, Setting
from ruleharbor.sources import logs
from ruleharbor.sources.tables import TableSpec, jdbc_options, read_table

AS_OF = datetime(2024, 1, 1)


def items(spark):
    rows = [(i, float(i % 7), f"k{i % 3}", None if i % 5 == 0 else f"{i}") for i in range(100)] + [(None, 6.0, "k9", "x")]
    return {"items": S.Source(spark.createDataFrame(rows, "id int, amount double, kind string, note string"), ("id",))}


def one_rule(i, op, value):
    kinds = {"amount": "simple", "kind": "simple", "note": "between"}
    column = ("amount", "kind", "note")[i % 3]
    return Rule(f"r{i}", "t", column, "BETWEEN" if column == "note" else op, "10,50" if column == "note" else value,
                data_type="number", rule_complexity=kinds[column])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ops=st.lists(st.tuples(st.sampled_from(["=", "!=", ">", "<="]), st.sampled_from(["1", "3.5", "k1"])), min_size=1, max_size=6))
def test_one_pass_equals_rule_by_rule(spark, ops):
    src = items(spark)
    rules = [one_rule(i, op, value) for i, (op, value) in enumerate(ops)]
    plan = lambda rs: S.plan_pairs(rs, src, Setting(AS_OF))
    together = sorted(map(tuple, S.hits(src, plan(rules)).collect()))
    apart = sorted(tuple(r) for rule in rules for r in S.hits(src, plan([rule])).collect())
    assert together == apart
    counted = {r["rule_id"]: r["violation_count"] for r in S.count_violations(src, plan(rules)).collect()}
    assert counted == {r.rule_id: sum(1 for h in together if h[0] == r.rule_id) for r in rules}


def test_many_rules_split_into_groups_of_one_read(spark, monkeypatch):
    monkeypatch.setattr(S, "RULES_PER_PASS", 2)
    src = items(spark)
    pairs = S.plan_pairs([one_rule(i, ">", "2") for i in range(7)], src, Setting(AS_OF))
    assert [len(g) for g in S._passes(S._conditions(pairs))] == [2, 2, 2, 1]
    monkeypatch.setattr(S, "RULES_PER_PASS", 50)
    whole = sorted(map(tuple, S.hits(src, pairs).collect()))
    monkeypatch.setattr(S, "RULES_PER_PASS", 2)
    assert sorted(map(tuple, S.hits(src, pairs).collect())) == whole


def test_one_scan_per_table_with_pushed_filters(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select("id", (F.col("id") * 2.0).alias("v"), F.lit("unused").alias("wide")).write.parquet(path)
    src = {"t": S.Source(spark.read.parquet(path), ("id",))}
    rules = [Rule("a", "t", "v", ">", "150", data_type="number"), Rule("b", "t", "v", "<", "10", data_type="number"),
             Rule("c", "t", "id", "=", "7", data_type="number")]
    plan = S.hits(src, S.plan_pairs(rules, src, Setting(AS_OF)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "Or(Or(GreaterThan(v,150.0),LessThan(v,10.0)),EqualTo(id,7))" in plan
    assert "unused" not in plan and "wide" not in plan.split("ReadSchema")[1]


def test_payload_ids_and_log(spark, tmp_path):
    src = items(spark)
    rules = [one_rule(0, ">", "5"), one_rule(1, "=", "k1")]
    run = lambda: S.scan(spark, src, rules, AS_OF, "s1").violations
    path = str(tmp_path / "log")
    logs.append_violations(run(), path)
    first = logs.read_log(spark, path)
    n = first.count()
    assert n == run().count() and first.select("violation_id").distinct().count() == n
    logs.replace_scan(run(), path)
    other = S.scan(spark, src, rules, AS_OF, "s2").violations
    logs.append_violations(other, path)
    again = logs.read_log(spark, path)
    assert again.where("scan_id = 's1'").count() == n and again.count() == 2 * n
    row = again.where("record_primary_key = '5' AND rule_id = 'r0'").first()
    assert row is None
    row = again.where("record_primary_key = '6' AND rule_id = 'r0' AND scan_id = 's1'").first()
    assert row["violating_data"] == '{"id":6,"amount":6.0,"kind":"k0","note":"6"}'
    assert again.where("record_primary_key IS NULL OR record_primary_key = ''").count() == 0


def test_targets_keys_and_counters(spark):
    src = {**items(spark), "people": S.Source(spark.createDataFrame([(1, 2.0)], "id int, last_name double"), ("id",)),
           "bare": S.Source(spark.createDataFrame([(9.0,)], "amount double"), ())}
    rules = [
        Rule("everywhere", "t", "amount", ">", "0", data_type="number"),
        Rule("named", "t", "id", ">", "0", applies_to_tables=("people", "absent")),
        Rule("private", "t", "id", ">", "0", requires_pii=True),
        Rule("nowhere", "t", "ghost", "=", "1"),
        Rule("never", "t", "amount", ">", "1000", data_type="number", applies_to_tables=("items",)),
    ]
    pairs = S.plan_pairs(rules, src, Setting(AS_OF))
    assert [(p.rule.rule_id, p.table, p.reason) for p in pairs] == [
        ("everywhere", "items", None), ("everywhere", "bare", "no primary key"), ("named", "people", None),
        ("private", "people", None), ("nowhere", "", "no applicable table"), ("never", "items", None)]
    out = S.scan_counters(S.count_violations(src, pairs), S.pairs_frame(spark, pairs), S.rules_frame(spark, rules)).first()
    assert out["violations_by_rule"] == {"everywhere": 85, "named": 1, "private": 1, "never": 0}
    assert out["violations_by_table"] == {"items": 85, "people": 2}
    assert (out["tables_scanned"], out["tables_skipped"], out["rules_processed"], out["rules_failed"]) == (4, 1, 4, 1)
    empty = S.scan_counters(
        spark.createDataFrame([], "rule_id string, table_name string, violation_count bigint"),
        S.pairs_frame(spark, []), S.rules_frame(spark, [])).first()
    assert empty["status"] == "skipped" and empty["total_violations"] == 0


def test_caps(spark):
    src = items(spark)["items"]
    over = F.col("amount") > 3
    assert S.capped_scan(src, over, 10, 2, cap_rows=False).count() == 20
    assert S.capped_scan(src, over, 10, 2, cap_rows=True).count() == sum(1 for i in range(20) if i % 7 > 3)
    assert S.capped_scan(src, over, 10, None, cap_rows=True).count() == sum(1 for i in range(100) if i % 7 > 3)


def test_empty_log_gives_zeros(spark):
    src = items(spark)
    none = S.scan(spark, src, [one_rule(0, ">", "99")], AS_OF, "s").violations
    row = report.scan_summary(none).first()
    assert (row["total_violations"], row["avg_confidence"], row["scan_start"]) == (0, 0.0, None)


def test_sources(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.range(3).write.option("header", True).csv(path)
    assert read_table(spark, TableSpec("c", path, format="csv", options={"header": "true"})).count() == 3
    with pytest.raises(ValueError, match="unsupported source type"):
        read_table(spark, TableSpec("c", path, format="mysql"))
    spec = TableSpec("public.t", "jdbc:postgresql://h/db", format="postgresql", options={"numPartitions": "8"})
    assert jdbc_options(spec)["dbtable"] == "public.t" and jdbc_options(spec)["numPartitions"] == "8"


def test_rule_catalogue_file(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text('[{"rule_id": "a", "rule_text": "t", "target_column": "amount", "operator": ">", "value": "5", '
                    '"data_type": "number", "rule_type": "data_quality", "source": "s", "requires_pii": false, '
                    '"confidence": 1.0, "rule_complexity": "simple"}]')
    rules = S.load_rules(logs.read_rules(spark, str(path)))
    src = items(spark)
    assert S.count_violations(src, S.plan_pairs(rules, src, Setting(AS_OF))).first()["violation_count"] == 14


def test_rule_catalogues_by_line_and_as_list(spark, tmp_path):
    one = '{"rule_id": "%s", "rule_text": "t", "target_column": "v", "operator": ">", "value": "1"}'
    (tmp_path / "a.jsonl").write_text("\n".join(one % i for i in "abc") + "\n\n")
    (tmp_path / "b.json").write_text(" [\n" + ",\n".join(one % i for i in "de") + "]\n")
    read = lambda name: sorted(r.rule_id for r in S.load_rules(logs.read_rules(spark, str(tmp_path / name))))
    assert read("a.jsonl") == ["a", "b", "c"] and read("b.json") == ["d", "e"] and read("") == ["a", "b", "c", "d", "e"]


def test_repeated_rule_ids_are_refused(spark):
    df = spark.createDataFrame([(1, 2)], "id int, v int")
    twice = [Rule("r", "t", "v", ">", "1", data_type="number"), Rule("r", "t", "v", ">", "0", data_type="number")]
    with pytest.raises(ValueError, match="unique"):
        S.scan(spark, {"t": S.Source(df, ("id",))}, twice, datetime(2024, 1, 1), "s")


def test_key_parts_cannot_be_confused(spark):
    df = spark.createDataFrame([("a|b", "c", 9), ("a", "b|c", 9)], "k string, l string, v int")
    found = S.scan(spark, {"t": S.Source(df, ("k", "l"))}, [Rule("r", "t", "v", ">", "1", data_type="number")],
                   datetime(2024, 1, 1), "s").violations.collect()
    assert {r.record_primary_key for r in found} == {r"a\|b|c", r"a|b\|c"} and len({r.violation_id for r in found}) == 2


@pytest.mark.parametrize("many", [3, 80])
def test_keys_are_written_once_per_row_and_not_per_broken_rule(spark, many):
    rows = [(i, f"a|{i}", float(i)) for i in range(20)]
    src = {"items": S.Source(spark.createDataFrame(rows, "id int, part string, amount double"), ("id", "part"))}
    rules = [Rule(f"r{i}", "t", "amount", ">", f"{i}", data_type="number") for i in range(many)]
    found = S.hits(src, S.plan_pairs(rules, src, Setting(AS_OF)), payload=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.index("Generate explode") < plan.index("concat_ws")
    want = sorted((f"r{i}", "items", f"{n}|a\\|{n}") for i in range(many) for n in range(20) if n > i)
    assert sorted(tuple(r)[:3] for r in found.collect()) == want


def test_stored_rows_append_and_are_found(spark, tmp_path):
    path = str(tmp_path / "log")
    for k in "ab":
        logs.append_rows(spark.createDataFrame([(k, 1)], "id string, n int"), path)
    assert logs.find_by_id(logs.read_log(spark, path), "id", "b").collect()[0].n == 1
