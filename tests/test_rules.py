from pyspark.sql import functions as F

from ruleharbor.functions.fixed_values import OPERATOR_SPELLINGS
from ruleharbor.operators import rules as R
from ruleharbor.sources.tables import schema_catalog


def raw(spark, *logic):
    rows = [(f"r{i}", "data_quality", "text", 0.9, x) for i, x in enumerate(logic)]
    return spark.createDataFrame(
        rows, "rule_id string, rule_type string, rule_text string, confidence double, "
              "logic struct<field string, operator string, value string>")


def catalog(spark):
    df = spark.createDataFrame([], "`Amount Paid` double, `Amount Received` double, opened string, corporate string")
    return schema_catalog(spark, {"t": df}, {"t": ()})


def structured(spark, *logic):
    out = R.structure_rules(raw(spark, *logic), catalog(spark)).orderBy("rule_id").collect()
    return [(r["operator"], r["value"], r["rule_complexity"], r["second_column"], r["data_type"]) for r in out]


def test_alias_table_is_complete():
    words = [w for ws in OPERATOR_SPELLINGS.values() for w in ws]
    assert len(words) == len(set(words)) == 59


def test_structuring(spark):
    got = structured(
        spark,
        ("amount paid", "BETWEEN", "1000 and 10000"),
        ("amount paid", "between", "1000 - 10000"),
        ("amount paid", "between", "1000-10000"),
        ("Amount Paid", "equals", " amount received "),
        ("Amount Paid", "equals", "amount paid"),
        ("opened", "lt", "NOW() - INTERVAL 90 DAYS"),
        ("opened", "=", "Unknown"),
        ("opened", "is not null", "x"),
        ("opened", "contains", ""),
        ("opened", "ends with", "z"),
        ("corporate", "=", "x"),
    )
    assert got == [
        ("BETWEEN", "1000 , 10000", "between", None, "number"),
        ("BETWEEN", "1000,10000", "between", None, "number"),
        ("=", "x", "simple", None, "string"),
        ("BETWEEN", "1000-10000", "between", None, "number"),
        ("=", " amount received ", "cross_field", "Amount Received", "number"),
        ("=", "amount paid", "simple", None, "number"),
        ("<", "NOW() - INTERVAL 90 DAYS", "date_math", None, "string"),
        ("=", "Unknown", "simple", None, "string"),
        ("IS NULL", "x", "simple", None, "string"),
        ("LIKE", "%", "simple", None, "string"),
        ("LIKE", "%z", "simple", None, "string"),
    ]


def test_rejects(spark):
    df = raw(spark, ("a and b", "=", "1"), ("*", "=", "1"), ("a", "exists", None), ("a", "", None), None, ("a", "=", "1"))
    good, bad = R.split_scannable(df)
    assert [r["rule_id"] for r in good.collect()] == ["r5"]
    assert {r["rule_id"]: r["reason"] for r in bad.collect()} == {
        "r0": "multi-column field", "r1": "multi-column field", "r2": "unscannable operator",
        "r3": "no scannable logic", "r4": "no scannable logic"}


def review_input(spark):
    low = R.structure_rules(raw(spark, *[("opened", "=", str(i)) for i in range(4)]), catalog(spark))
    ddl = "rule_id string, verdict string, changes map<string,string>, decided_at timestamp_ntz"
    return low, ddl


def test_review_without_decisions_keeps_all(spark):
    low, ddl = review_input(spark)
    assert R.merge_review(low, spark.createDataFrame([], ddl)).count() == 4


def test_review_merge(spark):
    low, ddl = review_input(spark)
    rows = [("r0", "approved", None, "2024-01-01"), ("r1", "edited", {"value": "x"}, "2024-01-01"),
            ("r1", "edited", {"value": "y", "bogus": "z"}, "2024-01-02"), ("r2", "dropped", None, "2024-01-01")]
    decisions = spark.createDataFrame(rows, ddl.replace("timestamp_ntz", "string")).withColumn(
        "decided_at", F.col("decided_at").cast("timestamp_ntz"))
    out = {r["rule_id"]: r["value"] for r in R.merge_review(low, decisions).collect()}
    assert out == {"r0": "0", "r1": "y"}
    fixed = R.rule_corrections(low, decisions).collect()
    assert [(r["rule_id"], r["original"], r["corrected"]) for r in fixed] == [("r1", {"value": "1"}, {"value": "y"})]


def test_rules_without_confidence_go_to_review(spark):
    rules = spark.createDataFrame([("a", 0.9), ("b", 0.1), ("c", None)], "rule_id string, confidence double")
    ready, review = R.route_by_confidence(rules)
    assert [r.rule_id for r in ready.collect()] == ["a"] and {r.rule_id for r in review.collect()} == {"b", "c"}
