import pytest
from pyspark.sql import functions as F

from ruleharbor.operators import audit, gate
from ruleharbor.operators.reuse import store_decisions
from ruleharbor.sources.tables import schema_catalog

SCENARIOS = [
    (1, 'SELECT COUNT(*) FROM transactions GROUP BY "Is Laundering"', "analyst", "Q4 fraud pattern analysis"),
    (2, 'SELECT Account, "Amount Received" FROM transactions WHERE "Amount Received" > 10000', "compliance_officer", "AML"),
    (3, "SELECT * FROM transactions", "intern", None),
    (4, "SELECT no_such FROM transactions", "viewer", "Customer analysis"),
    (5, "SELECT 1", "Stranger", ""),
    (6, "SELECT Timestamp FROM TRANSACTIONS", "admin", None),
]


@pytest.fixture(scope="module")
def requests(spark):
    ddl = "`Timestamp` string, Account string, `Amount Received` double, `Is Laundering` int"
    catalog = schema_catalog(spark, {"Transactions": spark.createDataFrame([], ddl)}, {})
    log = spark.createDataFrame(SCENARIOS, "query_id long, query string, user_role string, stated_purpose string")
    return gate.add_context(log.withColumn("user_id", F.lit("u")), catalog)


def test_context(requests):
    rows = {r["query_id"]: r for r in requests.collect()}
    names = {q: [c["column_name"] for c in r["columns"]] for q, r in rows.items()}
    every = ["Account", "Amount Received", "Is Laundering", "Timestamp"]
    assert names == {1: every, 2: ["Account", "Amount Received"], 3: every, 4: every, 5: every, 6: ["Timestamp"]}
    assert [rows[q]["access_level"] for q in sorted(rows)] == [3, 5, 1, 1, 2, 5]
    assert rows[6]["max_classification"] == "internal" and rows[2]["max_classification"] == "restricted"
    assert rows[2]["pii_categories"] == [] and rows[5]["tables"] == []


def test_intent(spark, requests):
    out = {r["query_id"]: r for r in gate.add_intent(requests).collect()}
    assert {q: (r["intent"], r["intent_confidence"], r["missing"]) for q, r in out.items()} == {
        1: ("CLEAR", 0.99, []), 2: ("CLEAR", 0.9, []),
        3: ("VAGUE", 0.95, ["PURPOSE", "COLUMN_SCOPE", "PII_JUSTIFICATION"]),
        4: ("CLEAR", 0.9, []), 5: ("VAGUE", 0.95, ["PURPOSE", "PII_JUSTIFICATION"]), 6: ("VAGUE", 0.8, ["PURPOSE"])}
    assert out[6]["clarification"].splitlines()[1].startswith("- The specific purpose")
    hints = spark.createDataFrame([(6, True, ["X"])], "query_id long, is_clear boolean, additional_missing array<string>")
    told = {r["query_id"]: r for r in gate.add_intent(requests, hints).collect()}
    assert (told[6]["intent"], told[6]["intent_confidence"], told[6]["missing"]) == ("CLEAR", 0.75, ["PURPOSE"])
    said = spark.createDataFrame([(6, False, ["X"])], "query_id long, is_clear boolean, additional_missing array<string>")
    assert {r["query_id"]: r["missing"] for r in gate.add_intent(requests, said).collect()}[6] == ["PURPOSE", "X"]
    placed = gate.add_intent(requests.withColumn("has_multi_jurisdiction", F.lit(True)))
    assert "JURISDICTION" in {r["query_id"]: r["missing"] for r in placed.collect()}[1]


VERDICT = "struct<decision:string,reasoning:string,cited_policies:array<string>,sensitive_columns:array<string>,required_controls:array<string>>"


def with_verdicts(spark, requests):
    verdicts = spark.createDataFrame([
        (1, ("APPROVE", "fine", ["p1"], [], ["log_access"])), (2, ("BLOCK", "no", ["p9"], ["Account"], ["mask_pii"])),
        (3, ("BLOCK", "no", [], [], [])), (4, ("BLOCK", "no", [], ["invented"], [])), (5, ("APPROVE", None, [], [], [])),
        (6, ("BLOCK", "why", [], ["timestamp"], ["mask_pii", "log_access"])),
    ], f"query_id long, verdict {VERDICT}")
    full = gate.add_intent(requests.withColumn("stated_purpose", F.lit("x"))).join(verdicts, "query_id")
    return gate.audit_checks(full.withColumns({
        "policy_ids": F.array(F.lit("p1")), "policy_confidence": F.lit(0.5), "policy_status": gate.policy_status(F.lit(0.5))}))


def test_checks_and_decisions(spark, requests):
    checked = with_verdicts(spark, requests)
    rows = {r["query_id"]: r for r in checked.collect()}
    failed = {q: sorted(k for k, ok in r["checks"].items() if not ok) for q, r in rows.items()}
    assert failed == {1: [], 2: ["citations_grounded"], 3: [], 4: ["columns_valid"], 5: ["json_valid"], 6: []}
    assert rows[2]["ungrounded"] == ["p9"] and rows[4]["invented"] == ["invented"]
    human = spark.createDataFrame([(4, "BLOCK", None), (5, "APPROVE", "ok")], "query_id long, human_decision string, human_reasoning string")
    base = checked.withColumns({
        "cached_decision": F.when(F.col("query_id") == 6, "BLOCK"), "cached_reason": F.when(F.col("query_id") == 6, "before"),
        "cached_guidance": F.lit(None).cast("string")})
    decided = gate.decide(base, human)
    got = {r["query_id"]: (r["final_decision"], r["block_reason"]) for r in decided.collect()}
    assert got == {1: ("APPROVE", None), 2: ("ESCALATED", None),
                   3: ("CLARIFICATION_REQUIRED", "Query is too vague to evaluate. Missing: COLUMN_SCOPE"),
                   4: ("BLOCK", "Human review"), 5: ("APPROVE", None), 6: ("BLOCK", "before")}
    assert [r["query_id"] for r in gate.escalations(decided).collect()] == [2]
    guides = {r["query_id"]: r["guidance"] for r in decided.collect()}
    assert guides[1] == "Applied controls: log_access"
    logged = decided.withColumns({
        "session_id": F.lit("s"), "created_at": F.lit("2024-01-01").cast("timestamp_ntz"),
        "reasoning": F.col("verdict.reasoning"), "cited_policies": F.col("verdict.cited_policies"),
        "sensitive_columns": F.col("verdict.sensitive_columns"), "required_controls": F.col("verdict.required_controls"),
        "cache_layer": F.when(F.col("query_id") == 6, "exact"), "total_cost_usd": F.lit(0.01),
        "processing_ms": F.lit(5.0), "stage_outputs": F.lit("{}")})
    stats = audit.audit_stats(audit.audit_rows(logged)).first()
    assert stats["total_decisions"] == 6 and stats["approved"] + stats["blocked"] + stats["escalated"] == 6
    assert abs(stats["cache_hit_rate"] - 1 / 6) < 1e-9 and stats["avg_cost_usd"] == 0.01
    kept = store_decisions(logged.withColumn("ts", F.col("created_at")), with_vectors=False)
    assert sorted(r["entry_id"] for r in kept.collect()) == [1, 4, 5]


def test_guidance(spark):
    text = spark.range(1).select(gate.block_guidance(F.array(F.lit("mask_pii")), F.array(F.lit("a"), F.lit("b")))).first()[0]
    lines = text.splitlines()
    assert lines[1] == "- Request only anonymised/masked columns" and lines[2] == "- Avoid requesting sensitive columns: a, b"
    assert len(lines) == 5


def test_governed_queries(spark):
    spark.range(5).createOrReplaceTempView("five")
    for cap, left_out in ((4, True), (5, False), (6, False), (None, False)):
        rows, cut = gate.run_governed(spark, " select * from five;", "APPROVE", cap=cap)
        assert rows.count() == min(5, cap or 5) and cut == left_out
    rows, cut = gate.run_governed(spark, "WITH x AS (SELECT 1) SELECT * FROM x", "APPROVE", cap=5)
    assert rows.count() == 1 and not cut
    assert gate.run_governed(spark, "UPDATE five SET id = 1", "APPROVE") is None
    assert gate.run_governed(spark, "select * from five", "BLOCK") is None


def test_repeated_answers_do_not_repeat_a_request(spark):
    human = spark.createDataFrame([(1, "APPROVE", "fine"), (1, "BLOCK", "no"), (2, "APPROVE", "ok")],
                                  "query_id long, human_decision string, human_reasoning string")
    verdict = "struct<decision:string,required_controls:array<string>,sensitive_columns:array<string>,reasoning:string>"
    asked = spark.range(1, 4).withColumnRenamed("id", "query_id").selectExpr(
        "query_id", "CAST(NULL AS STRING) AS cached_decision", "CAST(NULL AS STRING) AS cached_reason",
        "CAST(NULL AS STRING) AS cached_guidance", "'CLEAR' AS intent", "'UNCERTAIN' AS policy_status",
        "true AS checks_passed", "array('x') AS missing", "'' AS clarification", f"CAST(NULL AS {verdict}) AS verdict")
    found = sorted((r.query_id, r.final_decision, r.block_reason) for r in gate.decide(asked, human).collect())
    assert found == [(1, "BLOCK", "no"), (2, "APPROVE", None), (3, "ESCALATED", None)]
