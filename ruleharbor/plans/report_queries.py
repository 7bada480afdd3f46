"""Registered queries: reviews, samples, explanations and report tables over the violations log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleharbor.functions.replies import json_object_text, parse_object
from ruleharbor.operators import report, review
from ruleharbor.operators.scan import rules_frame
from ruleharbor.plans import fixtures as X
from ruleharbor.plans.scan_queries import COUNTS_SQL, LOG_CTES, counts, violations

# --- inputs ---------------------------------------------------------------------------------


def rules(spark):
    return rules_frame(spark, X.RULES)


def rule_counts(spark, sf_dir):
    return counts(spark, sf_dir).groupBy("rule_id").agg(F.sum("violation_count").alias("violation_count"))


def explanations(spark, sf_dir):
    return review.template_explanations(counts(spark, sf_dir), rules(spark))


def verdicts(log: DataFrame) -> DataFrame:
    """Two rounds of verdicts, by the last digit of the key; the last part decides where there are several."""
    digit = F.substring(F.col("record_primary_key"), -1, 1)
    verdict = F.when(digit == "0", "false_positive").when(digit <= "6", "confirmed")
    first = log.select(
        "violation_id", verdict.alias("verdict"), F.lit("first look").alias("notes"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("reviewed_at"),
    ).where("verdict IS NOT NULL")
    second = log.where(digit == "3").select(
        "violation_id", F.lit("false_positive").alias("verdict"), F.lit("second look").alias("notes"),
        F.lit("2024-01-02 00:00:00").cast("timestamp_ntz").alias("reviewed_at"),
    )
    return first.unionByName(second)


_DIGIT = "right(record_primary_key, 1)"
_VERDICT_SQL = f"""
SELECT *, CASE WHEN {_DIGIT} IN ('0', '3') THEN 'false_positive'
               WHEN {_DIGIT} <= '6' THEN 'confirmed' END AS verdict,
       CASE WHEN {_DIGIT} > '6' THEN NULL WHEN {_DIGIT} = '3' THEN 'second look'
            ELSE 'first look' END AS notes
FROM log
"""
_SAMPLE_SQL = """
SELECT * FROM judged WHERE violation_type IN ('data_quality', 'data_security', 'data_privacy') AND confidence < 0.85
QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY confidence, violation_id) <= 50
"""
_JUDGED = {**LOG_CTES, "judged": _VERDICT_SQL}
_RULE_COUNTS = {"c": COUNTS_SQL, "rules": X.RULES_SQL}
_SEVERITY = "CASE WHEN n >= 500 THEN 'HIGH' WHEN n >= 50 THEN 'MEDIUM' ELSE 'LOW' END"
_EXPL_SQL = f"""
SELECT rule_id, rule_text, rule_type, target_column, n AS violation_count, {_SEVERITY} AS severity,
       CAST(n AS STRING) || ' records in column ''' || target_column || ''' violate the rule: ' || rule_text AS explanation,
       substr(rule_text, 1, 120) AS policy_clause,
       'Unresolved violations in ''' || target_column || ''' may indicate non-compliance with policy: '
         || substr(rule_text, 1, 80) || '.' AS risk_description
FROM (SELECT rule_id, CAST(sum(violation_count) AS BIGINT) AS n FROM c GROUP BY 1) JOIN rules USING (rule_id) WHERE n > 0
"""
_EXPL = {**_RULE_COUNTS, "expl": _EXPL_SQL}

# --- reviews -----------------------------------------------------------------------------------


def validation_sample(spark, sf_dir):
    return review.validation_sample(violations(spark, sf_dir)).select("rule_id", "violation_id", "rank", "batch")


def explanation_sample(spark, sf_dir):
    return review.explanation_sample(violations(spark, sf_dir)).select("rule_id", "violation_id", "rank")


def apply_reviews(spark, sf_dir):
    log = violations(spark, sf_dir)
    out = review.apply_reviews(log, verdicts(log))
    return out.select("violation_id", "review_status", "reviewer_notes")


def apply_verdicts(spark, sf_dir):
    log = violations(spark, sf_dir)
    out = review.apply_verdicts(log, verdicts(log))
    return out.groupBy("rule_id", "review_status").agg(F.count("*").alias("n"))


def validation_summary(spark, sf_dir):
    log = violations(spark, sf_dir)
    return review.validation_summary(review.validation_sample(log), verdicts(log), rules(spark))


# --- explanations ------------------------------------------------------------------------------


def rule_severity(spark, sf_dir):
    return explanations(spark, sf_dir).select("rule_id", "violation_count", "severity")


def explanation_template(spark, sf_dir):
    out = explanations(spark, sf_dir)
    return out.withColumn("remediation_steps", F.array_join("remediation_steps", "|"))


def _stored(spark, sf_dir):
    """Explanations stored twice for rules with large counts: the later one says so."""
    base = explanations(spark, sf_dir).withColumn("scan_id", F.lit(X.SCAN_ID))
    at = lambda df, t: df.withColumn("generated_at", F.lit(t).cast("timestamp_ntz"))
    later = base.where("violation_count >= 50").withColumn("explanation", F.concat(F.lit("again: "), "explanation"))
    return at(base, "2024-01-01 00:00:00").unionByName(at(later, "2024-01-02 00:00:00"))


def explanations_latest(spark, sf_dir):
    return review.latest_explanations(_stored(spark, sf_dir)).select("scan_id", "rule_id", "explanation")


_REPLY_SCHEMA = "explanation string, policy_clause string, remediation_steps array<string>, severity string, risk_description string"


def explanation_replies(spark, sf_dir):
    """Explanations from replies where there is one that can be read, else the template."""
    base = explanations(spark, sf_dir)
    number = F.expr("CAST(substring(rule_id, -3) AS INT)")
    reply = F.when(number == 1, F.concat(
        F.lit('```json\n{"explanation": "seen '), F.col("violation_count"),
        F.lit('", "severity": "low", "remediation_steps": ["x", "y"]}\n```'),
    )).when(number == 3, F.lit('{"explanation": "none", "severity": "fatal"}')).otherwise("no object here")
    replies = base.select("rule_id", parse_object(json_object_text(reply), _REPLY_SCHEMA).alias("reply"))
    out = review.reply_explanations(replies.where("reply IS NOT NULL"), base)
    return out.select("rule_id", "severity", "explanation", F.array_join("remediation_steps", "|").alias("steps"))


# --- report -------------------------------------------------------------------------------------


def report_by_rule(spark, sf_dir):
    """Stored explanations for large counts, those in memory for the rest, none for tiny counts."""
    made = explanations(spark, sf_dir)
    stored = made.where("violation_count >= 500")
    memory = made.where("violation_count >= 20").withColumn("explanation", F.lit("from memory"))
    out = report.report_by_rule(violations(spark, sf_dir), stored, memory)
    return out.select("rule_id", "rule_text", "violation_count", "severity", "explanation",
                      F.size("remediation_steps").alias("steps"))


def report_rule_violations(spark, sf_dir):
    slim = report.slim(violations(spark, sf_dir))
    return slim.withColumn("detected_at", F.date_format("detected_at", "yyyy-MM-dd"))


def report_by_table(spark, sf_dir):
    return report.report_by_table(violations(spark, sf_dir))


def rule_status(spark, sf_dir):
    n = F.col("violation_count")
    return rule_counts(spark, sf_dir).select("rule_id", "violation_count", report.rule_status(n).alias("status"))


def compliance_score(spark, sf_dir):
    per_rule = rule_counts(spark, sf_dir)
    return report.compliance_score(per_rule, F.lit(len(X.RULES)))


def compliance_score_reviewed(spark, sf_dir):
    """The same score when false positives no longer count."""
    log = violations(spark, sf_dir)
    kept = review.apply_reviews(log, verdicts(log)).where("review_status <> 'false_positive'")
    return report.compliance_score(report.violations_per_rule(kept), F.lit(len(X.RULES)))


def dashboard_score(spark, sf_dir):
    return report.dashboard_score(explanations(spark, sf_dir))


def violations_by_type(spark, sf_dir):
    return report.violations_by_type(explanations(spark, sf_dir), rules(spark))


def report_rules_sorted(spark, sf_dir):
    """Report order made visible as a position; one row per rule."""
    ranked = report.sort_rules(explanations(spark, sf_dir)).select("rule_id", "severity", "violation_count")
    # One partition keeps the order of the sort; there is one row per rule.
    ids = ranked.coalesce(1).agg(F.collect_list("rule_id").alias("ids"))
    return ids.select(F.posexplode("ids").alias("position", "rule_id"))


def top_rules(spark, sf_dir):
    by_rule = report.top_counts(rule_counts(spark, sf_dir), "rule_id", 5).select(
        F.lit("rule").alias("kind"), F.col("rule_id").alias("name"), "violation_count")
    per_table = counts(spark, sf_dir).groupBy("table_name").agg(F.sum("violation_count").alias("violation_count"))
    by_table = report.top_counts(per_table, "table_name", 3).select(
        F.lit("table").alias("kind"), F.col("table_name").alias("name"), "violation_count")
    open_ = report.needs_review(violations(spark, sf_dir)).agg(
        F.lit("needs review beyond ten").alias("name"), F.greatest(F.count("*") - 10, F.lit(0)).alias("violation_count")
    ).select(F.lit("rest").alias("kind"), "name", "violation_count")
    return reduce(DataFrame.unionByName, [by_rule, by_table, open_])


def violations_by_scan(spark, sf_dir):
    return report.by_scan(violations(spark, sf_dir), X.SCAN_ID).select("violation_id", "confidence")


def violations_by_scan_table(spark, sf_dir):
    return report.by_scan_and_table(violations(spark, sf_dir), X.SCAN_ID, "lineitem").select("violation_id", "confidence")


def needs_review(spark, sf_dir):
    return report.needs_review(violations(spark, sf_dir)).select("violation_id", "confidence")


def high_confidence(spark, sf_dir):
    return report.high_confidence(violations(spark, sf_dir)).select("violation_id", "confidence")


def violations_search(spark, sf_dir):
    rows = explanations(spark, sf_dir).join(rules(spark).select("rule_id", "rule_type"), "rule_id")
    return report.search(rows, " PRIVACY ").select("rule_id", "rule_type", "violation_count").unionByName(
        report.search(rows, "o_total").select("rule_id", "rule_type", "violation_count"))


def expectations_check(spark, sf_dir):
    """Counts per rule against those found by plain filters, with one fact that must fail and one unmatched."""
    actual = counts(spark, sf_dir).select(F.col("rule_id").alias("fact"), F.col("violation_count").alias("n"))
    orders = X.table(spark, sf_dir, "orders")
    facts = {"AMT-001": F.col("o_totalprice") > 10000, "AMT-003": F.col("o_totalprice") < 2000,
             "FMT-002": F.col("o_orderpriority") == "2-HIGH", "NO-RULE": F.col("o_orderkey").isNull()}
    expected = orders.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(facts.values())]).select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("fact"), F.col(f"c{i}").alias("n")) for i, name in enumerate(facts)
    ])))
    return report.check_expectations(expected, actual)


def usage_totals(spark, sf_dir):
    return report.usage_totals(X.derived(spark, sf_dir, X.USAGE_SQL, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        validation_sample, explanation_sample, apply_reviews, apply_verdicts, validation_summary, rule_severity,
        explanation_template, explanations_latest, explanation_replies, report_by_rule, report_rule_violations,
        report_by_table, rule_status, compliance_score, compliance_score_reviewed, dashboard_score,
        violations_by_type, report_rules_sorted, top_rules, violations_by_scan, violations_by_scan_table,
        needs_review, high_confidence, violations_search, expectations_check, usage_totals,
    )
}

_SCORE = (
    "SELECT rules_failing, CAST(13 AS BIGINT) AS total_rules_checked, rules_passing, score AS compliance_score, "
    "CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 45 THEN 'D' "
    "ELSE 'F' END AS compliance_grade FROM (SELECT *, round(rules_passing / 13.0 * 100, 1) AS score FROM "
    "(SELECT f AS rules_failing, 13 - f AS rules_passing FROM ({failing})))"
)
_STEPS = (
    "'Review all ' || CAST(violation_count AS STRING) || ' flagged records in column ''' || target_column || '''.|"
    "Update or delete records that do not meet the policy requirement.|"
    "Implement data validation to prevent future violations.'"
)
_EXPL_OUT = "rule_id, rule_text, violation_count, severity, explanation, policy_clause, risk_description"
ORACLE = {
    "validation_sample": X.with_cte(
        "SELECT rule_id, violation_id, CAST(rn AS INT) AS rank, CAST((rn - 1) // 20 AS INT) AS batch FROM (SELECT *, "
        "row_number() OVER (PARTITION BY rule_id ORDER BY confidence, violation_id) AS rn FROM sample)",
        **_JUDGED, sample=_SAMPLE_SQL),
    "explanation_sample": X.with_cte(
        "SELECT rule_id, violation_id, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY rule_id "
        "ORDER BY confidence DESC, detected_at, violation_id) AS rn FROM log) WHERE rn <= 5", **LOG_CTES),
    "apply_reviews": X.with_cte(
        "SELECT violation_id, coalesce(verdict, 'pending') AS review_status, notes AS reviewer_notes FROM judged", **_JUDGED),
    "apply_verdicts": X.with_cte(
        "SELECT rule_id, coalesce(verdict, 'pending') AS review_status, count(*) AS n FROM judged GROUP BY 1, 2", **_JUDGED),
    "validation_summary": X.with_cte(
        "SELECT rules.rule_id, count(violation_id) AS validated, count(*) FILTER (WHERE verdict = 'confirmed') AS confirmed, "
        "count(*) FILTER (WHERE verdict = 'false_positive') AS false_positives, "
        "count(*) FILTER (WHERE verdict IS NULL AND violation_id IS NOT NULL) AS unresolved, "
        "count(DISTINCT CASE WHEN rules.rule_type NOT IN ('data_quality', 'data_security', 'data_privacy') THEN rules.rule_id END) "
        "AS skipped FROM rules LEFT JOIN sample ON rules.rule_id = sample.rule_id GROUP BY ROLLUP (rules.rule_id)",
        **_JUDGED, sample=_SAMPLE_SQL),
    "rule_severity": X.with_cte("SELECT rule_id, violation_count, severity FROM expl", **_EXPL),
    "explanation_template": X.with_cte(f"SELECT {_EXPL_OUT}, {_STEPS} AS remediation_steps FROM expl", **_EXPL),
    "explanations_latest": X.with_cte(
        f"SELECT '{X.SCAN_ID}' AS scan_id, rule_id, CASE WHEN violation_count >= 50 THEN 'again: ' ELSE '' END || explanation "
        "AS explanation FROM expl", **_EXPL),
    "explanation_replies": X.with_cte(
        "SELECT rule_id, CASE right(rule_id, 1) WHEN '1' THEN 'LOW' ELSE severity END AS severity, "
        "CASE right(rule_id, 1) WHEN '1' THEN 'seen ' || CAST(violation_count AS STRING) WHEN '3' THEN 'none' "
        f"ELSE explanation END AS explanation, CASE right(rule_id, 1) WHEN '1' THEN 'x|y' WHEN '3' THEN '' ELSE {_STEPS} END "
        "AS steps FROM expl", **_EXPL),
    "report_by_rule": X.with_cte(
        "SELECT rule_id, rule_text, violation_count, CASE WHEN violation_count >= 20 THEN severity ELSE '' END AS severity, "
        "CASE WHEN violation_count >= 500 THEN explanation WHEN violation_count >= 20 THEN 'from memory' ELSE '' END "
        "AS explanation, CASE WHEN violation_count >= 20 THEN 3 ELSE 0 END AS steps FROM expl", **_EXPL),
    "report_rule_violations": X.with_cte(
        "SELECT violation_id, rule_id, table_name, record_primary_key, confidence, violation_type, review_status, "
        "'2001-12-31' AS detected_at FROM log", **LOG_CTES),
    "report_by_table": X.with_cte("SELECT table_name, count(*) AS violation_count FROM log GROUP BY 1", **LOG_CTES),
    "rule_status": X.with_cte(
        "SELECT rule_id, violation_count, CASE WHEN violation_count > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM c",
        c=COUNTS_SQL),
    "compliance_score": X.with_cte(
        _SCORE.format(failing="SELECT count(*) FILTER (WHERE violation_count > 0) AS f FROM c"), c=COUNTS_SQL),
    "compliance_score_reviewed": X.with_cte(
        _SCORE.format(failing="SELECT count(DISTINCT rule_id) AS f FROM judged WHERE verdict IS DISTINCT FROM 'false_positive'"),
        **_JUDGED),
    "dashboard_score": X.with_cte(
        "SELECT score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 "
        "THEN 'D' ELSE 'F' END AS grade FROM (SELECT greatest(0, least(100, CAST(floor(100 - sum(least(25.0, CASE severity "
        "WHEN 'HIGH' THEN 8 WHEN 'MEDIUM' THEN 3 ELSE 1 END * sqrt(violation_count))) + 0.5) AS BIGINT))) AS score FROM expl)",
        **_EXPL),
    "violations_by_type": X.with_cte(
        "SELECT replace(rule_type, 'data_', '') AS name, CAST(sum(violation_count) AS BIGINT) AS violation_count FROM expl "
        "GROUP BY 1", **_EXPL),
    "report_rules_sorted": X.with_cte(
        "SELECT rule_id, CAST(row_number() OVER (ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, "
        "violation_count DESC, rule_id) - 1 AS INT) AS position FROM expl", **_EXPL),
    "top_rules": X.with_cte(
        "SELECT * FROM (SELECT 'rule' AS kind, rule_id AS name, violation_count FROM c ORDER BY 3 DESC, 2 LIMIT 5) UNION ALL "
        "SELECT * FROM (SELECT 'table', table_name, CAST(sum(violation_count) AS BIGINT) FROM c GROUP BY 2 "
        "ORDER BY 3 DESC, 2 LIMIT 3) UNION ALL SELECT 'rest', 'needs review beyond ten', greatest(count(*) - 10, 0) FROM log "
        "WHERE confidence < 0.7", **LOG_CTES, c=COUNTS_SQL),
    "violations_by_scan": X.with_cte("SELECT violation_id, confidence FROM log", **LOG_CTES),
    "violations_by_scan_table": X.with_cte(
        "SELECT violation_id, confidence FROM log WHERE table_name = 'lineitem'", **LOG_CTES),
    "needs_review": X.with_cte("SELECT violation_id, confidence FROM log WHERE confidence < 0.7", **LOG_CTES),
    "high_confidence": X.with_cte("SELECT violation_id, confidence FROM log WHERE confidence >= 0.7", **LOG_CTES),
    "violations_search": X.with_cte(
        "SELECT rule_id, rule_type, violation_count FROM expl WHERE contains(lower(concat_ws(' ', rule_id, rule_type, "
        "severity, explanation)), 'privacy') UNION ALL SELECT rule_id, rule_type, violation_count FROM expl WHERE "
        "contains(lower(explanation), 'o_total')", **_EXPL),
    "expectations_check": X.with_cte(
        "SELECT coalesce(e.fact, rule_id) AS fact, n AS expected, violation_count AS actual, CASE WHEN n = violation_count "
        "THEN 'PASS' ELSE 'FAIL' END AS verdict FROM c FULL OUTER JOIN e ON fact = rule_id",
        c=COUNTS_SQL, e="SELECT 'AMT-001' AS fact, count(*) AS n FROM orders WHERE o_totalprice > 10000 UNION ALL "
        "SELECT 'AMT-003', count(*) FROM orders WHERE o_totalprice < 2000 UNION ALL "
        "SELECT 'FMT-002', count(*) FROM orders WHERE o_orderpriority = '2-HIGH' UNION ALL SELECT 'NO-RULE', 0"),
    "usage_totals": X.with_cte(
        "SELECT CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS "
        "completion_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, count(*) AS llm_calls FROM u", u=X.USAGE_SQL),
}
