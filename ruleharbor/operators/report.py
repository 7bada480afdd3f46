"""Report tables over the violations log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleharbor.functions import fixed_values as K

SLIM_COLUMNS = (
    "violation_id", "rule_id", "table_name", "record_primary_key", "confidence", "violation_type",
    "review_status", "detected_at",
)
EXPLANATION_COLUMNS = ("severity", "explanation", "policy_clause", "remediation_steps", "risk_description")


def slim(violations: DataFrame) -> DataFrame:
    """Violations without the record payload."""
    return violations.select(*SLIM_COLUMNS)


def scan_summary(violations: DataFrame) -> DataFrame:
    """One row of totals; zeros for a scan without violations.

    Counted per (table, rule) first, so distinct counts run over a handful of rows.
    """
    small = violations.groupBy("table_name", "rule_id").agg(
        F.count("*").alias("n"),
        F.sum("confidence").alias("conf"),
        F.count("confidence").alias("conf_n"),
        F.min("detected_at").alias("first"),
        F.max("detected_at").alias("last"),
    )
    return small.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_violations"),
        F.count_distinct("table_name").alias("tables_with_violations"),
        F.count_distinct("rule_id").alias("rules_violated"),
        F.coalesce(F.sum("conf") / F.nullif(F.sum("conf_n"), F.lit(0)), F.lit(0.0)).alias("avg_confidence"),
        F.min("first").alias("scan_start"),
        F.max("last").alias("scan_end"),
    )


def violations_per_rule(violations: DataFrame) -> DataFrame:
    return violations.groupBy("rule_id").agg(F.count("*").alias("violation_count"))


def report_by_rule(violations: DataFrame, stored: DataFrame, in_memory: DataFrame) -> DataFrame:
    """One row per violated rule with its explanation: stored ones first, then those in memory.

    The violations themselves are ``slim(violations)``, keyed by rule_id.
    """
    groups = violations.groupBy("rule_id").agg(
        F.max("rule_text").alias("rule_text"), F.count("*").alias("violation_count")
    )
    first = stored.select("rule_id", F.struct(*EXPLANATION_COLUMNS).alias("s"))
    second = in_memory.select("rule_id", F.struct(*EXPLANATION_COLUMNS).alias("m"))
    joined = groups.join(first, "rule_id", "left").join(second, "rule_id", "left")
    best = F.coalesce("s", "m")
    return joined.withColumn("x", best).select(
        "rule_id", "rule_text", "violation_count",
        *[F.coalesce(F.col(f"x.{c}"), F.lit("")).alias(c) for c in EXPLANATION_COLUMNS if c != "remediation_steps"],
        F.coalesce("x.remediation_steps", F.array().cast("array<string>")).alias("remediation_steps"),
    )


def report_by_table(violations: DataFrame) -> DataFrame:
    return violations.groupBy("table_name").agg(F.count("*").alias("violation_count"))


def rule_status(count: Column) -> Column:
    return F.when(count > 0, "FAIL").otherwise("PASS")


def grade(score: Column, grades=K.REPORT_GRADES) -> Column:
    chain = None
    for name, floor in grades:
        chain = (F if chain is None else chain).when(score >= floor, name)
    return chain.otherwise("F")


def compliance_score(rule_counts: DataFrame, rules_checked: Column) -> DataFrame:
    """Share of rules without violations, in percent, with its grade.

    ``rule_counts``: rule_id, violation_count. ``rules_checked``: number of rules that were
    checked; 0 or NULL falls back to the number of failing rules.
    """
    failing = rule_counts.where("violation_count > 0").agg(F.count_distinct("rule_id").alias("rules_failing"))
    total = F.coalesce(F.nullif(rules_checked, F.lit(0)), F.col("rules_failing")).cast("long")
    shares = failing.withColumn("total_rules_checked", total).withColumn(
        "rules_passing", F.greatest(F.lit(0), F.col("total_rules_checked") - F.col("rules_failing"))
    )
    score = F.when(
        F.col("total_rules_checked") > 0,
        F.bround(F.col("rules_passing") / F.col("total_rules_checked") * 100, 1),
    ).otherwise(0.0)
    return shares.withColumn("compliance_score", score).withColumn(
        "compliance_grade", grade(F.col("compliance_score"))
    )


def dashboard_score(explanations: DataFrame) -> DataFrame:
    """100 minus a penalty per rule that grows with the root of its violation count."""
    chain = None
    for name, weight in K.DASHBOARD_WEIGHTS.items():
        chain = (F if chain is None else chain).when(F.col("severity") == name, weight)
    penalty = F.least(
        chain.otherwise(1) * F.sqrt(F.coalesce("violation_count", F.lit(0))), F.lit(float(K.DASHBOARD_PENALTY_CAP))
    )
    raw = 100 - F.coalesce(F.sum(penalty), F.lit(0.0))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(raw + 0.5))).cast("long")
    return explanations.agg(score.alias("score")).withColumn("grade", grade(F.col("score"), K.DASHBOARD_GRADES))


def violations_by_type(explanations: DataFrame, rules: DataFrame) -> DataFrame:
    typed = explanations.join(rules.select("rule_id", "rule_type"), "rule_id", "left")
    kind = F.replace(F.coalesce("rule_type", F.lit("unknown")), F.lit("data_"), F.lit(""))
    return (
        typed.groupBy(kind.alias("name"))
        .agg(F.sum("violation_count").alias("violation_count"))
        .orderBy(F.col("violation_count").desc(), "name")
    )


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "HIGH", 0).when(severity == "MEDIUM", 1).when(severity == "LOW", 2).otherwise(3)


def sort_rules(report_rules: DataFrame) -> DataFrame:
    return report_rules.orderBy(severity_rank(F.col("severity")), F.col("violation_count").desc(), "rule_id")


def top_counts(counts: DataFrame, key: str, n: int) -> DataFrame:
    return counts.orderBy(F.col("violation_count").desc(), key).limit(n)


# Thousands of violations share a confidence and a time. The id behind them lets a sort cut such a run into many tasks.


def by_scan(violations: DataFrame, scan_id: str) -> DataFrame:
    """Violations of a scan, the surest first; of equal ones the oldest, then the smallest id."""
    return violations.where(F.col("scan_id") == scan_id).orderBy(F.col("confidence").desc(), "detected_at", "violation_id")


def by_scan_and_table(violations: DataFrame, scan_id: str, table: str) -> DataFrame:
    chosen = (F.col("scan_id") == scan_id) & (F.col("table_name") == table)
    return violations.where(chosen).orderBy(F.col("confidence").desc(), "violation_id")


def needs_review(violations: DataFrame, floor: float = K.REVIEW_CONFIDENCE) -> DataFrame:
    open_ = (F.col("confidence") < floor) & (F.col("review_status") == "pending")
    return violations.where(open_).orderBy("confidence", "violation_id")


def high_confidence(violations: DataFrame, floor: float = K.REVIEW_CONFIDENCE) -> DataFrame:
    return violations.where(F.coalesce("confidence", F.lit(1.0)) >= floor)


def search(rows: DataFrame, text: str, sort_by: str = "violation_count") -> DataFrame:
    """Rows whose id, type, severity or explanation contains ``text``, ignoring case, largest first."""
    wanted = text.lower().strip()
    fields = ("rule_id", "rule_type", "severity", "explanation")
    hit = F.lit(not wanted)
    for f in fields:
        hit = hit | F.lower(F.coalesce(f, F.lit(""))).contains(wanted)
    return rows.where(hit).orderBy(F.col(sort_by).desc(), "rule_id")


def check_expectations(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected against actual counts per fact: PASS when equal, else FAIL."""
    both = expected.select("fact", F.col("n").alias("expected")).join(
        actual.select("fact", F.col("n").alias("actual")), "fact", "full_outer"
    )
    return both.withColumn("verdict", F.when(F.col("expected") == F.col("actual"), "PASS").otherwise("FAIL"))


def usage_totals(usage: DataFrame) -> DataFrame:
    return usage.agg(
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.count("*").alias("llm_calls"),
    )


def review_counts(decisions: DataFrame) -> DataFrame:
    return decisions.agg(
        F.count_if(F.col("verdict") == "approved").alias("approved"),
        F.count_if(F.col("verdict") == "dropped").alias("dropped"),
    )
