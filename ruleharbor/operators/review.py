"""Samples of violations, verdicts on them, and explanations per rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleharbor.functions import fixed_values as K
from ruleharbor.functions.ordering import first_row, top_rows
from ruleharbor.functions.text import strip


def validation_sample(
    violations: DataFrame,
    rule_types: tuple[str, ...] = K.VALIDATED_RULE_TYPES,
    ceiling: float = K.VALIDATION_CEILING,
    size: int = K.VALIDATION_SAMPLE,
    batch: int = K.VALIDATION_BATCH,
) -> DataFrame:
    """Pending, less certain violations per rule, least certain first, numbered in batches.

    Both spellings of a rule type (``data_quality`` and ``quality``) are sampled.
    """
    types = [*rule_types, *[t.removeprefix("data_") for t in rule_types]]
    candidates = violations.where(
        F.col("violation_type").isin(types) & (F.col("confidence") < ceiling) & (F.col("review_status") == "pending")
    )
    ranked = top_rows(candidates, ["rule_id"], [F.col("confidence"), F.col("violation_id")], size)
    return ranked.withColumn("batch", F.floor((F.col("rank") - 1) / batch).cast("int"))


def explanation_sample(violations: DataFrame, size: int = K.EXPLANATION_SAMPLE) -> DataFrame:
    """The first violations per rule, most certain and earliest first."""
    order = [F.col("confidence").desc(), F.col("detected_at"), F.col("violation_id")]
    return top_rows(violations, ["rule_id"], order, size)


def latest_reviews(reviews: DataFrame) -> DataFrame:
    return first_row(reviews, ["violation_id"], [F.col("reviewed_at").desc(), F.col("verdict")])


def apply_verdicts(violations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Violations with their latest verdict; without one they stay as they are.

    ``verdicts``: violation_id, verdict, notes, reviewed_at. A verdict other than
    ``false_positive`` confirms; a false positive without notes gets the standard one.
    """
    false_positive = F.lower("verdict") == "false_positive"
    latest = latest_reviews(verdicts).select(
        "violation_id",
        F.when(false_positive, "false_positive").otherwise("confirmed").alias("new_status"),
        F.coalesce("notes", F.when(false_positive, K.FALSE_POSITIVE_NOTE)).alias("new_notes"),
        F.col("reviewed_at").alias("new_at"),
    )
    return _with_status(violations, latest)


def apply_reviews(violations: DataFrame, reviews: DataFrame) -> DataFrame:
    """The log with the latest manual status per violation (confirmed, false_positive or pending)."""
    latest = latest_reviews(reviews).select(
        "violation_id",
        F.col("verdict").alias("new_status"),
        F.col("notes").alias("new_notes"),
        F.col("reviewed_at").alias("new_at"),
    )
    return _with_status(violations, latest)


def _with_status(violations: DataFrame, latest: DataFrame) -> DataFrame:
    joined = violations.join(latest, "violation_id", "left")
    return joined.withColumns({
        "review_status": F.coalesce("new_status", "review_status", F.lit("pending")),
        "reviewer_notes": F.coalesce("new_notes", "reviewer_notes"),
        "reviewed_at": F.coalesce("new_at", "reviewed_at"),
    }).select(*violations.columns)


def validation_summary(sample: DataFrame, verdicts: DataFrame, rules: DataFrame) -> DataFrame:
    """Per rule, and in a row with NULL rule_id in total: sampled, confirmed, false positives, open.

    Rules whose type is never validated are counted in ``skipped``.
    """
    latest = latest_reviews(verdicts).select("violation_id", F.lower("verdict").alias("verdict"))
    per_rule = sample.join(latest, "violation_id", "left").groupBy("rule_id").agg(
        F.count("*").alias("validated"),
        F.count_if(F.col("verdict") != "false_positive").alias("confirmed"),
        F.count_if(F.col("verdict") == "false_positive").alias("false_positives"),
        F.count_if(F.col("verdict").isNull()).alias("unresolved"),
    )
    types = [*K.VALIDATED_RULE_TYPES, *[t.removeprefix("data_") for t in K.VALIDATED_RULE_TYPES]]
    base = rules.select("rule_id", (~F.col("rule_type").isin(types)).cast("int").alias("skip"))
    return base.join(per_rule, "rule_id", "left").rollup("rule_id").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("validated", "confirmed", "false_positives", "unresolved")],
        F.sum("skip").alias("skipped"),
    )


# --- explanations --------------------------------------------------------------------


def severity(count: Column) -> Column:
    chain = None
    for name, floor in K.SEVERITY_FLOORS:
        chain = (F if chain is None else chain).when(count >= floor, name)
    return chain.otherwise("LOW")


def template_explanations(counts: DataFrame, rules: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Explanation rows for every rule with violations, for use where no model reply exists.

    ``max_chars`` bounds the rule text inside policy_clause and risk_description; by default it stays whole.
    """
    n, col, text = F.col("violation_count"), F.col("target_column"), F.col("rule_text")
    told = text if max_chars is None else F.substring(text, 1, max_chars)
    per_rule = counts.groupBy("rule_id").agg(F.sum("violation_count").alias("violation_count"))
    return per_rule.where(n > 0).join(rules.select("rule_id", "rule_text", "target_column"), "rule_id").select(
        "rule_id",
        "rule_text",
        "violation_count",
        severity(n).alias("severity"),
        F.format_string("%d records in column '%s' violate the rule: %s", n, col, text).alias("explanation"),
        told.alias("policy_clause"),
        F.array(
            F.format_string("Review all %d flagged records in column '%s'.", n, col),
            F.lit("Update or delete records that do not meet the policy requirement."),
            F.lit("Implement data validation to prevent future violations."),
        ).alias("remediation_steps"),
        F.format_string(
            "Unresolved violations in '%s' may indicate non-compliance with policy: %s.",
            col, told,
        ).alias("risk_description"),
    )


def reply_explanations(replies: DataFrame, templates: DataFrame) -> DataFrame:
    """Explanations from model replies (rule_id, parsed struct ``reply``), the template where one is missing.

    An unknown severity is replaced by the one the count implies; a missing one is MEDIUM.
    """
    joined = templates.join(replies.select("rule_id", "reply"), "rule_id", "left")
    has = F.col("reply").isNotNull()
    named = strip(F.upper(F.coalesce("reply.severity", F.lit("MEDIUM"))))
    own = F.when(named.isin("HIGH", "MEDIUM", "LOW"), named).otherwise(severity(F.col("violation_count")))
    pick = lambda c, blank: F.when(has, F.coalesce(F.col(f"reply.{c}"), blank)).otherwise(F.col(c)).alias(c)
    return joined.select(
        "rule_id", "rule_text", "violation_count",
        F.when(has, own).otherwise(F.col("severity")).alias("severity"),
        pick("explanation", F.lit("")),
        pick("policy_clause", F.lit("")),
        pick("remediation_steps", F.array().cast("array<string>")),
        pick("risk_description", F.lit("")),
    )


def latest_explanations(explanations: DataFrame) -> DataFrame:
    """The last explanation stored per scan and rule."""
    return first_row(explanations, ["scan_id", "rule_id"], [F.col("generated_at").desc()])
