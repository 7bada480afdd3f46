"""The append-only audit log of decisions and its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AUDIT_COLUMNS = (
    "log_id", "session_id", "created_at", "query", "user_id", "user_role", "stated_purpose", "decision",
    "reasoning", "cited_policies", "sensitive_cols", "required_ctrls", "cache_hit", "cache_layer",
    "total_cost_usd", "processing_ms", "stage_outputs",
)


def audit_rows(decided: DataFrame) -> DataFrame:
    """Audit rows, one per decided request. Ids depend on the request only, so a replay repeats them."""
    json_list = lambda c: F.to_json(F.coalesce(c, F.array().cast("array<string>")))
    return decided.select(
        F.sha2(F.concat_ws("|", F.col("query_id").cast("string"), F.col("session_id")), 256).alias("log_id"),
        "session_id", "created_at", "query", "user_id", "user_role", "stated_purpose",
        F.coalesce("final_decision", F.lit("BLOCK")).alias("decision"),
        F.coalesce("reasoning", "block_reason", F.lit("")).alias("reasoning"),
        json_list(F.col("cited_policies")).alias("cited_policies"),
        json_list(F.col("sensitive_columns")).alias("sensitive_cols"),
        json_list(F.col("required_controls")).alias("required_ctrls"),
        F.col("cache_layer").isNotNull().alias("cache_hit"),
        "cache_layer",
        F.coalesce("total_cost_usd", F.lit(0.0)).alias("total_cost_usd"),
        F.coalesce("processing_ms", F.lit(0.0)).alias("processing_ms"),
        "stage_outputs",
    )


def audit_stats(log: DataFrame) -> DataFrame:
    """Totals; whatever is neither approved nor blocked counts as escalated."""
    fresh = ~F.col("cache_hit")
    total = F.count("*")
    approved = F.count_if(F.col("decision") == "APPROVE")
    blocked = F.count_if(F.col("decision") == "BLOCK")
    mean = lambda c, digits: F.coalesce(F.bround(F.avg(F.when(fresh, F.col(c))), digits), F.lit(0.0))
    return log.agg(
        total.alias("total_decisions"),
        approved.alias("approved"),
        blocked.alias("blocked"),
        (total - approved - blocked).alias("escalated"),
        F.coalesce(F.count_if("cache_hit") / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("cache_hit_rate"),
        mean("total_cost_usd", 4).alias("avg_cost_usd"),
        mean("processing_ms", 1).alias("avg_latency_ms"),
    )


def recent(log: DataFrame, n: int = 50, where: Column | None = None) -> DataFrame:
    """The latest ``n`` rows, optionally of one user or session."""
    rows = log if where is None else log.where(where)
    return rows.orderBy(F.col("created_at").desc(), "log_id").limit(n)
