"""Screening of SQL requests: context, intent, verdict checks and the final decision.

Each step adds columns to one row per request. What depends on the text alone is worked
out once per distinct text and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleharbor.functions import fixed_values as K
from ruleharbor.functions import sqltext as S
from ruleharbor.functions.pii import classification, is_pii, pii_categories
from ruleharbor.session import cut_lineage

ANY_TABLE = "*"


def query_columns(texts: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query, tables, columns): schema columns each distinct text touches.

    Columns are those of the select list; all columns of the named tables for SELECT *, for
    texts without a select list, and when no listed column exists. Texts that name no table
    are read against every table. Table and column names match in any case.
    """
    parsed = texts.select("query").distinct().select(
        "query", S.tables_named(F.col("query")).alias("tables"), S.columns_selected(F.col("query")).alias("wanted")
    )
    reach = F.when(F.size("tables") > 0, F.col("tables")).otherwise(F.array(F.lit(ANY_TABLE)))
    name = F.col("column_name")
    known = catalog.select(
        F.explode(F.array(F.lower("table_name"), F.lit(ANY_TABLE))).alias("reached"),
        F.struct(
            "table_name", "column_name", "data_type",
            is_pii(name).alias("is_pii"),
            pii_categories(name).alias("pii_categories"),
            classification(is_pii(name)).alias("classification"),
        ).alias("c"),
    )
    found = (
        parsed.select("query", "tables", "wanted", F.explode(reach).alias("reached"))
        .join(known, "reached", "left")
        .groupBy("query")
        .agg(F.first("tables").alias("tables"), F.first("wanted").alias("wanted"), F.collect_list("c").alias("all"))
    )
    listed = F.filter("all", lambda c: F.array_contains("wanted", F.lower(c["column_name"])))
    open_list = (F.size("wanted") == 0) | F.array_contains("wanted", F.lit("*"))
    chosen = F.when(open_list | (F.size(listed) == 0), F.col("all")).otherwise(listed)
    return found.select("query", "tables", F.array_sort(chosen).alias("columns"))


def add_context(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requests with tables, columns, PII flags, classification, access level and context hash."""
    per_text = query_columns(requests, catalog)
    names = F.transform("columns", lambda c: c["column_name"])
    joined = requests.join(per_text, "query", "left").withColumns({
        "normalised_query": S.normalise_sql(F.col("query")),
        "has_pii": F.exists("columns", lambda c: c["is_pii"]),
        "pii_categories": F.array_sort(F.array_distinct(F.flatten(F.transform(
            F.filter("columns", lambda c: c["is_pii"]), lambda c: c["pii_categories"]
        )))),
        "queried_columns": F.array_distinct(F.transform(names, F.lower)),
        "access_level": access_level(F.col("user_role")),
    })
    return joined.withColumns({
        "max_classification": F.when(F.col("has_pii"), "restricted").otherwise("internal"),
        "context_hash": context_hash(F.col("normalised_query"), F.col("user_role"), F.col("tables"), names),
    })


def access_level(role: Column) -> Column:
    levels = F.create_map(*[F.lit(x) for pair in K.ACCESS_LEVELS.items() for x in pair])
    return F.coalesce(F.element_at(levels, F.lower(role)), F.lit(K.DEFAULT_ACCESS_LEVEL))


def context_hash(normalised: Column, role: Column, tables: Column, columns: Column) -> Column:
    joined = lambda a: F.array_join(F.array_sort(a), ",")
    return F.sha2(F.concat_ws("|", normalised, role, joined(tables), joined(columns)), 256)


def search_text(query: Column, purpose: Column, categories: Column) -> Column:
    tail = F.when(F.size(categories) > 0, F.concat(F.lit(" PII categories: "), F.array_join(categories, ", ")))
    return F.concat(query, F.lit(" "), F.coalesce(purpose, F.lit("")), F.coalesce(tail, F.lit("")))


# --- intent --------------------------------------------------------------------------


def missing_dimensions(query: Column, purpose: Column, has_pii: Column, multi_jurisdiction: Column) -> Column:
    no_purpose = F.coalesce(purpose, F.lit("")) == ""
    wide = S.is_select_star(query) & ~S.has_where(query)
    unplaced = multi_jurisdiction & ~S.normalise_sql(query).contains("jurisdiction")
    return F.array_compact(F.array(
        F.when(no_purpose, F.lit("PURPOSE")),
        F.when(wide, F.lit("COLUMN_SCOPE")),
        F.when(unplaced, F.lit("JURISDICTION")),
        F.when(has_pii & no_purpose, F.lit("PII_JUSTIFICATION")),
    ))


def clarification(missing: Column) -> Column:
    prompts = F.create_map(*[F.lit(x) for pair in K.CLARIFICATIONS.items() for x in pair])
    lines = F.transform(
        missing, lambda d: F.coalesce(F.element_at(prompts, d), F.concat(F.lit("- Details about: "), d))
    )
    return F.array_join(F.concat(F.array(F.lit(K.CLARIFICATION_HEAD)), lines), "\n")


def add_intent(requests: DataFrame, clear_replies: DataFrame | None = None) -> DataFrame:
    """Intent status, confidence, method and clarification.

    A request with exactly one missing dimension is vague unless ``clear_replies``
    (query_id, is_clear, additional_missing) says that it is clear. Of several replies all must say so.
    """
    if clear_replies is None:
        told = requests.withColumns({
            "is_clear": F.lit(False), "additional_missing": F.array().cast("array<string>")
        })
    else:
        replies = clear_replies.groupBy("query_id").agg(
            F.bool_and("is_clear").alias("is_clear"), F.max("additional_missing").alias("additional_missing"))
        told = requests.join(replies, "query_id", "left")
    multi = F.col("has_multi_jurisdiction") if "has_multi_jurisdiction" in requests.columns else F.lit(False)
    told = told.withColumn(
        "missing", missing_dimensions(F.col("query"), F.col("stated_purpose"), F.col("has_pii"), multi)
    )
    n = F.size("missing")
    asked = n == 1
    clear = (n == 0) | (asked & F.coalesce("is_clear", F.lit(False)))
    extra = F.coalesce("additional_missing", F.array().cast("array<string>"))
    status = F.when(clear, "CLEAR").otherwise("VAGUE")
    score = (
        F.when(n >= 2, 0.95)
        .when((n == 0) & S.has_aggregation(F.col("query")), 0.99)
        .when(n == 0, 0.90)
        .when(clear, 0.75)
        .otherwise(0.80)
    )
    widened = F.when(asked & ~clear, F.array_distinct(F.concat("missing", extra))).otherwise(F.col("missing"))
    out = told.withColumns({
        "intent": status,
        "intent_confidence": score,
        "intent_method": F.when(asked, "llm_classified").otherwise("rule_based"),
        "missing": widened,
    }).drop("is_clear", "additional_missing")
    return out.withColumn("clarification", F.when(F.col("intent") == "VAGUE", clarification(F.col("missing"))))


# --- verdict ---------------------------------------------------------------------------


def audit_checks(requests: DataFrame) -> DataFrame:
    """Checks of the verdict in column ``verdict`` against retrieved policies and known columns.

    Adds ``checks`` (map of booleans), the ungrounded citations, the invented columns and
    ``checks_passed``. Citations are only checked when policies were retrieved.
    """
    v = F.col("verdict")
    none = F.array().cast("array<string>")
    cited, sensitive = F.coalesce(v["cited_policies"], none), F.coalesce(v["sensitive_columns"], none)
    policies = F.coalesce("policy_ids", none)
    ungrounded = F.when(F.size(policies) > 0, F.filter(cited, lambda c: ~F.array_contains(policies, c))).otherwise(none)
    text = F.lower("query")
    invented = F.filter(
        sensitive, lambda s: ~F.array_contains("queried_columns", F.lower(s)) & ~text.contains(F.lower(s))
    )
    complete = (
        v["decision"].isNotNull() & v["reasoning"].isNotNull()
        & v["cited_policies"].isNotNull() & v["sensitive_columns"].isNotNull()
    )
    checked = requests.withColumns({"ungrounded": ungrounded, "invented": invented})
    checks = F.create_map(
        F.lit("json_valid"), complete,
        F.lit("decision_valid"), F.coalesce(v["decision"].isin("APPROVE", "BLOCK"), F.lit(False)),
        F.lit("citations_grounded"), F.size("ungrounded") == 0,
        F.lit("columns_valid"), F.size("invented") == 0,
    )
    return checked.withColumn("checks", checks).withColumn(
        "checks_passed", F.forall(F.map_values("checks"), lambda ok: ok)
    )


def policy_status(best_score: Column, floor: float = K.POLICY_CONFIDENCE) -> Column:
    return F.when(F.coalesce(best_score, F.lit(0.0)) >= floor, "CONFIDENT").otherwise("UNCERTAIN")


def block_guidance(controls: Column, sensitive: Column) -> Column:
    lines = F.array_compact(F.array(
        F.lit(K.GUIDANCE_HEAD),
        F.when(F.array_contains(controls, "mask_pii"), F.lit(K.GUIDANCE_MASK)),
        F.when(F.array_contains(controls, "log_access"), F.lit(K.GUIDANCE_LOG)),
        F.when(F.size(sensitive) > 0, F.concat(F.lit(K.GUIDANCE_AVOID), F.array_join(sensitive, ", "))),
        F.lit(K.GUIDANCE_JUSTIFY),
        F.lit(K.GUIDANCE_CONTACT),
    ))
    return F.array_join(lines, "\n")


def decide(requests: DataFrame, human: DataFrame) -> DataFrame:
    """One final decision per request.

    A reused decision comes first, then a vague intent, then (uncertain policies or failed
    checks) the human decision or ESCALATED, else the verdict. ``human``: query_id,
    human_decision, human_reasoning; of several answers to a request, BLOCK wins.
    """
    answered = human.groupBy("query_id").agg(F.max(F.struct("human_decision", "human_reasoning")).alias("h")).select(
        "query_id", "h.*")
    joined = requests.join(answered, "query_id", "left")
    reused = F.col("cached_decision").isNotNull()
    vague = F.col("intent") == "VAGUE"
    doubtful = (F.col("policy_status") == "UNCERTAIN") | ~F.col("checks_passed")
    v = F.col("verdict")
    controls = F.concat(F.lit("Applied controls: "), F.array_join(v["required_controls"], ", "))
    verdict_guidance = F.when(
        v["decision"] == "APPROVE", F.when(F.size(v["required_controls"]) > 0, controls)
    ).otherwise(block_guidance(v["required_controls"], v["sensitive_columns"]))
    return joined.withColumns({
        "final_decision": F.when(reused, F.col("cached_decision"))
        .when(vague, "CLARIFICATION_REQUIRED")
        .when(doubtful, F.coalesce("human_decision", F.lit("ESCALATED")))
        .otherwise(v["decision"]),
        "block_reason": F.when(reused, F.col("cached_reason"))
        .when(vague, F.concat(
            F.lit("Query is too vague to evaluate. Missing: "), F.array_join("missing", ", ")
        ))
        .when(doubtful, F.when(F.col("human_decision") == "BLOCK", F.coalesce("human_reasoning", F.lit("Human review"))))
        .otherwise(F.when(v["decision"] == "BLOCK", v["reasoning"])),
        "guidance": F.when(reused, F.col("cached_guidance"))
        .when(vague, F.col("clarification"))
        .when(doubtful, F.lit(None).cast("string"))
        .otherwise(verdict_guidance),
    }).drop("human_decision", "human_reasoning")


def escalations(decided: DataFrame) -> DataFrame:
    """Review queue: requests that wait for a person, with what the reviewer needs."""
    return decided.where(F.col("final_decision") == "ESCALATED").select(
        "query_id", "query", "user_id", "user_role", "stated_purpose",
        F.col("verdict.decision").alias("preliminary_decision"),
        F.map_keys(F.map_filter("checks", lambda _, ok: ~ok)).alias("failed_checks"),
        "policy_confidence", "policy_ids",
    )


def run_governed(spark, query: str, decision: str, cap: int | None = None) -> tuple[DataFrame, bool] | None:
    """(rows, truncated) of an approved SELECT or WITH text; None when it may not run."""
    head = query.lstrip(K.EDGE_SPACE).split(None, 1)[:1]
    if decision != "APPROVE" or not head or head[0].upper() not in ("SELECT", "WITH"):
        return None
    return capped_result(spark.sql(query.rstrip().rstrip(";")), cap)


def capped_result(rows: DataFrame, cap: int | None = None) -> tuple[DataFrame, bool]:
    """The rows and whether some are left out: all of them, or the first ``cap`` where the caller sets a cap.

    With a cap the text runs once, for one row more than asked.
    """
    if cap is None:
        return rows, False
    kept = cut_lineage(rows.limit(cap + 1))
    return kept.limit(cap), kept.count() > cap
