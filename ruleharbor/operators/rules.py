"""Preparing a catalogue of extracted rules: cleaning, structuring, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleharbor.functions import fixed_values as K
from ruleharbor.functions.expr import let
from ruleharbor.functions.ordering import first_row, top_rows
from ruleharbor.functions.pii import contains_any, is_pii
from ruleharbor.functions.values import NUMBER_PATTERN

RAW_RULE_SCHEMA = (
    "rule_id string, rule_type string, rule_text string, condition string, action string, scope string, "
    "penalty string, timeframe string, confidence double, source_reference string, "
    "logic struct<field string, operator string, value string>"
)

# --- cleaning and validation -----------------------------------------------------


def clean_placeholders(rules: DataFrame) -> DataFrame:
    """Placeholder words in the descriptive fields become NULL; logic parts become text, never NULL."""
    blank = {c: F.when(~F.col(c).isin(*K.PLACEHOLDERS), F.col(c)) for c in K.PLACEHOLDER_FIELDS}
    parts = [F.coalesce(F.col(f"logic.{p}").cast("string"), F.lit("")).alias(p) for p in ("field", "operator", "value")]
    return rules.withColumns({**blank, "logic": F.when(F.col("logic").isNotNull(), F.struct(*parts))})


def coerce_extraction(text: Column) -> Column:
    """Struct of document_type, entities and key_definitions with wrong shapes repaired.

    ``entities``: an object whose text values become one-item lists, anything else an empty
    map. ``key_definitions``: a list of (term, definition), anything else empty.
    ``document_type``: a non-empty text, otherwise ``informational``. A text that is no JSON has none of them.
    """
    at = lambda v, path, kind: F.try_variant_get(v, path, kind)
    is_a = lambda v, kind: F.schema_of_variant(v).startswith(kind)

    def listed(value: Column) -> Column:
        items = F.transform(at(value, "$", "array<variant>"), lambda x: at(x, "$", "string"))
        return F.when(is_a(value, "ARRAY"), items).otherwise(F.array(at(value, "$", "string")))

    def repaired(whole: Column) -> Column:
        kind, named, defined = (at(whole, f"$.{f}", "variant") for f in ("document_type", "entities", "key_definitions"))
        typed = F.when(is_a(kind, "STRING"), F.nullif(at(kind, "$", "string"), F.lit("")))
        entities = F.when(is_a(named, "OBJECT"), F.transform_values(at(named, "$", "map<string,variant>"), lambda _, v: listed(v)))
        terms = F.when(is_a(defined, "ARRAY"), F.transform(at(defined, "$", "array<variant>"), lambda d: F.struct(
            at(d, "$.term", "string").alias("term"), at(d, "$.definition", "string").alias("definition"))))
        return F.struct(
            F.coalesce(typed, F.lit("informational")).alias("document_type"),
            F.coalesce(entities, F.create_map().cast("map<string,array<string>>")).alias("entities"),
            F.coalesce(terms, F.array().cast("array<struct<term:string,definition:string>>")).alias("key_definitions"),
        )

    return let(F.try_parse_json(text), repaired)


def validate_rules(rules: DataFrame) -> DataFrame:
    """Known rule types with a non-blank text; confidence is clamped to [0, 1]."""
    named = F.col("rule_type").isin(*K.RULE_TYPES)
    worded = F.length(F.btrim(F.col("rule_text"), F.lit(K.EDGE_SPACE))) > 0
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    return rules.where(named & worded).withColumn("confidence", clamped)


def dedup_rules(rules: DataFrame, order: tuple[str, ...] = ("doc_id", "chunk_index", "position")) -> DataFrame:
    """The first rule seen per rule_id."""
    return first_row(rules, ["rule_id"], [F.col(c) for c in order])


# --- structuring ------------------------------------------------------------------


def alias_map() -> Column:
    pairs = [F.lit(x) for op, words in K.OPERATOR_SPELLINGS.items() for w in words for x in (w, op)]
    return F.create_map(*pairs)


def normalise_operator(op: Column) -> Column:
    """Canonical operator for any known spelling; unknown spellings stay, upper case and trimmed."""
    plain = F.btrim(F.upper(op), F.lit(K.EDGE_SPACE))
    return F.coalesce(F.element_at(alias_map(), plain), plain)


def reject_reason(field: Column, op: Column) -> Column:
    """Why a rule cannot be scanned, or NULL. ``op`` is the operator as written."""
    canonical = normalise_operator(op)
    return (
        F.when((F.coalesce(field, F.lit("")) == "") | (F.coalesce(op, F.lit("")) == ""), "no scannable logic")
        .when(F.lower(field).contains(" and ") | (F.btrim(field, F.lit(K.EDGE_SPACE)) == "*"), "multi-column field")
        .when(canonical.isin(*K.UNSCANNABLE_OPERATORS), "unscannable operator")
    )


def split_scannable(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scannable rules, rejects with a reason)."""
    tagged = rules.withColumn("reason", reject_reason(F.col("logic.field"), F.col("logic.operator")))
    return tagged.where("reason IS NULL").drop("reason"), tagged.where("reason IS NOT NULL")


def _has_date_token(value: Column) -> Column:
    return value.rlike(r"(?i)\b(" + "|".join(K.DATE_TOKENS) + r")\b")


def numeric_name(column: Column) -> Column:
    return contains_any(F.lower(column), K.NUMERIC_NAME_PARTS)


def name_data_type(column: Column, catalog_type: Column | None = None) -> Column:
    """``number`` or ``string``: by the catalogue's type when it is known, else by the name."""
    by_name = F.when(numeric_name(column), "number").otherwise("string")
    if catalog_type is None:
        return by_name
    numeric = catalog_type.rlike(r"^(tinyint|smallint|int|bigint|float|double|decimal)")
    return F.when(catalog_type.isNull(), by_name).when(numeric, "number").otherwise("string")


def structure_rules(rules: DataFrame, catalog: DataFrame) -> DataFrame:
    """Scannable raw rules as structured rules.

    Decides the complexity, brings values to the form the predicates read, turns null
    checks into their violating form, expands substring operators to LIKE patterns and
    resolves the second column of a cross-field rule to the catalogue's spelling.
    """
    space = F.lit(K.EDGE_SPACE)
    names = catalog.groupBy(F.lower("column_name").alias("known_lower")).agg(F.min("column_name").alias("known_name"))
    types = catalog.groupBy(F.lower("column_name").alias("typed_lower")).agg(F.min("data_type").alias("known_type"))
    raw_value = F.col("logic.value")
    prepared = rules.withColumns({
        "col": F.btrim(F.col("logic.field"), space),
        "op": normalise_operator(F.col("logic.operator")),
        "val": F.when(~raw_value.isin("null", "NULL", ""), raw_value),
    })
    matched = prepared.join(names, F.lower(F.btrim(F.col("val"), space)) == F.col("known_lower"), "left").join(
        types, F.lower("col") == F.col("typed_lower"), "left"
    )
    comparing = F.col("op").isin(*K.COMPARISONS) & F.col("val").isNotNull()
    other_column = F.col("known_lower").isNotNull() & (F.col("known_lower") != F.lower("col"))
    kind = (
        F.when(F.col("op") == "BETWEEN", "between")
        .when(F.col("op").isin(*K.REGEX_OPERATORS), "regex")
        .when(comparing & other_column, "cross_field")
        .when(comparing & _has_date_token(F.col("val")), "date_math")
        .otherwise("simple")
    )
    text = F.coalesce("val", F.lit(""))
    bounds = F.btrim(
        F.replace(F.regexp_replace("val", r"(?i)\bAND\b", ","), F.lit(" - "), F.lit(",")), space
    )
    value = (
        F.when(F.col("op") == "BETWEEN", bounds)
        .when(F.col("op").isin("CONTAINS", "STARTS_WITH", "ENDS_WITH") & (text == ""), "%")
        .when(F.col("op") == "CONTAINS", F.concat(F.lit("%"), text, F.lit("%")))
        .when(F.col("op") == "STARTS_WITH", F.concat(text, F.lit("%")))
        .when(F.col("op") == "ENDS_WITH", F.concat(F.lit("%"), text))
        .otherwise(F.col("val"))
    )
    operator = (
        F.when(F.col("op").isin("IS NOT NULL", "IS NULL"), "IS NULL")
        .when(F.col("op").isin("CONTAINS", "STARTS_WITH", "ENDS_WITH"), "LIKE")
        .otherwise(F.col("op"))
    )
    return matched.select(
        "rule_id",
        "rule_text",
        F.lit("pdf_extraction").alias("source"),
        "rule_type",
        F.col("col").alias("target_column"),
        operator.alias("operator"),
        value.alias("value"),
        name_data_type(F.col("col"), F.col("known_type")).alias("data_type"),
        F.lit(None).cast("array<string>").alias("applies_to_tables"),
        F.lit(False).alias("requires_pii"),
        "confidence",
        kind.alias("rule_complexity"),
        F.when(kind == "cross_field", F.col("known_name")).alias("second_column"),
    )


def route_by_confidence(rules: DataFrame, floor: float = K.ROUTING_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(ready rules, rules that go to human review); a rule without confidence goes to review."""
    ready = F.coalesce(F.col("confidence") >= floor, F.lit(False))
    return rules.where(ready), rules.where(~ready)


def infer_data_type(operator: Column, value: Column) -> Column:
    """Data type from the logic: date words, LIKE, then whether the value is a number (none counts as 0)."""
    upper = F.upper(F.coalesce(value, F.lit("")))
    dated = contains_any(upper, ("NOW()", "INTERVAL", "DAY"))
    numeric = F.coalesce(F.when(value != "", value), F.lit("0")).rlike(NUMBER_PATTERN)
    return (
        F.when(dated, "datetime")
        .when(F.upper(operator).contains("LIKE"), "string")
        .when(numeric, "number")
        .otherwise("string")
    )


def short_rule_type(rule_type: Column) -> Column:
    """``data_quality`` -> ``quality`` for the known types; anything else as it is."""
    return F.when(F.lower(rule_type).isin(*K.RULE_TYPES), F.substring(F.lower(rule_type), 6, 100)).otherwise(rule_type)


def rules_from_json(records: DataFrame, text_col: str = "text") -> DataFrame:
    """Structured rules from one JSON object per row, with the usual defaults filled in."""
    raw = F.from_json(
        F.col(text_col),
        "rule_id string, rule_text string, source string, source_reference string, rule_type string, "
        "target_column string, field string, operator string, value string, data_type string, "
        "applies_to_tables array<string>, requires_pii boolean, confidence double, rule_complexity string, "
        "second_column string",
    )
    j = records.withColumn("j", raw)
    text = lambda *c: F.coalesce(*[F.col(f"j.{x}") for x in c], F.lit(""))
    return j.select(
        text("rule_id").alias("rule_id"),
        text("rule_text").alias("rule_text"),
        text("source", "source_reference").alias("source"),
        short_rule_type(F.coalesce("j.rule_type", F.lit("quality"))).alias("rule_type"),
        text("target_column", "field").alias("target_column"),
        F.coalesce("j.operator", F.lit("=")).alias("operator"),
        F.when(F.col("j.value") != "", F.col("j.value")).alias("value"),
        F.coalesce("j.data_type", F.lit("string")).alias("data_type"),
        F.col("j.applies_to_tables").alias("applies_to_tables"),
        F.coalesce("j.requires_pii", F.lit(False)).alias("requires_pii"),
        F.coalesce("j.confidence", F.lit(1.0)).alias("confidence"),
        F.coalesce("j.rule_complexity", F.lit("simple")).alias("rule_complexity"),
        F.col("j.second_column").alias("second_column"),
    )


def unknown_columns(rules: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rules whose target column exists in no table."""
    return rules.join(catalog, rules["target_column"] == catalog["column_name"], "left_anti")


def rule_targets(rules: DataFrame, catalog: DataFrame) -> DataFrame:
    """(rule_id, table_name): named tables that exist, else tables with the column (and personal data if asked)."""
    named = F.size("applies_to_tables") > 0
    tables = catalog.groupBy("table_name").agg(F.bool_or(is_pii(F.col("column_name"))).alias("has_pii"))
    explicit = (
        rules.where(named)
        .select("rule_id", F.explode(F.array_distinct("applies_to_tables")).alias("table_name"))
        .join(tables, "table_name", "left_semi")
    )
    by_column = (
        rules.where(~F.coalesce(named, F.lit(False)))
        .join(catalog.select("table_name", "column_name"), F.col("target_column") == F.col("column_name"))
        .join(tables, "table_name")
        .where(~F.col("requires_pii") | F.col("has_pii"))
    )
    return explicit.select("rule_id", "table_name").unionByName(by_column.select("rule_id", "table_name"))


# --- human review --------------------------------------------------------------------

EDITABLE = ("rule_text", "target_column", "operator", "value", "data_type", "rule_type")


def merge_review(low_confidence: DataFrame, decisions: DataFrame) -> DataFrame:
    """Reviewed rules that go on to the scan.

    ``decisions``: rule_id, verdict (approved / edited / dropped), a ``changes`` map and
    decided_at; the latest edit of a rule counts.
    Dropped rules leave, edited rules take the changed fields, approved rules stay and
    unlisted rules leave, unless there is no decision at all: then every rule stays.
    """
    latest = decisions.groupBy("rule_id").agg(
        F.bool_or(F.col("verdict") == "dropped").alias("dropped"),
        F.bool_or(F.col("verdict") == "approved").alias("approved"),
        F.max_by("changes", F.when(F.col("verdict") == "edited", F.col("decided_at"))).alias("changes"),
    )
    if decisions.isEmpty():
        return low_confidence
    joined = low_confidence.join(latest, "rule_id")
    kept = joined.where(~F.col("dropped") & (F.col("changes").isNotNull() | F.col("approved")))
    edits = {c: F.coalesce(F.element_at("changes", F.lit(c)), F.col(c)) for c in EDITABLE}
    return kept.withColumns(edits).select(*low_confidence.columns)


def rule_corrections(low_confidence: DataFrame, decisions: DataFrame) -> DataFrame:
    """Original and corrected values of every edited rule; the latest correction per rule."""
    edits = top_rows(
        decisions.where(F.col("verdict") == "edited"), ["rule_id"], [F.col("decided_at").desc()], 1
    ).select("rule_id", "changes", F.col("decided_at").alias("corrected_at"))
    known = F.array(*[F.lit(c) for c in EDITABLE])
    return low_confidence.join(edits, "rule_id").select(
        "rule_id",
        F.map_filter(
            F.map_from_arrays(known, F.array(*EDITABLE)), lambda k, _: F.map_contains_key("changes", k)
        ).alias("original"),
        F.map_filter("changes", lambda k, _: F.array_contains(known, k)).alias("corrected"),
        "corrected_at",
    )
