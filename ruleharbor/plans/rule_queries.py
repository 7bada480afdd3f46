"""Registered queries: preparing the rule catalogue. Raw rules are derived from events, one per row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleharbor.functions import fixed_values as K
from ruleharbor.functions.text import high_confidence_rules
from ruleharbor.operators import report
from ruleharbor.operators import rules as R
from ruleharbor.plans import fixtures as X

# --- inputs ---------------------------------------------------------------------------------


def raw_rules(spark, sf_dir):
    flat = X.derived(spark, sf_dir, X.RAW_RULES_SQL)
    logic = F.struct(*[F.col(f"logic_{p}").alias(p) for p in ("field", "operator", "value")])
    return flat.withColumn("logic", logic).drop("logic_field", "logic_operator", "logic_value")


def structured(spark, sf_dir):
    ready, _ = R.split_scannable(R.dedup_rules(raw_rules(spark, sf_dir), ("position",)))
    return R.structure_rules(ready, X.catalog(spark, sf_dir))


def decisions(spark, sf_dir):
    flat = X.derived(spark, sf_dir, X.RULE_DECISIONS_SQL)
    return flat.withColumn("changes", F.create_map(F.lit("value"), "new_value")).drop("new_value")


RULE_OUT = ("rule_id", "target_column", "operator", "value", "data_type", "rule_complexity", "second_column", "confidence")

# --- checking SQL shared by several queries -----------------------------------------------------

_SQL_LIST = lambda words: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"
_ALIASES = "(VALUES " + ", ".join(
    f"('{w}', '{op}')" for op, words in K.OPERATOR_SPELLINGS.items() for w in words
) + ") AS a(word, canonical)"
_COLUMNS_SQL = f"""
SELECT lower(column_name) AS known, min(column_name) AS known_name, min(data_type) AS known_type
FROM information_schema.columns WHERE table_name IN {_SQL_LIST(X.KEYS)} GROUP BY 1
"""
_FIRST_SQL = "SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY position) = 1"
_OPS_SQL = "SELECT first.*, coalesce(canonical, upper(trim(logic_operator))) AS op FROM first LEFT JOIN " \
    + _ALIASES + " ON upper(trim(logic_operator)) = word"
_REASON = (
    "CASE WHEN coalesce(logic_field, '') = '' OR coalesce(logic_operator, '') = '' THEN 'no scannable logic' "
    "WHEN lower(logic_field) LIKE '% and %' OR trim(logic_field) = '*' THEN 'multi-column field' "
    "WHEN op IN ('EXISTS', 'SKIP', '') THEN 'unscannable operator' END"
)
_VALUED_SQL = f"""
SELECT *, trim(logic_field) AS col,
       CASE WHEN logic_value NOT IN ('null', 'NULL', '') THEN logic_value END AS val
FROM ops WHERE {_REASON} IS NULL
"""
_NUMERIC_NAME = " OR ".join(f"contains(lower(col), '{w}')" for w in K.NUMERIC_NAME_PARTS)
_COMPARE = "(op IN ('=', '!=', '>', '<', '>=', '<=') AND val IS NOT NULL)"
_STRUCTURED_SQL = f"""
SELECT rule_id, rule_text, rule_type, col AS target_column,
       CASE WHEN op IN ('IS NOT NULL', 'IS NULL') THEN 'IS NULL'
            WHEN op IN ('CONTAINS', 'STARTS_WITH', 'ENDS_WITH') THEN 'LIKE' ELSE op END AS operator,
       CASE WHEN op = 'BETWEEN' THEN trim(replace(regexp_replace(val, '\\bAND\\b', ',', 'gi'), ' - ', ','))
            WHEN op = 'CONTAINS' THEN CASE WHEN val IS NULL THEN '%' ELSE '%' || val || '%' END
            WHEN op = 'STARTS_WITH' THEN coalesce(val, '') || '%'
            WHEN op = 'ENDS_WITH' THEN '%' || coalesce(val, '') ELSE val END AS value,
       CASE WHEN t.known IS NULL THEN CASE WHEN {_NUMERIC_NAME} THEN 'number' ELSE 'string' END
            WHEN t.known_type IN ('INTEGER', 'BIGINT', 'DOUBLE', 'FLOAT') THEN 'number' ELSE 'string' END AS data_type,
       CASE WHEN op = 'BETWEEN' THEN 'between' WHEN op IN {_SQL_LIST(K.REGEX_OPERATORS)} THEN 'regex'
            WHEN {_COMPARE} AND v.known IS NOT NULL AND v.known <> lower(col) THEN 'cross_field'
            WHEN {_COMPARE} AND regexp_matches(val, '(?i)\\b({'|'.join(K.DATE_TOKENS)})\\b') THEN 'date_math'
            ELSE 'simple' END AS rule_complexity,
       CASE WHEN {_COMPARE} AND v.known IS NOT NULL AND v.known <> lower(col) THEN v.known_name END AS second_column,
       confidence
FROM valued LEFT JOIN cols v ON lower(trim(val)) = v.known LEFT JOIN cols t ON lower(col) = t.known
"""
_BASE = {"raw": X.RAW_RULES_SQL, "first": _FIRST_SQL, "ops": _OPS_SQL}
_FULL = {**_BASE, "cols": _COLUMNS_SQL, "valued": _VALUED_SQL, "structured": _STRUCTURED_SQL}
_OUT = ", ".join(RULE_OUT)
_REVIEWED_SQL = """
SELECT rule_id, bool_or(verdict = 'dropped') AS dropped, bool_or(verdict = 'approved') AS approved,
       arg_max(new_value, decided_at) FILTER (WHERE verdict = 'edited') AS new_value,
       max(decided_at) FILTER (WHERE verdict = 'edited') AS edited_at
FROM decisions GROUP BY rule_id
"""

# --- queries --------------------------------------------------------------------------------


def rules_clean(spark, sf_dir):
    out = R.clean_placeholders(raw_rules(spark, sf_dir))
    return out.select(
        "position", *K.PLACEHOLDER_FIELDS,
        *[F.col(f"logic.{p}").alias(f"logic_{p}") for p in ("field", "operator", "value")],
    )


def rules_valid(spark, sf_dir):
    out = R.validate_rules(raw_rules(spark, sf_dir))
    return out.select("position", "rule_type", F.round("confidence", 9).alias("confidence"))


def rules_dedup(spark, sf_dir):
    out = R.dedup_rules(raw_rules(spark, sf_dir), ("position",))
    return out.select("rule_id", "position", "doc_id")


def rules_rejected(spark, sf_dir):
    _, rejects = R.split_scannable(R.dedup_rules(raw_rules(spark, sf_dir), ("position",)))
    return rejects.select("rule_id", "reason")


def op_normalise(spark, sf_dir):
    raw = raw_rules(spark, sf_dir)
    return raw.select("position", R.normalise_operator(F.col("logic.operator")).alias("operator"))


def rule_complexity(spark, sf_dir):
    return structured(spark, sf_dir).select(*RULE_OUT)


def rule_dtype(spark, sf_dir):
    """Type of every raw rule by its field's name; rules without a field get the default."""
    raw = raw_rules(spark, sf_dir)
    return raw.select("position", R.name_data_type(F.col("logic.field")).alias("data_type"))


def rule_routing(spark, sf_dir):
    ready, review = R.route_by_confidence(structured(spark, sf_dir))
    tag = lambda df, route: df.select("rule_id", F.lit(route).alias("route"))
    return tag(ready, "structured").unionByName(tag(review, "low_confidence"))


def review_merge(spark, sf_dir):
    _, review = R.route_by_confidence(structured(spark, sf_dir))
    return R.merge_review(review, decisions(spark, sf_dir)).select("rule_id", "target_column", "operator", "value")


def rule_corrections(spark, sf_dir):
    _, review = R.route_by_confidence(structured(spark, sf_dir))
    out = R.rule_corrections(review, decisions(spark, sf_dir))
    return out.select(
        "rule_id", F.col("original")["value"].alias("original_value"), F.col("corrected")["value"].alias("corrected_value"),
        F.date_format("corrected_at", "yyyy-MM-dd HH:mm:ss").alias("corrected_at"),
    )


_JSON_RULES_SQL = f"""
SELECT event_id AS position,
       '{{"rule_id": "J' || CAST(event_id AS STRING) || '", "rule_type": "'
       || {X.pick('event_id', ('data_retention', 'DATA_Quality', 'privacy', 'custom'))} || '"'
       || CASE WHEN event_id % 2 = 0 THEN ', "target_column": "' ELSE ', "field": "' END || event_type || '"'
       || {X.pick('event_id', (', "value": ""', ', "value": "7"', ', "value": null'))}
       || {X.pick('event_id', ('', ', "confidence": 0.5', ', "requires_pii": true', ', "operator": ">"',
                               ', "source_reference": "page 1"'))} || '}}' AS text
FROM events
"""


def rules_from_json(spark, sf_dir):
    out = R.rules_from_json(X.derived(spark, sf_dir, _JSON_RULES_SQL))
    return out.select("rule_id", "source", "rule_type", "target_column", "operator", "value", "data_type",
                      "requires_pii", "confidence", "rule_complexity")


def rule_dtype_infer(spark, sf_dir):
    raw = raw_rules(spark, sf_dir)
    return raw.select("position", R.infer_data_type(F.col("logic.operator"), F.col("logic.value")).alias("data_type"))


def rules_unknown_col(spark, sf_dir):
    return R.unknown_columns(structured(spark, sf_dir), X.catalog(spark, sf_dir)).select("rule_id", "target_column")


def rule_targets(spark, sf_dir):
    named = F.when(F.length("rule_id") % 2 == 0, F.array(F.lit("orders"), F.lit("absent"), F.lit("part")))
    rules = structured(spark, sf_dir).withColumns({
        "applies_to_tables": named, "requires_pii": F.col("rule_complexity") == "simple",
    })
    return R.rule_targets(rules, X.catalog(spark, sf_dir))


_EXTRACTIONS_SQL = f"""
SELECT event_id,
       {X.pick('event_id', (
           '{"document_type": "requirement", "entities": {"roles": ["admin", "dpo"], "time": "90 days"}, "key_definitions": [{"term": "pd", "definition": "personal data"}]}',
           '{"document_type": "", "entities": [], "key_definitions": {"term": "x"}}',
           '{"document_type": 5, "entities": {"a": []}, "key_definitions": []}',
           '{"entities": null}',
           '{"document_type": null, "entities": "none", "key_definitions": [{"term": "a", "definition": "b"}, {"term": "c", "definition": "d"}]}',
           '{"entities": {"document_type": "nested", "n": [1, "x", null]}, "key_definitions": [{"term": "a"}, 5]}',
           'no JSON at all, but "document_type": "requirement"',
       ))} AS text, event_type
FROM events
"""
_EXTRACTION_ROWS = (("requirement", "roles=admin+dpo;time=90 days", 1), ("informational", "", 0), ("informational", "a=", 0),
                    ("informational", "", 0), ("informational", "", 2), ("informational", "document_type=nested;n=1+x", 2),
                    ("informational", "", 0))


def extraction_coerce(spark, sf_dir):
    out = X.derived(spark, sf_dir, _EXTRACTIONS_SQL).withColumn("x", R.coerce_extraction(F.col("text")))
    entities = F.transform(
        F.array_sort(F.map_entries("x.entities")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "+"))
    )
    return out.select(
        "event_id", "x.document_type", F.array_join(entities, ";").alias("entities"),
        F.size("x.key_definitions").alias("definitions"),
    )


def chunk_high_conf(spark, sf_dir):
    """Confident rules of a chunk; each row carries the three rules found in it."""
    found = [F.struct(F.lit(i).alias("rule"), (F.col("value") / 50 - i / 4).alias("confidence")) for i in range(3)]
    chunks = X.table(spark, sf_dir, "events").select("event_id", F.array(*found).alias("rules"))
    kept = F.transform(high_confidence_rules(F.col("rules")), lambda r: r["rule"].cast("string"))
    return chunks.select("event_id", F.array_join(kept, ",").alias("kept"))


def review_counts(spark, sf_dir):
    return report.review_counts(decisions(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        rules_clean, extraction_coerce, rules_valid, rules_dedup, rules_rejected, op_normalise, rule_complexity, rule_dtype,
        rule_routing, review_merge, rule_corrections, rules_from_json, rule_dtype_infer, rules_unknown_col,
        rule_targets, chunk_high_conf, review_counts,
    )
}

_PLACEHOLDERS = _SQL_LIST(K.PLACEHOLDERS)
_PII = " OR ".join(
    [f"lower(column_name) IN {_SQL_LIST(K.PII_NAMES)}"] + [f"contains(lower(column_name), '{p}')" for p in K.PII_NAME_PARTS]
)
_CATALOG_SQL = (
    f"SELECT table_name, column_name, {_PII} AS pii FROM information_schema.columns WHERE table_name IN {_SQL_LIST(X.KEYS)}"
)
ORACLE = {
    "rules_clean": X.with_cte(
        "SELECT position, "
        + ", ".join(f"CASE WHEN {c} NOT IN {_PLACEHOLDERS} THEN {c} END AS {c}" for c in K.PLACEHOLDER_FIELDS)
        + ", " + ", ".join(f"coalesce(logic_{p}, '') AS logic_{p}" for p in ("field", "operator", "value")) + " FROM raw",
        raw=X.RAW_RULES_SQL),
    "extraction_coerce": X.with_cte(
        "SELECT event_id, " + ", ".join(
            f"CASE event_id % {len(_EXTRACTION_ROWS)} {' '.join(f'WHEN {i} THEN ' + (str(r[n]) if n == 2 else repr(r[n])) for i, r in enumerate(_EXTRACTION_ROWS))} END AS {c}"
            for n, c in enumerate(("document_type", "entities", "definitions"))) + " FROM events"
        , raw=X.RAW_RULES_SQL),
    "rules_valid": X.with_cte(
        f"SELECT position, rule_type, round(greatest(0.0, least(1.0, confidence)), 9) AS confidence FROM raw "
        f"WHERE rule_type IN {_SQL_LIST(K.RULE_TYPES)} AND trim(rule_text) <> ''", raw=X.RAW_RULES_SQL),
    "rules_dedup": X.with_cte("SELECT rule_id, position, doc_id FROM first", raw=X.RAW_RULES_SQL, first=_FIRST_SQL),
    "rules_rejected": X.with_cte(
        f"SELECT rule_id, {_REASON} AS reason FROM ops WHERE {_REASON} IS NOT NULL", **_BASE),
    "op_normalise": X.with_cte(
        "SELECT position, coalesce(canonical, upper(trim(logic_operator))) AS operator FROM raw LEFT JOIN "
        + _ALIASES + " ON upper(trim(logic_operator)) = word", raw=X.RAW_RULES_SQL),
    "rule_complexity": X.with_cte(f"SELECT {_OUT} FROM structured", **_FULL),
    "rule_dtype": X.with_cte(
        f"SELECT position, CASE WHEN {_NUMERIC_NAME} THEN 'number' ELSE 'string' END AS data_type "
        "FROM (SELECT position, logic_field AS col FROM raw)", raw=X.RAW_RULES_SQL),
    "rule_routing": X.with_cte(
        "SELECT rule_id, CASE WHEN confidence >= 0.7 THEN 'structured' ELSE 'low_confidence' END AS route FROM structured",
        **_FULL),
    "review_merge": X.with_cte(
        "SELECT s.rule_id, target_column, operator, coalesce(new_value, value) AS value FROM structured s "
        "JOIN reviewed USING (rule_id) WHERE confidence < 0.7 AND NOT dropped AND (new_value IS NOT NULL OR approved)",
        **_FULL, decisions=X.RULE_DECISIONS_SQL, reviewed=_REVIEWED_SQL),
    "rule_corrections": X.with_cte(
        "SELECT s.rule_id, value AS original_value, new_value AS corrected_value, "
        "strftime(edited_at, '%Y-%m-%d %H:%M:%S') AS corrected_at FROM structured s JOIN reviewed USING (rule_id) "
        "WHERE confidence < 0.7 AND new_value IS NOT NULL",
        **_FULL, decisions=X.RULE_DECISIONS_SQL, reviewed=_REVIEWED_SQL),
    "rules_from_json": X.with_cte(
        "SELECT text->>'rule_id' AS rule_id, coalesce(text->>'source', text->>'source_reference', '') AS source, "
        "CASE text->>'rule_type' WHEN 'data_retention' THEN 'retention' WHEN 'DATA_Quality' THEN 'quality' "
        "ELSE text->>'rule_type' END AS rule_type, coalesce(text->>'target_column', text->>'field', '') AS target_column, "
        "coalesce(text->>'operator', '=') AS operator, nullif(text->>'value', '') AS value, 'string' AS data_type, "
        "coalesce(CAST(text->>'requires_pii' AS BOOLEAN), false) AS requires_pii, "
        "coalesce(CAST(text->>'confidence' AS DOUBLE), 1.0) AS confidence, 'simple' AS rule_complexity FROM j",
        j=_JSON_RULES_SQL),
    "rule_dtype_infer": X.with_cte(
        "SELECT position, CASE WHEN contains(v, 'NOW()') OR contains(v, 'INTERVAL') OR contains(v, 'DAY') THEN 'datetime' "
        "WHEN contains(upper(o), 'LIKE') THEN 'string' "
        "WHEN try_cast(coalesce(nullif(logic_value, ''), '0') AS DOUBLE) IS NOT NULL THEN 'number' ELSE 'string' END "
        "AS data_type FROM (SELECT position, logic_value, upper(coalesce(logic_value, '')) AS v, logic_operator AS o FROM raw)",
        raw=X.RAW_RULES_SQL),
    "rules_unknown_col": X.with_cte(
        "SELECT rule_id, target_column FROM structured WHERE target_column NOT IN (SELECT column_name FROM cat)",
        **_FULL, cat=_CATALOG_SQL),
    "rule_targets": X.with_cte(
        "SELECT rule_id, t AS table_name FROM structured, (VALUES ('orders'), ('part')) AS named(t) "
        "WHERE length(rule_id) % 2 = 0 UNION ALL "
        "SELECT rule_id, cat.table_name FROM structured JOIN cat ON target_column = column_name "
        "JOIN tabs ON cat.table_name = tabs.table_name WHERE length(rule_id) % 2 = 1 AND (rule_complexity <> 'simple' OR has_pii)",
        **_FULL, cat=_CATALOG_SQL, tabs="SELECT table_name, bool_or(pii) AS has_pii FROM cat GROUP BY 1"),
    "chunk_high_conf": (
        "SELECT event_id, concat_ws(',', CASE WHEN value / 50 >= 0.8 THEN '0' END, "
        "CASE WHEN value / 50 - 0.25 >= 0.8 THEN '1' END, CASE WHEN value / 50 - 0.5 >= 0.8 THEN '2' END) AS kept FROM events"),
    "review_counts": X.with_cte(
        "SELECT count(*) FILTER (WHERE verdict = 'approved') AS approved, count(*) FILTER (WHERE verdict = 'dropped') "
        "AS dropped FROM d", d=X.RULE_DECISIONS_SQL),
}
