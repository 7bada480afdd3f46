"""Inputs of the registered queries, all derived from the given tables.

The SQL texts below run unchanged on Spark and on the checking engine, so both sides start
from the same input rows. They hold no tested operator.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ruleharbor.operators.predicates import Rule
from ruleharbor.operators.scan import Source
from ruleharbor.sources.tables import TableSpec, read_table, schema_catalog

AS_OF = datetime(2001, 12, 31)
SCAN_ID = "scan_check"

KEYS: dict[str, tuple[str, ...]] = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey",),
    "customer": ("c_custkey",),
    "supplier": ("s_suppkey",),
    "part": ("p_partkey",),
    "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
    "events": ("event_id",),
    "documents": ("doc_id",),
    "embeddings": ("vec_id",),
    "pages": ("page_id",),
    "benchmark": ("item_id",),
    "labels": ("doc_id",),
    "conversations": ("conv_id", "turn"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, TableSpec(name, f"{sf_dir}/{name}.parquet", KEYS[name]))


def sources(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, Source]:
    return {n: Source(table(spark, sf_dir, n), KEYS[n]) for n in names or KEYS}


_SCHEMAS: dict[tuple[str, str], DataFrame] = {}


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue of the given tables; their schemas are read once per session."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _SCHEMAS:
        _SCHEMAS[at] = schema_catalog(spark, {n: table(spark, sf_dir, n) for n in KEYS}, KEYS)
    return _SCHEMAS[at]


# --- rules ------------------------------------------------------------------------------


def _rule(rule_id, table_name, column, operator, value, **more) -> Rule:
    return Rule(
        rule_id, more.pop("text", f"{rule_id} on {table_name}.{column}"), column, operator, value,
        source="policy", applies_to_tables=(table_name,), **more,
    )


RULES: tuple[Rule, ...] = (
    _rule("AMT-001", "orders", "o_totalprice", ">", "10000", data_type="number", confidence=0.8),
    _rule("AMT-003", "orders", "o_totalprice", "<", "2000", data_type="number", confidence=0.65),
    _rule("AMT-004", "lineitem", "l_extendedprice", ">", "100000", data_type="number", confidence=0.75),
    _rule("BAL-001", "supplier", "s_acctbal", "<", "0", data_type="number", confidence=0.9,
          rule_type="data_security"),
    _rule("FMT-002", "orders", "o_orderpriority", "=", "1-URGENT", confidence=0.6, rule_type="data_access"),
    _rule("LIK-001", "customer", "c_name", "NOT LIKE", "customer#%", confidence=0.95),
    _rule("SEG-001", "customer", "c_mktsegment", "NOT IN", "['BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']",
          confidence=0.7, rule_type="data_privacy"),
    _rule("EVT-001", "events", "event_type", "IN", "error", confidence=0.84, rule_type="data_security"),
    _rule("NUL-001", "orders", "o_custkey", "IS NULL", None, confidence=1.0),
    _rule("BTW-001", "lineitem", "l_quantity", "BETWEEN", "2,49", data_type="number", confidence=0.66,
          rule_complexity="between"),
    _rule("RGX-001", "part", "p_brand", "REGEX", "^Brand#[0-9]$", confidence=0.8, rule_complexity="regex",
          rule_type="data_privacy"),
    _rule("XF-001", "lineitem", "l_discount", "<=", "l_tax", confidence=0.55, rule_complexity="cross_field",
          second_column="l_tax"),
    _rule("DTM-001", "orders", "o_orderdate", "<", "NOW() - INTERVAL 2000 DAYS", data_type="datetime",
          confidence=0.9, rule_complexity="date_math", rule_type="data_retention"),
)
# Aimed at tables where they cannot run.
UNSCANNABLE: tuple[Rule, ...] = (
    Rule("BAD-001", "column that is in no table", "no_such_column", "=", "1"),
    _rule("BAD-002", "orders", "o_orderkey", "EXISTS", None),
)
SCAN_TABLES = ("orders", "lineitem", "supplier", "customer", "events", "part")

RULES_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{r.rule_id}', '{r.rule_text}', '{r.source}', '{r.rule_type}', '{r.target_column}', "
    f"CAST({r.confidence} AS DOUBLE))"
    for r in RULES
) + ") AS t(rule_id, rule_text, source, rule_type, target_column, confidence)"


# --- derived from events --------------------------------------------------------------------


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\\", "' || chr(92) || '") + "'"


def pick(number: str, items: tuple[str | None, ...]) -> str:
    """SQL text choosing one of ``items`` by a whole number, in turn."""
    cases = " ".join(
        f"WHEN {i} THEN " + ("NULL" if item is None else _quoted(item))
        for i, item in enumerate(items)
    )
    return f"CASE CAST({number} % {len(items)} AS INT) {cases} END"


ROLES = ("analyst", "compliance_officer", "intern", "viewer", "marketing")

QUERY_LOG_SQL = f"""
SELECT event_id AS query_id, ts, 'u' || CAST(user_id AS STRING) AS user_id,
       {pick('user_id', ROLES)} AS user_role,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'quarterly fraud review' END AS stated_purpose,
       's' || CAST(user_id AS STRING) AS session_id,
       CASE event_id % 6
         WHEN 0 THEN 'SELECT * FROM customer'
         WHEN 1 THEN 'SELECT COUNT(*) FROM orders GROUP BY o_orderstatus;'
         WHEN 2 THEN 'select c_name, c_acctbal from customer where c_custkey = ' || CAST(event_id % 50 AS STRING)
         WHEN 3 THEN 'SELECT o.o_orderkey,  l.l_quantity FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey'
         WHEN 4 THEN 'SELECT s_name FROM Supplier WHERE s_acctbal > ' || CAST(CAST(floor(value) AS BIGINT) AS STRING)
         ELSE 'UPDATE part SET p_size = 1'
       END AS query,
       CAST(floor(value) AS BIGINT) AS vec_ref
FROM events
"""

# Every request was decided when it came in; the decision answers later ones.
DECISIONS_SQL = """
SELECT event_id AS entry_id, ts AS created_at,
       CASE WHEN event_type IN ('error', 'signup') THEN 'BLOCK' ELSE 'APPROVE' END AS decision,
       CASE WHEN event_id % 2 = 0 THEN 21600 ELSE 3600 END AS ttl_seconds
FROM events
"""

REPLIES_SQL = f"""
SELECT event_id AS reply_id,
       CASE WHEN event_id % 7 = 0 THEN '```json\n{{"decision": "APPROVE", "reasoning": oops'
            ELSE '```json\n{{"decision": "' || {pick('event_id', ('approve', 'BLOCK', ' Approve ', 'maybe', 'block'))}
                 || '", "reasoning": "because of ' || event_type
                 || '", "cited_policies": ["p' || CAST(event_id % 10 AS STRING) || '"], "sensitive_columns": ["'
                 || {pick('event_id', ('c_name', 'c_acctbal', 'ghost'))}
                 || '"], "required_controls": ["' || {pick('event_id', ('mask_pii', 'log_access'))} || '"]'
                 || CASE WHEN event_id % 4 = 0 THEN '' ELSE ', "confidence": 0.' || CAST(event_id % 9 + 1 AS STRING) END
                 || '}}\n```'
       END AS text
FROM events
"""

RAW_RULES_SQL = f"""
SELECT 'R' || CAST(CASE WHEN event_id % 5 = 4 THEN event_id - 1 ELSE event_id END AS STRING) AS rule_id,
       event_id AS position, user_id AS doc_id, CAST(event_id % 17 AS INT) AS chunk_index,
       {pick('event_id', ('data_retention', 'data_access', 'data_quality', 'data_security', 'data_privacy', 'other'))}
         AS rule_type,
       CASE WHEN event_id % 11 = 0 THEN '  ' ELSE 'Every ' || event_type || ' must keep rule ' || CAST(event_id AS STRING) END
         AS rule_text,
       {pick('event_id', ('unknown', 'balance is negative', 'none'))} AS condition,
       {pick('event_id', ('reject', 'n/a', 'None', 'mask'))} AS action,
       {pick('event_id', ('all users', '', 'null', 'unknown ', None))} AS scope,
       {pick('event_id', ('fine', 'null'))} AS penalty,
       {pick('event_id', ('90 days', 'n/a', 'NULL'))} AS timeframe,
       value / 100.0 - 0.1 AS confidence,
       {pick('event_id', ('section 1', 'unknown', 'none', 'page 2'))} AS source_reference,
       {pick('event_id', ('o_totalprice', ' l_discount ', 'c_name', 'p_brand', 'o_orderdate', 's_acctbal', 'a and b', '*',
                          'L_QUANTITY', 'missing_amount', None))} AS logic_field,
       {pick('event_id', ('greater than', 'EQUALS', ' gte ', 'NOT NULL', 'between', 'matches', 'contains', 'exists',
                          'Starts With', 'missing', 'in list', '=', 'ends with', 'lt', None, '<>', 'FROBNICATE'))}
         AS logic_operator,
       {pick('event_id', ('100', '1000 AND 5000', '10 - 20', '^A', 'L_TAX', 'NOW() - INTERVAL 90 DAYS', 'null', '',
                          'Unknown', ' o_totalprice', 'CURRENT_DATE', '1000-10000', 'x,y'))} AS logic_value
FROM events
"""

RULE_DECISIONS_SQL = f"""
SELECT 'R' || CAST(event_id AS STRING) AS rule_id, ts AS decided_at,
       {pick('event_id', ('approved', 'edited', 'dropped', 'approved', 'edited'))} AS verdict,
       event_type AS new_value
FROM events WHERE event_type <> 'error'
"""

USAGE_SQL = """
SELECT conv_id, turn,
       CASE WHEN role = 'assistant' THEN 0 ELSE length(text) END AS prompt_tokens,
       CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END AS completion_tokens,
       length(text) AS total_tokens
FROM conversations
"""


CELLS_SQL = f"""
SELECT event_id,
       CASE CAST(event_id % 7 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'n/a'
         WHEN 2 THEN '1,' || CAST(CAST(floor(value) AS BIGINT) + 100 AS STRING)
         WHEN 3 THEN ' ' || CAST(CAST(floor(value) AS BIGINT) AS STRING) || ' '
         ELSE CAST(CAST(floor(value) AS BIGINT) AS STRING) END AS amount_text,
       CASE CAST(event_id % 5 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'n/a'
         ELSE CAST(user_id AS STRING) END AS limit_text,
       CASE CAST(event_id % 8 AS INT)
         WHEN 0 THEN '2020-' || CAST(event_id % 12 + 1 AS STRING) || '-' || CAST(event_id % 28 + 1 AS STRING)
         WHEN 1 THEN CAST(event_id % 28 + 1 AS STRING) || '/' || CAST(event_id % 12 + 1 AS STRING) || '/2021'
         WHEN 2 THEN '2020-06-' || CAST(event_id % 20 + 10 AS STRING) || ' 10:20:30'
         WHEN 3 THEN '2020-06-' || CAST(event_id % 20 + 10 AS STRING) || 'T23:59:59'
         WHEN 4 THEN '2020-13-45'
         WHEN 5 THEN CAST(event_id % 12 + 1 AS STRING) || '/' || CAST(event_id % 16 + 13 AS STRING) || '/2019'
         WHEN 6 THEN 'soon' ELSE NULL END AS day_text,
       {pick('event_id', ('Cash', 'bitcoin', 'BITCOIN', "it's", 'a_b', 'a%b', 'a' + chr(92) + 'b', None, 'Wire'))} AS pay_text,
       event_type, value
FROM events
"""


def derived(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """A shared SQL text over the given tables."""
    for n in names or ("events",):
        sql = sql.replace(f"FROM {n}", f"FROM parquet.`{sf_dir}/{n}.parquet`")
    return spark.sql(sql)


def with_cte(body: str, **ctes: str) -> str:
    """Checking SQL: named inputs, then the query."""
    return "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in ctes.items()) + " " + body
