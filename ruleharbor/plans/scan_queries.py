"""Registered queries: sources, predicates, scans and the violations log."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleharbor.functions.values import as_timestamp
from ruleharbor.operators import report, scan
from ruleharbor.operators.predicates import Rule, Setting, condition
from ruleharbor.plans import fixtures as X
from ruleharbor.session import shared_folder
from ruleharbor.sources import tables as tbl

# --- fixtures shared with the report queries ---------------------------------------------


def violations(spark: SparkSession, sf_dir: str, payload: bool = False) -> DataFrame:
    return scan.scan(spark, X.sources(spark, sf_dir, *X.SCAN_TABLES), X.RULES, X.AS_OF, X.SCAN_ID, payload).violations


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = X.sources(spark, sf_dir, *X.SCAN_TABLES)
    return scan.count_violations(src, scan.plan_pairs(X.RULES, src, Setting(X.AS_OF)))


VIOLATING_SQL = {
    "AMT-001": ("orders", "o_totalprice > 10000"),
    "AMT-003": ("orders", "o_totalprice < 2000"),
    "AMT-004": ("lineitem", "l_extendedprice > 100000"),
    "BAL-001": ("supplier", "s_acctbal < 0"),
    "FMT-002": ("orders", "o_orderpriority = '1-URGENT'"),
    "LIK-001": ("customer", "c_name NOT ILIKE 'customer#%'"),
    "SEG-001": ("customer", "c_mktsegment NOT IN ('BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')"),
    "EVT-001": ("events", "event_type IN ('error')"),
    "NUL-001": ("orders", "o_custkey IS NULL"),
    "BTW-001": ("lineitem", "l_quantity < 2 OR l_quantity > 49"),
    "RGX-001": ("part", "NOT regexp_matches(p_brand, '^Brand#[0-9]$')"),
    "XF-001": ("lineitem", "NOT (l_discount <= l_tax)"),
    "DTM-001": ("orders", "o_orderdate < TIMESTAMP '2001-12-31' - INTERVAL 2000 DAY"),
}


def _key_sql(table: str) -> str:
    return " || '|' || ".join(f"CAST({k} AS STRING)" for k in X.KEYS[table])


HITS_SQL = " UNION ALL ".join(
    f"SELECT '{rule}' AS rule_id, '{table}' AS table_name, {_key_sql(table)} AS record_primary_key "
    f"FROM {table} WHERE {where}"
    for rule, (table, where) in VIOLATING_SQL.items()
)
LOG_SQL = f"""
SELECT sha256('{X.SCAN_ID}|' || h.rule_id || '|' || table_name || '|' || record_primary_key) AS violation_id,
       '{X.SCAN_ID}' AS scan_id, h.rule_id, r.rule_text, r.source AS rule_source, table_name, record_primary_key,
       r.confidence, r.rule_type AS violation_type, TIMESTAMP '2001-12-31' AS detected_at,
       'pending' AS review_status
FROM (SELECT * FROM hits) h JOIN rules r ON h.rule_id = r.rule_id
"""
LOG_CTES = {"rules": X.RULES_SQL, "hits": HITS_SQL, "log": LOG_SQL}
COUNTS_SQL = " UNION ALL ".join(
    f"SELECT '{rule}' AS rule_id, '{table}' AS table_name, count(*) AS violation_count FROM {table} WHERE {where}"
    for rule, (table, where) in VIOLATING_SQL.items()
)

# --- sources -----------------------------------------------------------------------------

_DUCK_TYPES = {
    "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz",
    "FLOAT[]": "array<float>",
}
_KEYS_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', '{c}')" for t, cols in X.KEYS.items() for c in cols
) + ") AS k(table_name, column_name)"
_CATALOG_SQL = f"""
SELECT c.table_name, c.column_name, CAST(c.ordinal_position AS INT) AS position,
       CASE c.data_type {' '.join(f"WHEN '{d}' THEN '{s}'" for d, s in _DUCK_TYPES.items())} END AS data_type,
       true AS nullable, k.column_name IS NOT NULL AS is_key
FROM information_schema.columns c LEFT JOIN keys k USING (table_name, column_name)
WHERE c.table_name IN ({', '.join(f"'{t}'" for t in X.KEYS)})
"""
_ROW_COUNTS_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in X.KEYS)


def schema_catalog(spark, sf_dir):
    return _with_counts(spark, sf_dir, X.catalog(spark, sf_dir))


def _with_counts(spark, sf_dir, catalog):
    rows = tbl.row_counts({n: X.table(spark, sf_dir, n) for n in X.KEYS})
    return catalog.join(rows, "table_name")


def table_profile(spark, sf_dir):
    rows = tbl.row_counts({n: X.table(spark, sf_dir, n) for n in X.KEYS})
    return tbl.table_profile(X.catalog(spark, sf_dir), rows).withColumn("primary_key", F.array_join("primary_key", ","))


def schema_stats(spark, sf_dir):
    """Counts over the catalogue as if the two tables without a single-column key had none."""
    keys = {t: k for t, k in X.KEYS.items() if len(k) == 1}
    cat = tbl.schema_catalog(spark, {n: X.table(spark, sf_dir, n) for n in X.KEYS}, keys)
    rows = tbl.row_counts({n: X.table(spark, sf_dir, n) for n in X.KEYS})
    stats = tbl.schema_stats(cat, rows)
    return stats.withColumn("tables_without_key", F.array_join("tables_without_key", ","))


# --- predicates ----------------------------------------------------------------------------

_PRED = Setting(datetime(2021, 1, 1))


def _on_cells(*rules: Rule, setting: Setting = _PRED):
    """(rule_id, event_id) of the violating cells, every rule in one pass."""

    def run(spark, sf_dir):
        cells = X.derived(spark, sf_dir, X.CELLS_SQL)
        source = {"cells": scan.Source(cells, ("event_id",))}
        pairs = scan.plan_pairs(rules, source, setting)
        found = scan.hits(source, pairs)
        return found.select("rule_id", F.col("record_primary_key").cast("long").alias("event_id"))

    return run


def _cells_sql(**rules: str) -> str:
    parts = [f"SELECT '{r}' AS rule_id, event_id FROM cells WHERE {where}" for r, where in rules.items()]
    return X.with_cte(" UNION ALL ".join(parts), cells=X.CELLS_SQL)


def _r(rule_id, column, op, value=None, **more):
    return Rule(rule_id, rule_id, column, op, value, **more)


_NUM = "try_cast(replace(amount_text, ',', '') AS DOUBLE)"
_LIM = "try_cast(replace(limit_text, ',', '') AS DOUBLE)"
_DAY = ("try_strptime(trim(day_text), ['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d', '%d/%m/%Y', '%m/%d/%Y'])")

PREDICATES = {
    "pred_null": (
        _on_cells(_r("n1", "amount_text", "IS NULL"), _r("n2", "day_text", "IS NOT NULL")),
        _cells_sql(n1="amount_text IS NULL", n2="day_text IS NOT NULL"),
    ),
    "pred_like": (
        _on_cells(_r("l1", "pay_text", "LIKE", "bit%"), _r("l2", "pay_text", "NOT LIKE", "%A%"),
                  _r("l3", "pay_text", "LIKE", "a\\b")),
        _cells_sql(l1="pay_text ILIKE 'bit%'", l2="pay_text NOT ILIKE '%A%'", l3="pay_text = 'a\\b'"),
    ),
    "pred_like_case": (
        _on_cells(_r("l1", "pay_text", "LIKE", "bit%"), _r("l2", "pay_text", "NOT LIKE", "%A%"),
                  setting=Setting(_PRED.as_of, like_case_sensitive=True)),
        _cells_sql(l1="pay_text LIKE 'bit%'", l2="pay_text NOT LIKE '%A%'"),
    ),
    "pred_regex_op": (
        _on_cells(_r("x1", "pay_text", "~", "^[A-Z]"), _r("x2", "pay_text", "!~", "[%_]")),
        _cells_sql(x1="regexp_matches(pay_text, '^[A-Z]')", x2="NOT regexp_matches(pay_text, '[%_]')"),
    ),
    "pred_in": (
        _on_cells(_r("i1", "pay_text", "IN", "[Cash, 'bitcoin']"), _r("i2", "pay_text", "NOT IN", "Wire, it's"),
                  _r("i3", "event_id", "IN", "1, 02, 300, 4000, x")),
        _cells_sql(i1="pay_text IN ('Cash', 'bitcoin')", i2="pay_text NOT IN ('Wire', 'it''s')",
                   i3="event_id IN (1, 300, 4000)"),
    ),
    "pred_numeric": (
        _on_cells(*[_r(f"c{i}", "amount_text", op, "50", data_type="number")
                    for i, op in enumerate(("=", "!=", ">", "<", ">=", "<="))],
                  _r("c9", "value", ">", "100")),
        _cells_sql(**{f"c{i}": f"{_NUM} {op} 50" for i, op in enumerate(("=", "!=", ">", "<", ">=", "<="))},
                   c9="value > 100"),
    ),
    "pred_string": (
        _on_cells(*[_r(f"s{i}", "event_type", op, "error") for i, op in enumerate(("=", "!=", ">", "<", ">=", "<="))]),
        _cells_sql(**{f"s{i}": f"event_type {op} 'error'" for i, op in enumerate(("=", "!=", ">", "<", ">=", "<="))}),
    ),
    "pred_datetime": (
        _on_cells(_r("d1", "day_text", "<", "datetime('now', '-200 days')", data_type="datetime"),
                  _r("d2", "day_text", ">=", "2021-02-01", data_type="datetime")),
        _cells_sql(d1=f"{_DAY} < TIMESTAMP '2021-01-01' - INTERVAL 200 DAY", d2=f"{_DAY} >= TIMESTAMP '2021-02-01'"),
    ),
    "pred_between": (
        _on_cells(_r("b1", "amount_text", "BETWEEN", "20, 120", rule_complexity="between"),
                  _r("b2", "value", "BETWEEN", "5,200", rule_complexity="between"),
                  _r("b3", "value", "BETWEEN", "1000-10000", rule_complexity="between")),
        _cells_sql(b1=f"NOT ({_NUM} BETWEEN 20 AND 120)", b2="NOT (value BETWEEN 5 AND 200)"),
    ),
    "pred_regex": (
        _on_cells(_r("r1", "pay_text", "REGEX", "^[a-z]", rule_complexity="regex"),
                  _r("r2", "pay_text", "REGEX", "[", rule_complexity="regex")),
        _cells_sql(r1="NOT regexp_matches(pay_text, '^[a-z]')"),
    ),
    "pred_cross_field": (
        _on_cells(*[_r(f"f{i}", "amount_text", op, "limit_text", rule_complexity="cross_field",
                       second_column="LIMIT_TEXT") for i, op in enumerate(("=", "!=", ">", "<="))]),
        _cells_sql(**{
            f"f{i}": f"CASE WHEN {_NUM} IS NOT NULL AND {_LIM} IS NOT NULL THEN NOT ({_NUM} {op} {_LIM}) "
                     f"ELSE NOT (coalesce(amount_text, 'None') {op} coalesce(limit_text, 'None')) END"
            for i, op in enumerate(("=", "!=", ">", "<="))
        }),
    ),
    "pred_date_math": (
        _on_cells(_r("m1", "day_text", "<", "NOW() - INTERVAL 90 DAYS", rule_complexity="date_math"),
                  _r("m2", "day_text", ">", "now() - 6 months", rule_complexity="date_math"),
                  _r("m3", "day_text", ">=", "CURRENT_DATE", rule_complexity="date_math")),
        _cells_sql(m1=f"{_DAY} < TIMESTAMP '2021-01-01' - INTERVAL 90 DAY", m2=f"{_DAY} > TIMESTAMP '2020-07-01'",
                   m3=f"{_DAY} >= TIMESTAMP '2021-01-01'"),
    ),
}


_CARDS_SQL = """
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'no number' WHEN event_id % 13 = 0 THEN NULL
  WHEN event_id % 2 = 0 THEN CAST(4000000000 + event_id * 37 AS STRING)
  ELSE '4111 1111-' || CAST(10000000 + event_id * 7 AS STRING) END AS card
FROM events
"""


def pred_check_digit(spark, sf_dir):
    """Card numbers with a wrong check digit, by a function over Arrow batches inside the scan, beside a plain rule."""
    source = {"cards": scan.Source(X.derived(spark, sf_dir, _CARDS_SQL), ("event_id",))}
    rules = [Rule("CARD", "t", "card", "", rule_complexity="check_digit"), Rule("HYPHEN", "t", "card", "LIKE", "%-%")]
    found = scan.hits(source, scan.plan_pairs(rules, source, Setting(X.AS_OF)))
    return found.select("rule_id", F.col("record_primary_key").cast("long").alias("event_id"))


def date_parse(spark, sf_dir):
    cells = X.derived(spark, sf_dir, X.CELLS_SQL)
    moment = as_timestamp(F.col("day_text"), cells.schema["day_text"].dataType)
    return cells.select("event_id", F.date_format(moment, "yyyy-MM-dd HH:mm:ss").alias("moment"))


# --- scans ---------------------------------------------------------------------------------


def scan_simple(spark, sf_dir):
    rule = next(r for r in X.RULES if r.rule_id == "AMT-001")
    src = X.sources(spark, sf_dir, "orders")
    violates = condition(rule, src["orders"].df.schema, Setting(X.AS_OF))
    return src["orders"].df.where(F.col("o_orderkey").isNotNull() & violates)


def scan_complex(spark, sf_dir):
    src = X.sources(spark, sf_dir, "lineitem")
    rules = [r for r in X.RULES if r.rule_complexity != "simple" and "lineitem" in r.applies_to_tables]
    return scan.hits(src, scan.plan_pairs(rules, src, Setting(X.AS_OF)))


def scan_capped(spark, sf_dir):
    src = X.sources(spark, sf_dir, "orders")["orders"]
    rule = lambda i: next(r for r in X.RULES if r.rule_id == i)
    find = lambda i: condition(rule(i), src.df.schema, Setting(X.AS_OF))
    simple = scan.capped_scan(src, find("AMT-001"), 100, 3, cap_rows=False).withColumn("kind", F.lit("simple"))
    heavy = scan.capped_scan(src, find("DTM-001"), 100, 3, cap_rows=True).withColumn("kind", F.lit("complex"))
    free = scan.capped_scan(src, find("AMT-003"), 100, 0, cap_rows=True).withColumn("kind", F.lit("uncapped"))
    return simple.unionByName(heavy).unionByName(free).select("kind", "o_orderkey")


def scan_all(spark, sf_dir):
    return violations(spark, sf_dir).select(
        "violation_id", "rule_id", "table_name", "record_primary_key", "confidence", "violation_type", "review_status"
    )


def violation_log(spark, sf_dir):
    """Complete log rows; the record payload is compared by two of its fields."""
    orders_rules = [r for r in X.RULES if r.applies_to_tables == ("orders",)]
    found = scan.scan(spark, X.sources(spark, sf_dir, "orders"), orders_rules, X.AS_OF, X.SCAN_ID).violations
    field = lambda f: F.get_json_object("violating_data", f"$.{f}")
    return found.select(
        "violation_id", "scan_id", "rule_id", "rule_text", "rule_source", "table_name", "record_primary_key",
        "confidence", "violation_type", "review_status",
        F.date_format("detected_at", "yyyy-MM-dd").alias("detected_on"),
        field("o_orderkey").cast("long").alias("data_key"),
        field("o_orderstatus").alias("data_status"),
    )


def scan_counters(spark, sf_dir):
    """Counters of a scan, taken by the job that writes its log."""
    path = f"{shared_folder(spark)}/scan-{uuid.uuid4().hex}"
    totals = scan.scan_to_log(
        spark, X.sources(spark, sf_dir, *X.SCAN_TABLES), [*X.RULES, *X.UNSCANNABLE], X.AS_OF, X.SCAN_ID, path, payload=False)
    flat = lambda m: F.array_join(
        F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","
    )
    return totals.withColumns({
        "violations_by_rule": flat("violations_by_rule"), "violations_by_table": flat("violations_by_table"),
    })


_THOUSAND = (  # prefix, how many, table, violating SQL of rule i, the rule
    ("P", 300, "orders", "o_totalprice > 1500 * i",
     lambda i: dict(target_column="o_totalprice", operator=">", value=str(1500 * i), data_type="number")),
    ("L", 200, "orders", "o_totalprice <= 400 * i",
     lambda i: dict(target_column="o_totalprice", operator="<=", value=str(400 * i), data_type="number")),
    ("D", 200, "orders", "o_orderdate < TIMESTAMP '2001-12-31' - to_days(CAST(1000 + 7 * i AS INTEGER))",
     lambda i: dict(target_column="o_orderdate", operator="<", value=f"NOW() - {1000 + 7 * i} DAYS", rule_complexity="date_math")),
    ("Q", 100, "lineitem", "l_extendedprice < 20 * i OR l_extendedprice > 100000 - 300 * i",
     lambda i: dict(target_column="l_extendedprice", operator="BETWEEN", value=f"{20 * i}, {100000 - 300 * i}", rule_complexity="between")),
    ("C", 150, "orders", "o_custkey = i",
     lambda i: dict(target_column="o_custkey", operator="=", value=str(i), data_type="number")),
    ("N", 50, "orders", "o_custkey NOT IN (i, 2 * i)",
     lambda i: dict(target_column="o_custkey", operator="NOT IN", value=f"{i}, {2 * i}")),
)


def _thousand(*prefixes: str) -> list[Rule]:
    return [Rule(f"{p}{i}", p, applies_to_tables=(t,), **made(i)) for p, n, t, _, made in _THOUSAND if p in prefixes for i in range(n)]


def _thousand_sql(what: str, *prefixes: str) -> str:
    return " UNION ALL ".join(what.format(p=p, n=n, t=t, where=where, key=_key_sql(t)) for p, n, t, where, _ in _THOUSAND if p in prefixes)


def scan_thousand_counts(spark, sf_dir):
    """Violations of each of a thousand rules; either table is read once."""
    src = X.sources(spark, sf_dir, "orders", "lineitem")
    return scan.count_violations(src, scan.plan_pairs(_thousand(*(p for p, *_ in _THOUSAND)), src, Setting(X.AS_OF)))


def scan_thousand_hits(spark, sf_dir):
    """The rows that break any of 250 rules, which are looked up and not tried one by one."""
    src = X.sources(spark, sf_dir, "orders", "lineitem")
    return scan.hits(src, scan.plan_pairs(_thousand("Q", "C"), src, Setting(X.AS_OF)))


def scan_rejects(spark, sf_dir):
    """Rule and table pairs that are not scanned, with the rows that therefore stay unchecked."""
    src = X.sources(spark, sf_dir, *X.SCAN_TABLES)
    pairs = scan.pairs_frame(spark, scan.plan_pairs([*X.RULES, *X.UNSCANNABLE], src, Setting(X.AS_OF)))
    rows = tbl.row_counts({n: s.df for n, s in src.items()})
    return pairs.where("reason IS NOT NULL").join(rows, "table_name", "left")


def scan_summary(spark, sf_dir):
    out = report.scan_summary(violations(spark, sf_dir))
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select(
        "total_violations", "tables_with_violations", "rules_violated",
        F.round("avg_confidence", 6).alias("avg_confidence"), day("scan_start"), day("scan_end"),
    )


def violations_per_rule(spark, sf_dir):
    return counts(spark, sf_dir)


QUERIES = {
    "schema_catalog": schema_catalog,
    "table_profile": table_profile,
    "schema_stats": schema_stats,
    **{name: run for name, (run, _) in PREDICATES.items()},
    "pred_check_digit": pred_check_digit,
    "date_parse": date_parse,
    "scan_simple": scan_simple,
    "scan_complex": scan_complex,
    "scan_capped": scan_capped,
    "scan_all": scan_all,
    "violation_log": violation_log,
    "scan_counters": scan_counters,
    "scan_rejects": scan_rejects,
    "scan_thousand_counts": scan_thousand_counts,
    "scan_thousand_hits": scan_thousand_hits,
    "scan_summary": scan_summary,
    "violations_per_rule": violations_per_rule,
}

ORACLE = {
    "schema_catalog": X.with_cte(
        "SELECT c.*, n.row_count FROM cat c JOIN n USING (table_name)",
        keys=_KEYS_SQL, cat=_CATALOG_SQL, n=_ROW_COUNTS_SQL),
    "table_profile": X.with_cte(
        "SELECT table_name, count(*) AS column_count, "
        "coalesce(string_agg(CASE WHEN is_key THEN column_name END, ',' ORDER BY position), '') AS primary_key, "
        "max(row_count) AS row_count FROM cat JOIN n USING (table_name) GROUP BY table_name",
        keys=_KEYS_SQL, cat=_CATALOG_SQL, n=_ROW_COUNTS_SQL),
    "schema_stats": X.with_cte(
        "SELECT count(DISTINCT table_name) AS table_count, count(*) AS column_count, "
        "'conversations,lineitem' AS tables_without_key, (SELECT CAST(sum(row_count) AS BIGINT) FROM n) AS row_count FROM cat",
        keys=_KEYS_SQL, cat=_CATALOG_SQL, n=_ROW_COUNTS_SQL),
    **{name: sql for name, (_, sql) in PREDICATES.items()},
    "pred_check_digit": X.with_cte(
        "SELECT 'CARD' AS rule_id, event_id FROM digits WHERE list_sum(list_transform(range(length(d)), lambda i: CASE WHEN i % 2 = 0 "
        "THEN CAST(d[length(d) - i] AS INT) ELSE (2 * CAST(d[length(d) - i] AS INT)) // 10 + (2 * CAST(d[length(d) - i] AS INT)) % 10 END)) % 10 <> 0 "
        "UNION ALL SELECT 'HYPHEN', event_id FROM cards WHERE contains(card, '-')", cards=_CARDS_SQL,
        digits="SELECT event_id, regexp_replace(card, '[ -]', '', 'g') AS d FROM cards WHERE card <> 'no number'"),
    "date_parse": X.with_cte(
        f"SELECT event_id, strftime({_DAY}, '%Y-%m-%d %H:%M:%S') AS moment FROM cells", cells=X.CELLS_SQL),
    "scan_simple": "SELECT * FROM orders WHERE o_totalprice > 10000",
    "scan_complex": " UNION ALL ".join(
        f"SELECT '{r}' AS rule_id, 'lineitem' AS table_name, {_key_sql('lineitem')} AS record_primary_key "
        f"FROM lineitem WHERE {VIOLATING_SQL[r][1]}" for r in ("BTW-001", "XF-001")),
    "scan_capped": (
        "SELECT 'simple' AS kind, o_orderkey FROM (SELECT * FROM orders WHERE o_totalprice > 10000 "
        "ORDER BY o_orderkey LIMIT 300) UNION ALL "
        "SELECT 'complex', o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 300) "
        f"WHERE {VIOLATING_SQL['DTM-001'][1]} UNION ALL SELECT 'uncapped', o_orderkey FROM orders WHERE o_totalprice < 2000"),
    "scan_all": X.with_cte(
        "SELECT violation_id, rule_id, table_name, record_primary_key, confidence, violation_type, review_status FROM log",
        **LOG_CTES),
    "violation_log": X.with_cte(
        "SELECT l.violation_id, l.scan_id, l.rule_id, l.rule_text, l.rule_source, l.table_name, l.record_primary_key, "
        "l.confidence, l.violation_type, l.review_status, '2001-12-31' AS detected_on, o.o_orderkey AS data_key, "
        "o.o_orderstatus AS data_status FROM log l JOIN orders o ON l.record_primary_key = CAST(o.o_orderkey AS STRING) "
        "WHERE l.table_name = 'orders'", **LOG_CTES),
    "scan_counters": X.with_cte(
        "SELECT CAST(sum(violation_count) AS BIGINT) AS total_violations, CAST(13 AS BIGINT) AS tables_scanned, "
        "CAST(1 AS BIGINT) AS tables_skipped, CAST(14 AS BIGINT) AS rules_processed, CAST(1 AS BIGINT) AS rules_failed, "
        "(SELECT string_agg(rule_id || '=' || CAST(n AS STRING), ',' ORDER BY rule_id) FROM "
        "(SELECT rule_id, violation_count AS n FROM c UNION ALL SELECT 'BAD-002', 0)) AS violations_by_rule, "
        "(SELECT string_agg(table_name || '=' || CAST(n AS STRING), ',' ORDER BY table_name) FROM "
        "(SELECT table_name, CAST(sum(violation_count) AS BIGINT) AS n FROM c GROUP BY 1)) AS violations_by_table, "
        "'completed' AS status FROM c", c=COUNTS_SQL),
    "scan_rejects": (
        "SELECT 'BAD-001' AS rule_id, NULL AS table_name, 'no applicable table' AS reason, NULL AS row_count UNION ALL "
        "SELECT 'BAD-002', 'orders', 'unsupported operator or value', count(*) FROM orders"),
    "scan_summary": X.with_cte(
        "SELECT count(*) AS total_violations, count(DISTINCT table_name) AS tables_with_violations, "
        "count(DISTINCT rule_id) AS rules_violated, round(avg(confidence), 6) AS avg_confidence, "
        "'2001-12-31 00:00:00' AS scan_start, '2001-12-31 00:00:00' AS scan_end FROM log", **LOG_CTES),
    "scan_thousand_counts": _thousand_sql(
        "SELECT '{p}' || CAST(i AS STRING) AS rule_id, '{t}' AS table_name, count(*) FILTER (WHERE {where}) AS violation_count "
        "FROM {t}, range({n}) AS r(i) GROUP BY i", *(p for p, *_ in _THOUSAND)),
    "scan_thousand_hits": _thousand_sql(
        "SELECT '{p}' || CAST(i AS STRING) AS rule_id, '{t}' AS table_name, {key} AS record_primary_key "
        "FROM {t}, range({n}) AS r(i) WHERE {where}", "Q", "C"),
    "violations_per_rule": COUNTS_SQL,
}
