"""Registered queries against their SQL on the smallest given tables.

A selection runs by default; ALL_QUERIES=1 runs every one, as check.py does.
"""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from check import TABLES, bag  # noqa: E402
from ruleharbor.plans.registry import ORACLE, QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
SELECTION = (
    "schema_catalog", "pred_cross_field", "pred_date_math", "scan_all", "violation_log", "scan_counters", "violations_per_rule",
    "rules_clean", "rule_complexity", "review_merge", "validation_sample", "report_by_rule", "compliance_score",
    "chunk_documents", "redact_chunks", "embeddings_todo", "verdict_parse", "query_context", "policy_rerank",
    "vector_topk_cosine", "final_decisions",
)
NAMES = sorted(QUERIES) if os.environ.get("ALL_QUERIES") else SELECTION
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return connection


def test_every_query_has_checking_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    found = duck.execute(ORACLE[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert bag(df.columns, df.collect()) == bag(columns, found.fetchall())


def test_no_query_pairs_everything(spark):
    for name in NAMES:
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
