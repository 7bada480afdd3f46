import hashlib
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ruleharbor.functions import replies, sqltext, text
from ruleharbor.functions.ids import name_uuid
from ruleharbor.operators import review


def spans_by_definition(t, size, overlap, overlapping):
    out, start = [], 0
    while start < len(t):
        end = min(start + size, len(t))
        if end < len(t):
            cut = max(t.rfind(".", start, end), t.rfind("\n", start, end))
            if cut > start + size * 0.5:
                end = cut + 1
        piece = t[start:end].strip()
        if piece:
            out.append((piece, start, end - 1))
        if end >= len(t):
            break
        start = end - overlap if overlapping else max(start + size - overlap, end)
    return out


@pytest.mark.parametrize("overlapping", [False, True])
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet="ab.\n é\U0001f600\xa0", max_size=400), min_size=1, max_size=20))
def test_chunks_follow_the_definition(spark, overlapping, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", text.chunk_spans(F.col("t"), 40, 10, overlapping).alias("s")).collect()
    for row in got:
        assert [tuple(s) for s in row["s"]] == spans_by_definition(texts[row["i"]], 40, 10, overlapping)


def test_chunk_rows(spark):
    body = "Section 2. You MUST act. " + "word " * 300 + ". End"
    df = spark.createDataFrame([("doc", 3, body), ("none", 1, "  \n ")], "doc_id string, page int, text string")
    out = text.chunk_documents(df, page_col="page", context=1).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in out] == [0, 1] and {r["doc_id"] for r in out} == {"doc"}
    first = out[0]
    assert first["chunk_id"] == "doc_3_0_" + hashlib.md5(first["content"].encode()).hexdigest()[:8]
    assert first["section_header"] == "Section 2." and first["has_obligation"] and not out[1]["has_obligation"]
    assert first["context"] == out[0]["content"] + "\n\n" + out[1]["content"] == out[1]["context"]


@pytest.mark.parametrize(("content", "header"), [
    ("Article 12 applies", "Article 12"), ("Section 3: x", "Section 3:"), ("4. Scope of it", "4. Scope"),
    ("Chapter 9", "Chapter 9"), ("Part IV.", "Part IV"), ("see Article 12", None), ("x\nArticle 1", None)])
def test_section_headers(spark, content, header):
    df = spark.createDataFrame([(content,)], "c string")
    assert df.select(text.section_header(F.col("c"))).first()[0] == header


def test_guard(spark):
    pad = "x" * 60 + " "
    rows = [pad + "123-45-6789", pad + "1234567890123456", pad + "12345678901234567", pad + "a.b@c.org and d@e.fr",
            "short", "   " + "y" * 50 + "\n", None, "z" * 9000 + " 123-45-6789"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r[0] for r in df.select(text.guard_text(F.col("t"), max_chars=8000)).collect()]
    assert got[:4] == [pad + "[SSN_REDACTED]", pad + "[CC_REDACTED]", rows[2], pad + "[EMAIL_REDACTED] and [EMAIL_REDACTED]"]
    assert got[4] is None and got[5] == "y" * 50 and got[6] is None and got[7] == "z" * 8000
    whole = df.select(text.guard_text(F.col("t"))).collect()[7][0]
    assert whole.endswith(" [SSN_REDACTED]")


def test_ids_masks_and_tags(spark):
    df = spark.createDataFrame([("AMT-001",), ("é",)], "r string")
    assert [r[0] for r in df.select(name_uuid(F.col("r"))).collect()] == [
        str(uuid.uuid5(uuid.NAMESPACE_DNS, "AMT-001")), str(uuid.uuid5(uuid.NAMESPACE_DNS, "é"))]
    one = spark.range(1)
    assert one.select(text.mask_credentials(F.lit("postgresql://u:secret@h/db"))).first()[0] == "postgresql://u:***@h/db"
    tags = one.select(text.concept_tags(F.lit("Delete e-mail logs"), F.lit("data_retention"))).first()[0]
    assert tags == ["audit", "retention"]


def test_replies(spark):
    rows = ['```json\n{"decision": " approve ", "cited_policies": ["a"]}\n```', '{"decision": "maybe", "confidence": 0.2}',
            "no json", '{"broken": ', "{}"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r[0] for r in df.select(replies.parse_verdict(F.col("t"))).collect()]
    assert [(g["decision"], g["confidence"]) for g in got] == [
        ("APPROVE", 0.7), ("BLOCK", 0.2), ("BLOCK", 0.0), ("BLOCK", 0.0), ("BLOCK", 0.7)]
    assert got[2]["required_controls"] == ["manual_review"] and got[0]["cited_policies"] == ["a"]


def test_long_texts_stay_whole(spark):
    long = "no json " * 100 + "end"
    df = spark.createDataFrame([(long,)], "t string")
    whole, part = df.select(replies.parse_verdict(F.col("t")), replies.parse_verdict(F.col("t"), 200)).first()
    assert long in whole["reasoning"] and long[:200] + "." in part["reasoning"]
    counts = spark.createDataFrame([("r", 2)], "rule_id string, violation_count long")
    rules = spark.createDataFrame([("r", long, "c")], "rule_id string, rule_text string, target_column string")
    row = review.template_explanations(counts, rules).first()
    assert row.policy_clause == long and row.risk_description.endswith(f": {long}.")
    row = review.template_explanations(counts, rules, 80).first()
    assert row.policy_clause == long[:80] and row.risk_description.endswith(f": {long[:80]}.")


def test_records_and_steps(spark):
    one = spark.range(1)
    record = F.lit('{"ID": 1, "name": null, "kind": "x", "v": 2.5}')
    assert one.select(replies.column_value(record)).first()[0] == "x"
    assert [tuple(e) for e in one.select(replies.record_entries(record, 2)).first()[0]] == [("ID", "1"), ("name", None)]
    letters = F.array(*[F.lit(c) for c in '["a","b"]'])
    assert one.select(replies.join_letters(letters)).first()[0] == ["a", "b"]
    assert one.select(replies.join_letters(F.array(F.lit("one"), F.lit("two")))).first()[0] == ["one", "two"]


@pytest.mark.parametrize(("query", "tables", "columns"), [
    ('SELECT COUNT(*) FROM transactions GROUP BY "Is Laundering"', ["transactions"], []),
    ('SELECT Account, "Amount Received" FROM transactions WHERE "Amount Received" > 10000', ["transactions"],
     ["account", "amount received"]),
    ("SELECT * FROM Transactions", ["transactions"], ["*"]),
    ("select t.a as b, SUM(x), max( y ) from t join u on 1=1 join t", ["t", "u"], ["b", "x", "y"]),
    ("insert into x select a from y", ["x", "y"], ["a"]),
    ("UPDATE part SET p_size = 1", ["part"], []),
])
def test_sql_texts(spark, query, tables, columns):
    row = spark.createDataFrame([(query,)], "q string").select(
        sqltext.tables_named(F.col("q")), sqltext.columns_selected(F.col("q"))).first()
    assert (row[0], row[1]) == (tables, columns)


def test_normalised_sql(spark):
    df = spark.createDataFrame([("  SELECT\n 1 ;;",), ("A ;",)], "q string")
    assert [r[0] for r in df.select(sqltext.normalise_sql(F.col("q"))).collect()] == ["select 1 ", "a "]


@pytest.mark.parametrize(("query", "tables", "columns"), [
    ("SELECT 'sent from home' AS a, b FROM t", ["t"], ["a", "b"]),
    ("SELECT a FROM t -- from old_table", ["t"], ["a"]),
    ("SELECT (SELECT max(x) FROM u) AS m, b FROM t", ["u", "t"], ["m", "b"]),
    ('select count(*), sum(o.v) , "A b", `c` From s."T" join db.x.y', ["t", "y"], ["v", "a b", "c"]),
    ("SELECT * FROM t", ["t"], ["*"]),
    ("SELECT t.* FROM t, u", ["t"], []),
    ("SELECT DISTINCT a, coalesce(b, 0) FROM t", ["t"], ["a", "b"]),
    ("SELECT extract(year FROM d) y FROM t UNION SELECT z FROM w", ["t", "w"], ["y"]),
    ("WITH c AS (SELECT p, q FROM r) SELECT s FROM c", ["r", "c"], ["p", "q"]),
    ("SELECT 1", [], []),
    ("INSERT INTO t SELECT a b FROM u WHERE x IN (SELECT y FROM v)", ["t", "u", "v"], ["b"]),
    ("SELECT 'open from here", [], []),
    ("/* never closed from x", [], []),
    ("SELECT CASE WHEN a > 0 THEN b END FROM größe", ["größe"], ["b"]),
    ("SELECT 'it''s from x' AS a, ',' FROM t", ["t"], ["a"]),
    ("", [], []),
    ("((((", [], []),
])
def test_tables_and_columns_by_tokens(spark, query, tables, columns):
    row = spark.createDataFrame([(query,)], "q string").select(
        sqltext.tables_named(F.col("q")).alias("t"), sqltext.columns_selected(F.col("q")).alias("c")).first()
    assert (row.t, row.c) == (tables, columns)


def test_flags_do_not_look_into_strings_and_comments(spark):
    q = F.col("q")
    flags = [sqltext.has_where(q), sqltext.has_aggregation(q), sqltext.is_select_star(q), sqltext.is_read_only(q)]
    texts = ["-- select\nUPDATE t SET a = 'where max select *' /* group by */",
             "/* a */ select * from t where \"x'y\" = 'it''s' and max(a) > 1"]
    rows = spark.createDataFrame([(t,) for t in texts], "q string").coalesce(1).select(*flags).collect()
    assert [list(r) for r in rows] == [[False] * 4, [True] * 4]


def test_long_strings_and_comments_are_one_token(spark):
    text = "SELECT '" + "x" * 200_000 + "''" * 500 + "' AS a /*" + "y" * 200_000 + "*/ FROM t"
    row = spark.createDataFrame([(text,)], "q string").select(
        F.size(sqltext.sql_tokens(F.col("q"))), sqltext.columns_selected(F.col("q"))).first()
    assert row[0] == 6 and row[1] == ["a"]
