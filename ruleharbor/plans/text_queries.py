"""Registered queries: documents, chunks, replies and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleharbor.functions import fixed_values as K
from ruleharbor.functions import text as X_TEXT
from ruleharbor.functions.ids import content_key, name_uuid
from ruleharbor.functions.replies import (
    clean_steps, column_value, json_object_text, parse_object, parse_verdict, record_entries,
)
from ruleharbor.plans import fixtures as X
from ruleharbor.sources.files import still_to_do, work_key
from ruleharbor.sources.logs import new_rows_only

# --- chunks ---------------------------------------------------------------------------------


def documents(spark, sf_dir):
    return X.table(spark, sf_dir, "documents")


def chunk_documents(spark, sf_dir):
    """Chunks as the step rule defines them, every document whole."""
    return X_TEXT.chunk_documents(documents(spark, sf_dir)).select(
        "doc_id", "chunk_index", "start_char", "end_char", "chunk_id", F.length("content").alias("n_chars")
    )


def chunk_documents_overlapping(spark, sf_dir):
    return X_TEXT.chunk_documents(documents(spark, sf_dir), overlapping=True).select(
        "doc_id", "chunk_index", "start_char", "end_char", "chunk_id", F.length("content").alias("n_chars")
    )


def chunk_context(spark, sf_dir):
    out = X_TEXT.chunk_documents(documents(spark, sf_dir), context=1)
    return out.select("doc_id", "chunk_index", F.md5("context").alias("context_md5"))


def chunk_sections(spark, sf_dir):
    """Chunks of pages that start with a section header; the title line of every page is made one."""
    pages = X.derived(spark, sf_dir, _SECTIONS_SQL, "documents")
    return X_TEXT.chunk_documents(pages).select("doc_id", "chunk_index", "section_header")


def chunk_obligation(spark, sf_dir):
    notes = X.derived(spark, sf_dir, _OBLIGATIONS_SQL, "documents")
    return X_TEXT.chunk_documents(notes).select("doc_id", "chunk_index", "has_obligation")


def chunk_citations(spark, sf_dir):
    chunks = X_TEXT.chunk_documents(documents(spark, sf_dir))
    cited = X_TEXT.citation(
        F.col("doc_id").cast("string"), F.col("chunk_id"), F.col("chunk_index"), F.col("start_char"), F.col("end_char")
    )
    return chunks.withColumn("c", cited).select("c.source", "c.chunk_id", "c.chunk_index", "c.char_range")


_SECTIONS_SQL = f"""
SELECT doc_id, {X.pick('doc_id', ('Article 7 ', 'Section 3: ', '2. Scope ', 'Chapter 12 ', 'Part IV ', 'article 9 ', ''))}
       || text AS text FROM documents
"""
_OBLIGATIONS_SQL = f"""
SELECT doc_id, {X.pick('doc_id', ('All MUST comply. ', 'It is Required to log. ', 'Nothing. ', 'Prohibited here. '))}
       || text AS text FROM documents
"""



def _walk_ctes(documents_sql: str, overlapping: bool) -> dict[str, str]:
    """Chunk walk in plain recursive SQL over the same texts."""
    step = "e - 200" if overlapping else "greatest(s + 800, e)"
    last_cut = (
        "1001 - least(coalesce(nullif(strpos(reverse(substring(text, s + 1, 1000)), '.'), 0), 1001), "
        "coalesce(nullif(strpos(reverse(substring(text, s + 1, 1000)), chr(10)), 0), 1001))"
    )
    end = f"CASE WHEN s + 1000 >= n THEN n WHEN {last_cut} - 1 > 500 THEN s + {last_cut} ELSE s + 1000 END"
    return {
        "docs": documents_sql,
        "walk(doc_id, text, n, s, e)": (
            f"SELECT doc_id, text, n, s, {end} AS e FROM (SELECT doc_id, text, length(text) AS n, 0 AS s FROM docs "
            "WHERE length(text) > 0) UNION ALL "
            f"SELECT doc_id, text, n, s, {end} FROM (SELECT doc_id, text, n, {step} AS s FROM walk "
            f"WHERE e < n AND {step} < n)"
        ),
        "chunks": (
            f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INT) AS chunk_index, "
            "CAST(s AS INT) AS start_char, CAST(e - 1 AS INT) AS end_char, content FROM (SELECT doc_id, s, e, "
            f"trim(substring(text, s + 1, e - s), {_SPACES}) AS content FROM walk) WHERE content <> ''"
        ),
    }


_SPACES = "'' || " + " || ".join(f"chr({ord(c)})" for c in K.EDGE_SPACE)


def _walk_sql(body: str, documents_sql: str = "SELECT doc_id, text FROM documents", overlapping: bool = False) -> str:
    return X.with_cte(body, **_walk_ctes(documents_sql, overlapping)).replace("WITH ", "WITH RECURSIVE ", 1)


_CHUNK_ID = "CAST(doc_id AS STRING) || '_' || CAST(chunk_index AS STRING) || '_' || substr(md5(content), 1, 8)"
_CHUNK_OUT = f"SELECT doc_id, chunk_index, start_char, end_char, {_CHUNK_ID} AS chunk_id, CAST(length(content) AS INT) AS n_chars FROM chunks"

# --- guardrail --------------------------------------------------------------------------------


def redact_documents(spark, sf_dir):
    """Whole texts, stripped and redacted; short ones are dropped."""
    guarded = documents(spark, sf_dir).select("doc_id", X_TEXT.guard_text(F.col("text"), max_chars=None).alias("text"))
    return guarded.where("text IS NOT NULL").select("doc_id", F.md5("text").alias("text_md5"))


def redact_chunks(spark, sf_dir):
    chunks = X_TEXT.chunk_documents(documents(spark, sf_dir))
    guarded = chunks.select("chunk_id", X_TEXT.guard_text(F.col("content")).alias("content"))
    return guarded.where("content IS NOT NULL").select("chunk_id", F.md5("content").alias("content_md5"))


def rejected_documents(spark, sf_dir):
    """Documents that are too short to be processed."""
    short = X_TEXT.guard_text(F.col("text"), max_chars=None).isNull()
    return documents(spark, sf_dir).where(short).select("doc_id", F.lit("too short").alias("reason"))


_GUARDED = (
    "regexp_replace(regexp_replace(regexp_replace({t}, '\\b\\d{{3}}-\\d{{2}}-\\d{{4}}\\b', '[SSN_REDACTED]', 'g'), "
    "'\\b\\d{{16}}\\b', '[CC_REDACTED]', 'g'), "
    "'\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{{2,}}\\b', '[EMAIL_REDACTED]', 'g')"
)

# --- texts for embedding --------------------------------------------------------------------


def embedding_text(spark, sf_dir):
    rows = X.derived(spark, sf_dir, X.RAW_RULES_SQL)
    rule = F.struct("rule_type", "action", "condition")
    entities = F.create_map(F.lit("roles"), F.array(F.col("scope")), F.lit("empty"), F.array().cast("array<string>"))
    rules = F.when(F.col("position") % 3 == 0, F.array().cast("array<struct<rule_type:string,action:string,condition:string>>")) \
        .otherwise(F.array(rule))
    kind = F.when(F.col("position") % 2 == 0, "requirement").otherwise("informational")
    ents = F.when(F.col("scope").isNotNull(), entities)
    return rows.select("position", X_TEXT.embedding_text(F.col("rule_text"), kind, rules, ents).alias("text"))


def policy_text(spark, sf_dir):
    rows = X.derived(spark, sf_dir, X.RAW_RULES_SQL)
    cols = [F.col(c) for c in ("rule_text", "rule_type", "logic_field", "logic_operator", "logic_value")]
    return rows.select("position", X_TEXT.policy_text(*cols).alias("text"))


def concept_tags(spark, sf_dir):
    docs = documents(spark, sf_dir)
    tags = X_TEXT.concept_tags(F.col("text"), F.concat(F.lit("data_"), F.col("lang")))
    return docs.select("doc_id", F.array_join(tags, ",").alias("tags"))


def policy_ids(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", name_uuid(F.concat(F.lit("rule-"), F.col("doc_id"))).alias("id"))


def mask_credentials(spark, sf_dir):
    rows = X.derived(spark, sf_dir, _URLS_SQL)
    return rows.select("event_id", X_TEXT.mask_credentials(F.col("url")).alias("url"))


_URLS_SQL = """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'sqlite:///data/' || event_type || '.db'
  ELSE 'postgresql://u' || CAST(user_id AS STRING) || ':p' || CAST(event_id AS STRING) || '@db.example.com:5432/' || event_type END AS url
FROM events
"""

# --- work that is still open -----------------------------------------------------------------


def documents_todo(spark, sf_dir):
    """Documents not processed yet with these settings; labelled ones count as processed."""
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id"))
    docs = documents(spark, sf_dir).withColumn("key", work_key(path, F.col("n_chars"), 1000, 200))
    done = docs.join(X.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return still_to_do(docs, done).select("doc_id", "key")


def new_chunks_only(spark, sf_dir):
    """Chunks whose id is not stored yet; those of labelled documents are."""
    chunks = X_TEXT.chunk_documents(documents(spark, sf_dir)).select("doc_id", "chunk_id")
    stored = chunks.join(X.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return new_rows_only(chunks, stored, "chunk_id")


def embeddings_todo(spark, sf_dir):
    """Texts without a stored vector, equal texts once; texts of labelled documents have one."""
    docs = documents(spark, sf_dir).select("doc_id", content_key(F.col("text"), F.lit("bge-small")).alias("key"))
    stored = docs.join(X.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("key")
    return docs.groupBy("key").agg(F.min("doc_id").alias("doc_id")).join(stored, "key", "left_anti")


# --- replies and records ---------------------------------------------------------------------


def verdict_parse(spark, sf_dir):
    rows = X.derived(spark, sf_dir, X.REPLIES_SQL).withColumn("v", parse_verdict(F.col("text")))
    return rows.select(
        "reply_id", "v.decision", "v.confidence",
        F.array_join("v.cited_policies", ",").alias("cited"),
        F.array_join("v.sensitive_columns", ",").alias("sensitive"),
        F.array_join("v.required_controls", ",").alias("controls"),
        F.col("v.reasoning").startswith("Verdict generation failed").alias("failed"),
    )


_RESULTS_SQL = """
SELECT event_id AS reply_id, 'Here you are: ```json' || chr(10) || '{"results": [{"violation_id": ' || CAST(event_id AS STRING)
       || ', "verdict": "confirmed", "reason": "' || event_type || '"}, {"violation_id": ' || CAST(event_id + 1 AS STRING)
       || ', "verdict": "false_positive"}]}' || CASE WHEN event_id % 5 = 0 THEN '' ELSE chr(10) || '``` done' END AS text
FROM events
"""


def reply_parse(spark, sf_dir):
    """Verdict rows out of fenced replies with prose around them."""
    rows = X.derived(spark, sf_dir, _RESULTS_SQL)
    parsed = parse_object(
        json_object_text(F.col("text")), "results array<struct<violation_id bigint, verdict string, reason string>>"
    )
    return rows.select("reply_id", F.inline(parsed["results"]))


def record_preview(spark, sf_dir):
    """First entries and first value of every order, from its JSON text."""
    orders = X.table(spark, sf_dir, "orders")
    text = F.to_json(F.struct(F.col("o_orderkey").alias("ID"), "o_custkey", "o_orderstatus", "o_orderpriority"))
    rows = orders.select("o_orderkey", text.alias("record"))
    shown = F.transform(record_entries(F.col("record"), 3), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return rows.select(
        "o_orderkey", F.array_join(shown, ";").alias("preview"), column_value(F.col("record")).alias("first_value")
    )


_STEPS_SQL = f"""
SELECT event_id, {X.pick('event_id', ('["a", "b"]', 'one step', '  ', '["x"]', '[broken', None))} AS steps, event_type FROM events
"""


def steps_clean(spark, sf_dir):
    rows = X.derived(spark, sf_dir, _STEPS_SQL)
    return rows.select("event_id", F.array_join(clean_steps(F.col("steps")), "|").alias("steps"))


QUERIES = {
    f.__name__: f
    for f in (
        chunk_documents, chunk_documents_overlapping, chunk_context, chunk_sections, chunk_obligation, chunk_citations,
        redact_documents, redact_chunks, rejected_documents, embedding_text, policy_text, concept_tags, policy_ids,
        mask_credentials, documents_todo, new_chunks_only, embeddings_todo, verdict_parse, reply_parse,
        record_preview, steps_clean,
    )
}

_STRIPPED = f"SELECT doc_id, trim(text, {_SPACES}) AS t FROM documents"
_HEADER = " ".join(
    f"WHEN regexp_matches(content, '^{p}') THEN regexp_extract(content, '^{p}')" for p in K.SECTION_PATTERNS
)
_CONCEPTS = ", ".join(
    f"CASE WHEN {' OR '.join(f'''contains(lower(text), '{w}')''' for w in words)} THEN '{tag}' END"
    for tag, words in K.CONCEPT_WORDS.items()
)
_WORD = lambda c: f"coalesce({c}, '')"
ORACLE = {
    "chunk_documents": _walk_sql(_CHUNK_OUT),
    "chunk_documents_overlapping": _walk_sql(_CHUNK_OUT, overlapping=True),
    "chunk_context": _walk_sql(
        "SELECT doc_id, chunk_index, md5(concat_ws(chr(10) || chr(10), lag(content) OVER w, content, lead(content) OVER w)) "
        "AS context_md5 FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)"),
    "chunk_sections": _walk_sql(
        f"SELECT doc_id, chunk_index, CASE {_HEADER} END AS section_header FROM chunks", _SECTIONS_SQL),
    "chunk_obligation": _walk_sql(
        "SELECT doc_id, chunk_index, " + " OR ".join(f"contains(lower(content), '{t}')" for t in K.OBLIGATION_TERMS)
        + " AS has_obligation FROM chunks", _OBLIGATIONS_SQL),
    "chunk_citations": _walk_sql(
        f"SELECT CAST(doc_id AS STRING) AS source, {_CHUNK_ID} AS chunk_id, chunk_index, "
        "CAST(start_char AS STRING) || '-' || CAST(end_char AS STRING) AS char_range FROM chunks"),
    "redact_documents": X.with_cte(
        f"SELECT doc_id, md5({_GUARDED.format(t='t')}) AS text_md5 FROM s WHERE length(t) >= 50", s=_STRIPPED),
    "redact_chunks": _walk_sql(
        f"SELECT {_CHUNK_ID} AS chunk_id, md5({_GUARDED.format(t='content')}) AS content_md5 FROM chunks "
        "WHERE length(content) >= 50"),
    "rejected_documents": X.with_cte("SELECT doc_id, 'too short' AS reason FROM s WHERE length(t) < 50", s=_STRIPPED),
    "embedding_text": X.with_cte(
        "SELECT position, concat_ws(' ', rule_text, CASE WHEN position % 2 = 0 THEN '[Document Type: requirement]' END, "
        "CASE WHEN position % 3 <> 0 THEN '[Rule: ' || rule_type || ' - ' || coalesce(action, 'None') || ' when ' || "
        "coalesce(condition, 'None') || ']' END, CASE WHEN scope IS NOT NULL THEN '[roles: ' || scope || ']' END) AS text "
        "FROM raw", raw=X.RAW_RULES_SQL),
    "policy_text": X.with_cte(
        f"SELECT position, 'Compliance rule: ' || {_WORD('rule_text')} || '. Type: ' || {_WORD('rule_type')} || '. Column: ' "
        f"|| {_WORD('logic_field')} || '. Operator: ' || {_WORD('logic_operator')} || '. Value: ' || "
        "coalesce(logic_value, 'None') || '.' AS text FROM raw", raw=X.RAW_RULES_SQL),
    "concept_tags": (
        f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([{_CONCEPTS}, lang], lambda x: x IS NOT NULL))), "
        "',') AS tags FROM documents"),
    "policy_ids": X.with_cte(
        "SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || "
        "substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || "
        "substr(h, 21, 12) AS id FROM h",
        h=f"SELECT doc_id, sha1(unhex('{K.DNS_NAMESPACE}') || encode('rule-' || CAST(doc_id AS STRING))) AS h FROM documents"),
    "mask_credentials": X.with_cte(
        "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN url ELSE regexp_replace(url, ':p[0-9]+@', ':***@') END AS url FROM u",
        u=_URLS_SQL),
    "documents_todo": (
        "SELECT doc_id, md5(source || '/' || CAST(doc_id AS STRING) || '|' || CAST(n_chars AS STRING) || '|1000|200') AS key "
        "FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "new_chunks_only": _walk_sql(
        f"SELECT doc_id, {_CHUNK_ID} AS chunk_id FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "embeddings_todo": X.with_cte(
        "SELECT key, min(doc_id) AS doc_id FROM d GROUP BY key HAVING bool_and(doc_id NOT IN (SELECT doc_id FROM labels))",
        d="SELECT doc_id, md5(text || '|bge-small') AS key FROM documents"),
    "verdict_parse": X.with_cte(
        "SELECT reply_id, CASE WHEN NOT ok THEN 'BLOCK' WHEN upper(trim(j->>'decision')) = 'APPROVE' THEN 'APPROVE' "
        "ELSE 'BLOCK' END AS decision, CASE WHEN ok THEN coalesce(CAST(j->>'confidence' AS DOUBLE), 0.7) ELSE 0.0 END AS confidence, "
        "CASE WHEN ok THEN j->'cited_policies'->>0 ELSE '' END AS cited, "
        "CASE WHEN ok THEN j->'sensitive_columns'->>0 ELSE '' END AS sensitive, "
        "CASE WHEN ok THEN j->'required_controls'->>0 ELSE 'manual_review' END AS controls, NOT ok AS failed FROM "
        "(SELECT reply_id, json_valid(t) AS ok, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM "
        "(SELECT reply_id, trim(replace(replace(text, '```json', ''), '```', ''), chr(10)) AS t FROM r))",
        r=X.REPLIES_SQL),
    "reply_parse": (
        "SELECT event_id AS reply_id, event_id AS violation_id, 'confirmed' AS verdict, event_type AS reason FROM events "
        "UNION ALL SELECT event_id, event_id + 1, 'false_positive', NULL FROM events"),
    "record_preview": (
        "SELECT o_orderkey, 'ID=' || CAST(o_orderkey AS STRING) || ';o_custkey=' || CAST(o_custkey AS STRING) || "
        "';o_orderstatus=' || o_orderstatus AS preview, CAST(o_custkey AS STRING) AS first_value FROM orders"),
    "steps_clean": (
        "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'a|b' WHEN 1 THEN 'one step' WHEN 3 THEN 'x' WHEN 4 THEN '[broken' "
        "ELSE '' END AS steps FROM events"),
}
