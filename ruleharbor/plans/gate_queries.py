"""Registered queries: screening the request log, reuse of decisions, vector search and the audit log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleharbor.functions import fixed_values as K
from ruleharbor.functions import sqltext as S
from ruleharbor.functions.pii import is_pii, pii_categories
from ruleharbor.functions.replies import parse_verdict
from ruleharbor.functions.text import concept_tags
from ruleharbor.operators import audit, gate, reuse, screening, vectors
from ruleharbor.plans import fixtures as X
from ruleharbor.session import cut_lineage

# --- inputs ---------------------------------------------------------------------------------


def query_log(spark, sf_dir):
    return X.derived(spark, sf_dir, X.QUERY_LOG_SQL)


def requests(spark, sf_dir):
    """The log with a key and, where there is one, a vector per request."""
    return reuse.with_key(query_log(spark, sf_dir)).join(_vectors(spark, sf_dir), "vec_ref", "left")


def _vectors(spark, sf_dir):
    return X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vec_ref"), "embedding")


def entries(spark, sf_dir):
    """Stored decisions with key and vector; the vectors come last, so that the join of decisions does not move them."""
    told = X.derived(spark, sf_dir, X.DECISIONS_SQL)
    asked = reuse.with_key(query_log(spark, sf_dir)).select(
        F.col("query_id").alias("entry_id"), "key", "normalised_query", "user_role", "vec_ref")
    return asked.join(told, "entry_id").join(_vectors(spark, sf_dir), "vec_ref", "left").drop("vec_ref")


_POLICY_LABELS = (
    ("c_name", "Customer names are personal data", "data_privacy"),
    ("o_totalprice", "Orders above the limit need a fraud check", "data_quality"),
    ("l_quantity", "Quantities must be plausible", "data_quality"),
    ("s_name", "Mask supplier names before export", "data_security"),
    ("c_acctbal", "Balances are shown for a quarterly report only", "data_access"),
    ("p_size", "Sizes must not change without a record", "data_quality"),
    ("o_orderkey", "Keep keys for 90 days", "data_retention"),
    ("s_acctbal", "Access is by role", "data_access"),
    ("p_name", "Encrypt product names at rest", "data_security"),
    ("l_tax", "Tax lines need review", "data_quality"),
)
_POLICIES_SQL = f"""
SELECT vec_id, 'p' || CAST(vec_id AS STRING) AS policy_id, embedding,
       CASE WHEN label % 2 = 0 THEN 'AML' ELSE 'GDPR' END AS framework,
       {X.pick('label', tuple(p[0] for p in _POLICY_LABELS))} AS target_column,
       {X.pick('label', tuple(p[1] for p in _POLICY_LABELS))} AS rule_text,
       {X.pick('label', tuple(p[2] for p in _POLICY_LABELS))} AS rule_type
FROM embeddings
"""
_HINTS_SQL = """
SELECT event_id AS query_id, event_type IN ('view', 'click') AS is_clear,
       CASE WHEN event_type = 'error' THEN 'JURISDICTION' END AS extra
FROM events
"""
_HUMAN_SQL = """
SELECT event_id AS query_id, CASE WHEN event_id % 2 = 0 THEN 'APPROVE' ELSE 'BLOCK' END AS human_decision,
       'checked by hand' AS human_reasoning
FROM events WHERE event_type = 'purchase'
"""


def policies(spark, sf_dir):
    rows = X.derived(spark, sf_dir, _POLICIES_SQL, "embeddings")
    return rows.withColumn("concepts", concept_tags(F.col("rule_text"), F.col("rule_type")))


def context(spark, sf_dir):
    return gate.add_context(requests(spark, sf_dir), X.catalog(spark, sf_dir))


def inputs(spark, sf_dir):
    """The tables of the gate. Only policies of one framework are searched."""
    hints = X.derived(spark, sf_dir, _HINTS_SQL).select(
        "query_id", "is_clear", F.array_compact(F.array("extra")).alias("additional_missing"))
    return screening.GateInputs(
        catalog=X.catalog(spark, sf_dir),
        policies=policies(spark, sf_dir).where("framework = 'AML'").withColumnRenamed("vec_id", "id"),
        embeddings=X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"),
        replies=X.derived(spark, sf_dir, X.REPLIES_SQL).withColumnRenamed("reply_id", "query_id"),
        clear_replies=hints,
        human=X.derived(spark, sf_dir, _HUMAN_SQL),
        entries=entries(spark, sf_dir),
    )


def intent(spark, sf_dir):
    return screening.with_intent(requests(spark, sf_dir), inputs(spark, sf_dir))


def with_policies(spark, sf_dir, asked):
    return screening.with_policies(asked, inputs(spark, sf_dir))


def screened(spark, sf_dir):
    """Requests with intent, policies, verdict and checks."""
    given = inputs(spark, sf_dir)
    return screening.with_checks(screening.with_policies(intent(spark, sf_dir), given), given)


def decided(spark, sf_dir):
    return screening.gate_requests(query_log(spark, sf_dir), inputs(spark, sf_dir))


def audit_log_rows(spark, sf_dir):
    """Audit rows of all requests; asking cost and time grow with the length of the text."""
    timed = decided(spark, sf_dir).withColumns({
        "created_at": F.col("ts"),
        "reasoning": F.col("verdict.reasoning"),
        "cited_policies": F.col("verdict.cited_policies"),
        "sensitive_columns": F.col("verdict.sensitive_columns"),
        "required_controls": F.col("verdict.required_controls"),
        "total_cost_usd": F.when(F.col("cache_layer").isNull(), F.length("query") / 1000.0).otherwise(0.0),
        "processing_ms": F.length("query").cast("double"),
        "stage_outputs": F.to_json(F.struct("intent", "missing", "policy_status", "checks")),
    })
    return audit.audit_rows(timed)


# --- query text ------------------------------------------------------------------------------


def query_normalise(spark, sf_dir):
    return query_log(spark, sf_dir).select("query_id", S.normalise_sql(F.col("query")).alias("normalised"))


# Each request with a second text made from its number: strings, comments, quoted names, brackets, other statements.
_TEXTS_SQL = """
SELECT event_id AS query_id, 'made' AS kind, CASE CAST(event_id % 8 AS INT)
  WHEN 0 THEN 'SELECT ''sent from home'' AS a, b FROM t' || CAST(event_id % 7 AS STRING) || ' -- from old_table'
  WHEN 1 THEN 'SELECT (SELECT max(x) FROM u' || CAST(event_id % 5 AS STRING) || ') AS m, b FROM t JOIN "Order Lines" ON 1 = 1'
  WHEN 2 THEN '/* from c */ SELECT "First Name", s.age FROM people s WHERE note = ''it is from x, y'''
  WHEN 3 THEN 'select distinct a, count(*) , sum(v) from big_' || CAST(event_id % 3 AS STRING) || ' group by a'
  WHEN 4 THEN 'INSERT INTO log_' || CAST(event_id % 4 AS STRING) || ' SELECT x, y AS z FROM src'
  WHEN 5 THEN 'SELECT t.a FROM (SELECT a, ''join k'' AS k FROM deep_' || CAST(event_id % 6 AS STRING) || ') t JOIN more ON t.a = more.a'
  WHEN 6 THEN 'SELECT extract(year FROM d) AS yr, c FROM cal_' || CAST(event_id % 9 AS STRING)
  ELSE 'UPDATE stock_' || CAST(event_id % 3 AS STRING) || ' SET n = 1 WHERE k = ''from z''' END AS query
FROM events
"""


def _texts(spark, sf_dir):
    logged = query_log(spark, sf_dir).select("query_id", F.lit("logged").alias("kind"), "query")
    return logged.unionByName(X.derived(spark, sf_dir, _TEXTS_SQL))


def query_tables(spark, sf_dir):
    return _texts(spark, sf_dir).select("query_id", "kind", F.array_join(S.tables_named(F.col("query")), ",").alias("tables"))


def query_select_cols(spark, sf_dir):
    return _texts(spark, sf_dir).select("query_id", "kind", F.array_join(S.columns_selected(F.col("query")), ",").alias("columns"))


def query_flags(spark, sf_dir):
    q = F.col("query")
    return query_log(spark, sf_dir).select(
        "query_id", S.has_where(q).alias("has_where"), S.has_aggregation(q).alias("has_aggregation"),
        S.is_select_star(q).alias("select_star"), S.is_read_only(q).alias("read_only"))


def pii_columns(spark, sf_dir):
    """Columns that hold personal data by their name, with the number of rows behind them."""
    from ruleharbor.plans.scan_queries import schema_catalog

    name = F.col("column_name")
    return schema_catalog(spark, sf_dir).select(
        "table_name", "column_name", "row_count", is_pii(name).alias("is_pii"),
        F.array_join(pii_categories(name), ",").alias("categories"))


def query_columns(spark, sf_dir):
    return context(spark, sf_dir).select("query_id", F.explode("columns").alias("c")).select(
        "query_id", "c.table_name", "c.column_name", "c.is_pii", "c.classification")


def query_context(spark, sf_dir):
    return context(spark, sf_dir).select(
        "query_id", "has_pii", "max_classification", F.array_join("pii_categories", ",").alias("categories"),
        F.size("columns").alias("n_columns"))


def access_level(spark, sf_dir):
    return query_log(spark, sf_dir).select("query_id", gate.access_level(F.col("user_role")).alias("access_level"))


def context_hash(spark, sf_dir):
    return context(spark, sf_dir).select("query_id", "context_hash")


def search_text(spark, sf_dir):
    return context(spark, sf_dir).select(
        "query_id", gate.search_text(F.col("query"), F.col("stated_purpose"), F.col("pii_categories")).alias("text"))


def missing_dims(spark, sf_dir):
    rows = gate.add_intent(context(spark, sf_dir))
    return rows.select("query_id", F.array_join("missing", ",").alias("missing"))


def intent_class(spark, sf_dir):
    return intent(spark, sf_dir).select(
        "query_id", "intent", "intent_confidence", "intent_method", F.array_join("missing", ",").alias("missing"),
        "clarification")


# --- vectors -----------------------------------------------------------------------------------


def _items(spark, sf_dir):
    return X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def vector_topk_l2(spark, sf_dir):
    """The ten nearest vectors of every vector."""
    items = _items(spark, sf_dir)
    hits = vectors.top_k(items, items, K.L2_K, "l2")
    return hits.select("query_id", "item_id", F.round("score", 6).alias("distance"), "rank")


def vector_topk_cosine(spark, sf_dir):
    """The ten most alike AML policies of every vector, from a score of 0.2."""
    rules = policies(spark, sf_dir).where("framework = 'AML'").select(F.col("vec_id").alias("id"), "embedding")
    hits = vectors.top_k(_items(spark, sf_dir), rules, 10, "cosine", min_score=0.2)
    return hits.select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


def policy_rerank(spark, sf_dir):
    ranked = with_policies(spark, sf_dir, context(spark, sf_dir)).select("query_id", F.posexplode("policies").alias("pos", "p"))
    return ranked.select(
        "query_id", "p.item_id", F.round("p.score", 6).alias("score"), (F.col("pos") + 1).alias("rank"))


def policy_routing(spark, sf_dir):
    return screened(spark, sf_dir).select("query_id", "policy_status")


def semantic_category(spark, sf_dir):
    """Best category of every vector; a category's vector is the mean of its labels, which are more than categories."""
    items = X.table(spark, sf_dir, "embeddings").withColumn("label", F.col("label") % len(K.SEMANTIC_CATEGORIES))
    names = F.array(*[F.lit(c) for c in K.SEMANTIC_CATEGORIES])
    means = vectors.centroids(items)
    best = vectors.best_category(_items(spark, sf_dir), means.select(F.col("label").alias("id"), "embedding"), 0.3)
    return best.select("id", F.get(names, F.col("category_id").cast("int")).alias("category"), F.round("score", 6).alias("score"))


# --- reuse ---------------------------------------------------------------------------------------


def reuse_exact(spark, sf_dir):
    return reuse.exact_hits(requests(spark, sf_dir), reuse.lifetimes(entries(spark, sf_dir)))


def reuse_fuzzy(spark, sf_dir):
    return reuse.fuzzy_hits(requests(spark, sf_dir), reuse.lifetimes(entries(spark, sf_dir)))


def reuse_semantic(spark, sf_dir):
    stored = entries(spark, sf_dir)
    hits = reuse.semantic_hits(requests(spark, sf_dir), reuse.lifetimes(reuse.with_names(stored)), stored=stored)
    return hits.withColumn("score", F.round("score", 6))


def reuse_cascade(spark, sf_dir):
    return reuse.reuse_cascade(requests(spark, sf_dir), entries(spark, sf_dir))


def reuse_stats(spark, sf_dir):
    out = reuse.reuse_stats(reuse_cascade(spark, sf_dir))
    return out.withColumn("hit_rate", F.round("hit_rate", 9))


# --- decisions -----------------------------------------------------------------------------------


def audit_checks(spark, sf_dir):
    out = screened(spark, sf_dir)
    return out.select(
        "query_id", *[F.col("checks")[c].alias(c) for c in ("json_valid", "decision_valid", "citations_grounded", "columns_valid")],
        F.array_join("ungrounded", ",").alias("ungrounded"), F.array_join("invented", ",").alias("invented"), "checks_passed")


def block_guidance(spark, sf_dir):
    v = X.derived(spark, sf_dir, X.REPLIES_SQL).select("reply_id", parse_verdict(F.col("text")).alias("v"))
    return v.select("reply_id", gate.block_guidance(F.col("v.required_controls"), F.col("v.sensitive_columns")).alias("guidance"))


def final_decisions(spark, sf_dir):
    return decided(spark, sf_dir).select("query_id", "cache_layer", "final_decision", "block_reason", "guidance")


def escalations(spark, sf_dir):
    out = gate.escalations(decided(spark, sf_dir))
    return out.select("query_id", "user_role", "preliminary_decision", F.array_join(F.array_sort("failed_checks"), ",").alias("failed"))


def governed_query(spark, sf_dir):
    """Rows of an approved request, cut at the result cap; ``truncated`` is its flag."""
    orders = X.table(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey")
    rows, truncated = gate.capped_result(orders, K.RESULT_ROW_CAP)
    return rows.withColumn("truncated", F.lit(truncated))


def audit_log(spark, sf_dir):
    return audit_log_rows(spark, sf_dir).select(
        "log_id", "session_id", "query", "user_id", "user_role", "stated_purpose", "decision", "cited_policies",
        "sensitive_cols", "required_ctrls", "cache_hit", "cache_layer", "total_cost_usd", "processing_ms")


def audit_stats(spark, sf_dir):
    out = audit.audit_stats(audit_log_rows(spark, sf_dir))
    return out.withColumn("cache_hit_rate", F.round("cache_hit_rate", 9))


def audit_recent(spark, sf_dir):
    """The latest rows overall, of one user, and of one session."""
    log = cut_lineage(audit_log_rows(spark, sf_dir).select("log_id", "session_id", "user_id", "created_at"))
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), "log_id", "session_id")
    return tag(audit.recent(log, 50), "recent").unionByName(
        tag(audit.recent(log, 50, F.col("user_id") == "u7"), "user")).unionByName(
        tag(audit.recent(log, 1, F.col("session_id") == "s9"), "session"))


QUERIES = {
    f.__name__: f
    for f in (
        query_normalise, query_tables, query_select_cols, query_flags, pii_columns, query_columns, query_context,
        access_level, context_hash, search_text, missing_dims, intent_class, vector_topk_l2, vector_topk_cosine,
        policy_rerank, policy_routing, semantic_category, reuse_exact, reuse_fuzzy, reuse_semantic, reuse_cascade,
        reuse_stats, audit_checks, block_guidance, final_decisions, escalations, governed_query, audit_log,
        audit_stats, audit_recent,
    )
}

# --- checking SQL ----------------------------------------------------------------------------------

_SPACES = "'' || " + " || ".join(f"chr({ord(c)})" for c in K.EDGE_SPACE)
_NORMAL = f"regexp_replace(lower(rtrim(trim(query, {_SPACES}), ';')), '\\s+', ' ', 'g')"
_LOG = {"ql": X.QUERY_LOG_SQL}
_KINDS = (  # per kind of text: selected columns, named tables, columns reached (with their table)
    ("*", "customer", [("customer", c) for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")]),
    ("", "orders", [("orders", c) for c in (
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")]),
    ("c_name,c_acctbal", "customer", [("customer", "c_name"), ("customer", "c_acctbal")]),
    ("o_orderkey,l_quantity", "orders,lineitem", [("lineitem", "l_quantity"), ("orders", "o_orderkey")]),
    ("s_name", "supplier", [("supplier", "s_name")]),
    ("", "part", [("part", c) for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")]),
)
_COLS_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({kind}, '{t}', '{c}', {'true' if c.endswith('_name') else 'false'})"
    for kind, (_, _, cols) in enumerate(_KINDS) for t, c in cols
) + ") AS v(kind, table_name, column_name, is_pii)"
_KIND_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({kind}, '{sel}', '{tabs}', '{','.join(sorted(tabs.split(',')))}', '{','.join(sorted(c for _, c in cols))}', "
    f"{'true' if any(c.endswith('_name') for _, c in cols) else 'false'}, {len(cols)})"
    for kind, (sel, tabs, cols) in enumerate(_KINDS)
) + ") AS v(kind, selected, tables, sorted_tables, sorted_columns, has_pii, n_columns)"
# Strings are one sign, comments none, functions with a FROM of their own too; then patterns tell tables and lists.
_CLEANED = {
    **_LOG,
    "texts": "SELECT query_id, 'logged' AS kind, query FROM ql UNION ALL " + _TEXTS_SQL,
    "cleaned": (
        "SELECT query_id, kind, regexp_replace(regexp_replace(regexp_replace(query, '--[^\\n]*|/\\*.*?\\*/', ' ', 'g'), "
        "'''[^'']*''', '0', 'g'), '(?i)extract\\([^()]*\\)', '0', 'g') AS clean FROM texts"),
    "listed": (
        "SELECT query_id, kind, regexp_extract(regexp_replace(clean, '(?i)\\(SELECT [^()]*(\\([^()]*\\)[^()]*)*\\)', '0', 'g'), "
        "'(?is)\\bSELECT\\s+(?:DISTINCT\\s+)?(.*?)\\s+FROM\\b', 1) AS clause FROM cleaned"),
}
_CTX_SQL = f"SELECT ql.*, {_NORMAL} AS norm, k.* FROM ql JOIN kinds k ON query_id % 6 = kind"
_CTX = {**_LOG, "kinds": _KIND_SQL, "ctx": _CTX_SQL}
_CATEGORIES = (  # by the columns reached
    "CASE kind WHEN 0 THEN 'name' WHEN 2 THEN 'name' WHEN 4 THEN 'name' WHEN 5 THEN 'name' ELSE '' END"
)
_MISSING = (
    "CASE kind WHEN 0 THEN ['PURPOSE', 'COLUMN_SCOPE', 'PII_JUSTIFICATION'] WHEN 3 THEN ['PURPOSE'] ELSE [] END"
)
_INTENT_SQL = f"""
SELECT query_id, CASE kind WHEN 0 THEN 'VAGUE' WHEN 3 THEN CASE WHEN is_clear THEN 'CLEAR' ELSE 'VAGUE' END
         ELSE 'CLEAR' END AS intent,
       CASE kind WHEN 0 THEN 0.95 WHEN 1 THEN 0.99 WHEN 3 THEN CASE WHEN is_clear THEN 0.75 ELSE 0.8 END ELSE 0.9 END
         AS intent_confidence,
       CASE kind WHEN 3 THEN 'llm_classified' ELSE 'rule_based' END AS intent_method,
       CASE WHEN kind = 3 AND NOT is_clear AND extra IS NOT NULL THEN ['PURPOSE', extra] ELSE {_MISSING} END AS missing
FROM ctx JOIN hints USING (query_id)
"""
_CLARIFY = "'" + K.CLARIFICATION_HEAD + "' || chr(10) || array_to_string(list_transform(missing, lambda d: CASE d " + " ".join(
    f"WHEN '{d}' THEN '{t}'" for d, t in K.CLARIFICATIONS.items()) + " END), chr(10))"
_INTENT = {**_CTX, "hints": _HINTS_SQL, "intents": _INTENT_SQL}

_EMB = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"
_POLICY_SQL = _POLICIES_SQL
_NEAR_SQL = """
SELECT a.vec_id AS vec_ref, b.vec_id AS item_id, list_cosine_similarity(a.e, b.e) AS score FROM emb a, emb b
WHERE b.label % 2 = 0
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.vec_id) <= 20
"""
_PRIVATE = " OR ".join(
    [f"contains(lower(rule_text), '{w}')" for w in (*K.CONCEPT_WORDS["pii"], *K.CONCEPT_WORDS["encryption"])]
    + ["rule_type = 'data_privacy'"])
_RANKED_SQL = f"""
SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (
  SELECT query_id, item_id, near.score
       + CASE WHEN contains(',' || sorted_columns || ',', ',' || target_column || ',') THEN 0.10 ELSE 0 END
       + CASE WHEN has_pii AND ({_PRIVATE}) THEN 0.08 ELSE 0 END
       + CASE WHEN stated_purpose IS NOT NULL AND (contains(lower(rule_text), 'quarterly') OR contains(lower(rule_text), 'fraud')
              OR contains(lower(rule_text), 'review')) THEN 0.05 ELSE 0 END AS score
  FROM ctx JOIN near USING (vec_ref) JOIN policies ON item_id = vec_id)
QUALIFY rank <= 5
"""
_RANKED = {**_CTX, "emb": _EMB, "policies": _POLICY_SQL, "near": _NEAR_SQL, "ranked": _RANKED_SQL}

_REQ_SQL = f"SELECT ql.*, {_NORMAL} AS norm, sha256({_NORMAL} || '|' || user_role) AS key, e FROM ql LEFT JOIN emb ON vec_ref = vec_id"
_ENT_SQL = """
SELECT entry_id, decision, created_at AS born, r.key, r.norm, r.user_role, r.e,
       least(created_at + to_seconds(ttl_seconds), lead(created_at) OVER (PARTITION BY r.key ORDER BY created_at)) AS dies
FROM told JOIN req r ON entry_id = query_id
"""
_LIVE = "r.user_role = n.user_role AND n.born < r.ts AND r.ts <= n.dies"
_EXACT_SQL = "SELECT query_id, entry_id, decision FROM req r JOIN ent n ON r.key = n.key AND n.born < r.ts AND r.ts <= n.dies"
_RATIO = "1.0 - CAST(levenshtein(r.norm, n.norm) AS DOUBLE) / greatest(length(r.norm), length(n.norm))"
_FUZZY_SQL = f"""
SELECT query_id, entry_id, decision FROM req r JOIN ent n ON {_LIVE}
  AND abs(length(r.norm) - length(n.norm)) <= 0.06 * greatest(length(r.norm), length(n.norm))
WHERE {_RATIO} >= 0.95
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n.born, n.key) = 1
"""
_SEMANTIC_SQL = f"""
SELECT query_id, entry_id, decision, score FROM (
  SELECT query_id, entry_id, decision, n.key, round(list_cosine_similarity(r.e, n.e), 12) AS score FROM req r JOIN ent n ON {_LIVE}
  WHERE r.e IS NOT NULL AND n.e IS NOT NULL)
WHERE score >= 0.92
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key, entry_id) = 1
"""
_CASCADE_SQL = """
SELECT req.query_id, coalesce(x.entry_id, f.entry_id, s.entry_id) AS entry_id,
       coalesce(x.decision, f.decision, s.decision) AS decision,
       CASE WHEN x.query_id IS NOT NULL THEN 'exact' WHEN f.query_id IS NOT NULL THEN 'fuzzy'
            WHEN s.query_id IS NOT NULL THEN 'semantic' ELSE 'miss' END AS layer
FROM req LEFT JOIN exact x USING (query_id) LEFT JOIN fuzzy f USING (query_id) LEFT JOIN semantic s USING (query_id)
"""
_REUSE = {
    **_LOG, "emb": _EMB, "told": X.DECISIONS_SQL, "req": _REQ_SQL, "ent": _ENT_SQL, "exact": _EXACT_SQL,
    "fuzzy": _FUZZY_SQL, "semantic": _SEMANTIC_SQL, "cascade": _CASCADE_SQL,
}

_VERDICT_SQL = """
SELECT reply_id AS query_id, ok, CASE WHEN ok AND upper(trim(j->>'decision')) = 'APPROVE' THEN 'APPROVE' ELSE 'BLOCK' END AS decision,
       CASE WHEN ok THEN j->'cited_policies'->>0 END AS cited, CASE WHEN ok THEN j->'sensitive_columns'->>0 END AS sensitive,
       CASE WHEN ok THEN j->'required_controls'->>0 ELSE 'manual_review' END AS control,
       CASE WHEN ok THEN j->>'reasoning' ELSE 'Verdict generation failed: Unparseable LLM response: ' || substr(t, 1, 200)
         || '. Blocking by default for safety.' END AS reasoning
FROM (SELECT reply_id, t, json_valid(t) AS ok, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM
      (SELECT reply_id, trim(replace(replace(text, '```json', ''), '```', ''), chr(10)) AS t FROM replies))
"""
_GUIDANCE = (
    f"'{K.GUIDANCE_HEAD}' || CASE WHEN control = 'mask_pii' THEN chr(10) || '{K.GUIDANCE_MASK}' ELSE '' END"
    f" || CASE WHEN control = 'log_access' THEN chr(10) || '{K.GUIDANCE_LOG}' ELSE '' END"
    f" || CASE WHEN sensitive IS NOT NULL THEN chr(10) || '{K.GUIDANCE_AVOID}' || sensitive ELSE '' END"
    f" || chr(10) || '{K.GUIDANCE_JUSTIFY}' || chr(10) || '{K.GUIDANCE_CONTACT}'"
)
_CHECKED_SQL = """
SELECT ctx.query_id, v.decision, v.control, v.sensitive, v.reasoning,
       CASE WHEN cited IS NOT NULL AND p.ids IS NOT NULL AND NOT list_contains(p.ids, cited) THEN cited ELSE '' END AS ungrounded,
       CASE WHEN sensitive IS NOT NULL AND NOT contains(',' || sorted_columns || ',', ',' || sensitive || ',')
            AND NOT contains(lower(query), sensitive) THEN sensitive ELSE '' END AS invented,
       CASE WHEN p.best >= 0.40 THEN 'CONFIDENT' ELSE 'UNCERTAIN' END AS policy_status
FROM ctx JOIN verdicts v USING (query_id) LEFT JOIN
  (SELECT query_id, list('p' || CAST(item_id AS STRING)) AS ids, max(score) AS best FROM ranked GROUP BY 1) p USING (query_id)
"""
_CHECKED = {**_RANKED, "replies": X.REPLIES_SQL, "verdicts": _VERDICT_SQL, "checked": _CHECKED_SQL}
_FINAL_SQL = f"""
SELECT query_id, nullif(layer, 'miss') AS cache_layer,
  CASE WHEN layer <> 'miss' THEN s.decision WHEN intent = 'VAGUE' THEN 'CLARIFICATION_REQUIRED'
       WHEN doubtful THEN coalesce(human_decision, 'ESCALATED') ELSE c.decision END AS final_decision,
  CASE WHEN layer <> 'miss' THEN CASE WHEN s.decision = 'BLOCK' THEN 'blocked before' END
       WHEN intent = 'VAGUE' THEN 'Query is too vague to evaluate. Missing: ' || array_to_string(missing, ', ')
       WHEN doubtful THEN CASE WHEN human_decision = 'BLOCK' THEN human_reasoning END
       WHEN c.decision = 'BLOCK' THEN reasoning END AS block_reason,
  CASE WHEN layer <> 'miss' THEN NULL WHEN intent = 'VAGUE' THEN {_CLARIFY} WHEN doubtful THEN NULL
       WHEN c.decision = 'APPROVE' THEN 'Applied controls: ' || control ELSE {_GUIDANCE} END AS guidance
FROM (SELECT *, policy_status = 'UNCERTAIN' OR ungrounded <> '' OR invented <> '' AS doubtful FROM checked) c
  JOIN cascade s USING (query_id) JOIN intents USING (query_id) LEFT JOIN human USING (query_id)
"""
_FINAL = {**_REUSE, **_CHECKED, **_INTENT, "human": _HUMAN_SQL, "final": _FINAL_SQL}
_AUDIT_SQL = """
SELECT sha256(CAST(query_id AS STRING) || '|' || session_id) AS log_id, session_id, query, user_id, user_role, stated_purpose,
       ts AS created_at, final_decision AS decision,
       CASE WHEN ok THEN '["' || cited || '"]' ELSE '[]' END AS cited_policies,
       CASE WHEN ok THEN '["' || sensitive || '"]' ELSE '[]' END AS sensitive_cols, '["' || control || '"]' AS required_ctrls,
       cache_layer IS NOT NULL AS cache_hit, cache_layer,
       CASE WHEN cache_layer IS NULL THEN length(query) / 1000.0 ELSE 0.0 END AS total_cost_usd,
       CAST(length(query) AS DOUBLE) AS processing_ms
FROM ql JOIN final USING (query_id) JOIN verdicts USING (query_id)
"""
_AUDIT = {**_FINAL, "audit": _AUDIT_SQL}
_PII_NAMES = "(" + ", ".join(f"'{n}'" for n in K.PII_NAMES) + ")"

ORACLE = {
    "query_normalise": X.with_cte(f"SELECT query_id, {_NORMAL} AS normalised FROM ql", **_LOG),
    "query_tables": X.with_cte(
        "SELECT query_id, kind, lower(array_to_string(list_transform(regexp_extract_all(clean, "
        "'(?i)\\b(?:FROM|JOIN|INTO|UPDATE)\\s+(?:\\w+|\"[^\"]+\")'), "
        "lambda x: trim(regexp_replace(x, '^\\w+\\s+', ''), '\"')), ',')) AS tables FROM cleaned", **_CLEANED),
    "query_select_cols": X.with_cte(
        "SELECT query_id, kind, CASE WHEN clause = '*' THEN '*' ELSE lower(array_to_string(list_transform(list_filter("
        "string_split(clause, ','), lambda i: i <> '' AND NOT regexp_matches(i, '(?i)^\\s*(count|sum|avg|min|max)\\s*\\(.*\\*')), "
        "lambda i: CASE WHEN contains(i, '\"') THEN regexp_extract(i, '\"([^\"]+)\"', 1) ELSE regexp_extract(i, '(\\w+)\\)*\\s*$', 1) END), "
        "',')) END AS columns FROM listed", **_CLEANED),
    "query_flags": X.with_cte(
        "SELECT query_id, kind IN (2, 4) AS has_where, kind = 1 AS has_aggregation, kind = 0 AS select_star, kind <> 5 AS "
        "read_only FROM ctx", **_CTX),
    "pii_columns": (
        "SELECT c.table_name, column_name, row_count, contains(column_name, 'name') OR contains(column_name, 'account') OR "
        f"contains(column_name, 'email') OR contains(column_name, 'phone') OR contains(column_name, 'ssn') OR column_name IN {_PII_NAMES} "
        "AS is_pii, concat_ws(',', CASE WHEN contains(column_name, 'name') THEN 'name' END) AS categories "
        "FROM information_schema.columns c JOIN (" + " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in X.KEYS) + ") n ON c.table_name = n.table_name"),
    "query_columns": X.with_cte(
        "SELECT query_id, table_name, column_name, is_pii, CASE WHEN is_pii THEN 'confidential' ELSE 'internal' END AS "
        "classification FROM ql JOIN cols ON query_id % 6 = kind", **_LOG, cols=_COLS_SQL),
    "query_context": X.with_cte(
        "SELECT query_id, has_pii, CASE WHEN has_pii THEN 'restricted' ELSE 'internal' END AS max_classification, "
        f"{_CATEGORIES} AS categories, n_columns FROM ctx", **_CTX),
    "access_level": X.with_cte(
        "SELECT query_id, CASE user_role WHEN 'analyst' THEN 3 WHEN 'compliance_officer' THEN 5 WHEN 'marketing' THEN 2 "
        "ELSE 1 END AS access_level FROM ql", **_LOG),
    "context_hash": X.with_cte(
        "SELECT query_id, sha256(norm || '|' || user_role || '|' || sorted_tables || '|' || sorted_columns) AS context_hash "
        "FROM ctx", **_CTX),
    "search_text": X.with_cte(
        f"SELECT query_id, query || ' ' || coalesce(stated_purpose, '') || CASE WHEN {_CATEGORIES} <> '' THEN "
        f"' PII categories: ' || {_CATEGORIES} ELSE '' END AS text FROM ctx", **_CTX),
    "missing_dims": X.with_cte(f"SELECT query_id, array_to_string({_MISSING}, ',') AS missing FROM ctx", **_CTX),
    "intent_class": X.with_cte(
        "SELECT query_id, intent, CAST(intent_confidence AS DOUBLE) AS intent_confidence, intent_method, "
        f"array_to_string(missing, ',') AS missing, CASE WHEN intent = 'VAGUE' THEN {_CLARIFY} END AS clarification FROM intents",
        **_INTENT),
    "vector_topk_l2": X.with_cte(
        "SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_distance(a.e, b.e), 6) AS distance, CAST(row_number() OVER "
        "(PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS INT) AS rank FROM emb a, emb b QUALIFY rank <= 10",
        emb=_EMB),
    "vector_topk_cosine": X.with_cte(
        "SELECT vec_ref AS query_id, item_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY vec_ref ORDER BY "
        "near.score DESC, item_id) AS INT) AS rank FROM near QUALIFY rank <= 10 AND near.score >= 0.2", emb=_EMB, near=_NEAR_SQL),
    "policy_rerank": X.with_cte(
        "SELECT query_id, item_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM ranked", **_RANKED),
    "policy_routing": X.with_cte("SELECT query_id, policy_status FROM checked", **_CHECKED),
    "semantic_category": X.with_cte(
        "SELECT id, category, round(score, 6) AS score FROM (SELECT vec_id AS id, category, list_cosine_similarity(e, m) AS score "
        "FROM emb, means) QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(score, 12) DESC, category) = 1 AND score > 0.3",
        emb=_EMB,
        means="SELECT label, CASE label " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(K.SEMANTIC_CATEGORIES))
        + " END AS category, list(x ORDER BY i) AS m FROM (SELECT label % 9 AS label, i, avg(e[i]) AS x FROM emb, range(1, 65) AS r(i) "
        "GROUP BY 1, 2) GROUP BY label"),
    "reuse_exact": X.with_cte("SELECT * FROM exact", **_REUSE),
    "reuse_fuzzy": X.with_cte("SELECT * FROM fuzzy", **_REUSE),
    "reuse_semantic": X.with_cte("SELECT query_id, entry_id, decision, round(score, 6) AS score FROM semantic", **_REUSE),
    "reuse_cascade": X.with_cte("SELECT * FROM cascade", **_REUSE),
    "reuse_stats": X.with_cte(
        "SELECT count(*) AS total_lookups, count(*) FILTER (WHERE layer = 'exact') AS exact_hits, count(*) FILTER (WHERE layer = "
        "'fuzzy') AS fuzzy_hits, count(*) FILTER (WHERE layer = 'semantic') AS semantic_hits, count(*) FILTER (WHERE layer = 'miss') "
        "AS misses, round(CAST(count(*) FILTER (WHERE layer <> 'miss') AS DOUBLE) / count(*), 9) AS hit_rate FROM cascade", **_REUSE),
    "audit_checks": X.with_cte(
        "SELECT query_id, true AS json_valid, true AS decision_valid, ungrounded = '' AS citations_grounded, invented = '' AS "
        "columns_valid, ungrounded, invented, ungrounded = '' AND invented = '' AS checks_passed FROM checked", **_CHECKED),
    "block_guidance": X.with_cte(
        f"SELECT query_id AS reply_id, {_GUIDANCE} AS guidance FROM verdicts", replies=X.REPLIES_SQL, verdicts=_VERDICT_SQL),
    "final_decisions": X.with_cte("SELECT * FROM final", **_FINAL),
    "escalations": X.with_cte(
        "SELECT f.query_id, user_role, c.decision AS preliminary_decision, concat_ws(',', CASE WHEN ungrounded <> '' THEN "
        "'citations_grounded' END, CASE WHEN invented <> '' THEN 'columns_valid' END) AS failed FROM final f JOIN checked c "
        "USING (query_id) JOIN ql USING (query_id) WHERE final_decision = 'ESCALATED'", **_FINAL),
    "governed_query": "SELECT o_orderkey, true AS truncated FROM orders ORDER BY o_orderkey LIMIT 1000",
    "audit_log": X.with_cte("SELECT * EXCLUDE (created_at) FROM audit", **_AUDIT),
    "audit_stats": X.with_cte(
        "SELECT count(*) AS total_decisions, count(*) FILTER (WHERE decision = 'APPROVE') AS approved, count(*) FILTER (WHERE "
        "decision = 'BLOCK') AS blocked, count(*) FILTER (WHERE decision NOT IN ('APPROVE', 'BLOCK')) AS escalated, "
        "round(CAST(count(*) FILTER (WHERE cache_hit) AS DOUBLE) / count(*), 9) AS cache_hit_rate, "
        "round(avg(total_cost_usd) FILTER (WHERE NOT cache_hit), 4) AS avg_cost_usd, "
        "round(avg(processing_ms) FILTER (WHERE NOT cache_hit), 1) AS avg_latency_ms FROM audit", **_AUDIT),
    "audit_recent": X.with_cte(
        "SELECT * FROM (SELECT 'recent' AS kind, log_id, session_id FROM audit ORDER BY created_at DESC LIMIT 50) UNION ALL "
        "SELECT * FROM (SELECT 'user', log_id, session_id FROM audit WHERE user_id = 'u7' ORDER BY created_at DESC LIMIT 50) "
        "UNION ALL SELECT * FROM (SELECT 'session', log_id, session_id FROM audit WHERE session_id = 's9' "
        "ORDER BY created_at DESC LIMIT 1)", **_AUDIT),
}
