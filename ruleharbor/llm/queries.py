"""Registered queries of the operators and their checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleharbor.llm import (
    alignment,
    chat,
    decontaminate,
    divergence,
    exact_dedup,
    langid,
    licenses,
    minhash,
    mixing,
    quality,
    simhash,
    toxicity,
    url_rules,
)
from ruleharbor.llm.common import id_remainder, table


def op1_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every document in the mixed order: doc_id, source, copy number and order key."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.replicate(documents).select(
        "doc_id", "source", F.col("__copy").alias("copy"), F.col("__order").alias("order_key"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(id_remainder(5) == 0, F.lit(False)).alias("held_out"),
                         F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that the document holds."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = langid.label(table(spark, sf_dir, "documents"))
    return labelled.select("doc_id", F.coalesce(id_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(id_remainder(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, paths = chat.tree(chat.with_probe(spark, table(spark, sf_dir, "conversations")))
    return chat.read_back(nodes, paths)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_poisson_mix, op2_quality, op3_url_rules, op4_licenses, op5_exact_dedup, op6_decontaminate, op7_simhash,
    op8_language, op9_toxicity, op10_chat_tree, op11_alignment, op12_divergence, op13_minhash)}

ORACLE = {
    "op1_poisson_mix": f"""
WITH RECURSIVE sizes AS (
  SELECT source, sum(coalesce(length(text), 0) + 1)::DOUBLE AS size FROM documents GROUP BY source),
rated AS (
  SELECT source, pow(size, {mixing.POWER}) / sum(pow(size, {mixing.POWER})) OVER () * sum(size) OVER () / size AS rate
  FROM sizes),
terms AS (
  SELECT source, rate, 0 AS k, 0.0::DOUBLE AS logf, exp(-rate) AS total FROM rated
  UNION ALL
  SELECT source, rate, k + 1, logf + ln(k + 1.0::DOUBLE), total + exp((k + 1) * ln(rate) - rate - (logf + ln(k + 1.0::DOUBLE)))
  FROM terms WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
drawn AS (
  SELECT doc_id, source,
    ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents),
counts AS (
  SELECT d.doc_id, d.source, d.u, count(t.k) AS n FROM drawn d
  JOIN terms t ON d.source IS NOT DISTINCT FROM t.source AND t.total <= d.u GROUP BY ALL)
SELECT doc_id, source, copy::INTEGER AS copy,
  md5('{mixing.SEED}:order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy::VARCHAR) AS order_key
FROM (SELECT doc_id, source, unnest(range(n)) AS copy FROM counts)""",
    "op5_exact_dedup": r"""
WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY content) AS keep_id, count(*) OVER (PARTITION BY content) AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY content) AS kept, sha256(content) AS text_sha256
FROM texts""",
    "op12_divergence": rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
words AS (SELECT row_id, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row_id) >= {divergence.LEAST_DOCUMENTS}),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
parts AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
wide AS (
  SELECT p.lang, p.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY p.lang, p.source) AS total, s.v
  FROM parts p JOIN kept k ON p.lang = k.lang JOIN sizes s ON s.lang = p.lang
  LEFT JOIN counts c ON c.lang = p.lang AND c.source = p.source AND c.term = k.term),
shares AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (total + v)::HUGEINT AS p FROM wide),
whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v)::HUGEINT AS q
  FROM (SELECT lang, term, sum(n) AS n, any_value(v) AS v FROM wide GROUP BY lang, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, 'pair' AS part FROM parts a JOIN parts b ON a.lang = b.lang AND a.source <> b.source),
far AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
telling AS (
  SELECT a.lang, a.source, 'term' AS part, a.term AS item, ((a.p - w.q) * (a.p - w.q)) // w.q AS value
  FROM shares a JOIN whole w ON a.lang = w.lang AND a.term = w.term WHERE a.n > 0 AND a.p > w.q),
rows AS (
  SELECT p.lang, p.source, p.part, p.item, coalesce(f.value, 0)::BIGINT AS value
  FROM pairs p LEFT JOIN far f ON p.lang = f.lang AND p.source = f.source AND p.item = f.item
  UNION ALL SELECT lang, source, part, item, value::BIGINT FROM telling),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM rows)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.MOST_TERMS}""",
}
