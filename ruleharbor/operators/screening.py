"""The request gate as one call: context, intent, policies, verdict checks, reuse and final decision.

Every step is a function over the requests and stays usable by itself; ``gate_requests`` puts them
together. Model replies, vectors and human answers are input tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleharbor.functions import fixed_values as K
from ruleharbor.functions.replies import parse_verdict
from ruleharbor.functions.text import concept_tags
from ruleharbor.operators import gate, reuse, vectors


@dataclass(frozen=True)
class GateInputs:
    """The tables a gate works with.

    * ``catalog``: table_name, column_name, ..
    * ``policies``: id (whole number), embedding, target_column, rule_text, rule_type
    * ``embeddings``: id, embedding; a request names its vector by ``vec_ref``
    * ``replies``: query_id, text: a model's verdict for a request
    * ``clear_replies`` (optional): query_id, is_clear, additional_missing
    * ``human`` (optional): query_id, human_decision, human_reasoning
    * ``entries`` (optional): stored decisions, see ``reuse``
    """

    catalog: DataFrame
    policies: DataFrame
    embeddings: DataFrame
    replies: DataFrame
    clear_replies: DataFrame | None = None
    human: DataFrame | None = None
    entries: DataFrame | None = None


def with_intent(requests: DataFrame, inputs: GateInputs) -> DataFrame:
    """Requests with the tables, columns and personal data they touch, and their intent."""
    return gate.add_intent(gate.add_context(requests, inputs.catalog), inputs.clear_replies)


def with_policies(asked: DataFrame, inputs: GateInputs, retrieve: int = K.RETRIEVE_K) -> DataFrame:
    """Requests with their best policies. Vectors that requests name are compared once each, however many share one."""
    rules = inputs.policies.withColumn("concepts", concept_tags(F.col("rule_text"), F.col("rule_type")))
    about = rules.select(F.col("id").alias("item_id"), "target_column", "rule_text", "concepts")
    wanted = inputs.embeddings.join(asked.select(F.col("vec_ref").alias("id")).distinct(), "id", "left_semi")
    near = vectors.hit_lists(vectors.top_k(wanted, rules.select("id", "embedding"), retrieve), about)
    ranked = vectors.rerank(
        F.col("hits"), F.col("queried_columns"), F.size("pii_categories") > 0, F.col("stated_purpose"))
    return asked.join(near.withColumnRenamed("query_id", "vec_ref"), "vec_ref", "left").withColumn(
        "policies", ranked).drop("hits")


def with_checks(rated: DataFrame, inputs: GateInputs, policy_name: Column | None = None) -> DataFrame:
    """Requests with the verdict of their reply and its checks. ``policy_name`` names policy ``p`` in replies."""
    # Replies are read behind the join: as many tasks share the work as it has parts, however few parts the table has.
    replies = inputs.replies.select("query_id", F.struct("text").alias("reply"))
    named = F.transform("policies", lambda p: F.concat(F.lit("p"), p["item_id"])) if policy_name is None else policy_name
    told = rated.withColumns({
        "policy_confidence": F.get("policies", F.lit(0))["score"], "policy_ids": named,
    }).join(replies, "query_id", "left").withColumn(
        "verdict", F.when(F.col("reply").isNotNull(), parse_verdict(F.col("reply.text")))).drop("reply")
    return gate.audit_checks(told.withColumn("policy_status", gate.policy_status(F.col("policy_confidence"))))


def with_reuse(checked: DataFrame, requests: DataFrame, inputs: GateInputs) -> DataFrame:
    """Requests with the stored decision that answers them, where one does. ``requests`` hold key and vector."""
    if inputs.entries is None:
        none = F.lit(None).cast("string")
        cached = checked.withColumns({"cache_layer": none, "cached_decision": none})
    else:
        answers = reuse.reuse_cascade(requests, inputs.entries).select(
            "query_id", F.nullif("layer", F.lit("miss")).alias("cache_layer"), F.col("decision").alias("cached_decision"))
        cached = checked.join(answers, "query_id")
    return cached.withColumns({
        "cached_reason": F.when(F.col("cached_decision") == "BLOCK", "blocked before"),
        "cached_guidance": F.lit(None).cast("string"),
    })


def gate_requests(requests: DataFrame, inputs: GateInputs) -> DataFrame:
    """One row per request with its final decision, block reason and guidance.

    ``requests``: query_id, query, user_id, user_role, stated_purpose, ts, vec_ref.
    """
    vecs = inputs.embeddings.select(F.col("id").alias("vec_ref"), "embedding")
    keyed = reuse.with_key(requests).join(vecs, "vec_ref", "left")
    checked = with_checks(with_policies(with_intent(keyed, inputs), inputs), inputs)
    human = inputs.human
    if human is None:
        human = checked.sparkSession.createDataFrame(
            [], f"query_id {checked.schema['query_id'].dataType.simpleString()}, human_decision string, human_reasoning string")
    return gate.decide(with_reuse(checked, keyed, inputs), human)
