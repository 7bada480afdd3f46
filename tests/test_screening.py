from pyspark.sql import functions as F

from ruleharbor.operators import screening, vectors


def test_only_vectors_that_requests_name_are_searched(spark, monkeypatch):
    searched = []
    plain = vectors.top_k

    def watched(queries, *more, **named):
        searched.append(sorted(r["id"] for r in queries.collect()))
        return plain(queries, *more, **named)

    monkeypatch.setattr(vectors, "top_k", watched)
    held = spark.range(12).select("id", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    policies = held.select("id", "embedding", F.lit("c").alias("target_column"), F.lit("t").alias("rule_text"), F.lit("data_quality").alias("rule_type"))
    asked = spark.createDataFrame(
        [(1, 3, ["c"], [], None), (2, 3, [], [], "audit work"), (3, 7, [], [], None), (4, 99, [], [], None), (5, None, [], [], None)],
        "query_id long, vec_ref long, queried_columns array<string>, pii_categories array<string>, stated_purpose string")
    given = screening.GateInputs(catalog=None, policies=policies, embeddings=held, replies=None)
    told = {r["query_id"]: r["policies"] for r in screening.with_policies(asked, given).collect()}
    assert searched == [[3, 7]]
    assert told[1][0]["item_id"] == 3 and told[3][0]["item_id"] == 7 and len(told) == 5
    assert told[4] is None and told[5] is None


def test_replies_are_read_behind_their_join(spark):
    """A table of few parts is then no bound on the tasks that read; no reply is no verdict, an empty one blocks."""
    policies = "array<struct<item_id:long,score:double>>"
    rated = spark.createDataFrame(
        [(i, "select c from t", ["c"], [(7, 0.9)]) for i in (1, 2, 3, 4)], f"query_id long, query string, queried_columns array<string>, policies {policies}")
    text = '{"decision": "approve", "reasoning": "r", "cited_policies": ["p7"], "sensitive_columns": [], "required_controls": []}'
    replies = spark.createDataFrame([(1, text), (2, "no json"), (3, None), (1, "again")], "query_id long, text string")
    given = screening.GateInputs(catalog=None, policies=None, embeddings=None, replies=replies)
    checked = screening.with_checks(rated, given)
    got = sorted((r["query_id"], r["verdict"] and r["verdict"]["decision"], r["verdict"] and r["verdict"]["cited_policies"])
                 for r in checked.collect())
    assert got == [(1, "APPROVE", ["p7"]), (1, "BLOCK", []), (2, "BLOCK", []), (3, "BLOCK", []), (4, None, None)]
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" in plan.split("Join", 1)[0] and "from_json" not in plan.split("Join", 1)[1]


def test_hits_are_sorted_by_their_own_order(spark):
    """Ties go by id; no comparison function runs per pair of hits, and no pattern is compiled per row."""
    hits = spark.createDataFrame(
        [(1, [(4, 0.5, "a", "x", False), (2, 0.5, "b", "long words", False), (9, 0.4, "c", "y", True)]), (2, None)],
        "id long, hits array<struct<item_id:long,score:double,column:string,text:string,private:boolean>>")
    best = vectors.rerank(F.col("hits"), F.array(F.lit("c")), F.lit(False), F.lit(" of\tLONG\n"), 3)
    ranked = hits.select("id", best.alias("best"))
    got = {r["id"]: r["best"] and [h["item_id"] for h in r["best"]] for r in ranked.collect()}
    assert got == {1: [2, 4, 9], 2: None}
    plan = hits.select(vectors.rerank(F.col("hits"), F.array("id").cast("array<string>"), F.col("id") > 1, F.col("id").cast("string"))
                       )._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "split(" not in plan
