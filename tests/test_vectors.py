import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleharbor.operators import cells as C
from ruleharbor.operators import vectors as V


def frame(spark, matrix, first=0):
    rows = [(first + i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)


def by_definition(queries, items, k, metric):
    out = {}
    for qi, q in enumerate(queries):
        if metric == "l2":
            order = sorted(range(len(items)), key=lambda i: (np.linalg.norm(items[i] - q), i))
        else:
            score = lambda i: float(items[i] @ q / (np.linalg.norm(items[i]) * np.linalg.norm(q)))
            order = sorted(range(len(items)), key=lambda i: (-score(i), i))
        out[qi] = order[:k]
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("block_rows", [1000, 30, 7])  # items held, queries held, both in blocks
def test_all_strategies_find_the_same(spark, metric, block_rows):
    rng = np.random.default_rng(5)
    queries = rng.normal(size=(20, 8)).astype(np.float32).astype(float)
    items = rng.normal(size=(45, 8)).astype(np.float32).astype(float)
    out = V.top_k(frame(spark, queries), frame(spark, items), 4, metric, block_rows=block_rows)
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["item_id"])
    assert got == by_definition(queries, items, 4, metric)


def clustered(rng, n, spread=0.05, centres=30, dim=16):
    middle = np.random.default_rng(1).normal(size=(centres, dim))
    return middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_two_rounds_find_the_same_and_leave_most_cells_out(spark, metric):
    rng = np.random.default_rng(8)
    queries, items = clustered(rng, 60), clustered(rng, 900)
    queries[0], items[5], items[6] = 0, 0, 0  # of length zero
    items[10:20] = items[9]
    queries[1] = items[9]
    out = V.top_k(frame(spark, queries), frame(spark, items), 7, metric, block_rows=30)
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["item_id"])
    kept = frame(spark, items).collect()  # as floats of 32 bits
    near = np.array([r["embedding"] for r in sorted(kept, key=lambda r: r["id"])])
    asked = np.array([r["embedding"] for r in sorted(frame(spark, queries).collect(), key=lambda r: r["id"])])
    for i, q in enumerate(asked):
        if metric == "l2":
            score = -np.sqrt(((near - q) ** 2).sum(axis=1))
        else:
            norms = np.linalg.norm(near, axis=1) * np.linalg.norm(q)
            score = np.divide(near @ q, norms, out=np.zeros(len(near)), where=norms > 0)
        want = sorted(range(len(near)), key=lambda j: (-round(score[j], 9), j))[:7]
        assert [round(score[j], 9) for j in got[i]] == [round(score[j], 9) for j in want]
        assert sorted(got[i]) == sorted(want) or metric == "l2" or i

    index = C.build(frame(spark, items), metric, 30)
    assert index.cells > 15
    asked = frame(spark, queries).where("id > 0")
    first = V.first_cells(asked, index, 7)
    hits = V.top_rows(V._meet(first, C.with_cell(frame(spark, items), index), 7, metric, 30), ["query_id"],
                      [F.col("score").desc() if metric == "cosine" else F.col("score"), "item_id"], 7)
    met = first.count() + V.other_cells(asked, hits, index, 7).count()
    assert met < 0.25 * 59 * index.cells


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_bounds_hold_for_every_vector_of_a_cell(spark, metric):
    rng = np.random.default_rng(2)
    items, points = rng.normal(size=(400, 6)), rng.normal(size=(50, 6))
    items[:100] *= 0.1
    index = C.build(frame(spark, items), metric, 20)
    stored = np.array([r["embedding"] for r in frame(spark, items).collect()])
    inside, at = index.cell_of(stored), C.placed(points, metric)
    away = C.distances(at, C.placed(stored, metric))
    least = index.least(at)
    for cell in range(index.cells):
        assert (away[:, inside == cell] >= least[:, [cell]]).all()
        assert (inside == cell).sum() == index.count[cell]
    reach = np.full(50, 0.7)
    for i, cells in enumerate(index.within(points, reach)):
        assert set(inside[away[i] <= 0.7]) <= set(cells)
    assert all(index.count[c].sum() >= 30 for c in index.nearest(points, 30))


def test_equal_vectors_are_one_cell_of_many_parts(spark):
    items = np.vstack([np.ones((300, 3)), np.eye(3), 2 * np.eye(3)])
    index = C.build(frame(spark, items), "l2", 40)
    assert index.cells <= 7 and index.count.sum() == 306
    out = V.top_k(frame(spark, np.ones((5, 3))), frame(spark, items), 4, "l2", block_rows=40)
    assert sorted((r["query_id"], r["item_id"]) for r in out.collect()) == [(q, i) for q in range(5) for i in range(4)]


def test_no_items_and_fewer_than_k(spark):
    none = frame(spark, np.eye(3)).where("id < 0")
    assert V.top_k(frame(spark, np.eye(3)), none, 2).count() == 0
    assert V.top_k(none, frame(spark, np.eye(3)), 2).count() == 0
    assert V.top_k(frame(spark, np.eye(3)), frame(spark, np.eye(3)), 9, block_rows=1).count() == 9


def test_a_third_of_equal_vectors(spark):
    items = np.vstack([np.ones((40, 4)), np.eye(4)])
    out = V.top_k(frame(spark, np.ones((3, 4))), frame(spark, items), 5, block_rows=10)
    assert sorted((r["query_id"], r["item_id"]) for r in out.collect()) == [(q, i) for q in range(3) for i in range(5)]


def test_single_vector_search(spark):
    items = frame(spark, [[0, 0], [3, 4], [1, 0], [0, 2]]).withColumnRenamed("id", "item_id").withColumn(
        "framework", F.when(F.col("item_id") == 2, "GDPR").otherwise("AML"))
    near = V.search_l2(items, [0.0, 0.0], 3).collect()
    assert [(r["item_id"], r["score"]) for r in near] == [(0, 0.0), (2, 1.0), (3, 2.0)]
    assert [r["item_id"] for r in V.search_l2(items, [0.0, 0.0], 3, F.col("framework") == "AML").collect()] == [0, 3, 1]
    alike = V.search_cosine(items, [1.0, 0.0], 10, min_score=0.5, framework="AML").collect()
    assert [(r["item_id"], round(r["score"], 6)) for r in alike] == [(1, 0.6)]
    assert [r["item_id"] for r in V.search_cosine(items, [1.0, 0.0], 2).collect()] == [2, 1]


def test_rerank(spark):
    hits = spark.createDataFrame(
        [(1, 10, 0.5, "c_name", "Fraud check", ["pii"]), (1, 11, 0.6, "x", "nothing", ["aml"]),
         (1, 12, 0.55, "y", "for a quarterly report", ["aml"])],
        "query_id long, item_id long, score double, target_column string, rule_text string, concepts array<string>")
    lists = V.hit_lists(hits.select("query_id", "item_id", "score"), hits.drop("query_id", "score"))
    best = V.rerank(F.col("hits"), F.array(F.lit("c_name")), F.lit(True), F.lit("the Quarterly FRAUD run"), 2)
    got = [(h["item_id"], round(h["score"], 6)) for h in lists.select(best).first()[0]]
    assert got == [(10, 0.73), (11, 0.6)] or got == [(10, 0.73), (12, 0.6)]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_a_query_is_sent_once_to_the_cells_of_a_zone(spark, metric):
    rng = np.random.default_rng(4)
    items = rng.normal(size=(900, 16))  # without structure: all cells are in reach
    items[:600] = items[0]  # a cell of several zones
    held = frame(spark, items)
    index = C.build(held, metric, 10)
    inside = C.with_cell(held, index)
    zones = C.zones(inside, index, 160)
    assert index.cells > 50 and zones.parts.max() == 4
    assert (zones.zone + zones.parts).max() <= 7
    kept = np.array([r["embedding"] for r in sorted(held.collect(), key=lambda r: r["id"])])
    found = V.top_k(held.where("id % 9 = 0"), held, 5, metric, block_rows=10)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((round(r["score"], 9), r["item_id"]))
    for q in range(0, 900, 9):
        if metric == "l2":
            score = np.sqrt(((kept - kept[q]) ** 2).sum(axis=1))
        else:
            score = -(kept @ kept[q]) / np.linalg.norm(kept, axis=1) / np.linalg.norm(kept[q])
        want = sorted((round(float(s), 9), i) for i, s in enumerate(score))[:5]
        assert [i for _, i in got[q]] == [i for _, i in want]
