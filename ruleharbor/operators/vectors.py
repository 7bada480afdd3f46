"""Exact vector search.

One vector against a table is a plain projection and ``orderBy.limit``. Many vectors against a table go
through a metric index (``cells``) in two rounds. First each vector meets the nearest cells that hold
``k`` items, which gives its ``k``-th best score so far; then it meets the other cells that may still hold
something as good, and no more. Cells meet their queries by zones, groups of neighbouring cells: a query is sent
once to a zone and not to each of its cells. Rows meet in pairs of blocks of bounded size, each one group that returns its
best ``k`` per query, in the second round only what reaches the ``k``-th best of the first, and never all pairs. Up to
``BLOCK_ROWS`` items are a single cell and one round.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleharbor.functions import fixed_values as K
from ruleharbor.functions.expr import let
from ruleharbor.functions.ordering import top_rows
from ruleharbor.operators import cells
from ruleharbor.operators.cells import matrix
from ruleharbor.session import cut_lineage

BLOCK_ROWS = 2048
ZONE_CELLS = 16  # full cells of a zone
ZONE_NUMBERS = 1 << 21  # numbers of the vectors of a zone: fewer rows of long vectors
QUERY_PART = 4  # a zone meets so many times fewer queries at a time than it holds vectors
SCORES = 1 << 21  # of a matrix product
PAIRS = 1 << 16  # scored exactly at a time
HIT_SCHEMA = "query_id long, item_id long, score double, rank int"


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x * x))


def search_l2(
    items: DataFrame, vector: Sequence[float], k: int = K.L2_K, where: Column | None = None
) -> DataFrame:
    """The ``k`` rows nearest to one vector; ``where`` restricts the rows searched."""
    rows = items if where is None else items.where(where)
    target = F.array(*[F.lit(float(v)) for v in vector])
    return rows.withColumn("score", euclidean(F.col("embedding"), target)).orderBy("score", "item_id").limit(k)


def search_cosine(
    items: DataFrame, vector: Sequence[float], k: int = 10, min_score: float = 0.0, framework: str | None = None
) -> DataFrame:
    """The ``k`` rows most alike to one vector, then those of at least ``min_score``."""
    rows = items if framework is None else items.where(F.col("framework") == framework)
    target = F.array(*[F.lit(float(v)) for v in vector])
    scored = rows.withColumn("score", cosine(F.col("embedding"), target))
    return scored.orderBy(F.col("score").desc(), "item_id").limit(k).where(F.col("score") >= min_score)


# --- many against many -----------------------------------------------------------------


def score_matrix(queries: np.ndarray, items: np.ndarray, metric: str) -> np.ndarray:
    """Pairwise scores, larger is better (distances are negated and squared), up to rounding."""
    products = queries @ items.T
    if metric == "l2":
        squares = [np.einsum("ij,ij->i", m, m) for m in (queries, items)]
        return 2 * products - squares[0][:, None] - squares[1][None, :]
    norms = np.outer(np.linalg.norm(queries, axis=1), np.linalg.norm(items, axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norms > 0, products / norms, 0.0)


def _exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Scores of paired rows; the same for a pair wherever it stands."""
    if metric == "l2":
        return -np.sqrt(((a - b) ** 2).sum(axis=1))
    norms = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norms > 0, (a * b).sum(axis=1) / norms, 0.0)


def _best(query_ids: np.ndarray, queries: np.ndarray, item_ids: np.ndarray, items: np.ndarray, k: int, metric: str,
          looks: np.ndarray | None = None, place: np.ndarray | None = None, reach: np.ndarray | None = None) -> pa.Table:
    """The best ``k`` items per query within one block, ranked; equal scores go to the smaller id.

    The matrix product finds all pairs that may be among the best, up to its rounding; these are scored exactly.
    A query meets an item only if ``looks`` (flags per query) has the item's ``place``. Where its ``reach`` is
    known (a distance in metric space), items beyond it are left out.
    """
    found: list[tuple[np.ndarray, ...]] = []
    order = np.argsort(item_ids, kind="stable")
    item_ids, items = item_ids[order], items[order]
    place = None if place is None else place[order]
    step = max(1, min(512, SCORES // max(1, len(items))))
    for at in range(0, len(query_ids), step):
        some, known, own_ids = queries[at:at + step], items, item_ids
        barred = None
        if looks is not None:
            met = looks[at:at + step].any(axis=0)[place]
            known, own_ids = (items, item_ids) if met.all() else (items[met], item_ids[met])
            barred = ~looks[at:at + step][:, place[met]]
        if not len(known):
            continue
        rough = score_matrix(some, known, metric)
        kept = min(k, rough.shape[1])
        slack = 1e-11 * (1 + np.abs(rough).max(axis=1, keepdims=True) + (some * some).sum(axis=1, keepdims=True))
        if barred is not None:
            rough[barred] = -np.inf
        bar = np.full((len(some), 1), -np.inf)
        if reach is not None:
            squared = reach[at:at + step, None] ** 2
            bar = (-squared if metric == "l2" else 1 - squared / 2) - 1e-9 * (1 + squared)
            bar[~np.isfinite(squared)] = -np.inf
        free = np.flatnonzero(np.isneginf(bar))
        bar[free] = np.partition(rough[free], -kept, axis=1)[:, [-kept]]
        row, col = np.nonzero((rough >= bar - slack) & (rough > -np.inf))
        score = np.concatenate([_exact(some[row[i:i + PAIRS]], known[col[i:i + PAIRS]], metric) for i in range(0, len(row), PAIRS)] or [np.zeros(0)])
        ranked = np.lexsort((col, -score, row))
        row, col, score = row[ranked], col[ranked], score[ranked]
        rank = np.arange(len(row)) - np.searchsorted(row, row, side="left") + 1
        top = rank <= kept
        found.append((query_ids[at:at + step][row[top]], own_ids[col[top]],
                      score[top] if metric == "cosine" else -score[top], rank[top]))
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32())
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.array([])] * 4
    return pa.table([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)],
                    names=["query_id", "item_id", "score", "rank"])


def _meet(queries: DataFrame, items: DataFrame, k: int, metric: str, block_rows: int) -> DataFrame:
    """The best ``k`` per query and pair of blocks; ``queries`` (id, embedding, cell) hold a row per cell to look in."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return _best(np.array([]), np.zeros((0, 1)), np.array([]), np.zeros((0, 1)), k, metric)
        return _best(
            left.column("id").to_numpy(), matrix(left.column("embedding")),
            right.column("id").to_numpy(), matrix(right.column("embedding")), k, metric,
        )

    return cells.meet(queries, items, ["cell"], ("id", "id"), block_rows, run, HIT_SCHEMA).drop("rank")


def _zone_rows(index: cells.Index, block_rows: int) -> int:
    return max(block_rows, min(ZONE_CELLS * block_rows, ZONE_NUMBERS // max(1, index.pivots.shape[1])))


def _meet_zones(queries: DataFrame, inside: DataFrame, k: int, metric: str, zones: cells.Zones, rows: int,
                reached: Callable[[pa.RecordBatch, np.ndarray], np.ndarray]) -> DataFrame:
    """The best ``k`` per query and zone; ``queries`` may have a ``reach``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return _best(np.array([]), np.zeros((0, 1)), np.array([]), np.zeros((0, 1)), k, metric)
        left = left.sort_by("mask")
        flags = np.frombuffer(b"".join(left.column("mask").to_pylist()), np.uint8).reshape(left.num_rows, -1)
        return _best(
            left.column("id").to_numpy(), matrix(left.column("embedding")), right.column("id").to_numpy(), matrix(right.column("embedding")),
            k, metric, np.unpackbits(flags, axis=1).astype(bool), right.column("place").to_numpy(),
            left.column("reach").to_numpy() if "reach" in left.column_names else None)

    return cells.meet_zones(queries, inside, reached, zones, max(1, rows // QUERY_PART), run, HIT_SCHEMA).drop("rank")


def first_cells(queries: DataFrame, index: cells.Index, k: int) -> DataFrame:
    """``queries`` with the nearest cells that hold ``k`` items, a row per cell."""
    return cells.with_reached(queries, lambda batch, vectors: index.nearest(vectors, k))


def other_cells(queries: DataFrame, hits: DataFrame, index: cells.Index, k: int) -> DataFrame:
    """``queries`` with the cells beyond the first that may hold an item as good as their ``k``-th of ``hits``, a row per cell."""
    return cells.with_reached(_with_reach(queries, hits, index, k), lambda batch, vectors: [
        (np.flatnonzero(row) + cells.ZERO).tolist() for row in _beyond(batch, vectors, index, k)]).drop("reach")


def _with_reach(queries: DataFrame, hits: DataFrame, index: cells.Index, k: int) -> DataFrame:
    """``queries`` and the distance of their ``k``-th of ``hits`` in metric space, infinite where there are fewer."""
    worst = F.max("score") if index.metric == "l2" else F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.min("score")))
    reach = F.when(F.count("*") >= k, worst).otherwise(float("inf"))
    return queries.join(hits.groupBy(F.col("query_id").alias("id")).agg(reach.alias("reach")), "id", "left").na.fill({"reach": float("inf")})


def _beyond(batch: pa.RecordBatch, vectors: np.ndarray, index: cells.Index, k: int) -> np.ndarray:
    """Flags of the cells in reach that were not met in the first round."""
    return index.within_mask(vectors, batch.column("reach").to_numpy()) & ~index.nearest_mask(vectors, k)


def top_k(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    metric: str = "cosine",
    min_score: float | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, item_id, score, rank): the best ``k`` items per query, exactly.

    Both inputs have ``id`` and ``embedding``. ``cosine`` ranks high scores first, ``l2``
    ranks small distances first. ``min_score`` drops weaker hits after the top ``k``.
    """
    present = F.col("embedding").isNotNull()
    queries = queries.where(present).select(F.col("id").cast("long"), "embedding")
    items = items.where(present).select(F.col("id").cast("long"), "embedding")
    order = F.col("score").desc() if metric == "cosine" else F.col("score")
    best = lambda hits: top_rows(hits, ["query_id"], [order, F.col("item_id")], k)
    index = cells.build(items, metric, block_rows)
    if index.cells == 1:
        # Zero for all; not a literal, by which Spark would join every row with every row.
        only = F.pmod(F.xxhash64("id"), F.lit(1)).cast("long").alias("cell")
        ranked = best(_meet(queries.select("*", only), items.select("*", only), k, metric, block_rows))
    else:
        inside = cells.with_cell(items, index)
        nothing = F.forall("embedding", lambda x: x == 0) if metric == "cosine" else F.lit(False)
        asked = queries.where(~nothing)
        rows = _zone_rows(index, block_rows)
        zones = cells.zones(inside, index, rows)
        near = cut_lineage(best(_meet_zones(
            asked, inside, k, metric, zones, rows, lambda batch, vectors: index.nearest_mask(vectors, k))))
        more = _meet_zones(_with_reach(asked, near, index, k), inside, k, metric, zones, rows,
                           lambda batch, vectors: _beyond(batch, vectors, index, k))
        found = near.drop("rank").unionByName(more)
        if metric == "cosine":
            # A vector of length zero scores 0 with every item: the smallest ids are its best.
            first = items.select(F.col("id").alias("item_id")).orderBy("item_id").limit(k)
            lowest = F.array(*[F.lit(r["item_id"]) for r in first.collect()])
            found = found.unionByName(queries.where(nothing).select(
                F.col("id").alias("query_id"), F.explode(lowest).alias("item_id"), F.lit(0.0).alias("score")))
        ranked = best(found)
    return ranked if min_score is None else ranked.where(F.col("score") >= min_score)


# --- categories ------------------------------------------------------------------------


def centroids(items: DataFrame, label: str = "label") -> DataFrame:
    """(label, embedding): mean vector per label."""
    parts = items.select(label, F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(label).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("embedding")
    )


def best_category(items: DataFrame, categories: DataFrame, floor: float = K.SEMANTIC_CATEGORY_MIN) -> DataFrame:
    """(id, category_id, score) of the most alike category, where it is above ``floor``."""
    hits = top_k(items, categories, 1)
    return hits.where(F.col("score") > floor).select(
        F.col("query_id").alias("id"), F.col("item_id").alias("category_id"), "score"
    )


# --- policies for a request --------------------------------------------------------------


def hit_lists(hits: DataFrame, about: DataFrame) -> DataFrame:
    """(query_id, hits): the hits of one vector as an array of at most ``k`` structs.

    ``about``: item_id, target_column, rule_text, concepts.
    """
    told = hits.join(about, "item_id").select(
        "query_id", "item_id", "score",
        F.lower(F.coalesce("target_column", F.lit(""))).alias("column"),
        F.lower(F.coalesce("rule_text", F.lit(""))).alias("text"),
        F.arrays_overlap("concepts", F.array(*[F.lit(c) for c in K.PRIVACY_CONCEPTS])).alias("private"),
    )
    return told.groupBy("query_id").agg(
        F.collect_list(F.struct("item_id", "score", "column", "text", "private")).alias("hits")
    )


def rerank(hits: Column, columns: Column, has_pii_categories: Column, purpose: Column, k: int = K.FINAL_K) -> Column:
    """The best ``k`` of an array of hits after boosts, as (item_id, score), best first.

    ``columns`` are the queried columns in lower case. Works inside the row of the request.
    """
    purpose_words = F.regexp_extract_all(F.lower(F.coalesce(purpose, F.lit(""))), F.lit(r"\S{4,}"), F.lit(0))

    def boosted(h: Column, words: Column) -> Column:
        boost = (
            F.when(F.array_contains(columns, h["column"]), K.BOOST_COLUMN).otherwise(0.0)
            + F.when(has_pii_categories & h["private"], K.BOOST_PII).otherwise(0.0)
            + F.when(F.exists(words, lambda w: h["text"].contains(w)), K.BOOST_PURPOSE).otherwise(0.0)
        )
        return F.struct((-(h["score"] + boost)).alias("neg"), h["item_id"].alias("item_id"))

    best = let(
        purpose_words,
        lambda words: F.slice(F.sort_array(F.transform(hits, lambda h: boosted(h, words))), 1, k),
    )
    return F.transform(best, lambda h: F.struct(h["item_id"].alias("item_id"), (-h["neg"]).alias("score")))
