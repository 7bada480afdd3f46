"""A metric index: vectors in cells around pivots, with bounds that rule cells out before vectors are joined.

Pivots are vectors of the indexed side, chosen farthest first from a sample of bounded size. Every vector lies in
the cell of its nearest pivot. Per cell the index keeps how many vectors it holds, its radius, and the least and
the largest distance of its vectors to ``LANDMARKS`` of the pivots: a table whose size is bounded by the
number of pivots. By the triangle inequality a query's own distances to the pivots give, for every cell, a
distance below which the cell holds nothing:

* the distance to its pivot less its radius,
* half of what its pivot is farther away than the query's nearest pivot,
* the gap between the query's distance to a landmark and the cell's distances to it.

Cosine scores are distances of unit vectors, ``d^2 = 2 - 2 s``. Vectors of length zero score 0 with all others
and have a cell of their own (``ZERO``). Distances carry a little slack for rounding, so bounds never cut off
an answer; what is left is scored exactly by the caller.

Cells that hold more than a block of vectors are cut into parts by hash, so a cell that holds a third of all
vectors (equal ones, say) is many tasks' work. Neighbouring cells that hold less than a block together are a zone: a
query that has to look in several of them goes there once, with a mask of the cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_PIVOTS = 1024
LANDMARKS = 32
SAMPLED = 4  # vectors of the sample per pivot
ZERO = -1
_STEP = 256


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column as a float64 matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def placed(vectors: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as points of the metric space: as they are, or of unit length; zero vectors stay."""
    if metric == "l2":
        return vectors
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = [np.einsum("ij,ij->i", m, m) for m in (a, b)]
    return np.sqrt(np.maximum(squares[0][:, None] + squares[1][None, :] - 2 * a @ b.T, 0.0))


def farthest_first(points: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` of the points, each the one farthest from those before it; no two equal ones."""
    if not len(points):
        return points
    chosen = [0]
    away = distances(points, points[:1])[:, 0]
    while len(chosen) < most and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, distances(points, points[chosen[-1:]])[:, 0])
        away[chosen] = 0.0
    return points[chosen]


@dataclass(frozen=True)
class Index:
    """Pivots in metric space and what is known of their cells; without pivots all vectors are one cell."""

    metric: str
    pivots: np.ndarray
    count: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def cells(self) -> int:
        return max(1, len(self.pivots))

    @property
    def slack(self) -> float:
        """More than distances can be wrong by rounding."""
        return 1e-6 * (1.0 + (float(np.linalg.norm(self.pivots, axis=1).max()) if len(self.pivots) else 0.0))

    def cell_of(self, vectors: np.ndarray) -> np.ndarray:
        points = placed(vectors, self.metric)
        if not len(self.pivots) or not len(points):
            return np.zeros(len(points), np.int64)
        cell = np.concatenate([distances(points[i:i + _STEP], self.pivots).argmin(axis=1) for i in range(0, len(points), _STEP)])
        return np.where(self.zero(points), ZERO, cell)

    def zero(self, points: np.ndarray) -> np.ndarray:
        return ~points.any(axis=1) if self.metric == "cosine" and len(points) else np.zeros(len(points), bool)

    def least(self, points: np.ndarray) -> np.ndarray:
        """A row per point: how near the vectors of each cell can be at most."""
        away = distances(points, self.pivots)
        bound = np.maximum(away - self.radius, (away - away.min(axis=1, keepdims=True)) / 2)
        for j in range(self.low.shape[1]):
            bound = np.maximum(bound, np.maximum(self.low[:, j] - away[:, [j]], away[:, [j]] - self.high[:, j]))
        return bound - self.slack * (1.0 + np.linalg.norm(points, axis=1, keepdims=True))

    def within(self, vectors: np.ndarray, reach: np.ndarray) -> list[list[int]]:
        """Per vector the cells that may hold something at a distance of ``reach`` or less."""
        return self._lists(vectors, lambda: self.within_mask(vectors, reach))

    def nearest(self, vectors: np.ndarray, k: int) -> list[list[int]]:
        """Per vector its nearest cells that together hold at least ``k`` vectors, or all cells."""
        return self._lists(vectors, lambda: self.nearest_mask(vectors, k))

    def _lists(self, vectors: np.ndarray, mask: Callable[[], np.ndarray]) -> list[list[int]]:
        if not len(self.pivots):
            return [[0]] * len(vectors)
        return [(np.flatnonzero(row) + ZERO).tolist() for row in mask()]

    def within_mask(self, vectors: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """``within`` as a row of flags per vector: cell ``ZERO`` and then those of the pivots, of which there must be some."""
        found = self._each(vectors, lambda points, at: self.least(points) <= reach[at:at + len(points), None])
        if self.metric == "cosine":
            # A vector of length zero scores 0 with all others.
            far = reach >= math.sqrt(2) - self.slack
            none = self.zero(vectors)
            found[:, 0] = far
            found[none] = far[none, None]
        return found

    def nearest_mask(self, vectors: np.ndarray, k: int) -> np.ndarray:
        """``nearest`` as a row of flags per vector, like ``within_mask``."""

        def some(points: np.ndarray, at: int) -> np.ndarray:
            order = distances(points, self.pivots).argsort(axis=1, kind="stable")
            before = np.cumsum(self.count[order], axis=1) - self.count[order]
            out = np.zeros(order.shape, bool)
            np.put_along_axis(out, order, before < k, axis=1)
            return out

        return self._each(vectors, some)

    def _each(self, vectors: np.ndarray, some: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
        points = placed(vectors, self.metric)
        out = np.zeros((len(points), 1 + len(self.pivots)), bool)
        for at in range(0, len(points), _STEP):
            out[at:at + _STEP, 1:] = some(points[at:at + _STEP], at)
        return out


def build(items: DataFrame, metric: str, rows_per_cell: int) -> Index:
    """The index of ``items`` (embedding, never null). Up to ``rows_per_cell`` vectors it is a single cell and reads only their number."""
    none = np.zeros((0, 0))
    most = min(MOST_PIVOTS, math.ceil(items.count() / rows_per_cell))
    if most <= 1:
        return Index(metric, none, none, none, none, none)
    sample = items.select("embedding").orderBy(F.xxhash64("embedding")).limit(SAMPLED * most).toArrow()
    points = placed(matrix(sample.column("embedding")), metric)
    pivots = farthest_first(points[points.any(axis=1)] if metric == "cosine" else points, most)
    if len(pivots) <= 1:
        return Index(metric, none, none, none, none, none)
    bare = Index(metric, pivots, none, none, none, none)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = min(LANDMARKS, len(pivots))
        count, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
        low, high = np.full((len(pivots), marks), np.inf), np.full((len(pivots), marks), -np.inf)
        for batch in batches:
            points = placed(matrix(batch.column("embedding")), metric)
            points = points[~bare.zero(points)]
            for at in range(0, len(points), _STEP):
                away = distances(points[at:at + _STEP], pivots)
                cell = away.argmin(axis=1)
                np.add.at(count, cell, 1)
                np.maximum.at(radius, cell, away[np.arange(len(cell)), cell])
                np.minimum.at(low, cell, away[:, :marks])
                np.maximum.at(high, cell, away[:, :marks])
        here = np.flatnonzero(count)
        mark = np.tile(np.arange(marks), len(here))
        cells = np.repeat(here, marks)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells), pa.array(mark), pa.array(np.where(mark == 0, count[cells], 0)), pa.array(radius[cells]),
             pa.array(low[here].ravel()), pa.array(high[here].ravel())], names=["cell", "mark", "n", "radius", "low", "high"])

    shape = "cell long, mark long, n long, radius double, low double, high double"
    found = items.select("embedding").mapInArrow(measure, shape).groupBy("cell", "mark").agg(
        F.sum("n").alias("n"), F.max("radius").alias("radius"), F.min("low").alias("low"), F.max("high").alias("high"))
    count, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    low, high = np.full((len(pivots), min(LANDMARKS, len(pivots))), np.inf), np.full((len(pivots), min(LANDMARKS, len(pivots))), -np.inf)
    for r in found.collect():  # a row per pivot and landmark
        count[r["cell"]] += r["n"]
        radius[r["cell"]] = max(radius[r["cell"]], r["radius"])
        low[r["cell"], r["mark"]], high[r["cell"], r["mark"]] = r["low"], r["high"]
    return Index(metric, pivots, count, radius, low, high)


def with_cell(items: DataFrame, index: Index) -> DataFrame:
    """``items`` and the number of their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = index.cell_of(matrix(batch.column("embedding")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], names=[*batch.schema.names, "cell"])

    return items.mapInArrow(run, _shape(items) + ", cell long")


def _shape(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def with_reached(queries: DataFrame, reached: Callable[[pa.RecordBatch, np.ndarray], list[list[int]]]) -> DataFrame:
    """A row of ``queries`` for each cell that ``reached`` names for it, given the batch and its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = reached(batch, matrix(batch.column("embedding")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int64()))], names=[*batch.schema.names, "cells"])

    found = queries.mapInArrow(run, _shape(queries) + ", cells array<long>")
    return found.withColumn("cell", F.explode("cells")).drop("cells")


def meet(left: DataFrame, right: DataFrame, keys: list[str], by: tuple[str, str], block: int,
         compare: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``compare`` on the rows of both sides with equal ``keys``, in pairs of blocks of about ``block`` rows.

    ``by`` names the column of either side whose hash deals rows to blocks.
    """
    count = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = count(left, "l_parts").join(count(right, "r_parts"), keys)
    own = lambda column, parts: F.pmod(F.xxhash64(column), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    groups = [*keys, "l_part", "r_part"]
    one = left.join(sizes, keys).withColumn("l_part", own(by[0], "l_parts")).withColumn("r_part", every("r_parts"))
    two = right.join(sizes, keys).withColumn("r_part", own(by[1], "r_parts")).withColumn("l_part", every("l_parts"))
    # Both sides come from the same counts: new names keep their columns apart.
    two = two.toDF(*two.columns)
    return one.groupBy(*groups).cogroup(two.groupBy(*groups)).applyInArrow(compare, schema)


# --- zones -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Zones:
    """Of each cell (``ZERO`` first) its zone, its place there and in how many zones it is cut; 0: it holds nothing."""

    zone: np.ndarray
    place: np.ndarray
    parts: np.ndarray


def _by_neighbours(pivots: np.ndarray) -> list[int]:
    """The numbers of the pivots, each followed by the nearest of those that are left."""
    order, left = [0], np.ones(len(pivots), bool)
    left[0] = False
    while left.any():
        away = np.where(left, distances(pivots[order[-1:]], pivots)[0], np.inf)
        order.append(int(away.argmin()))
        left[order[-1]] = False
    return order


def zones(inside: DataFrame, index: Index, rows: int) -> Zones:
    """Neighbouring cells together, up to about ``rows`` vectors; a cell of more is several zones. ``inside``: ``with_cell``."""
    held = {r["cell"]: r["n"] for r in inside.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per pivot
    found = Zones(*(np.zeros(1 + index.cells, np.int64) for _ in range(3)))
    zone, room, place = -1, 0, 0
    for cell in [ZERO, *_by_neighbours(index.pivots)]:
        n = held.get(cell, 0)
        if not n:
            continue
        if n > room:
            zone, room, place = zone + 1, rows, 0
        at, parts = cell - ZERO, math.ceil(n / rows)
        found.zone[at], found.place[at], found.parts[at] = zone, place, parts
        zone, room, place = zone + parts - 1, room - n if parts == 1 else 0, place + 1
    return found


def meet_zones(queries: DataFrame, inside: DataFrame, reached: Callable[[pa.RecordBatch, np.ndarray], np.ndarray], zoned: Zones,
               rows: int, compare: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``compare`` on the queries and the vectors of each zone, about ``rows`` queries at a time.

    ``reached`` gives the flags of the cells in which a batch of ``queries`` (id, embedding and others) looks. ``compare``
    gets them with ``mask``, bits by ``place`` in the zone, and the vectors of ``inside`` (id, embedding, cell) with their ``place``.
    """
    cells_of: dict[int, list[int]] = {}
    for at in np.flatnonzero(zoned.parts).tolist():
        for part in range(zoned.parts[at]):
            cells_of.setdefault(int(zoned.zone[at]) + part, []).append(at)
    for found in cells_of.values():
        found.sort(key=lambda at: zoned.place[at])

    def flags(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        looks = reached(batch, matrix(batch.column("embedding")))
        for zone, there in cells_of.items():
            own = looks[:, there]
            some = np.flatnonzero(own.any(axis=1))
            if len(some):
                yield zone, some, own[some]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(zone, len(some)) for zone, some, _ in flags(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["zone", "n"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for zone, some, own in flags(batch):
                mask = [row.tobytes() for row in np.packbits(own, axis=1)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.take(pa.array(some)).columns, pa.array([zone] * len(some), pa.int64()), pa.array(mask, pa.binary())],
                    names=[*batch.schema.names, "zone", "mask"])

    spark = queries.sparkSession
    asked = queries.mapInArrow(number, "zone long, n long").groupBy("zone").agg(F.sum("n").alias("n")).collect()  # a row per zone
    parts = {r["zone"]: math.ceil(r["n"] / rows) for r in asked}
    one = queries.mapInArrow(deal, _shape(queries) + ", zone long, mask binary").join(
        F.broadcast(spark.createDataFrame(list(parts.items()), "zone long, parts int")), "zone").withColumn(
        "part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    there = [(at + ZERO, int(zoned.zone[at]), int(zoned.place[at]), int(zoned.parts[at]), [parts.get(int(zoned.zone[at]) + i, 0) for i in range(zoned.parts[at])])
             for at in np.flatnonzero(zoned.parts).tolist()]
    places = F.broadcast(spark.createDataFrame(there, "cell long, first long, place int, cuts int, parts array<int>"))
    cut = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")
    two = inside.join(places, "cell").withColumn("cut", cut).withColumn("own", F.get("parts", F.col("cut"))).where("own > 0").select(
        "id", "embedding", "place", (F.col("first") + F.col("cut")).alias("zone"), F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("part"))
    return one.groupBy("zone", "part").cogroup(two.groupBy("zone", "part")).applyInArrow(compare, schema)
