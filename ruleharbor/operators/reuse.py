"""Reuse of stored decisions: exact, nearly equal and similar requests of the same role.

A stored entry answers requests from its creation until its time to live ends or a newer
entry with the same key replaces it: at any time at most one entry of a key lives. Texts and
vectors are compared once each, however often they are asked or stored, and without regard to
time; which entry of a key lives at a request's time is one running look-up in the rows of that key. Time is
cut into slices of about ``SLICE_ROWS`` rows, so that a busy key is not one task's.

A text or a vector matches many keys. Its requests are therefore not multiplied by them: requests, matching pairs
and the entries that live in a slice of time meet in groups of bounded size, where lifetimes are searched (``best_living``).
Few requests and many entries make as many slices as many requests and few entries.

Nearly equal texts are found through an index of segments (``near_text``), similar vectors through a metric
index (``cells``). A vector is known by a 128-bit hash, worked out once per row.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleharbor.functions import fixed_values as K
from ruleharbor.functions.sqltext import normalise_sql
from ruleharbor.operators import cells, near_text
from ruleharbor.operators.cells import matrix
from ruleharbor.operators.vectors import score_matrix
from ruleharbor.session import cut_lineage

SLICE_ROWS = 1_000_000
GROUP_SLICE_ROWS = 500_000  # requests, and births of entries, of a time slice in which they meet
GROUP_ROWS = 250_000  # requests and matching pairs of a group
GROUP_ENTRIES = 1_000_000  # entries of a group
STEP_PAIRS = 1_000_000  # requests times lanes that are searched at once
TIME_STEPS = 4096  # of which slices are made
VECTORS_PER_BLOCK = 2048

HIT_COLUMNS = ("query_id", "entry_id", "decision")
_PAIRS = pa.schema([("user_role", pa.string()), ("r_vector", pa.string()), ("e_vector", pa.string()), ("score", pa.float64())])


def decision_key(normalised: Column, role: Column) -> Column:
    return F.sha2(F.concat_ws("|", normalised, role), 256)


def with_key(requests: DataFrame) -> DataFrame:
    """Requests with ``normalised_query`` and ``key``."""
    normal = requests.withColumn("normalised_query", normalise_sql(F.col("query")))
    return normal.withColumn("key", decision_key(F.col("normalised_query"), F.col("user_role")))


def vector_name(embedding: Column) -> Column:
    """A vector's name: two hashes of 64 bits; null for none."""
    return F.when(embedding.isNotNull(), F.concat(F.hex(F.xxhash64(embedding)), F.hex(F.xxhash64(F.lit(1), embedding))))


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def slice_width(rows: DataFrame, at: str, most: int | None = None) -> int:
    """Microseconds in which about ``most`` of the rows come; one second at least."""
    found = rows.agg(F.count(at).alias("n"), (F.max(at) - F.min(at)).alias("span")).first()
    slices = max(1, math.ceil(found["n"] / (most or SLICE_ROWS)))
    return max(1_000_000, math.ceil(((found["span"] or 0) + 1) / slices))


def _slice(at: Column, width: int) -> Column:
    return F.floor(at / F.lit(width)).cast("long")


def lifetimes(entries: DataFrame) -> DataFrame:
    """Entries with ``born`` and ``dies`` in microseconds; they answer for born < t <= dies.

    The next entry of a key is looked up inside a time slice, and for the last entry of a
    slice among the first entries of later slices, so no key is gathered in one task.
    """
    timed = entries.withColumn("born", _micros(F.col("created_at")))
    timed = timed.withColumn("_slice", _slice(F.col("born"), slice_width(timed.select("born"), "born")))
    firsts = timed.groupBy("key", "_slice").agg(F.min("born").alias("_first"))
    following = F.lead("_first").over(Window.partitionBy("key").orderBy("_slice"))
    later = firsts.select("key", "_slice", following.alias("_later"))
    inside = F.lead("born").over(Window.partitionBy("key", "_slice").orderBy("born", "entry_id"))
    replaced = timed.withColumn("_next", inside).join(later, ["key", "_slice"], "left")
    dies = F.col("born") + F.col("ttl_seconds").cast("long") * F.lit(1_000_000)
    return replaced.withColumn("dies", F.least(dies, F.coalesce("_next", "_later"))).drop(
        "_slice", "_next", "_later"
    ).where("dies > born")


def living(asked: DataFrame, alive: DataFrame, width: int, *more: str) -> DataFrame:
    """``asked`` (key, at and others) with ``e``, the entry of the key that lives at that time; rows without one go.

    Requests and entries of a key are laid out by time; a request takes the last entry before it, in its
    slice of ``width`` microseconds or carried over from the last earlier slice that has one.
    """
    entry = F.struct("born", "dies", "key", "entry_id", "decision", *more)
    kept = [c for c in asked.columns if c not in ("key", "at")]
    rows = asked.select("key", F.col("at").alias("time"), F.lit(0).alias("kind"), F.struct(*kept).alias("r"))
    events = rows.unionByName(alive.select(
        "key", F.col("born").alias("time"), F.lit(1).alias("kind"), entry.alias("e")), allowMissingColumns=True)
    events = events.withColumn("slice", _slice(F.col("time"), width))
    ends = events.groupBy("key", "slice").agg(F.max("e").alias("end"))  # the first field is the time of birth
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("key", "slice", F.last("end", ignorenulls=True).over(earlier).alias("carried")).where("carried IS NOT NULL")
    # At one time, requests come before entries: an entry answers after its birth.
    so_far = Window.partitionBy("key", "slice").orderBy("time", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = events.withColumn("last", F.last("e", ignorenulls=True).over(so_far)).where("kind = 0")
    found = found.join(carried, ["key", "slice"], "left").withColumn("last", F.coalesce("last", "carried"))
    return found.where("time <= last.dies").select("key", F.col("time").alias("at"), "r.*", F.col("last").alias("e"))


def slim_requests(requests: DataFrame) -> DataFrame:
    """What the layers need of requests: query_id, at, key, user_role, normalised_query and the name of the vector."""
    return requests.select("query_id", _micros(F.col("ts")).alias("at"), "key", "user_role", "normalised_query",
                           _named(requests).alias("vector"))


def slim_entries(alive: DataFrame) -> DataFrame:
    """What the layers need of living entries (``lifetimes``); a vector is known by its name."""
    return alive.select("key", "entry_id", "decision", "born", "dies", "user_role", "normalised_query", _named(alive).alias("vector"))


def _named(rows: DataFrame) -> Column:
    if "vector" in rows.columns:
        return F.col("vector")
    return vector_name(F.col("embedding")) if "embedding" in rows.columns else F.lit(None).cast("string")


def with_names(rows: DataFrame) -> DataFrame:
    """``rows`` with the name of their vector in place of its numbers, which joins and windows then need not carry."""
    return rows.withColumn("vector", _named(rows)).drop("embedding")


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(user_role, vector, embedding): each vector of a role once."""
    if "embedding" not in rows.columns:
        return rows.select("user_role", F.lit(None).cast("string").alias("vector"), F.lit(None).cast("array<double>").alias("embedding")).where("false")
    named = rows.where("embedding IS NOT NULL").select("user_role", vector_name(F.col("embedding")).alias("vector"), "embedding")
    return named.dropDuplicates(["user_role", "vector"])


def _subject(role: str, name: str) -> Column:
    """A text or vector of a role by one name; null where either is."""
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit("|"), F.col(role), F.col(name)), 256)


def exact_hits(requests: DataFrame, alive: DataFrame) -> DataFrame:
    """Requests whose normalised text and role are stored; at most one entry each."""
    return _exact(cut_lineage(slim_requests(requests)), slim_entries(alive))


def _exact(asked: DataFrame, alive: DataFrame) -> DataFrame:
    width = slice_width(asked, "at")
    return living(asked.select("query_id", "at", "key"), alive, width).select("query_id", "e.entry_id", "e.decision")


# --- requests that match many keys ----------------------------------------------------------


@dataclass(frozen=True)
class TimeSlices:
    """Slices of time from ``first`` to ``last`` (microseconds): steps of equal length, and of each the number of its slice.

    ``entries``: the most entries that live in a slice.
    """

    first: int
    last: int
    numbers: tuple[int, ...]
    entries: int = 0

    def step(self, at: Column) -> Column:
        """The step of a time; times outside go to the first or the last one."""
        length = math.ceil((self.last - self.first + 1) / len(self.numbers))
        return F.least(F.greatest(F.floor((at - F.lit(self.first)) / F.lit(length)), F.lit(0)), F.lit(len(self.numbers) - 1)).cast("int")

    def number(self, at: Column) -> Column:
        told = F.split(F.lit(",".join(map(str, self.numbers))), ",").cast("array<int>")  # a constant to Spark
        return F.get(told, self.step(at))

    def living(self, alive: DataFrame) -> DataFrame:
        """The entries that can answer a request in the slices."""
        return alive.where((F.col("born") < self.last) & (F.col("dies") >= self.first))


def time_slices(asked: DataFrame, alive: DataFrame, most: int) -> TimeSlices:
    """Slices that hold about ``most`` requests (at) and as many births of entries (born, dies), however these lie in time.

    Entries that live on from one slice into the next are sent to both. Where more than ``most`` do, the next slice takes as many
    births or requests as there are such entries, so all slices together hold no more than a few times the rows.
    """
    span = asked.agg(F.min("at").alias("first"), F.max("at").alias("last")).first()
    even = TimeSlices(span["first"] or 0, span["last"] or 0, tuple(range(TIME_STEPS)))
    one = lambda at, *kind: F.struct(even.step(at).alias("step"), *[F.lit(int(x)).alias(c) for c, x in zip(("asked", "born", "died"), kind)])
    rows = asked.select(F.array(one(F.col("at"), True, False, False)).alias("all")).unionAll(even.living(alive).select(
        F.array(one(F.col("born"), False, True, False), one(F.col("dies"), False, False, True)).alias("all")))
    held = np.zeros((TIME_STEPS, 3), np.int64)
    for r in rows.select(F.inline("all")).groupBy("step").agg(F.sum("asked"), F.sum("born"), F.sum("died")).collect():  # a row per step
        held[r[0]] = r[1:]
    number, numbers, inside, carried, living, largest = 0, [], np.zeros(2, np.int64), 0, 0, 0
    for step in held:
        if inside.any() and (inside + step[:2]).max() > max(most, carried):
            number, inside, carried = number + 1, np.zeros(2, np.int64), living
        numbers.append(number)
        inside = inside + step[:2]
        living += step[1] - step[2]
        largest = max(largest, carried + inside[1])
    return TimeSlices(even.first, even.last, tuple(numbers), int(largest))


def _runs(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """``many`` whole numbers from each of ``first``, one run behind the other."""
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())


def _nearest_living(left: pa.Table, right: pa.Table, oldest: bool) -> pa.Table:
    """Of each request the best entry that lives at its time, among those of the matching objects.

    ``left``: query_id, at, subject. ``right``: matches (subject, object, score) and entries (object, key, born, dies, ..), which
    have a time of birth. The entries of an object and key follow each other in a lane, so a binary search finds the living one.
    """
    isborn = right.column("born").is_valid()
    pairs, entries = right.filter(pc.invert(isborn)), right.filter(isborn)

    def codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
        """The rank of each value among all, in the order of its bytes."""
        both = pa.chunked_array([c for x in columns for c in x.chunks], columns[0].type)
        values = pc.unique(both)
        values = values.take(pc.sort_indices(values))
        return [pc.index_in(x, values).to_numpy().astype(np.int64) for x in columns]

    subject, p_subject = codes(left.column("subject"), pairs.column("subject"))
    p_object, e_object = codes(pairs.column("object"), entries.column("object"))
    (key,) = codes(entries.column("key"))
    born, dies = (entries.column(c).to_numpy().astype(np.int64) for c in ("born", "dies"))
    at = left.column("at").to_numpy().astype(np.int64)

    order = np.lexsort((born, key, e_object))
    e_object, key, born, dies = e_object[order], key[order], born[order], dies[order]
    starts = np.flatnonzero(np.r_[len(order) > 0, (e_object[1:] != e_object[:-1]) | (key[1:] != key[:-1])][:len(order)])
    lane = np.cumsum(np.isin(np.arange(len(order)), starts)) - 1
    moments = np.unique(born)
    place = lane * (len(moments) + 1) + np.searchsorted(moments, born)  # rising
    rank = np.empty(len(order), np.int64)
    rank[np.lexsort((key, born))] = np.arange(len(order))

    # The pairs of each subject, and the lanes of each pair.
    by_subject = np.argsort(p_subject, kind="stable")
    owner, p_object = p_subject[by_subject], p_object[by_subject]
    first, last = (np.searchsorted(e_object[starts], p_object, side) for side in ("left", "right"))
    many = last - first
    score = pairs.column("score").to_numpy().astype(np.float64)[by_subject]
    levels = np.unique(-score)
    level = np.searchsorted(levels, -score)
    begin, end = np.searchsorted(owner, subject, "left"), np.searchsorted(owner, subject, "right")
    before = np.r_[0, np.cumsum(many)]
    width = before[end] - before[begin]
    asked = np.flatnonzero(width)
    width = width[asked]
    moment = np.searchsorted(moments, at)

    rows, hits, scores = [], [], []
    cuts = np.flatnonzero(np.diff((np.cumsum(width) - width) // STEP_PAIRS)) + 1
    for some, wide in zip(np.split(asked, cuts), np.split(width, cuts), strict=True):
        if not len(some):
            continue
        offset = np.cumsum(wide) - wide
        pair = _runs(begin[some], (end - begin)[some])
        at_lane, at_level = _runs(first[pair], many[pair]), np.repeat(level[pair], many[pair])
        found = np.searchsorted(place, at_lane * (len(moments) + 1) + np.repeat(moment[some], wide)) - 1
        lives = (found >= 0) & (lane[found] == at_lane) & (dies[found] >= np.repeat(at[some], wide))
        worth = rank[found] if oldest else at_level * (len(order) + 1) + key[found]
        worth = np.where(lives, worth, np.iinfo(np.int64).max)
        best = np.minimum.reduceat(worth, offset)
        # The first of each request's lanes that has the least value.
        top = np.flatnonzero(lives & (worth == np.repeat(best, wide)))
        whose = np.searchsorted(offset, top, "right") - 1
        keep = np.r_[True, whose[1:] != whose[:-1]][:len(top)]
        top, whose = top[keep], whose[keep]
        rows.append(some[whose])
        hits.append(order[found[top]])
        scores.append(-levels[at_level[top]])
    none = np.zeros(0, np.int64)
    told = entries.take(pa.array(np.concatenate([none, *hits])))
    return pa.table({"query_id": left.column("query_id").take(pa.array(np.concatenate([none, *rows]))),
                     **{c: told.column(c) for c in ("born", "key", "entry_id", "decision")},
                     "score": pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())})


def best_living(asked: DataFrame, near: DataFrame, alive: DataFrame, oldest: bool) -> DataFrame:
    """(query_id, born, key, entry_id, decision, score): of each request the best entry living at its time; rows without one go.

    ``asked``: query_id, at, subject. ``near``: subject, object, score, each pair once. ``alive``: object, key, born, dies, entry_id,
    decision (``lifetimes``: entries of a key do not overlap). The best is the oldest entry, else the one of the highest score;
    then the smallest key. A request is sent to one group, an entry to the groups of its slices that hold a matching subject.
    Subjects are dealt to groups by hash; one with more requests in a slice than a group holds has several. A group that more
    than ``GROUP_ENTRIES`` entries would reach is cut by their objects and keys, and a request has a row of each part that answers it.
    """
    asked = asked.where("at IS NOT NULL AND subject IS NOT NULL")
    slices = time_slices(asked, alive, GROUP_SLICE_ROWS)
    asked = asked.withColumn("slice", slices.number(F.col("at")))
    pairs_of = near.groupBy("subject").agg(F.count(F.lit(1)).alias("pairs"))
    counts = cut_lineage(asked.groupBy("slice", "subject").agg(F.count(F.lit(1)).alias("n")).join(pairs_of, "subject"))
    groups = lambda n: F.ceil(n / GROUP_ROWS).cast("int")
    parts = F.broadcast(counts.groupBy("slice").agg(groups(F.sum(F.col("n") + F.col("pairs"))).alias("parts")))  # a row per slice
    busy = F.broadcast(counts.where(F.col("n") > GROUP_ROWS).select("slice", "subject", groups(F.col("n")).alias("salts")))  # few by their size

    def dealt(rows: DataFrame) -> DataFrame:
        found = rows.join(parts, "slice").join(busy, ["slice", "subject"], "left")
        return found.withColumn("part", F.pmod(F.xxhash64("subject"), F.col("parts")).cast("int")).withColumn(
            "salts", F.coalesce("salts", F.lit(1))).drop("parts")

    keys = ["slice", "part", "salt"]
    one = dealt(asked).withColumn("salt", F.pmod(F.xxhash64("query_id", "at"), F.col("salts")).cast("int")).select(
        *keys, "query_id", "at", "subject")
    pairs = dealt(counts.select("slice", "subject").join(near, "subject")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(*keys, "subject", "object", "score")
    spans = slices.living(alive).select(
        "object", "key", "born", "dies", "entry_id", "decision",
        F.explode(F.sequence(slices.number(F.col("born")), slices.number(F.col("dies")))).alias("slice"))
    places = pairs.select(*keys, "object").distinct()
    entries = spans.join(places, ["slice", "object"])
    by = keys
    if slices.entries > GROUP_ENTRIES:
        lives = spans.groupBy("slice", "object").agg(F.count(F.lit(1)).alias("lives"))
        large = F.broadcast(cut_lineage(places.join(lives, ["slice", "object"]).groupBy(*keys).agg(
            F.ceil(F.sum("lives") / GROUP_ENTRIES).cast("int").alias("cuts")).where("cuts > 1")))  # few by their size
        cuts = F.coalesce("cuts", F.lit(1))
        every = lambda rows: rows.join(large, keys, "left").withColumn("cut", F.explode(F.sequence(F.lit(0), cuts - 1))).drop("cuts")
        one, pairs = every(one), every(pairs)
        entries = entries.join(large, keys, "left").withColumn("cut", F.pmod(F.xxhash64("object", "key"), cuts).cast("int")).drop("cuts")
        by = [*keys, "cut"]
    two = pairs.unionByName(entries, allowMissingColumns=True)
    kind = {f.name: f.dataType.simpleString() for f in alive.schema}
    shape = (f"query_id {asked.schema['query_id'].dataType.simpleString()}, born long, key string, entry_id {kind['entry_id']}, "
             f"decision {kind['decision']}, score double")
    return one.groupBy(*by).cogroup(two.groupBy(*by)).applyInArrow(lambda left, right: _nearest_living(left, right, oldest), shape)


# --- nearly equal texts ------------------------------------------------------------------


def fuzzy_hits(
    requests: DataFrame, alive: DataFrame, ratio: float = K.FUZZY_RATIO, spread: int = near_text.SPREAD
) -> DataFrame:
    """Requests with a nearly equal stored text of the same role; the entry stored first answers."""
    return _fuzzy(cut_lineage(slim_requests(requests)), cut_lineage(slim_entries(alive)), ratio, spread)


def _fuzzy(asked: DataFrame, alive: DataFrame, ratio: float, spread: int = near_text.SPREAD) -> DataFrame:
    stored = alive.select(F.col("user_role").alias("group"), "key", F.col("normalised_query").alias("text"))
    texts = asked.select(F.col("user_role").alias("group"), F.col("normalised_query").alias("text"))
    near = near_text.near_texts(texts, stored, ratio, spread).withColumnsRenamed({"group": "user_role", "text": "normalised_query"})
    subject = _subject("user_role", "normalised_query").alias("subject")
    pairs = cut_lineage(near.select(subject, F.col("key").alias("object"), F.lit(0.0).alias("score")))
    entries = alive.withColumn("object", F.col("key"))
    found = best_living(asked.select("query_id", "at", subject), pairs, entries, oldest=True)
    oldest = found.groupBy("query_id").agg(F.min(F.struct("born", "key", "entry_id", "decision")).alias("e"))
    return oldest.select("query_id", "e.entry_id", "e.decision")


# --- similar vectors ---------------------------------------------------------------------


def similar_vectors(asked: DataFrame, stored: DataFrame, floor: float, block: int) -> DataFrame:
    """(user_role, r_vector, e_vector, score) of the vectors of a role at cosine ``floor`` or more.

    ``asked`` and ``stored`` hold each vector of a role once (user_role, vector, embedding). An asked vector meets
    the cells of the stored ones that may hold a vector near enough, in blocks of bounded size.
    """
    index = cells.build(stored, "cosine", block)
    # Scores are compared after rounding.
    reach = math.sqrt(max(0.0, 2 - 2 * (floor - 1e-11)))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return _PAIRS.empty_table()
        scores = np.round(score_matrix(matrix(left["embedding"]), matrix(right["embedding"]), "cosine"), 12)
        i, j = np.nonzero(scores >= floor)
        return pa.table({"user_role": left["user_role"].take(i), "r_vector": left["vector"].take(i),
                         "e_vector": right["vector"].take(j), "score": pa.array(scores[i, j])})

    reached = cells.with_reached(asked, lambda batch, vectors: index.within(vectors, np.full(len(vectors), reach)))
    return cells.meet(reached, cells.with_cell(stored, index), ["user_role", "cell"], ("vector", "vector"), block, compare,
                      "user_role string, r_vector string, e_vector string, score double")


def semantic_hits(
    requests: DataFrame, alive: DataFrame, floor: float = K.SEMANTIC_COSINE, block: int = VECTORS_PER_BLOCK,
    stored: DataFrame | None = None
) -> DataFrame:
    """Requests with a stored vector of the same role at cosine ``floor`` or more; the most alike answers.

    ``alive`` may hold names (``with_names``); then ``stored`` (user_role, embedding) has the vectors.
    """
    vectors = distinct_vectors(alive if stored is None else stored)
    return _semantic(cut_lineage(slim_requests(requests)), cut_lineage(slim_entries(alive)), distinct_vectors(requests),
                     vectors, floor, block)


def _semantic(asked: DataFrame, alive: DataFrame, asked_vectors: DataFrame, stored_vectors: DataFrame, floor: float,
              block: int = VECTORS_PER_BLOCK) -> DataFrame:
    near = similar_vectors(cut_lineage(asked_vectors), cut_lineage(stored_vectors), floor, block)
    pairs = cut_lineage(near.select(
        _subject("user_role", "r_vector").alias("subject"), _subject("user_role", "e_vector").alias("object"), "score"))
    # A lifetime ends when another entry of the key follows, also one without vector.
    entries = alive.where("vector IS NOT NULL").withColumn("object", _subject("user_role", "vector"))
    found = best_living(asked.select("query_id", "at", _subject("user_role", "vector").alias("subject")), pairs, entries, oldest=False)
    top = found.groupBy("query_id").agg(
        F.min(F.struct((-F.col("score")).alias("neg"), "key", "entry_id", "decision", "score")).alias("e"))
    return top.select("query_id", "e.entry_id", "e.decision", "e.score")


# --- all layers --------------------------------------------------------------------------


def reuse_cascade(
    requests: DataFrame,
    entries: DataFrame,
    layers: Iterable[str] = ("exact", "fuzzy", "semantic"),
    semantic_floor: float = K.SEMANTIC_COSINE,
) -> DataFrame:
    """(query_id, layer, entry_id, decision) for every request; layer is ``miss`` when nothing answers.

    The requests are written once without their texts and vectors' numbers (``slim_requests``), so are the entries;
    a layer looks only at the requests no earlier layer answered, so the answers of all but the last layer are
    written as they are found.
    """
    alive = cut_lineage(slim_entries(lifetimes(with_names(entries))))
    asked = cut_lineage(slim_requests(requests))

    def semantic(rest: DataFrame) -> DataFrame:
        def vectors(rows: DataFrame, slim: DataFrame) -> DataFrame:
            wanted = slim.where("vector IS NOT NULL").select("user_role", "vector").distinct()
            return distinct_vectors(rows).join(wanted, ["user_role", "vector"], "left_semi")

        return _semantic(rest, alive, vectors(requests, rest), vectors(entries, alive), semantic_floor).select(*HIT_COLUMNS)

    finders = {
        "exact": lambda rest: _exact(rest, alive),
        "fuzzy": lambda rest: _fuzzy(rest, alive, K.FUZZY_RATIO),
        "semantic": semantic,
    }
    layers = list(layers)
    rest, found = asked, []
    for layer in layers:
        hits = finders[layer](rest).withColumn("layer", F.lit(layer))
        if layer != layers[-1]:
            hits = cut_lineage(hits)
            rest = cut_lineage(rest.join(hits.select("query_id"), "query_id", "left_anti"))
        found.append(hits)
    answers = reduce(DataFrame.unionByName, found)
    return asked.select("query_id").join(answers, "query_id", "left").select(
        "query_id", "entry_id", "decision", F.coalesce("layer", F.lit("miss")).alias("layer"))


def reuse_stats(cascade: DataFrame) -> DataFrame:
    """Lookups, hits per layer, misses and hit rate in one row."""
    hit = F.col("layer") != "miss"
    layer_hits = lambda name: F.count_if(F.col("layer") == name).alias(f"{name}_hits")
    return cascade.agg(
        F.count("*").alias("total_lookups"),
        layer_hits("exact"), layer_hits("fuzzy"), layer_hits("semantic"),
        F.count_if(~hit).alias("misses"),
        F.coalesce(F.count_if(hit) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("hit_rate"),
    )


def store_decisions(decided: DataFrame, with_vectors: bool) -> DataFrame:
    """Entries for requests that were approved or blocked afresh; misses and escalations store nothing."""
    fresh = decided.where(F.col("final_decision").isin("APPROVE", "BLOCK") & F.col("cache_layer").isNull())
    ttl = K.VECTOR_TTL_SECONDS if with_vectors else K.EXACT_TTL_SECONDS
    keyed = with_key(fresh)
    return keyed.select(
        F.col("query_id").alias("entry_id"), "key", "normalised_query", "user_role",
        F.col("final_decision").alias("decision"),
        *(["embedding"] if with_vectors else []),
        F.col("ts").alias("created_at"), F.lit(ttl).alias("ttl_seconds"),
    )
