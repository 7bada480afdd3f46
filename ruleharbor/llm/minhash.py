"""Near duplicates by MinHash signatures and an inverted join over their coordinates.

*Sets.* A text's words (white space apart, A-Z lower-cased) give the set of its shingles of four words; fewer
words are one shingle. Rows of equal sets are one class, represented once: copies are never compared.

*Signature.* ``COORDINATES`` minima of hashed shingles. Two sets agree at a coordinate with the
probability of their similarity, so sets at 0.8 agree at fewer than ``MATCHES`` of them once in 1e7 pairs.

*Inverted join.* Every class is posted under its (coordinate, value) pairs. Pairs that no other class holds
are dropped; a class left with fewer than ``MATCHES`` has no partner. The others put their pairs into one
order, rarest first, and two classes that agree ``MATCHES`` times meet in their first ``held - MATCHES + 1``
pairs (prefix). The long posting lists at the end of the order are skipped: how often candidates collide
is counted on the two signatures. Candidates that reach the threshold are confirmed on their full sets.

*Dense groups.* In a first round the members of a list are held only against its most central one (the class
whose pairs are posted most often), which is linear in the list and joins a family of near copies. A second
round takes the lists that still hold several components, leaves out classes that hold too few shingles of other
components, and compares the rest in blocks of bounded size, signatures first and then full sets. Only
links that join components become rows, so no component is missed and a family of n copies never makes
n squared rows.

Classes and shingles are known by 64-bit hashes: n sets share one by chance with probability n * n / 2^65.

Defined cases: a text without words (empty, white space, null) has the empty set, is linked with nothing and
stays; repeated rows get one row each; a null id never names a component unless all its ids are null;
``kept`` is true where the id names the component, so for every row of a repeated id; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ruleharbor.llm.common import bytes_of, cut, per_text, sliced
from ruleharbor.llm.graph import components

WORDS = 4
COORDINATES = 80
MATCHES = 44
BLOCK = 256  # members of a list that are held against as many others at a time
PIECE = 1 << 22
_LOW = 0xFFFFFFFF


@lru_cache(maxsize=1)
def _numbers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors of words within shingles by their number (0: none), and factors and terms of the coordinates."""
    rng = np.random.default_rng(20250313)

    def draw(shape: int | tuple[int, int]) -> np.ndarray:
        return rng.integers(0, 1 << 63, shape, np.uint64) << np.uint64(1) | np.uint64(1)

    return draw((WORDS + 1, WORDS)), draw(COORDINATES), draw(COORDINATES)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a long one in pieces cut at white space."""
    start = 0
    while start < len(text):
        end = min(start + PIECE, len(text))
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end = min(i for i in [*(text.find(c, end) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")), len(text)] if i >= 0)
        yield text[start:end].lower().split()
        start = end


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Per text the sorted hashes of its distinct shingles."""
    known: dict[bytes, int] = {}
    ids, ends = [np.zeros(0, np.int32)], []
    for text in texts:
        held = 0
        for words in _words(text):
            ids.append(np.array([known.setdefault(w, len(known)) for w in words], np.int32))
            held += len(words)
        ends.append((ends[-1] if ends else 0) + held)
    hashes = np.array([xxh3_64_intdigest(w) for w in known], np.uint64)[np.concatenate(ids)]
    factors = _numbers()[0]
    full = sum((hashes[i:len(hashes) - WORDS + 1 + i] * factors[WORDS, i] for i in range(WORDS)), np.zeros(max(0, len(hashes) - WORDS + 1), np.uint64))
    full = _mixed(full)
    out, start = [], 0
    for end in ends:
        size = end - start
        if size >= WORDS:
            out.append(np.unique(full[start:end - WORDS + 1]))
        else:
            out.append(_mixed((hashes[start:end] * factors[size, :size]).sum(keepdims=True)) if size else hashes[:0])
        start = end
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``COORDINATES`` minima per set, none of them empty."""
    _, factors, terms = _numbers()
    out = np.empty((len(sets), COORDINATES), np.uint32)
    if sets:
        flat, starts = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
        for first in range(0, COORDINATES, 8):
            for i in range(first, min(first + 8, COORDINATES)):
                out[:, i] = np.minimum.reduceat(((flat * factors[i] + terms[i]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _text_key() -> Column:
    return F.xxhash64(F.col("text").cast("binary"))


def _lists(values: np.ndarray, lengths: list[int], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(values, kind))


def prints(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, key of the text, class (null without words), n of its shingles and its signature."""

    def work(texts: list[bytes]) -> dict[str, pa.Array]:
        sets = shingle_sets(texts)
        signed = signatures([s for s in sets if len(s)]).view(np.int32)
        return {"class": pa.array([int(np.uint64(xxh3_64_intdigest(s.tobytes())).view(np.int64)) if len(s) else None for s in sets], pa.int64()),
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "signature": _lists(signed.ravel(), [COORDINATES if len(s) else 0 for s in sets], pa.int32())}

    return per_text(documents.select("doc_id", "text", _text_key().alias("key")), work,
                    "class long, n long, signature array<int>", ["doc_id", "key"])


def full_sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """class and set (hashes) of the classes of ``wanted`` (doc_id and key of a row that holds the class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced([batch], 1 << 20):
                sets = shingle_sets(bytes_of(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("class"), _lists(np.concatenate(sets).view(np.int64), [len(s) for s in sets], pa.int64())], names=["class", "set"])

    rows = documents.select("doc_id", _text_key().alias("key"), F.col("text").cast("binary").alias("text"))
    on = rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["key"] == wanted["key"])
    found = rows.join(wanted, on).select(wanted["class"], "text").mapInArrow(run, "class long, set array<long>")
    return found.groupBy("class").agg(F.first("set").alias("set"))  # a row may be repeated


def posted(classes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """Classes that may have a partner: class, n, signature, the prefix of their pairs, and how central they are.

    ``classes`` holds class, n and signature.
    """
    pair = F.transform("signature", lambda x, i: F.shiftleft(i.cast("long"), 32).bitwiseOR(x.cast("long").bitwiseAND(F.lit(_LOW).cast("long"))))
    posts = classes.select("class", F.explode(pair).alias("post"))
    held = cut(posts.groupBy("post").agg(F.count(F.lit(1)).alias("among")).where("among > 1"))
    own = posts.join(held, "post").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("among", "post"))).alias("posts")).where(
        F.size("posts") >= matches)
    return own.join(classes, "class").select(
        "class", "n", "signature", F.expr(f"slice(posts, 1, size(posts) - {matches - 1}).post").alias("prefix"),
        F.aggregate("posts", F.lit(0).cast("long"), lambda s, x: s + x["among"]).alias("central"))


def _sizes_fit(a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= 80 * F.greatest(a, b)


def _collide(a: str, b: str) -> Column:
    """At how many coordinates two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def _lists_of(near: DataFrame) -> DataFrame:
    """post and class: the posting lists of the prefixes of ``near`` (the columns of ``posted``)."""
    return near.select(F.explode("prefix").alias("post"), "class")


def central_pairs(near: DataFrame, matches: int = MATCHES) -> DataFrame:
    """Each member (a) of a posting list beside its most central one (b), if sizes and signatures allow a link."""
    lists = near.select(F.explode("prefix").alias("post"), "class", "central")
    middle = lists.groupBy("post").agg(F.max(F.struct("central", "class")).alias("m")).select("post", F.col("m.class").alias("b"))
    beside = lists.select("post", F.col("class").alias("a")).join(middle, "post").where("a != b").select("a", "b").distinct()

    def of(name: str) -> DataFrame:
        return near.select(F.col("class").alias(name), F.col("n").alias(f"n_{name}"), F.col("signature").alias(f"s_{name}"))

    return beside.join(of("a"), "a").join(of("b"), "b").where(_sizes_fit("n_a", "n_b")).where(
        _collide("s_a", "s_b") >= matches).select("a", "b")


class _Block:
    """Rows of a block, against which others are held one after the other."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.marks, self.numbers = np.zeros((0, COORDINATES), np.int32), np.zeros((0, 2), np.int64)

    def add(self, row: dict) -> None:
        if len(self.rows) == len(self.marks):
            room = max(16, len(self.rows))
            self.marks = np.r_[self.marks, np.zeros((room, COORDINATES), np.int32)]
            self.numbers = np.r_[self.numbers, np.zeros((room, 2), np.int64)]
        self.marks[len(self.rows)] = row["signature"]
        self.numbers[len(self.rows)] = row["n"], row["shared"]
        self.rows.append(row)

    def alike(self, row: dict, matches: int) -> Iterator[dict]:
        """Rows that collide with ``row`` often enough and may still be linked with it."""
        n, shared = self.numbers[:len(self.rows)].T
        most = np.minimum(shared, row["shared"])
        some = np.flatnonzero(100 * most >= 80 * (n + row["n"] - most))
        some = some[(self.marks[some] == np.array(row["signature"], np.int32)).sum(axis=1) >= matches]
        return (self.rows[i] for i in some.tolist())


def _block_links(matches: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Confirmed links (a, b) that join components, among the members of one group and pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, joined, links = None, _Block(), {}, []

        def find(x: int) -> int:
            while x in joined:
                x = joined[x]
            return x

        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                sets = part.column("set")
                for i, r in enumerate(part.drop_columns(["set"]).to_pylist()):
                    now = (r["group"], r["low"], r["high"])
                    if now != key:
                        key, held, joined = now, _Block(), {}
                    r["set"] = sets[i].values.to_numpy()
                    # A block meets itself, or a later one; its own rows come first.
                    own = r["low"] == r["high"]
                    if own or r["block"] == r["high"]:
                        for x in held.alike(r, matches):
                            a, b = find(x["root"]), find(r["root"])
                            if a != b:
                                both = len(np.intersect1d(x["set"], r["set"], assume_unique=True))
                                if 100 * both >= 80 * (x["n"] + r["n"] - both):
                                    joined[max(a, b)] = min(a, b)
                                    links.append((x["class"], r["class"]))
                    if own or r["block"] == r["low"]:
                        held.add(r)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])
                links = []

    return run


def _open(lists: DataFrame) -> DataFrame:
    """Of ``lists`` (post, class, root) those that hold several components; of two members both were met in the first round."""
    several = lists.groupBy("post").agg(F.count(F.lit(1)).alias("members"), F.min("root").alias("x"), F.max("root").alias("y")).where(
        "x != y and members > 2").select("post", "members")
    return lists.join(several, "post")


def remaining_links(near: DataFrame, sets: DataFrame, roots: DataFrame, matches: int = MATCHES, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join what the first round left apart (``roots``: node, root).

    1. A class needs 80 % of its shingles in other components: what it holds alone or shares with its own
       component bounds every link of it (``shared``). That leaves most members of a large family out.
    2. Posting lists that overlap are one region. The members of a region are held against each other, or those
       of each list by itself where that is less work; either way in blocks of bounded size.
    """
    lists = _lists_of(near).join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    asked = cut(_open(lists).select("post", "class", "root"))
    shingles = asked.select("class", "root").distinct().join(sets, "class").select("class", "root", F.explode("set").alias("shingle"))
    abroad = shingles.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("shingle")
    able = shingles.join(abroad, "shingle").groupBy("class").agg(F.count(F.lit(1)).alias("shared")).join(
        near.select("class", "n", "signature"), "class").where("100 * shared >= 80 * n")
    able = cut(able)
    rest = cut(_open(asked.join(able.select("class"), "class")))
    least = rest.groupBy("post").agg(F.min("class").alias("b"))
    regions = cut(components(rest.select("post", F.col("class").alias("a")).join(least, "post").select("a", "b")))
    within = rest.join(regions.select(F.col("node").alias("class"), F.col("root").alias("region")), "class")
    # The work of a region as a whole and list by list.
    whole = regions.groupBy(F.col("root").alias("region")).agg((F.count(F.lit(1)).cast("double") ** 2).alias("whole"))
    parts = within.select("region", "post", "members").distinct().groupBy("region").agg(F.sum(F.col("members").cast("double") ** 2).alias("parts"))
    as_one = whole.join(parts, "region").select("region", (F.col("whole") <= F.col("parts")).alias("as_one"))
    group = F.struct(F.when(F.col("as_one"), F.lit(0)).otherwise(1).alias("kind"), F.when(F.col("as_one"), F.col("region")).otherwise(F.col("post")).alias("id"))
    members = within.join(as_one, "region").select(group.alias("group"), "class", "root").distinct()
    sizes = members.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = members.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    own = able.join(sets, "class").select("class", "n", "shared", "signature", "set")
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(own, "class")
    tasks = int(near.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.select(
        F.xxhash64("group").alias("group"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "class",
        "root", "n", "shared", "signature", "set").repartition(tasks, "group", "low", "high").sortWithinPartitions(
        "group", "low", "high", "block").mapInArrow(_block_links(matches), "a long, b long").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are 0.8 alike."""
    def of(name: str) -> DataFrame:
        return sets.select(F.col("class").alias(name), F.col("set").alias(f"set_{name}"))

    # Members first: the set of a class that many are held against is then met in place, not moved per pair.
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return pairs.join(of("a"), "a").join(of("b"), "b").where(
        100 * both >= 80 * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")


def links(classes: DataFrame, documents: DataFrame, matches: int = MATCHES, block: int = BLOCK) -> DataFrame:
    """(node, root) of every class that is linked with another one.

    ``classes`` holds class, n, signature, and doc_id and key of a row that has the class.
    """
    near = cut(posted(classes.select("class", "n", "signature"), matches))
    sets = cut(full_sets(documents, near.select("class").join(classes, "class").select("class", "doc_id", "key")))
    first = cut(central_pairs(near, matches))
    found = cut(components(confirmed(first, sets)))
    more = cut(remaining_links(near, sets, found, matches, block))
    if more.isEmpty():
        return found
    return cut(components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)))


def near_duplicates(documents: DataFrame, matches: int = MATCHES, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable) and kept (its id names the component)."""
    rows = cut(prints(documents))
    classes = cut(rows.where("class is not null").groupBy("class").agg(
        F.first("n").alias("n"), F.first("signature").alias("signature"), F.min(F.struct("doc_id", "key")).alias("row"),
        F.min("doc_id").alias("least_id")).select("class", "n", "signature", "row.doc_id", "row.key", "least_id"))
    found = links(classes.drop("least_id"), documents, matches, block)
    rooted = cut(classes.join(found, classes["class"] == found["node"], "left").select(
        "class", "least_id", F.coalesce("root", "class").alias("root")))
    # Written first, so that the join on a root of many classes can be split.
    ids = cut(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")))
    named = rooted.select("class", "root").join(ids, "root").select("class", "component_id")
    told = rows.select("doc_id", "n", "class").join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return told.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                       F.col("doc_id").eqNullSafe(component).alias("kept"))
