"""Near duplicates by 64-bit similarity fingerprints and covering locality-sensitive hashing.

*Fingerprints.* A text's words (white space apart, A-Z lower-cased) give shingles of four words,
repeats included; bit i is set if it is set in over half of the shingles' XXH64 values.

*Covering tables.* Bit i of the fingerprint gets the code ``1 + i mod 31`` of five bits. Table v
(1..31) keeps the bits whose code has an odd number of ones in common with v. Any four codes span
at most four of five dimensions, so some v has an even number in common with all of them: every
pair that differs in at most four bits agrees on all kept bits of that table. No pair is missed.

*Links.* Only distinct fingerprints enter the tables. Their rows are shuffled once and read in the order of
the buckets. A bucket of two is its own pair. A larger one of at most ``GATHERED`` members is compared
inside its group and gives a spanning forest, never its pairs. A bucket beyond that is not gathered:
its members go on as rows and send out their variants with up to two of the free bits flipped; two members are within
four bits exactly if they share a variant, and each variant links its members to the smallest
one. That is linear in the size of the bucket and loses no link.

*Components* are star contractions over distinct fingerprints, then the smallest id of each.

Defined cases: a text without words (empty, white space, null) has fingerprint zero, linked like
any other; fewer than four words are one shingle; repeated rows get one row each; a null id
never names a component unless all its ids are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from ruleharbor.llm.common import cut, per_text
from ruleharbor.llm.graph import components

WORDS = 4
SEED = 42
RADIUS = 4
TABLES = (1 << (RADIUS + 1)) - 1
GATHERED = 512
_CODES = [1 + i % TABLES for i in range(64)]
_COLUMN = (np.arange(8, dtype=np.int64) << 8)[None, :]
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


# The bits that a table keeps, most significant bit first as bit 63.
MASKS = [signed(sum(1 << i for i in range(64) if (_CODES[i] & v).bit_count() % 2)) for v in range(1, TABLES + 1)]
FREE = [[i for i in range(64) if not (_CODES[i] & v).bit_count() % 2] for v in range(1, TABLES + 1)]


def fingerprint(text: bytes) -> int:
    """The fingerprint of a text as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    ones, total = np.zeros(64, np.int64), max(1, len(words) - WORDS + 1)
    for at in range(0, total, 1 << 16):
        part = words[at:at + (1 << 16) + WORDS - 1]
        whole = b" ".join(part)
        ends = (np.cumsum([len(w) + 1 for w in part]) - 1).tolist()
        starts = [0, *(e + 1 for e in ends[:-1])]
        lasts = ends[WORDS - 1:] or ends[-1:]
        hashes = b"".join([xxh64_digest(whole[s:e], SEED) for s, e in zip(starts, lasts, strict=False)])
        values = np.frombuffer(hashes, np.uint8).reshape(-1, 8) + _COLUMN
        counts = np.bincount(values.ravel(), minlength=2048).reshape(8, 256)
        ones += (counts @ _BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (doc_id) and fingerprint (``fp``, a signed long) of every row."""

    def work(texts: list[bytes]) -> dict[str, pa.Array]:
        return {"fp": pa.array([signed(fingerprint(t)) for t in texts], pa.int64())}

    return per_text(documents, work, "fp long", ["doc_id"] if keep is None else keep)


def forest(members: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links of a spanning forest over members (signed, distinct) that differ in at most ``radius`` bits."""
    rest = np.sort(members).view(np.uint64)
    links: list[tuple[int, int]] = []
    front: list[np.uint64] = []
    while len(rest):
        if not front:
            front, rest = [rest[0]], rest[1:]
        middle = front.pop()
        close = np.bitwise_count(rest ^ middle) <= radius
        found = rest[close]
        links += [(int(middle.astype(np.int64)), int(x)) for x in found.view(np.int64)]
        front += list(found)
        rest = rest[~close]
    return links


def _in_buckets(gathered: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links (a, b) within the buckets of rows (v, key, fp) sorted by v and key; members (v, a) of those of more than ``gathered``."""

    def links_of(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
        a, b = (fps[starts[sizes == 2] + i] for i in (0, 1))
        close = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= RADIUS
        found = list(zip(a[close].tolist(), b[close].tolist(), strict=True))
        for at, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            found += forest(fps[at:at + size])
        return found

    def told(found: list[tuple[int, int]], v: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        none = [None] * len(found)
        return pa.RecordBatch.from_arrays([
            pa.array([*none, *v.tolist()], pa.int32()), pa.array([*(x for x, _ in found), *fps.tolist()], pa.int64()),
            pa.array([*(y for _, y in found), *[None] * len(fps)], pa.int64())], names=["v", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last bucket of a batch may go on in the next one: it is held back, or, when too large, only known by its name.
        held, open_wide = np.zeros((3, 0), np.int64), None
        for batch in batches:
            rows = np.c_[held, [batch.column(c).to_numpy().astype(np.int64) for c in ("v", "key", "fp")]]
            if not rows.shape[1]:
                continue
            starts = np.flatnonzero(np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)])
            sizes = np.diff(np.r_[starts, rows.shape[1]])
            wide = sizes > gathered
            if open_wide == tuple(rows[:2, 0]):
                wide[0] = True
            open_wide = tuple(rows[:2, -1]) if wide[-1] else None
            held = rows[:, rows.shape[1]:] if wide[-1] else rows[:, starts[-1]:]
            far = np.repeat(wide, sizes)
            wide[-1] = True  # is told with the next batch
            yield told(links_of(rows[2], starts[~wide], sizes[~wide]), rows[0, far], rows[2, far])
        sizes = np.array([held.shape[1]])
        yield told(links_of(held[2], np.array([0]), sizes), held[0, :0], held[2, :0])

    return run


def links(distinct: DataFrame, gathered: int = GATHERED) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``distinct`` (fp, once each) in the radius."""
    tables = F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                       for v, m in enumerate(MASKS)])
    # A row becomes 31: spread the few bytes of the fingerprints over all tasks first.
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = distinct.repartition(parts, "fp").select("fp", F.explode(tables).alias("t")).select("t.v", "t.key", "fp")
    found = cut(keyed.repartition(parts, "v", "key").sortWithinPartitions("v", "key").mapInArrow(
        _in_buckets(gathered), "v int, a long, b long"))
    inside = found.where("b IS NOT NULL").select("a", "b")

    free = F.array(*[F.array(*[F.lit(signed(1 << i)) for i in bits]) for bits in FREE])
    wide = found.where("b IS NULL").select("v", F.col("a").alias("fp")).withColumn("free", F.element_at(free, F.col("v") + 1))
    flips = F.concat(
        F.array(F.lit(0).cast("long")), F.col("free"),
        F.flatten(F.transform("free", lambda x, i: F.transform(
            F.slice("free", i + 2, F.size("free")), lambda y: x.bitwiseOR(y)))))
    variants = wide.select("v", "fp", F.explode(flips).alias("flip")).select(
        "v", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    middle = variants.groupBy("v", "variant").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    through = variants.join(middle, ["v", "variant"]).where("fp != b").select(F.col("fp").alias("a"), "b")
    return inside.union(through).distinct()


def named(prints: DataFrame, gathered: int = GATHERED) -> DataFrame:
    """Per distinct fingerprint of ``prints`` (doc_id, fp): the root of its component and the smallest id in it."""
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    found = cut(components(links(classes.select("fp"), gathered)))
    rooted = cut(classes.join(found, classes["fp"] == found["node"], "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")))
    # Written first, so that the join on a root of many fingerprints can be split.
    ids = cut(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")))
    return rooted.select("fp", "root").join(ids, "root")


def near_duplicates(documents: DataFrame, gathered: int = GATHERED) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits) and component_id, the smallest id reachable."""
    prints = cut(fingerprints(documents))
    return prints.join(named(prints, gathered).select("fp", "component_id"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, gathered: int = GATHERED) -> DataFrame:
    """One document of each component, with its columns: the one with the smallest id, which any id beats none for.

    Rows are told apart by id and text, so ids that come twice and rows without id lose no other text's
    document. Where several texts of a component have that id, the one of the smallest digest stays; of
    rows equal in both, one.
    """
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    prints = cut(fingerprints(documents.select("doc_id", "text", digest.alias("digest")), ["doc_id", "digest"]))
    least = prints.join(named(prints, gathered), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = least.groupBy("root").agg(F.first("component_id").alias("doc_id"), F.min("digest").alias("digest"))

    def key(digest: Column) -> Column:
        return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), digest)

    rows = documents.withColumn("__key", key(digest))
    one = Window.partitionBy("__key").orderBy(F.xxhash64("text"))
    return rows.join(first.select(key(F.col("digest")).alias("__stay")), F.col("__key") == F.col("__stay"), "left_semi").withColumn(
        "__n", F.row_number().over(one)).where("__n = 1").select(*documents.columns)
