"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

1. *Word vectors.* Each word, known by a 64-bit hash, owns a sparse ternary index vector. A word's vector
   is the sum of the index vectors of its neighbours over the whole collection, exact for every word.
   Sums are whole numbers, so the result is the same in any order of tasks. Words that a sample shows to be
   frequent (at most ``FREQUENT``) are added up per task and sent to the tasks as one table. Any other word has
   a row per document, small numbers packed three or two to a byte; their sum, written once with the keys of its documents, goes back to the documents that
   share the word by a join on the document's key, to which texts go packed, and a word of one document only is
   summed up from this document. Which words count as frequent changes the work but no vector.
2. *Pooling.* A document is, per dimension, the mean of its words' unit vectors, their spread, and the
   mean products of neighbouring words' vectors and index vectors, which are high where words repeat.
3. *Network.* One hidden layer, trained in numpy on at most ``MOST_LABELLED`` labelled documents
   (chosen by hash of the id; a documented bound); a quarter of them is kept apart to fit
   the temperature that calibrates the probabilities.

Words are runs of letters and digits (case ignored) and runs of marks, so what stands between the
words counts as well. Neither source, language nor id enters a score.

Defined cases: an empty or null text is a document without words and gets the network's
score of the zero vector. Without two classes of labelled rows the score is the smoothed share
of label 1 (0.5 without labels). A document with several label rows takes the smallest label.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations, product
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ruleharbor.llm.common import bytes_of, cut, id_remainder, learning_sample, sliced

SLOTS = 1 << 15  # of the hashed form, which no query uses
FREQUENT = 1 << 18  # words in the table that every task gets (8 MB of sums below 128, 16 MB below 32,768)
SAMPLED = 4  # one row in so many shows which words are frequent
WIDTH = 32
NONZERO = 4
REACH = 2
POOLS = 4  # mean, spread, product of neighbours' vectors, product of neighbours' index vectors
BLOCK = 1024
HIDDEN = 24
MOST_LABELLED = 20_000
KEYS = 1 << 12  # keys in a row of the sum of a word; more are several rows
THRESHOLD = 0.3
_UNIT = re.compile(rb"[0-9a-z\x80-\xff]+|[^\s0-9a-z\x80-\xff]+")


def slots_of(text: bytes) -> list[int]:
    mask = SLOTS - 1
    return [crc32(w) & mask for w in _UNIT.findall(text.lower())]


@lru_cache(maxsize=1)
def index_vectors() -> np.ndarray:
    """The sparse ternary index vectors; the last row, of no word, is zero."""
    rng = np.random.default_rng(20240517)
    out = np.zeros((SLOTS + 1, WIDTH), np.int8)
    places = np.argsort(rng.random((SLOTS, WIDTH)), axis=1)[:, :NONZERO]
    out[np.arange(SLOTS)[:, None], places] = rng.choice(np.array([-1, 1], np.int8), (SLOTS, NONZERO))
    return out


def add_contexts(sums: np.ndarray, texts: list[bytes], index: np.ndarray) -> None:
    """Adds to each word's row the index vectors of the words up to ``REACH`` places away."""
    gap = [SLOTS] * REACH
    flat: list[int] = list(gap)
    for text in texts:
        flat += slots_of(text)
        flat += gap
    ids = np.array(flat, np.int32)
    around = np.zeros((len(ids), WIDTH), np.int16)
    near = index[ids].astype(np.int16)
    for step in range(1, REACH + 1):
        around[step:] += near[:-step]
        around[:-step] += near[step:]
    order = np.argsort(ids, kind="stable")
    ranked = ids[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    sums[ranked[starts]] += np.add.reduceat(around[order], starts, axis=0, dtype=np.int64)


def _sum_blocks(rows: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for block, data in rows:
        part = np.frombuffer(data, np.int64)
        held[block] = held[block] + part if block in held else part
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())],
        names=["block", "data"])


def _add_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _sum_blocks((k, d) for b in batches
                           for k, d in zip(b.column("block").to_pylist(), b.column("data").to_pylist(), strict=True))


def word_vectors(documents: DataFrame) -> np.ndarray:
    """Unit vectors of all slots over all documents; a fixed ``SLOTS`` x ``WIDTH`` table (4 MB).

    The hashed form: words of one slot share a vector. It is kept to compare with; scores use ``word_sums``.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sums = index_vectors(), np.zeros((SLOTS + 1, WIDTH), np.int64)
        for batch in sliced(batches, 2 << 20):
            add_contexts(sums, bytes_of(batch.column("text")), index)
        blocks = ((i // BLOCK, sums[i:i + BLOCK]) for i in range(0, SLOTS, BLOCK))
        yield from _sum_blocks((i, block.tobytes()) for i, block in blocks if block.any())

    shape = "block int, data binary"
    parts = documents.select(F.col("text").cast("binary").alias("text")).mapInArrow(gather, shape)
    blocks = SLOTS // BLOCK
    lanes = F.pmod(F.spark_partition_id(), F.lit(8))
    total = parts.withColumn("lane", lanes).repartition(blocks, "block", "lane").select("block", "data").mapInArrow(
        _add_parts, shape).repartition(blocks, "block").mapInArrow(_add_parts, shape)
    table = np.zeros((SLOTS + 1, WIDTH), np.float32)
    for block, data in total.collect():
        table[block * BLOCK:(block + 1) * BLOCK] = np.frombuffer(data, np.int64).reshape(-1, WIDTH)
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    return table


@lru_cache(maxsize=1)
def ternary() -> np.ndarray:
    """All vectors of ``WIDTH`` numbers of which ``NONZERO`` are one or minus one (18 MB)."""
    places = np.array(list(combinations(range(WIDTH), NONZERO)))
    signs = np.array(list(product((-1, 1), repeat=NONZERO)), np.int8)
    out = np.zeros((len(places), len(signs), WIDTH), np.int8)
    out[np.arange(len(places))[:, None, None], np.arange(len(signs))[None, :, None], places[:, None, :]] = signs
    return out.reshape(-1, WIDTH)


def index_of(words: np.ndarray) -> np.ndarray:
    """The index vectors of hashed words."""
    return ternary()[words.view(np.uint64) % np.uint64(len(ternary()))]


class Places:
    """The word places of some texts: ``words`` are the hashes of the distinct words, ``ids`` their numbers by place
    with ``REACH`` places of -1 around each text, ``bounds`` the first place and the end of each text."""

    def __init__(self, texts: list[bytes]):
        known: dict[bytes, int] = {}
        flat, self.bounds = [-1] * REACH, []
        for text in texts:
            start = len(flat)
            flat += [known.setdefault(w, len(known)) for w in _UNIT.findall(text.lower())]
            self.bounds.append((start, len(flat)))
            flat += [-1] * REACH
        self.ids = np.array(flat, np.int32)
        self.words = np.array([xxh3_64_intdigest(w) for w in known], np.uint64).view(np.int64)
        self.index = np.r_[index_of(self.words), np.zeros((1, WIDTH), np.int8)]

    def sums(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The groups (a number per place, none below 0) and the sums of the index vectors around their places."""
        near = self.index[self.ids]
        around = np.zeros(near.shape, np.int8)  # at most 2 * REACH
        for step in range(1, REACH + 1):
            around[step:] += near[:-step]
            around[:-step] += near[step:]
        wanted = np.flatnonzero(groups >= 0)
        order = wanted[np.argsort(groups[wanted], kind="stable")]
        ranked = groups[order]
        if not len(ranked):
            return ranked, np.zeros((0, WIDTH), np.int64)
        starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        return ranked[starts], np.add.reduceat(around[order], starts, axis=0, dtype=np.int64)

    def rows_in(self, words: np.ndarray) -> np.ndarray:
        """Per distinct word its row in sorted hashes, or -1; one more for no word."""
        out = np.full(len(self.words) + 1, -1)
        if len(words):
            at = np.minimum(np.searchsorted(words, self.words), len(words) - 1)
            out[:-1] = np.where(words[at] == self.words, at, -1)
        return out


def _triples(sums: np.ndarray) -> np.ndarray:
    """Numbers from -2 to 2, three to a byte."""
    digits = np.zeros((len(sums), 3 * -(-WIDTH // 3)), np.uint8)
    digits[:, :WIDTH] = sums + 2
    return digits[:, 0::3] * np.uint8(25) + digits[:, 1::3] * np.uint8(5) + digits[:, 2::3]


def _halves(sums: np.ndarray) -> np.ndarray:
    """Numbers from -7 to 7, two to a byte."""
    digits = (sums + 8).astype(np.uint8)
    return digits[:, 0::2] << np.uint8(4) | digits[:, 1::2]


_OF_TRIPLES = np.array(list(product(range(-2, 3), repeat=3)), np.int8)
_OF_HALVES = np.array(list(product(range(-8, 8), repeat=2)), np.int8)
# The largest number, the way to bytes and back; a cell's length tells which it is.
_CELLS = (
    (2, _triples, lambda found: _OF_TRIPLES[found]),
    (7, _halves, lambda found: _OF_HALVES[found]),
    (127, lambda sums: sums.astype(np.int8).view(np.uint8), lambda found: found.view(np.int8)),
    (np.iinfo(np.int64).max, lambda sums: sums.astype(np.int64).view(np.uint8), lambda found: found.view(np.int64)),
)
_LENGTHS = tuple(pack(np.zeros((1, WIDTH), np.int64)).shape[1] for _, pack, _ in _CELLS)


def _pieces(chosen: np.ndarray) -> Iterator[np.ndarray]:
    rows = np.flatnonzero(chosen)
    for i in range(0, len(rows), 1 << 14):
        yield rows[i:i + (1 << 14)]


def _packed(sums: np.ndarray) -> pa.Array:
    """A cell per row, in the fewest bytes of ``_CELLS`` that hold its numbers."""
    form = np.searchsorted([most for most, _, _ in _CELLS], np.abs(sums).max(axis=1, initial=0))
    ends = np.cumsum(np.array(_LENGTHS)[form])
    data = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    for i, (_, pack, _) in enumerate(_CELLS):
        for rows in _pieces(form == i):
            data[(ends[rows] - _LENGTHS[i])[:, None] + np.arange(_LENGTHS[i])] = pack(sums[rows])
    return pa.Array.from_buffers(pa.binary(), len(sums), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(data)])


def _unpacked(cells: list[bytes]) -> np.ndarray:
    sizes = np.fromiter(map(len, cells), np.int64, len(cells))
    data, ends = np.frombuffer(b"".join(cells), np.uint8), np.cumsum(sizes)
    out = np.empty((len(cells), WIDTH), np.int64)
    for length, (_, _, unpack) in zip(_LENGTHS, _CELLS, strict=True):
        for rows in _pieces(sizes == length):
            out[rows] = unpack(data[(ends[rows] - length)[:, None] + np.arange(length)]).reshape(len(rows), -1)[:, :WIDTH]
    return out


def _units(sums: np.ndarray) -> np.ndarray:
    return (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def texts_of(packed: list[bytes | None], sizes: list[int]) -> list[bytes]:
    """The texts that ``packed_texts`` wrote; a null is an empty text."""
    codec = pa.Codec("zstd")
    return [codec.decompress(c, n, asbytes=True) if n else b"" for c, n in zip(packed, sizes, strict=True)]


def _by_size(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of a piece hold about ``most`` bytes or are one."""
    for batch in batches:
        start, held = 0, 0
        for i, size in enumerate(batch.column("__size").to_pylist()):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def packed_texts(rows: DataFrame) -> DataFrame:
    """``rows`` with ``__packed`` and ``__size`` in place of ``__text`` (binary), which makes the way to a join shorter."""
    names = [c for c in rows.columns if c != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in sliced(batches):
            texts = batch.column("__text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array([t and codec.compress(t, asbytes=True) for t in texts], pa.binary()),
                 pa.array([len(t or b"") for t in texts], pa.int64())], names=[*names, "__packed", "__size"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text"]
    return rows.mapInArrow(run, ", ".join([*fields, "__packed binary", "__size long"]))


def key_of() -> Column:
    """Rows of equal id and text have the same key. Rows that share one by chance only share what is looked up."""
    return F.xxhash64("doc_id", F.col("text").cast("binary"))


def _block(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed blocks of rows for a cut, in which rows would stand uncompressed."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_block(batch)], pa.binary())], names=["block"])


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.column("block"):
            yield from pa.ipc.open_stream(block.as_buffer())


def frequent_words(rows: DataFrame, most: int) -> np.ndarray:
    """The sorted hashes of at most ``most`` words, the more frequent ones of a sample of the rows (key, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = Places(bytes_of(batch.column("text")))
            n = np.bincount(found.ids[found.ids >= 0], minlength=len(found.words))
            yield pa.RecordBatch.from_arrays([pa.array(found.words), pa.array(n, pa.int64())], names=["word", "n"])

    shape = "word long, n long"
    counts = cut(rows.where(F.pmod("key", F.lit(SAMPLED)) == 0).mapInArrow(count, shape).groupBy("word").agg(
        F.sum("n").alias("n")).mapInArrow(_pressed, "block binary")).mapInArrow(_rows_of, shape)
    chosen, held = F.lit(False), 0
    for n, words in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).collect():
        # Of the last count as many words as there is room for, by their hash; a little less, as shares of hashes vary.
        share = 1.0 if held + words <= most else max(0.0, (most - held) / words - 4 / words ** 0.5)
        chosen = (F.col("n") > n) | ((F.col("n") == n) & (F.pmod("word", F.lit(1 << 20)) < int(share * (1 << 20))))
        held += words
        if held > most:
            break
    return np.sort(counts.where(chosen).select("word").toArrow().column("word").to_numpy())


_SUMS = "word long, key long, sums binary"
_TOTALS = "word long, keys array<long>, sums binary"


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per word: without keys for a frequent one, for others with their keys, if there are several."""
    held = list(batches)
    if not sum(b.num_rows for b in held):
        return
    rows = pa.Table.from_batches(held)
    word, key = rows.column("word").to_numpy(), rows.column("key").fill_null(0).to_numpy()
    everywhere = rows.column("key").is_null().to_numpy()
    order = np.lexsort((key, word))
    word, key, everywhere = word[order], key[order], everywhere[order]
    new = np.r_[True, word[1:] != word[:-1]]
    starts = np.flatnonzero(new)
    total = np.add.reduceat(_unpacked(rows.column("sums").to_pylist())[order], starts, axis=0)
    several = np.diff(np.r_[starts, len(word)]) > 1
    group = np.cumsum(new) - 1
    first = new | np.r_[True, key[1:] != key[:-1]]
    keep = np.flatnonzero(first & (everywhere | several[group]))
    word, key, everywhere, group = word[keep], key[keep], everywhere[keep], group[keep]
    if not len(keep):
        return
    # A row ends with its word, or with as many keys as a row holds.
    new = np.r_[True, word[1:] != word[:-1]]
    place = np.arange(len(word))
    new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % KEYS == 0
    ends = np.r_[np.flatnonzero(new), len(word)]
    for i in range(0, len(ends) - 1, 10_000):
        bounds = ends[i:i + 10_001]
        some, low, high = bounds[:-1], bounds[0], bounds[-1]
        keys = pa.ListArray.from_arrays(pa.array(bounds - low, pa.int32()), pa.array(key[low:high], pa.int64()), mask=pa.array(everywhere[some]))
        yield pa.RecordBatch.from_arrays([pa.array(word[some]), keys, _packed(total[group[some]])], names=["word", "keys", "sums"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``_sum_rows`` as compressed blocks, those of frequent words (without keys) apart."""
    for batch in batches:
        alone = batch.column("keys").is_null()
        for everywhere, chosen in ((True, alone), (False, pc.invert(alone))):
            some = batch.filter(chosen)
            if some.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([everywhere]), pa.array([_block(some)], pa.binary())], names=["everywhere", "block"])


class Frequent:
    """Sorted hashes of the frequent words and the sums of their contexts, each in the fewest bytes that hold it."""

    def __init__(self, words: np.ndarray, rows: np.ndarray, sums: np.ndarray):
        self.words, self.parts = words, []
        most = np.abs(sums).max(axis=1, initial=0)
        left = np.argsort(rows)
        for kind in (np.int8, np.int16, np.int32, np.int64):
            fits = most[left] <= np.iinfo(kind).max
            some, left = left[fits], left[~fits]
            self.parts.append((rows[some], sums[some].astype(kind)))

    def units(self, rows: np.ndarray) -> np.ndarray:
        """The unit vectors of the words of ``rows``; zero for one without contexts."""
        out = np.zeros((len(rows), WIDTH), np.int64)
        for held, sums in self.parts:
            if len(held):
                at = np.minimum(np.searchsorted(held, rows), len(held) - 1)
                known = held[at] == rows
                out[known] = sums[at[known]]
        return _units(out)


@dataclass(frozen=True)
class Words:
    """The frequent words as every task gets them, and (key, word, sums) of the others in several rows."""

    frequent: Broadcast[Frequent]
    shared: DataFrame


def word_sums(documents: DataFrame) -> Words:
    """The context sums of all words over all documents."""
    rows = documents.select(key_of().alias("key"), F.col("text").cast("binary").alias("text"))
    frequent = frequent_words(rows, FREQUENT)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(frequent), WIDTH), np.int64)
        for batch in sliced(batches, 2 << 20):
            found = Places(bytes_of(batch.column("text")))
            at = found.rows_in(frequent)[found.ids]
            some, added = found.sums(at)
            sums[some] += added
            text = np.zeros(len(found.ids), np.int64)
            for i, (start, stop) in enumerate(found.bounds):
                text[start:stop] = i
            size = len(found.words) + 1
            pairs, added = found.sums(np.where((at < 0) & (found.ids >= 0), text * size + found.ids, -1))
            keys = batch.column("key").to_numpy()[pairs // size]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.words[pairs % size], pa.int64()), pa.array(keys, pa.int64()), _packed(added)],
                names=["word", "key", "sums"])
        some = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(frequent[some]), pa.nulls(len(some), pa.int64()), _packed(sums[some])], names=["word", "key", "sums"])

    total = cut(rows.mapInArrow(gather, _SUMS).repartition("word").mapInArrow(lambda b: _blocks(_sum_rows(b)), "everywhere boolean, block binary"))
    found = total.where("everywhere").select("block").mapInArrow(_rows_of, _TOTALS).select("word", "sums").toArrow()
    held = Frequent(frequent, np.searchsorted(frequent, found.column("word").to_numpy()), _unpacked(found.column("sums").to_pylist()))
    shared = total.where("not everywhere").select("block").mapInArrow(_rows_of, _TOTALS)
    return Words(documents.sparkSession.sparkContext.broadcast(held), shared.select(F.explode("keys").alias("key"), "word", "sums"))


def pooled(found: Places, vectors: np.ndarray) -> np.ndarray:
    """Per text the mean of its words' vectors, their spread, and mean products of neighbours' vectors of both kinds.

    A text without words gets zeros.
    """
    out = np.zeros((len(found.bounds), POOLS * WIDTH), np.float32)
    for i, (first, stop) in enumerate(found.bounds):
        size = stop - first
        if size:
            total, square, beside, same = np.zeros((4, WIDTH))
            for start in range(first, stop, 1 << 16):
                some = found.ids[start:min(stop, start + (1 << 16) + 1)]
                rows, marks = vectors[some], found.index[some]
                own = rows[:1 << 16]
                total += own.sum(axis=0, dtype=np.float64)
                square += np.einsum("ij,ij->j", own, own, dtype=np.float64)
                beside += np.einsum("ij,ij->j", rows[1:], rows[:-1], dtype=np.float64)
                same += (marks[1:] * marks[:-1]).sum(axis=0, dtype=np.int64)
            mean = total / size
            out[i, :WIDTH] = mean
            out[i, WIDTH:2 * WIDTH] = np.sqrt(np.maximum(square / size - mean * mean, 0))
            out[i, 2 * WIDTH:3 * WIDTH] = beside / max(1, size - 1)
            out[i, 3 * WIDTH:] = same / max(1, size - 1)
    return out


def features_of(texts: list[bytes], words: np.ndarray, cells: list[bytes], frequent: Frequent) -> np.ndarray:
    """The pooled vectors of texts; ``words`` and ``cells`` are the sums of their words that other texts hold too."""
    found = Places(texts)
    vectors = np.zeros((len(found.words) + 1, WIDTH), np.float32)
    rows = found.rows_in(frequent.words)
    vectors[rows >= 0] = frequent.units(rows[rows >= 0])
    words, first = np.unique(words, return_index=True)
    told = found.rows_in(words)
    told[rows >= 0] = -1
    used = np.flatnonzero(told >= 0)
    vectors[used] = _units(_unpacked([cells[first[t]] for t in told[used].tolist()]))
    own, sums = found.sums(np.where((rows < 0) & (told < 0), np.r_[np.arange(len(found.words)), -1], -1)[found.ids])
    vectors[own] = _units(sums)
    return pooled(found, vectors)


def per_row(documents: DataFrame, known: Words, work: Callable[[np.ndarray], pa.Array], schema: str,
            keep: list[str]) -> DataFrame:
    """Runs ``work`` over the pooled vectors of documents; returns ``keep`` and its column."""
    frequent, name = known.frequent, schema.split()[0]
    kind = documents.schema["text"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_size(batches, 2 << 20):
            told = pc.list_flatten(batch.column("__told"))
            texts = texts_of(batch.column("__packed").to_pylist(), batch.column("__size").to_pylist())
            found = features_of(texts, pc.struct_field(told, "word").to_numpy(zero_copy_only=False).astype(np.int64),
                                pc.struct_field(told, "sums").to_pylist(), frequent.value)
            columns = {k: batch.column(k) for k in keep if k != "text"}
            if "text" in keep:
                plain = pa.array(texts, pa.binary(), mask=batch.column("__packed").is_null().to_numpy(zero_copy_only=False))
                columns["text"] = plain if kind == "binary" else plain.view(pa.string())
            yield pa.RecordBatch.from_arrays([*(columns[k] for k in keep), work(found)], names=[*keep, name])

    told = known.shared.groupBy(F.col("key").alias("__key")).agg(F.collect_list(F.struct("word", "sums")).alias("__told"))
    rows = packed_texts(documents.select(
        *(k for k in keep if k != "text"), key_of().alias("__key"), F.col("text").cast("binary").alias("__text"))).join(told, "__key", "left").drop("__key")
    fields = [f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in keep]
    return rows.mapInArrow(run, ", ".join([*fields, schema]))


@dataclass(frozen=True)
class Network:
    """Two layers on standardised features; ``prior`` alone where there was nothing to learn."""

    prior: float
    shift: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple[np.ndarray, ...] = ()
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.shift) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 30, seed: int = 7) -> Network:
    """Adam on the cross entropy; the temperature is the one with the least loss on rows kept apart."""
    prior = (float(y.sum()) + 1) / (len(y) + 2)
    if len(y) < 8 or y.min() == y.max():
        return Network(prior)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    apart, rest = np.split(order, [len(y) // 4])
    shift, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - shift) / scale
    layers = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN),
              rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second, step = [0 * w for w in layers], [0 * w for w in layers], 0
    rounds = epochs * max(1, len(rest) // 128)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(rest), max(1, len(rest) // 128)):
            hidden = np.tanh(z[batch] @ layers[0] + layers[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ layers[2] + layers[3], -60, 60))) - y[batch]) / len(batch)
            back = np.outer(error, layers[2]) * (1 - hidden * hidden)
            grads = [z[batch].T @ back + 1e-4 * layers[0], back.sum(axis=0), hidden.T @ error + 1e-4 * layers[2],
                     error.sum(keepdims=True)]
            step += 1
            rate = 0.01 * max(0.02, 1 - step / rounds)
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                layers[i] = layers[i] - rate * (first[i] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    found = Network(prior, shift, scale, tuple(layers))
    logits, truth = found.logits(x[apart]), y[apart]
    options = np.exp(np.linspace(np.log(0.5), np.log(8.0), 33))
    losses = [np.mean(np.logaddexp(0, logits / t) - truth * logits / t) for t in options]
    return Network(prior, shift, scale, tuple(layers), float(options[int(np.argmin(losses))]))


def fit(documents: DataFrame, labels: DataFrame, words: Words, most: int = MOST_LABELLED) -> Network:
    """Learns from labelled rows whose crc32(doc_id as text) mod 5 is not 0."""
    known = labels.where((id_remainder(5) != 0) & F.col("quality").isNotNull()).groupBy("doc_id").agg(
        F.min("quality").alias("quality"))
    sample = learning_sample(documents, known, most, ["quality"])
    keys = sample.select(key_of().alias("key")).distinct()
    near = Words(words.frequent, words.shared.join(F.broadcast(keys), "key", "left_semi"))

    def work(found: np.ndarray) -> pa.Array:
        return pa.array(list(found), pa.list_(pa.float32()))

    rows = per_row(sample, near, work, "features array<float>", ["doc_id", "quality"]).toArrow().sort_by("doc_id")
    if rows.num_rows == 0:
        return Network(0.5)
    x = np.array(rows.column("features").to_pylist(), np.float64)
    y = (rows.column("quality").to_numpy() >= 1).astype(float)
    return train(x, y)


def score(documents: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (the id by default), the score in [0, 1] and the verdict at the threshold, per document."""
    words = word_sums(documents)
    network = fit(documents, labels, words)

    def work(found: np.ndarray) -> pa.Array:
        return pa.array(network.scores(found.astype(np.float64)), pa.float64())

    scored = per_row(documents, words, work, "__score double", ["doc_id"] if keep is None else keep)
    return scored.withColumn("__predicted", (F.col("__score") >= THRESHOLD).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents the classifier accepts, with their columns."""
    return score(documents, labels, documents.columns).where("__predicted = 1").select(*documents.columns)
