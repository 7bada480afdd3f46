"""Benchmark decontamination by greedy string tiling.

The benchmark is the stated set of queries: its items are dealt into blocks of bounded size, and
each block goes over all documents once. In a task, the words of a batch of documents become
numbers, windows of ``LEAST`` words become rolling hashes, and windows whose hash is one of the block's
are the seeds that pair a document with an item. Tiles consist of such windows, so the words of the item that its
found windows hold together bound what tiles can cover: a pair that this bound keeps below the threshold (a phrase
that many texts have in common, say) is not looked at again. Each other pair is tiled: the longest common run of
unmarked words is found by bisecting its length with Karp-Rabin hashes, equal words are checked,
its places are marked in document and item, and the search goes on until no run of ``LEAST`` words is left.
Tiles may stand in any order, so a reordered passage covers its item just the same. An item is in
a document if tiles cover at least ``COVER`` of its words.

Words are runs of letters and digits, case ignored; marks between them do not count.

Defined cases: an item or a document of fewer than ``LEAST`` words matches nothing; null texts are
empty; rows with equal ids are judged each; an item id that comes twice is one item per text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleharbor.llm.common import bytes_of, sliced

LEAST = 5
COVER = 0.5
BLOCK_BYTES = 4 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BASE = 0x9E3779B97F4A7C15
_SIEVE = 20
_AT_ONCE = 1 << 20


def words_of(text: bytes) -> list[bytes]:
    """Words with A-Z and the two-byte Latin capitals lower-cased."""
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode()
    return _WORD.findall(text.lower())


def rolling(numbers: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of every window of ``length`` numbers, by doubling."""
    if len(numbers) < length:
        return np.zeros(0, np.uint64)
    total = len(numbers) - length + 1
    out, done = np.zeros(total, np.uint64), 0
    power, size = numbers.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1), 1
    base, left = _BASE, length
    while left:
        if left & 1:
            out = out * np.uint64(base) + power[done:done + total]
            done += size
        left >>= 1
        if left:
            power = power[:len(power) - size] * np.uint64(base) + power[size:]
            base = base * base % (1 << 64)
            size *= 2
    return out


def _open_windows(marked: np.ndarray, length: int) -> np.ndarray:
    """Starts of windows of ``length`` places none of which is marked."""
    if len(marked) < length:
        return np.zeros(0, np.int64)
    sums = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(sums[length:] == sums[:-length])


def _common(a: np.ndarray, b: np.ndarray, marked_a: np.ndarray, marked_b: np.ndarray, length: int):
    """(hashes of a's windows, of b's, hashes in both) over unmarked windows of ``length`` words."""
    at_a, at_b = _open_windows(marked_a, length), _open_windows(marked_b, length)
    ha, hb = rolling(a, length)[at_a], rolling(b, length)[at_b]
    return at_a, ha, at_b, hb, np.intersect1d(ha, hb)


def tiles(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in a, start in b, length) of two number sequences, longest first."""
    marked_a, marked_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    out: list[tuple[int, int, int]] = []
    most = min(len(a), len(b))
    while most >= least:
        low, high = least - 1, most
        while low < high:  # a common run of n words holds one of n - 1
            middle = (low + high + 1) // 2
            if len(_common(a, b, marked_a, marked_b, middle)[4]):
                low = middle
            else:
                high = middle - 1
        if low < least:
            break
        at_a, ha, at_b, hb, shared = _common(a, b, marked_a, marked_b, low)
        places: dict[int, list[int]] = {}
        for i in np.flatnonzero(np.isin(ha, shared))[::-1].tolist():
            places.setdefault(int(ha[i]), []).append(int(at_a[i]))
        placed = False
        for j in np.flatnonzero(np.isin(hb, shared)).tolist():
            start, starts = int(at_b[j]), places.get(int(hb[j]), [])
            while starts and not marked_b[start:start + low].any():
                x = starts.pop()
                if not marked_a[x:x + low].any() and (a[x:x + low] == b[start:start + low]).all():
                    marked_a[x:x + low] = marked_b[start:start + low] = True
                    out.append((x, start, low))
                    placed = True
        most = low if placed else low - 1
    return out


class Block:
    """A block of benchmark items with the sieve and the sorted hashes of their windows."""

    def __init__(self, items: list[tuple[int, bytes]], least: int = LEAST):
        self.least = least
        self.items = [(i, w) for i, w in ((i, words_of(t)) for i, t in items) if len(w) >= least]
        windows = [rolling(np.array([crc32(w) for w in words], np.uint64), least) for _, words in self.items]
        self.sizes = np.array([len(words) for _, words in self.items], np.int64)
        self.hashes = np.concatenate([np.zeros(0, np.uint64), *windows])
        self.owners = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
        self.places = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(w)) for w in windows)])
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.owners, self.places = self.hashes[order], self.owners[order], self.places[order]
        self.sieve = np.zeros(1 << _SIEVE, bool)
        self.sieve[(self.hashes >> np.uint64(64 - _SIEVE)).astype(np.int64)] = True

    def seeds(self, texts: list[bytes], cover: float) -> tuple[list[list[bytes]], list[tuple[int, int]]]:
        """The words of each text, and the pairs (text, item) whose common windows hold ``cover`` of the item's words."""
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.array([crc32(w) for text in words for w in text], np.uint64)
        found = rolling(flat, self.least)
        hits = np.flatnonzero(self.sieve[(found >> np.uint64(64 - _SIEVE)).astype(np.int64)])
        ends = np.cumsum(sizes)
        text = np.searchsorted(ends, hits, side="right")
        inside = hits + self.least <= ends[text] if len(hits) else hits.astype(bool)
        hits, text = hits[inside], text[inside]
        low = np.searchsorted(self.hashes, found[hits], side="left")
        many = np.searchsorted(self.hashes, found[hits], side="right") - low
        # A window counts once per text, wherever it stands in it.
        _, once = np.unique(np.stack((text, low))[:, many > 0], axis=1, return_index=True)
        kept = np.flatnonzero(many > 0)[once]
        text, low, many = text[kept], low[kept], many[kept]
        pairs: list[tuple[int, int]] = []
        # Some texts at a time, whose windows stand at about ``_AT_ONCE`` places of items.
        parts = np.searchsorted(np.cumsum(many), np.arange(_AT_ONCE, many.sum() + _AT_ONCE, _AT_ONCE)) if len(many) else []
        edges = sorted({0, *np.searchsorted(text, text[np.minimum(parts, len(text) - 1)], side="right").tolist()} | {len(text)}) if len(text) else [0]
        for start, stop in zip(edges, edges[1:], strict=False):
            n = many[start:stop]
            at = np.arange(n.sum()) + np.repeat(low[start:stop] - np.cumsum(n) + n, n)
            pairs += self._enough(np.repeat(text[start:stop], n), self.owners[at], self.places[at], cover)
        return words, pairs

    def _enough(self, text: np.ndarray, item: np.ndarray, place: np.ndarray, cover: float) -> list[tuple[int, int]]:
        """Pairs (text, item) whose windows, which begin at these places of the item, hold enough of its words."""
        order = np.lexsort((place, item, text))
        text, item, place = text[order], item[order], place[order]
        if not len(text):
            return []
        new = np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1])]
        starts = np.flatnonzero(new)
        # A window adds the words up to where the next one begins, the last one all of its own.
        gap = np.r_[np.minimum(np.diff(place), self.least), self.least]
        gap[np.r_[new[1:], True]] = self.least
        held = np.add.reduceat(gap, starts)
        enough = starts[held >= cover * self.sizes[item[starts]]]
        return list(zip(text[enough].tolist(), item[enough].tolist(), strict=True))

    def judge(self, document: list[bytes], item: int, cover: float) -> tuple[int, int, float, int] | None:
        """(item_id, tiles, covered share, longest tile) if the item is in the document."""
        item_id, words = self.items[item]
        numbers: dict[bytes, int] = {}
        b = np.array([numbers.setdefault(w, len(numbers) + 1) for w in words], np.int64)
        a = np.array([numbers.get(w, 0) for w in document], np.int64)
        found = tiles(a, b, self.least)
        share = sum(n for _, _, n in found) / len(words)
        return (item_id, len(found), share, found[0][2]) if share >= cover else None


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """The items, a block of about ``block_bytes`` at a time."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    total = items.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    count = -(-total // block_bytes)
    for block in range(count):
        yield [(r["item_id"], bytes(r["text"])) for r in
               items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block).orderBy("item_id", "text").collect()]


SHAPE = "item_id long, n_tiles int, coverage double, longest int"


def matches(documents: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, cover: float = COVER,
            least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item that it holds: ``keep`` (doc_id), item_id, tiles, coverage, longest tile."""
    keep = ["doc_id"] if keep is None else keep
    kept = documents.select(*keep, F.col("text").cast("binary").alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "__text"]
    out = None
    for items in blocks_of(benchmark, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            block = Block(items, least)
            for batch in sliced(batches, 2 << 20):
                words, pairs = block.seeds(bytes_of(batch.column("__text")), cover)
                rows = [(t, found) for t, k in sorted(pairs) if (found := block.judge(words[t], k, cover))]
                taken = batch.select(keep).take(pa.array([t for t, _ in rows], pa.int64()))
                kinds = (pa.int64(), pa.int32(), pa.float64(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, *(pa.array([f[i] for _, f in rows], kind) for i, kind in enumerate(kinds))],
                    names=[*keep, "item_id", "n_tiles", "coverage", "longest"])

        found = kept.mapInArrow(run, ", ".join([*fields, SHAPE]))
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = documents.sparkSession.createDataFrame([], ", ".join([*fields, SHAPE]))
    return out


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, cover: float = COVER, least: int = LEAST,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no benchmark item, with their columns: each row judged in its own task, by its text alone."""
    for items in blocks_of(benchmark, block_bytes):

        def clean(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            block = Block(items, least)
            for batch in sliced(batches, 2 << 20):
                words, pairs = block.seeds(bytes_of(batch.column("text").cast(pa.binary())), cover)
                leaks = {t for t, k in sorted(pairs) if block.judge(words[t], k, cover)}
                yield batch.filter(pa.array([t not in leaks for t in range(batch.num_rows)], pa.bool_()))

        documents = documents.mapInArrow(clean, documents.schema)
    return documents
