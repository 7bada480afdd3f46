"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) and of a sentencepiece model (B) cover the same bytes.

1. *Segments.* Neither tokenizer joins what stands on both sides of a single space between two characters
   that are no white space: every pre-token of A begins anew there, and no piece of B holds a space mark
   behind another character (``Tokenizers`` checks that on the vocabulary). So a text is cut there, and a
   segment is encoded and aligned once per worker, however often it comes again.
2. *Spans.* The character offsets of A and the spans of B's proto are coarse cuts: they name the byte where
   a token ends wherever the next token begins behind it. Tokens that share a character (parts of a
   multibyte character, byte-fallback pieces) are refined by the length of their decoded bytes. The decoded
   bytes of all tokens must be the text, else the text has no tokens.
3. *Groups and links.* Both token lists are cut where tokens of both end at the same byte. Inside, an A and a B
   token are linked if their byte ranges overlap.
4. *Corpus.* Links are counted per pair of ids over all documents, pre-aggregated per task. A document's
   links are looked up in two ways that together cover all pairs: at most ``FREQUENT`` frequent pairs are
   sent to every task as a table (16 MB), any other pair is met by a join.

Per document one written row holds its pairs and counts; nothing is tokenized twice for the second pass.

Defined cases: null and empty texts and texts that a tokenizer does not give back byte for byte (the space
mark U+2581, invalid UTF-8) have no tokens: all zeros, empty digest. Special token strings are ordinary
text. Repeated rows are documents of their own and count again. An empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleharbor.llm.common import bytes_of, cut, sliced, small

FOLDER = "/opt/tokenizers"
FILES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
FREQUENT = 1 << 20
HELD_SEGMENTS = 500_000  # segments that a worker remembers, and links of theirs
HELD_LINKS = 6_000_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
_MARK = "▁"


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers and the bytes of their ids."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if not self.b.is_control(i) and not self.b.is_unknown(i) and _MARK in piece.lstrip(_MARK):
                raise ValueError(f"piece {piece!r} spans a space, so texts cannot be cut there")
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_MARK, " ").encode())
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        # Ids as they are told inside a group and at its end.
        self.marked = [f"{i}{mark}".encode() for n, marks in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for i in range(n) for mark in marks]
        self.codes = 2 * np.arange(len(self.a_bytes)), 2 * (len(self.a_bytes) + np.arange(len(self.b_bytes)))


@lru_cache(maxsize=2)
def tokenizers(folder: str) -> Tokenizers:
    return Tokenizers(*(os.path.join(folder, name) for name in FILES))


def ends_of(begins: np.ndarray, ends: np.ndarray, last: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The byte where each token ends, one text after the other.

    ``begins`` and ``ends`` are the byte spans that a tokenizer tells, ``last`` marks the last token of a text, ``sizes``
    are the lengths of the decoded bytes. A span's end is a cut if the next token begins behind it. Tokens that
    share a character end, counted from the cut before them, where their bytes end.
    """
    if not len(ends):
        return ends
    cut = last | (np.r_[begins[1:], ends[-1]] >= ends) & (ends > begins)
    total = np.cumsum(sizes)
    before = np.maximum.accumulate(np.where(cut, np.arange(len(ends)), -1))
    found = np.where(before >= 0, ends[before] - total[before], 0) + total
    if (found[cut] != ends[cut]).any() or not np.array_equal(np.diff(found, prepend=0), sizes):
        raise ValueError("spans and bytes of tokens differ")
    return found


@dataclass
class Aligned:
    """Texts one after the other: whether both tokenizers give the bytes back, numbers of tokens, groups and links, groups
    as text, and the links (A's id above B's)."""

    sound: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    told: list[bytes]
    links: np.ndarray


def _flat(rows: Iterable, kind: type = np.int64) -> np.ndarray:
    return np.fromiter(chain.from_iterable(rows), kind)


def aligned(tools: Tokenizers, texts: list[str]) -> Aligned:
    """Both encodings of texts that begin with a space, cut into groups and linked."""
    ours = tools.a.encode_batch(texts, add_special_tokens=False)
    # B adds the space itself.
    theirs = [t.pieces for t in tools.b.encode([t[1:] for t in texts], return_type="proto", num_threads=1)]
    whole = [t.encode() for t in texts]
    a_ids = [e.ids for e in ours]
    b_told = [[x for p in t for x in (p.id, p.begin, p.end)] for t in theirs]
    b_ids = [t[::3] for t in b_told]
    sound = np.array([b"".join([tools.a_bytes[i] for i in a]) == w == b"".join([tools.b_bytes[i] for i in b])
                      for a, b, w in zip(a_ids, b_ids, whole, strict=True)], bool)
    use = np.flatnonzero(sound).tolist()
    text = b"".join([whole[i] for i in use])
    # The byte where each character begins, and where each text does.
    chars = np.r_[np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80), len(text)]
    sizes = [np.array([len(rows[i]) for i in use], np.int64) for rows in (a_ids, b_ids, texts, whole)]
    first_char, first_byte = (np.cumsum(n) - n for n in sizes[2:])
    ends, flat, parts = [], [], []
    for side, ids, lengths in ((0, a_ids, tools.a_sizes), (1, b_ids, tools.b_sizes)):
        row = np.repeat(np.arange(len(use)), sizes[side])
        own = _flat(ids[i] for i in use)
        last = np.r_[row[1:] != row[:-1], np.ones(min(1, len(row)), bool)]
        if side == 0:
            spans = _flat(chain.from_iterable(ours[i].offsets) for i in use).reshape(-1, 2) + first_char[row][:, None]
            begins, stops = chars[spans[:, 0]], chars[spans[:, 1]]
        else:
            # B's spans are bytes and leave out the space that it adds in front.
            spans = _flat(b_told[i] for i in use).reshape(-1, 3)[:, 1:] + first_byte[row][:, None] + 1
            begins, stops = spans[:, 0] - np.r_[True, last[:-1]][:len(row)], spans[:, 1]
        ends.append(ends_of(begins, stops, last, lengths[own]))
        flat.append(own)
        parts.append(row)
    shared = np.intersect1d(*ends, assume_unique=True)
    # Tokens in the order they are told: per group those of A, then those of B, each with the mark behind it.
    codes, order = [], []
    for side in (0, 1):
        closing = np.isin(ends[side], shared, assume_unique=True)
        codes.append(tools.codes[side][flat[side]] + closing)
        order.append(2 * (np.cumsum(closing) - closing) + side)
    codes, order = np.concatenate(codes), np.argsort(np.concatenate(order), kind="stable")
    marked = [tools.marked[c] for c in codes[order].tolist()]
    stops = np.cumsum(sizes[0] + sizes[1]).tolist()
    told = [b"".join(marked[i:j])[:-1] for i, j in zip([0, *stops], stops, strict=False)]
    # The first and the last token of B that a token of A overlaps.
    low = np.searchsorted(ends[1], ends[0] - tools.a_sizes[flat[0]], side="right")
    many = np.searchsorted(ends[1], ends[0]) - low + 1
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    links = np.repeat(flat[0], many) << 32 | flat[1][at]
    out = Aligned(sound, *(np.zeros(len(texts), np.int64) for _ in range(4)), [b""] * len(texts), links)
    out.n_a[use], out.n_b[use] = sizes[0], sizes[1]
    out.n_links[use] = np.bincount(parts[0], many, len(use)).astype(np.int64)
    out.n_groups[use] = np.bincount(np.searchsorted(np.cumsum(sizes[3]), shared), minlength=len(use))
    for i, t in zip(use, told, strict=True):
        out.told[i] = t
    return out


class Segments:
    """Segments met by a worker: their numbers, and by number what is known of them."""

    def __init__(self, tools: Tokenizers, most: int = HELD_SEGMENTS, most_links: int = HELD_LINKS):
        self.tools, self.most, self.most_links = tools, most, most_links
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.told: list[bytes] = []
        self.sizes = np.zeros((0, 5), np.int64)  # sound, tokens of A, of B, groups, links
        self.starts, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def drop_rare(self) -> None:
        """Keeps the half that came up most often, so that common segments are not learned again."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[:self.most // 2])
        many = self.sizes[keep, 4]
        at = np.arange(many.sum()) + np.repeat(self.starts[keep] - np.cumsum(many) + many, many)
        names = list(self.number)  # in the order of their numbers
        self.number = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.told = [self.told[i] for i in keep.tolist()]
        self.links, self.sizes, self.uses = self.links[at], self.sizes[keep], self.uses[keep] // 2
        self.starts = np.cumsum(many) - many
        if len(self.links) > self.most_links // 2:
            self.forget()

    def learn(self, segments: Iterable[str]) -> None:
        if len(self.number) > self.most or len(self.links) > self.most_links:
            self.drop_rare()
        new = [s for s in dict.fromkeys(segments) if s not in self.number]
        sizes, links = [self.sizes], [self.links]
        for start in range(0, len(new), 4096):
            some = new[start:start + 4096]
            found = aligned(self.tools, [" " + s for s in some])
            self.number |= zip(some, range(len(self.told), len(self.told) + len(some)), strict=True)
            self.told += found.told
            sizes.append(np.stack([found.sound, found.n_a, found.n_b, found.n_groups, found.n_links], axis=1).astype(np.int64))
            links.append(found.links)
        if new:
            self.sizes, self.links = np.concatenate(sizes), np.concatenate(links)
            self.starts = np.cumsum(self.sizes[:, 4]) - self.sizes[:, 4]
            self.uses = np.r_[self.uses, np.zeros(len(self.sizes) - len(self.uses), np.int64)]


@lru_cache(maxsize=1)
def _remembered(folder: str) -> Segments:
    return Segments(tokenizers(folder))


def _decoded(text: bytes) -> str | None:
    try:
        return text.decode() or None
    except UnicodeDecodeError:
        return None


def per_document(texts: list[bytes], known: Segments) -> dict[str, pa.Array]:
    """The alignment of texts: tokens, groups, links, digest, and distinct links (``pairs``) with their counts."""
    cells = [_CUT.split(t) if t is not None else [] for t in map(_decoded, texts)]
    known.learn(chain.from_iterable(cells))
    none = np.zeros(0, np.int64)
    sums, digests, pairs, counts = np.zeros((len(texts), 4), np.int64), [""] * len(texts), [none] * len(texts), [none] * len(texts)
    for row, segments in enumerate(cells):
        at = np.fromiter(map(known.number.__getitem__, segments), np.int64, len(segments))
        sizes = known.sizes[at]
        known.uses[at] += 1
        if not len(at) or not sizes[:, 0].all():
            continue
        many = sizes[:, 4]
        places = np.arange(many.sum()) + np.repeat(known.starts[at] - np.cumsum(many) + many, many)
        pairs[row], counts[row] = np.unique(known.links[places], return_counts=True)
        sums[row] = sizes[:, 1:].sum(axis=0)
        digests[row] = hashlib.sha256(b";".join([known.told[i] for i in at.tolist()])).hexdigest()
    found = {name: pa.array(sums[:, i]) for i, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
    offsets = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
    return found | {"groups_sha256": pa.array(digests, pa.string()),
                    "pairs": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([none, *pairs]), pa.int64())),
                    "counts": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([none, *counts]).astype(np.int32)))}


_SHAPE = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, counts array<int>"


def alignments(documents: DataFrame, folder: str = FOLDER) -> DataFrame:
    """Per row its doc_id, a number of its own (row_id), sizes, digest, and its distinct linked pairs with their counts."""
    names = [part.split()[0] for part in _SHAPE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _remembered(folder)
        for batch in batches:
            for part in sliced([batch], 2 << 20):
                found = per_document(bytes_of(part.column("text")), known)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(found[n] for n in names)], names=["doc_id", *names])

    rows = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {_SHAPE}").withColumn("row_id", F.monotonically_increasing_id())


def _links_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of the document in the batch, the pair and the count of every distinct link."""
    lengths = np.diff(batch.column("pairs").offsets.to_numpy())
    return (np.repeat(np.arange(batch.num_rows), lengths), batch.column("pairs").flatten().to_numpy(zero_copy_only=False),
            batch.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held_pairs, held_counts, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate([held_pairs, *(p for p, _ in waiting)])
        added = np.concatenate([held_counts, *(n for _, n in waiting)])
        order = np.argsort(every, kind="stable")
        every = every[order]
        starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
        return every[starts], np.add.reduceat(added[order], starts) if len(every) else held_counts

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held_pairs), pa.array(held_counts)], names=["pair", "n"])

    for batch in batches:
        _, pairs, counts = _links_of(batch)
        waiting.append((pairs, counts))
        if sum(len(p) for p, _ in waiting) > 2_000_000:
            held_pairs, held_counts = merged()
            waiting.clear()
            if len(held_pairs) > 2_000_000:
                yield told()
                held_pairs, held_counts = held_pairs[:0], held_counts[:0]
    held_pairs, held_counts = merged()
    yield told()


def pair_counts(rows: DataFrame) -> DataFrame:
    """Per linked pair of ids: pair (A's id above B's), n over all documents, and whether it is the most of its B id."""
    counts = cut(rows.select("pairs", "counts").mapInArrow(_count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("b")
    most = cut(counts.groupBy(b).agg(F.max("n").alias("most")))  # one row per id of B's vocabulary
    return counts.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).join(small(most), "b").select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _frequent(counts: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` pairs reach it, among powers of the square root of two."""
    step = F.ceil(F.log2("n") * 2)
    held, least = 0, None
    # At most 127 rows: counts are below 2^63.
    for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("n")).orderBy(F.desc("step")).collect():
        held += r["pairs"]
        if held > most:
            break
        least = r["n"]
    return (1 << 62) if least is None else least


def align(documents: DataFrame, folder: str = FOLDER, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    rows = cut(alignments(documents, folder))
    counts = cut(pair_counts(rows))
    least = _frequent(counts, frequent)
    often = counts.where(F.col("n") >= least).toArrow()
    order = np.argsort(often.column("pair").to_numpy())
    table = tuple(often.column(c).to_numpy()[order] for c in ("pair", "n", "best"))
    sizes = ("doc_id", "row_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, total, best = table
        for batch in batches:
            row, pair, n = _links_of(batch)
            at = np.minimum(np.searchsorted(pairs, pair), max(0, len(pairs) - 1))
            here = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            one, many = (np.zeros(batch.num_rows, np.int64) for _ in range(2))
            np.add.at(one, row[here], n[here] * best[at[here]])
            np.add.at(many, row[here], n[here] * total[at[here]])
            ends = np.cumsum(np.bincount(row[~here], minlength=batch.num_rows))
            offsets = pa.array(np.r_[0, ends], pa.int32())
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~here], pa.int64())) for x in (pair, n)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in sizes), pa.array(one), pa.array(many), *rest],
                names=[*sizes, "one", "many", "pairs", "counts"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    shape = (f"doc_id {kind}, row_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
             "one long, many long, pairs array<long>, counts array<long>")
    found = cut(rows.select(*sizes, "pairs", "counts").mapInArrow(look_up, shape))
    rare = found.select("row_id", F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select(
        "row_id", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("times"))
    more = rare.join(counts, "pair").groupBy("row_id").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("one_more"),
        F.sum(F.col("times") * F.col("n")).alias("many_more"))
    no = F.lit(0).cast("long")
    return found.drop("pairs", "counts").join(more, "row_id", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("one") + F.coalesce("one_more", no)).alias("n_best"),
        (F.col("many") + F.coalesce("many_more", no)).alias("count_sum"), "groups_sha256")
