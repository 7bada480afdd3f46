"""Language identification by a bidirectional gated recurrent network over bytes.

A text's bytes are cut into segments of ``STEPS`` bytes. One network reads each segment forwards,
another backwards; at every byte the two states give a probability per language. A document's
probabilities are the mean over all its bytes, so each position is labelled and none is skipped.
Segments of many documents run side by side in numpy, so a very long text costs memory for
a slice of its segments only.

The network learns in numpy by backpropagation through time from at most ``MOST_DOCUMENTS`` documents
of known language (per language at most ``PER_LANGUAGE``, chosen by hash of the id), of which at most
``MOST_SEGMENTS`` segments, chosen by hash from all places of the texts, reach the driver. These bounds are
parameters. Source, language and id are never inputs of a prediction.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without any learning row every
text is ``und``; rows are judged one by one, so repeated rows and null ids are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleharbor.llm.common import bytes_of, id_remainder, learning_sample, per_text

STEPS = 96
HIDDEN = 12
PER_LANGUAGE = 400
MOST_DOCUMENTS = 4000
MOST_SEGMENTS = 8192
SIDE_BY_SIDE = 2048
UNKNOWN = "und"
_LETTERS = bytes(i for i in range(256) if 65 <= i <= 90 or 97 <= i <= 122)


def has_letter(text: bytes) -> bool:
    if len(text.translate(None, _LETTERS)) < len(text):
        return True
    return not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace"))


def segments(text: bytes, steps: int = STEPS) -> list[bytes]:
    return [text[i:i + steps] for i in range(0, len(text), steps)]


@dataclass(frozen=True)
class Network:
    """Weights by column: per direction a table (3H x 256) and a square (3H x H); the output (K x 2H) and bias (K).

    The rows of table and square are the update gate, the reset gate and the candidate.
    """

    languages: tuple[str, ...]
    tables: tuple[np.ndarray, np.ndarray]
    squares: tuple[np.ndarray, np.ndarray]
    output: np.ndarray
    bias: np.ndarray

    @property
    def hidden(self) -> int:
        return self.squares[0].shape[1]

    def read(self, side: int, data: np.ndarray, lengths: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States (steps x H x n) of one direction over data (steps x n); behind a piece's end they stay zero."""
        size, steps, wide = self.hidden, *data.shape
        table, square = self.tables[side], self.squares[side]
        out = np.empty((steps, size, wide), np.float32)
        state = np.zeros((size, wide), np.float32)
        given, own = np.empty((3 * size, wide), np.float32), np.empty((3 * size, wide), np.float32)
        half, shortest = np.float32(0.5), int(lengths.min())
        for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
            np.take(table, data[t], axis=1, out=given, mode="clip")
            np.matmul(square, state, out=own)
            gates = given[:2 * size]
            gates += own[:2 * size]
            gates *= half
            np.tanh(gates, out=gates)
            gates *= half
            gates += half
            lifted = own[2 * size:].copy() if trace is not None else None
            candidate = own[2 * size:]
            candidate *= gates[size:]
            candidate += given[2 * size:]
            np.tanh(candidate, out=candidate)
            after = out[t]
            np.subtract(state, candidate, out=after)
            after *= gates[:size]
            after += candidate
            if t >= shortest:
                after *= t < lengths
            if trace is not None:
                trace.append((t, state, gates.copy(), lifted, candidate.copy()))
            state = after
        return out

    def probabilities(self, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Per language and piece at one position."""
        size = self.hidden
        logits = self.output[:, :size] @ ahead + self.output[:, size:] @ back + self.bias[:, None]
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        return logits

    def sums(self, pieces: list[bytes]) -> np.ndarray:
        """Per piece the sum over its bytes of each language's probability (n x K)."""
        data, lengths = laid_out(pieces)
        ahead, back = self.read(0, data, lengths), self.read(1, data, lengths)
        total = np.zeros((len(self.languages), len(pieces)), np.float64)
        for t in range(len(data)):
            total += self.probabilities(ahead[t], back[t]) * (t < lengths)
        return total.T

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        """The most likely language of each text and its probability, pooled over all bytes."""
        totals = np.zeros((len(texts), max(1, len(self.languages))))
        owners: list[int] = []
        pieces: list[bytes] = []

        def flush() -> None:
            if pieces:
                np.add.at(totals, owners, self.sums(pieces))
                owners.clear()
                pieces.clear()

        read = [bool(self.languages) and has_letter(text) for text in texts]
        for i, text in enumerate(texts):
            if read[i]:
                for piece in segments(text):
                    owners.append(i)
                    pieces.append(piece)
                    if len(pieces) == SIDE_BY_SIDE:
                        flush()
        flush()
        best = totals.argmax(axis=1)
        scores = totals.max(axis=1) / np.maximum([len(t) for t in texts], 1)
        return ([self.languages[b] if r else UNKNOWN for b, r in zip(best, read, strict=True)],
                [min(1.0, float(s)) if r else 0.0 for s, r in zip(scores, read, strict=True)])


def laid_out(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The pieces as columns of bytes (steps x n), filled up behind their ends, and their lengths."""
    steps = max(map(len, pieces))
    data = np.frombuffer(b"".join(p.ljust(steps, b"\0") for p in pieces), np.uint8).reshape(len(pieces), steps)
    return np.ascontiguousarray(data.T), np.array([len(p) for p in pieces])


def _through_time(net: Network, side: int, trace: list, data: np.ndarray, lengths: np.ndarray,
                  slopes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of table and square from the slopes of the states (steps x H x n)."""
    size, (steps, wide) = net.hidden, data.shape
    square = net.squares[side]
    for_square = np.zeros_like(square)
    for_given = np.empty((3 * size, steps, wide), np.float32)
    carried = np.zeros((size, wide), np.float32)
    for t, before, gates, lifted, candidate in reversed(trace):
        slope = (slopes[t] + carried) * (t < lengths)
        update, reset = gates[:size], gates[size:]
        d_candidate = slope * (1 - update) * (1 - candidate * candidate)
        d_update = slope * (before - candidate) * update * (1 - update)
        d_reset = d_candidate * lifted * reset * (1 - reset)
        for_given[:size, t], for_given[size:2 * size, t], for_given[2 * size:, t] = d_update, d_reset, d_candidate
        own = np.concatenate((d_update, d_reset, d_candidate * reset))
        for_square += own @ before.T
        carried = slope * update + square.T @ own
    flat = data.ravel()
    for_table = np.stack([np.bincount(flat, weights=row.ravel(), minlength=256) for row in for_given])
    return for_table.astype(np.float32), for_square


def gradients(net: Network, pieces: list[bytes], truth: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all bytes of the pieces, and its gradient for each array of weights."""
    data, lengths = laid_out(pieces)
    size, total = net.hidden, float(lengths.sum())
    traces: tuple[list, list] = ([], [])
    states = [net.read(side, data, lengths, traces[side]) for side in (0, 1)]
    slopes = [np.empty_like(s) for s in states]
    d_output, d_bias, loss = np.zeros_like(net.output), np.zeros_like(net.bias), 0.0
    for t in range(len(data)):
        inside = t < lengths
        p = net.probabilities(states[0][t], states[1][t])
        loss -= float((np.log(p[truth, np.arange(len(pieces))] + 1e-12) * inside).sum())
        p[truth, np.arange(len(pieces))] -= 1
        p *= inside / np.float32(total)
        p = p.astype(np.float32)
        d_output += p @ np.concatenate((states[0][t], states[1][t])).T
        d_bias += p.sum(axis=1)
        slopes[0][t], slopes[1][t] = net.output[:, :size].T @ p, net.output[:, size:].T @ p
    found = [_through_time(net, side, traces[side], data, lengths, slopes[side]) for side in (0, 1)]
    return loss / total, [found[0][0], found[1][0], found[0][1], found[1][1], d_output, d_bias]


def start(languages: tuple[str, ...], hidden: int = HIDDEN, seed: int = 11) -> Network:
    rng = np.random.default_rng(seed)

    def normal(scale: float, *shape: int) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    return Network(languages, (normal(0.4, 3 * hidden, 256), normal(0.4, 3 * hidden, 256)),
                   (normal(0.3, 3 * hidden, hidden), normal(0.3, 3 * hidden, hidden)),
                   normal(0.3, len(languages), 2 * hidden), np.zeros(len(languages), np.float32))


def train(pieces: list[bytes], names: list[str], epochs: int = 3, batch: int = 256, seed: int = 11) -> Network:
    """Adam on the position-wise cross entropy, with falling steps."""
    languages = tuple(sorted(set(names)))
    net = start(languages, seed=seed)
    if len(languages) < 2:
        return net
    truth = np.array([languages.index(n) for n in names])
    rng = np.random.default_rng(seed)
    first = second = None
    step, rounds = 0, epochs * max(1, len(pieces) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(pieces))
        for some in np.array_split(order, max(1, len(pieces) // batch)):
            _, slopes = gradients(net, [pieces[i] for i in some], truth[some])
            norm = np.sqrt(sum(float((g * g).sum()) for g in slopes))
            slopes = [g * min(1.0, 1.0 / (norm + 1e-9)) for g in slopes]
            weights = [*net.tables, *net.squares, net.output, net.bias]
            first = first or [0 * w for w in weights]
            second = second or [0 * w for w in weights]
            step += 1
            rate = 0.03 * max(0.1, 1 - step / rounds)
            for i, g in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                move = first[i] / (1 - 0.9 ** step) / (np.sqrt(second[i] / (1 - 0.99 ** step)) + 1e-7)
                weights[i] = (weights[i] - rate * move).astype(np.float32)
            net = Network(languages, (weights[0], weights[1]), (weights[2], weights[3]), weights[4], weights[5])
    return net


LEARN_STEPS = 64


def first_of_each(rows: DataFrame, order: list[Column], most: int, lanes: int = 32) -> DataFrame:
    """The first ``most`` rows per language; lanes choose first, so that a frequent language is no single task's."""
    lane = F.pmod(F.xxhash64(*rows.columns), F.lit(lanes))
    for keys in (["lang", "__lane"], ["lang"]):
        rows = rows.withColumn("__lane", lane).withColumn("__n", F.row_number().over(
            Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= most).drop("__n", "__lane")
    return rows


def fit(documents: DataFrame, per_language: int = PER_LANGUAGE, most_documents: int = MOST_DOCUMENTS,
        most_segments: int = MOST_SEGMENTS) -> Network:
    """Learns from texts of known language whose crc32(doc_id as text) mod 4 is not 2."""
    known = documents.where((id_remainder(4) != 2) & F.col("lang").isNotNull()).groupBy("doc_id").agg(
        F.min("lang").alias("lang"))
    ranked = first_of_each(known, [F.xxhash64("doc_id"), F.col("doc_id")], per_language)
    sample = learning_sample(documents, ranked, most_documents, ["lang"])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(crc32(p), lang, p) for text, lang in zip(bytes_of(b.column("text")), b.column("lang").to_pylist(), strict=True)
                    for p in segments(text, LEARN_STEPS) if has_letter(p)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
                 pa.array([r[2] for r in rows], pa.binary())], names=["h", "lang", "piece"])

    pieces = sample.select("text", "lang").mapInArrow(cut_up, "h long, lang string, piece binary").distinct()
    share = max(1, most_segments // max(1, known.select("lang").distinct().count()))
    even = first_of_each(pieces, [F.col("h"), F.col("piece")], share)
    rows = even.orderBy("h", "piece", "lang").limit(most_segments).select("piece", "lang").collect()
    if not rows:
        return start(())
    return train([bytes(r["piece"]) for r in rows], [r["lang"] for r in rows])


def label(documents: DataFrame, net: Network | None = None) -> DataFrame:
    """Per document: doc_id, lang_pred and score."""
    network = fit(documents) if net is None else net

    def work(texts: list[bytes]) -> dict[str, pa.Array]:
        names, scores = network.predict(texts)
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}

    return per_text(documents, work, "lang_pred string, score double", ["doc_id"])
