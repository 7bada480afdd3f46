"""Toxicity by a weighted finite-state pattern grammar that scores clauses.

Three transducers are composed over the words of a clause (text between sentence marks or line ends):

* the *lexicon* turns a word into a symbol with a weight: an insult (by whole word or by word stem), a
  threat verb, a target (a person addressed), a negation, a verb of reported speech, or another word;
* the *scope* transducer keeps what an insult stands under: a negation reaches ``NEGATION_REACH``
  words, reported speech reaches to the end of its clause;
* the *clause* transducer pairs insults and threats with a target in the same clause and emits
  the clause's weight: an insult alone, aimed at somebody, negated or reported, a threat with a target.

Insult words and stems, with their weights, are learned from the labels: document counts
per word and stem, a stem being kept at its longest form that loses no toxic document. A logistic
layer on the clause weights turns them into a probability; it learns on other labelled rows than the
lexicon. At most ``MOST_LABELLED`` labelled documents (by hash of the id) take part, a documented bound of the
fit; the lexicon keeps all that their counts support. Scoring reads whole texts: an Aho-Corasick pass finds the
clauses with a lexicon hit, and only those run through the grammar.

Defined cases: an empty or null text has no clause and gets the score of none. Without labels of both
kinds the fixed words below make the lexicon and the layer keeps its default weights. Several labels
of one document count as their largest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleharbor.llm.common import cut, id_remainder, learning_sample, per_text

MOST_LABELLED = 20_000
LEAST_DOCUMENTS = 4
THRESHOLD = 0.3
NEGATION_REACH = 3
LAYER_SHARE = 10  # one labelled document in so many teaches the layer, the others the lexicon
STEM = 4  # letters a stem has at least

# The closed word classes of the grammar, and insults known without labels.
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown".split()
THREATS = "kill hurt destroy beat punish töten schlagen tuer frapper matar golpear".split()
TARGETS = "you your yours they them he she him her du dich euch sie ihr tu toi vous ils elles tú usted ustedes ellos".split()
NEGATIONS = "not never no nobody nicht kein keine nie pas jamais ne nunca jamás".split()
REPORTS = "said says say quoted wrote claimed called sagte schrieb dit écrit dijo escribió".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
FEATURES = 6
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TABLE = bytes(
    i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 10 if i in b"\n.!?;:" else 32 for i in range(256))


@dataclass(frozen=True)
class Grammar:
    """Weights of insult words and stems (UTF-8 text) and the logistic layer over clause features."""

    words: dict[str, float]
    stems: dict[str, float]
    layer: tuple[float, ...] = (-4.0, 2.0, 0.5, 0.5, 1.0, -0.5, 5.0)


def plain(text: bytes) -> str:
    """Lower case, clauses parted by line feeds, words by spaces; one character per byte."""
    lowered = text.decode("utf-8", "replace").lower().encode()
    return " " + lowered.translate(_TABLE).replace(b"\n", b" \n ").decode("latin-1") + " "


def _narrow(word: str) -> str:
    return word.encode().decode("latin-1")


_SHORT_NOT = _narrow("n\u2019t")


class Matcher:
    """The composed transducers of a grammar."""

    def __init__(self, grammar: Grammar):
        self.words = {_narrow(w): x for w, x in grammar.words.items()}
        self.stems = {_narrow(s): x for s, x in grammar.stems.items()}
        self.lengths = sorted({len(s) for s in self.stems})
        self.closed = {_narrow(w): kind for kind, group in (
            (THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in group}
        self.layer = np.array(grammar.layer)
        self.finder = ahocorasick.Automaton()
        for w in self.words:
            self.finder.add_word(f" {w} ", 0)
        for s in self.stems:
            self.finder.add_word(f" {s}", 0)
        for w in THREATS:
            self.finder.add_word(f" {_narrow(w)} ", 0)
        self.finder.make_automaton()

    def symbol(self, word: str) -> tuple[int, float]:
        """The lexicon transducer: class and weight of a word; the strongest entry counts."""
        weight = self.words.get(word, 0.0)
        for n in self.lengths:
            if n > len(word):
                break
            weight = max(weight, self.stems.get(word[:n], 0.0))
        return (INSULT, weight) if weight else (self.closed.get(word, OTHER), 0.0)

    def clause(self, words: list[str]) -> tuple[float, float, float, float]:
        """Scope and clause transducers: weights of open, aimed, negated-or-reported insults and of threats."""
        negated, reported, aimed, threats = 0, False, False, 0
        free, bound, before = 0.0, 0.0, ""
        for word in words:
            kind, weight = self.symbol(word)
            # "isn't" is two words, or one with a typographic apostrophe.
            if (word == "t" and before.endswith("n")) or word.endswith(_SHORT_NOT):
                kind = NEGATION
            before = word
            if kind == INSULT:
                if negated or reported:
                    bound += weight
                else:
                    free += weight
            elif kind == NEGATION:
                negated = NEGATION_REACH + 1
            elif kind == REPORT:
                reported = True
            elif kind == TARGET:
                aimed = True
            elif kind == THREAT:
                threats += not (negated or reported)
            negated = max(0, negated - 1)
        return free, free if aimed else 0.0, bound, float(threats if aimed else 0)

    def features(self, text: bytes) -> list[float]:
        """Of a document: has a clause, strongest clause, sum of clauses, aimed, negated or reported, threats."""
        flat = plain(text)
        best = total = aimed_total = bound_total = threat_total = 0.0
        done = -1
        for end, _ in self.finder.iter(flat):
            if end < done:
                continue
            start = flat.rfind("\n", 0, end) + 1
            done = flat.find("\n", end)
            done = len(flat) if done < 0 else done
            free, aimed, bound, threats = self.clause(flat[start:done].split())
            best, total = max(best, free + bound), total + free + bound
            aimed_total, bound_total, threat_total = aimed_total + aimed, bound_total + bound, threat_total + threats
        return [float(total > 0), best, math.log1p(total), math.log1p(aimed_total), math.log1p(bound_total), threat_total]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.layer[0] + rows @ self.layer[1:], -60, 60)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        rows = np.array([self.features(t) for t in texts]).reshape(-1, FEATURES)
        return self.scores(rows)


def _labelled(documents: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    known = labels.where((id_remainder(4) != 2) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(
        (F.max("toxic") >= 1).cast("int").alias("toxic"))
    # Of an id that many documents carry, one text: the sample stays within its bound.
    return learning_sample(documents, known, most, ["toxic"]).groupBy("doc_id", "toxic").agg(
        F.min(F.coalesce("text", F.lit(b""))).alias("text"))


def _weight(pos: Column, neg: Column, base: float) -> Column:
    return F.log((pos + 0.5) / (neg + 0.5)) - F.lit(base)


def learn_lexicon(sample: DataFrame, positive: int, negative: int) -> Grammar:
    """Words and stems that far more toxic than other documents hold."""
    base = math.log((positive + 0.5) / (negative + 0.5))
    words = sample.select("toxic", F.explode(F.array_distinct(
        F.split(F.lower(F.col("text").cast("string")), _SPLIT))).alias("word")).where("word != ''")
    counted = cut(words.groupBy("word").agg(
        F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")))
    sure = (F.col("pos") >= LEAST_DOCUMENTS) & (F.col("pos") >= 8 * F.col("neg") * positive / max(1, negative)) & (
        F.col("neg") <= 0.1 * F.col("pos"))
    whole = counted.where(sure).withColumn("w", _weight(F.col("pos"), F.col("neg"), base))
    length = F.length("word")
    prefixes = counted.where(length > STEM).select("pos", "neg", F.explode(F.transform(
        F.sequence(F.lit(STEM), length - 1), lambda n: F.substring("word", F.lit(1), n))).alias("stem"))
    stems = prefixes.groupBy("stem").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count(F.lit(1)).alias("forms")).where(
        sure & (F.col("forms") > 1))
    # Both are entries of a bounded sample's words.
    top = stems.withColumn("w", _weight(F.col("pos"), F.col("neg"), base)).collect()
    counts = {r["stem"]: r["pos"] for r in top}
    # A stem that a longer one replaces without losing a document is left out.
    spent = {s[:n] for s, c in counts.items() for n in range(STEM, len(s)) if counts.get(s[:n]) == c}
    return Grammar({r["word"]: float(r["w"]) for r in whole.collect()},
                   {r["stem"]: float(r["w"]) for r in top if r["stem"] not in spent})


def learn_layer(rows: np.ndarray, truth: np.ndarray, rounds: int = 30) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps."""
    x = np.column_stack((np.ones(len(rows)), rows))
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6, *[1e-2] * rows.shape[1]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - truth) + ridge @ w
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), slope)
        w = w - move * min(1.0, 4.0 / (np.linalg.norm(move) + 1e-9))
    return tuple(w.tolist())


def fit(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Grammar:
    """Learns from labelled rows whose crc32(doc_id as text) mod 4 is not 2; most give the lexicon, the others the layer."""
    sample = _labelled(documents, labels, most)
    lane = F.pmod(F.xxhash64(F.lit("layer"), "doc_id"), F.lit(LAYER_SHARE))
    first = sample.where(lane != 0)
    count = {r["toxic"]: r["n"] for r in first.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not count.get(0) or not count.get(1):
        return Grammar({w: 3.0 for w in INSULTS}, {})
    learned = learn_lexicon(first, count[1], count[0])
    grammar = Grammar({**{w: 3.0 for w in INSULTS}, **learned.words}, learned.stems)

    def work(texts: list[bytes]) -> dict[str, pa.Array]:
        return {"features": pa.array([matcher_of(grammar).features(t) for t in texts], pa.list_(pa.float64()))}

    rows = per_text(sample.where(lane == 0), work, "features array<double>", ["doc_id", "toxic"]).orderBy("doc_id").toArrow()
    truth = rows.column("toxic").to_numpy()
    if not len(truth) or truth.min() == truth.max():
        return grammar
    x = np.array(rows.column("features").to_pylist(), float)
    return Grammar(grammar.words, grammar.stems, learn_layer(x, truth.astype(float)))


def _frozen(grammar: Grammar) -> tuple:
    return tuple(sorted(grammar.words.items())), tuple(sorted(grammar.stems.items())), grammar.layer


@lru_cache(maxsize=4)
def _matcher(frozen: tuple) -> Matcher:
    return Matcher(Grammar(dict(frozen[0]), dict(frozen[1]), frozen[2]))


def matcher_of(grammar: Grammar) -> Matcher:
    """The matcher of a grammar, built once per worker."""
    return _matcher(_frozen(grammar))


def score(documents: DataFrame, labels: DataFrame, grammar: Grammar | None = None) -> DataFrame:
    """doc_id, score in [0, 1] and the verdict at the threshold, per document."""
    known = fit(documents, labels) if grammar is None else grammar

    def work(texts: list[bytes]) -> dict[str, pa.Array]:
        return {"score": pa.array(matcher_of(known).score(texts), pa.float64())}

    return per_text(documents, work, "score double", ["doc_id"]).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))
