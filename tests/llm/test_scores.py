"""Quality, language and toxicity: held-out accuracy, defined cases, and parts held against brute force."""

import math
import re
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ruleharbor.llm import langid, quality, toxicity
from ruleharbor.llm.common import table
from ruleharbor.llm.queries import QUERIES
from tests.llm.conftest import SHAPE

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def held_out(doc_id, modulus, rest):
    return crc32(str(doc_id).encode()) % modulus == rest


def test_quality_on_held_out_rows(spark):
    rows = QUERIES["op2_quality"](spark, SF).join(table(spark, SF, "labels"), "doc_id").collect()
    assert all(r.held_out == held_out(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    apart = [r for r in rows if r.held_out]
    assert len(apart) > 30 and np.mean([r.predicted == r.quality for r in apart]) > 0.9


def test_word_vectors_by_hand(spark):
    texts = ["a b c a", "c d", None, "", "b b b b b"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SHAPE).repartition(3)
    got, index = quality.word_vectors(docs), quality.index_vectors().astype(np.int64)
    want = np.zeros((quality.SLOTS + 1, quality.WIDTH))
    for t in texts:
        ids = quality.slots_of((t or "").encode())
        for i, w in enumerate(ids):
            for j in range(max(0, i - quality.REACH), min(len(ids), i + quality.REACH + 1)):
                want[w] += index[ids[j]] if i != j else 0
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(got, want, atol=1e-6)


@pytest.mark.parametrize("most", [0, 5, 1 << 17])
def test_every_word_has_its_own_vector(spark, monkeypatch, most):
    """Words of one slot stay apart, and which words count as frequent changes nothing."""
    monkeypatch.setattr(quality, "FREQUENT", most)
    monkeypatch.setattr(quality, "SAMPLED", 2)
    slots = {}
    twins = next((slots[s], w) for w in (f"w{i}" for i in range(100_000)) if slots.setdefault(
        s := quality.slots_of(w.encode())[0], w) != w)
    texts = [f"{twins[0]} a b c", f"d {twins[1]} e f", f"a {twins[1]} d", "a b a b only", "", None, "a b a b only", twins[0]]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate([*texts, "a b"])] + [
        (8, "a b", "en", "s", 0)], SHAPE).repartition(3)
    split = [(t or "").split() for t in [*texts, "a b", "a b"]]
    index = {w: quality.index_of(np.array([quality.xxh3_64_intdigest(w.encode())], np.uint64).view(np.int64))[0].astype(int)
             for words in split for w in words}
    want = {w: np.zeros(quality.WIDTH) for w in index}
    for words in split:
        for i, w in enumerate(words):
            for j in range(max(0, i - quality.REACH), min(len(words), i + quality.REACH + 1)):
                want[w] += index[words[j]] if i != j else 0
    unit = {w: v / max(np.linalg.norm(v), 1e-9) for w, v in want.items()}
    assert not np.allclose(unit[twins[0]], unit[twins[1]])
    found = quality.per_row(docs, quality.word_sums(docs), lambda x: quality.pa.array(list(x), quality.pa.list_(quality.pa.float32())),
                            "features array<float>", ["doc_id"]).collect()
    assert len(found) == len(split)
    for r in found:
        rows = np.array([unit[w] for w in split[r.doc_id]]).reshape(-1, quality.WIDTH)
        mean = rows.mean(axis=0) if len(rows) else np.zeros(quality.WIDTH)
        beside = (rows[1:] * rows[:-1]).mean(axis=0) if len(rows) > 1 else np.zeros(quality.WIDTH)
        assert np.allclose(r.features[:quality.WIDTH], mean, atol=1e-6)
        assert np.allclose(r.features[2 * quality.WIDTH:3 * quality.WIDTH], beside, atol=1e-6)


def test_the_sum_of_a_word_is_written_once_with_its_keys(monkeypatch):
    """Frequent words have no keys, a word of one document is left out, many keys are several rows."""
    monkeypatch.setattr(quality, "KEYS", 2)
    rows = [(7, k, 1) for k in (3, 1, 2, 1, 5, 4)] + [(9, 8, 5), (4, None, 200), (4, None, 1), (6, 8, 3), (6, 8, 2), (5, -1, 4), (5, 2, 4)]
    batches = [quality.pa.RecordBatch.from_arrays(
        [quality.pa.array([r[i] for r in part], quality.pa.int64()) for i in (0, 1)] +
        [quality._packed(np.full((len(part), quality.WIDTH), [[r[2]] for r in part], np.int64))], names=["word", "key", "sums"]) for part in (rows[:8], rows[8:])]
    found = quality.pa.Table.from_batches(list(quality._sum_rows(iter(batches))))
    sums = quality._unpacked(found.column("sums").to_pylist())
    got = list(zip(found.column("word").to_pylist(), found.column("keys").to_pylist(), sums[:, 0].tolist(), strict=True))
    assert got == [(4, None, 201), (5, [-1, 2], 8), (6, [8], 5), (7, [1, 2], 6), (7, [3, 4], 6), (7, [5], 6)]
    assert (sums == sums[:, :1]).all() and not list(quality._sum_rows(iter([])))


def test_sums_take_the_fewest_bytes_that_hold_them():
    rng = np.random.default_rng(2)
    rows = [rng.integers(-most, most + 1, (20_000, quality.WIDTH)) for most in (2, 7, 127, 10**12)]
    edges = np.zeros((9, quality.WIDTH), np.int64)
    edges[range(9), range(9)] = [-2, 2, -3, 7, -8, 127, -127, 128, -128]
    sums = np.concatenate([edges, *rows])[rng.permutation(80_009)]
    cells = quality._packed(sums).to_pylist()
    assert np.array_equal(quality._unpacked(cells), sums)
    most = np.abs(sums).max(axis=1)
    assert [len(c) for c in cells] == np.select([most <= 2, most <= 7, most <= 127], [11, 16, 32], 256).tolist()
    assert len(quality._packed(sums[:0])) == 0 and quality._unpacked([]).shape == (0, quality.WIDTH)


def test_sums_are_cut_as_compressed_blocks(spark, odd, monkeypatch):
    rng = np.random.default_rng(3)
    words, many = np.arange(5000), [None if i % 7 == 0 else [i] * (i % 4) for i in range(5000)]
    sums = quality._packed(rng.integers(-1, 2, (5000, quality.WIDTH)))
    rows = quality.pa.RecordBatch.from_arrays([quality.pa.array(words), quality.pa.array(many, quality.pa.list_(quality.pa.int64())), sums],
                                              names=["word", "keys", "sums"])
    blocks = list(quality._blocks(iter([rows, rows.slice(0, 0)])))
    found = quality.pa.Table.from_batches(list(quality._rows_of(iter(blocks))))
    assert sorted(found.to_pylist(), key=str) == sorted(rows.to_pylist(), key=str)
    assert [b.column("everywhere").to_pylist() for b in blocks] == [[True], [False]]
    seen = []
    monkeypatch.setattr(quality, "cut", lambda df, cut=quality.cut: seen.append(df.columns) or cut(df))
    quality.word_sums(odd)
    assert seen == [["block"], ["everywhere", "block"]]


def test_frequent_words_are_sent_in_few_bytes():
    rng = np.random.default_rng(1)
    sums = rng.integers(-100, 100, (3000, quality.WIDTH)) * np.repeat([1, 100, 10**5, 10**10], [2400, 300, 200, 100])[:, None]
    rows = rng.permutation(3500)[:3000]
    held = quality.Frequent(np.arange(3500), rows, sums)
    want = np.zeros((3500, quality.WIDTH), np.float32)
    want[rows] = quality._units(sums)
    asked = rng.integers(0, 3500, 900)
    assert np.array_equal(held.units(asked), want[asked])
    assert sum(s.nbytes + r.nbytes for r, s in held.parts) < want.nbytes / 1.5
    none = quality.Frequent(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, quality.WIDTH), np.int64))
    assert none.units(np.zeros(0, np.int64)).shape == (0, quality.WIDTH)


def test_texts_come_back_whole_from_their_way(spark, odd, monkeypatch):
    monkeypatch.setattr(quality, "FREQUENT", 3)
    words = quality.word_sums(odd)
    found = quality.per_row(odd, words, lambda x: quality.pa.array(np.abs(x).sum(axis=1), quality.pa.float64()), "total double", odd.columns)
    assert found.drop("total").schema.simpleString() == odd.schema.simpleString()
    assert sorted(map(tuple, found.drop("total").collect()), key=str) == sorted(map(tuple, odd.collect()), key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "__packed" in plan.split("Join")[1]  # what goes to the join is packed


def test_network_is_calibrated_and_falls_back():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    truth = (rng.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = quality.train(x, truth)
    scores = net.scores(x)
    for low in (0.0, 0.25, 0.5, 0.75):
        inside = (scores >= low) & (scores < low + 0.25)
        assert abs(scores[inside].mean() - truth[inside].mean()) < 0.08
    assert quality.train(x[:4], truth[:4]).scores(x[:2]).tolist() == [(truth[:4].sum() + 1) / 6] * 2
    assert np.allclose(quality.train(x[:50], np.ones(50)).scores(x[:3]), 51 / 52)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (3, 1, None), (None, 0, 1), (7, None, None)]])
def test_quality_and_toxicity_of_odd_rows(spark, odd, none, labels):
    given = spark.createDataFrame(labels, LABELS)
    for found in (quality.score(odd, given).withColumnsRenamed({"__score": "score", "__predicted": "predicted"}),
                  toxicity.score(odd, given)):
        rows = found.collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    good = quality.keep_good(odd, given)
    assert good.columns == odd.columns and good.count() == odd.count()
    assert quality.score(none, given).count() == 0 and toxicity.score(none, given).count() == 0


def test_language_on_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    rows = QUERIES["op8_language"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == held_out(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in rows)
    apart = [r for r in rows if r.held_out and r.lang]
    assert len(apart) > 100 and np.mean([r.lang == r.lang_pred for r in apart]) > 0.97


def test_network_gradients_by_differences():
    net = langid.start(("a", "b", "c"), hidden=4)
    pieces, truth = [b"hello wor", b"bon", b"xyzzy"], np.array([0, 1, 2])
    _, slopes = langid.gradients(net, pieces, truth)
    for weights, slope in zip([*net.tables, *net.squares, net.output, net.bias], slopes, strict=True):
        at = np.unravel_index(np.argmax(np.abs(slope)), weights.shape)
        kept = weights[at]
        weights[at] = kept + 1e-2
        up, _ = langid.gradients(net, pieces, truth)
        weights[at] = kept - 1e-2
        down, _ = langid.gradients(net, pieces, truth)
        weights[at] = kept
        assert math.isclose((up - down) / 2e-2, slope[at], rel_tol=0.02)


def probabilities_by_hand(net, text):
    """One byte after the other, per segment, in plain loops."""
    size, total = net.hidden, np.zeros(len(net.languages))
    for piece in langid.segments(text):
        states = []
        for side in (0, 1):
            h, out = np.zeros(size), []
            for byte in piece if side == 0 else piece[::-1]:
                given, own = net.tables[side][:, byte], net.squares[side] @ h
                update = 1 / (1 + np.exp(-(given[:size] + own[:size])))
                reset = 1 / (1 + np.exp(-(given[size:2 * size] + own[size:2 * size])))
                candidate = np.tanh(given[2 * size:] + reset * own[2 * size:])
                h = update * h + (1 - update) * candidate
                out.append(h)
            states.append(out if side == 0 else out[::-1])
        for a, b in zip(*states, strict=True):
            logits = net.output @ np.concatenate((a, b)) + net.bias
            total += np.exp(logits) / np.exp(logits).sum()
    return total / len(text)


def test_pooled_probabilities_by_hand(monkeypatch):
    monkeypatch.setattr(langid, "SIDE_BY_SIDE", 3)
    net = langid.start(("x", "y", "z"))
    texts = [b"one two three " * 20, b"", b"12 34", "äöü".encode() * 50, b"a", "٣٤".encode(), "語".encode()]
    names, scores = net.predict(texts)
    assert [n == langid.UNKNOWN for n in names] == [False, True, True, False, False, True, False]
    for t, n, s in zip(texts, names, scores, strict=True):
        if n != langid.UNKNOWN:
            want = probabilities_by_hand(net, t)
            assert net.languages[int(want.argmax())] == n and math.isclose(want.max(), s, rel_tol=1e-3)
        else:
            assert s == 0


def test_language_of_odd_rows(spark, odd, none):
    rows = langid.label(odd).collect()
    assert len(rows) == odd.count()
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5)} == {"und"}
    assert langid.label(none).count() == 0
    unknown = langid.label(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unknown} == {("und", 0.0)}


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op9_toxicity"](spark, sf).join(table(spark, sf, "labels"), "doc_id").collect()
    assert all(r.held_out == held_out(r.doc_id, 4, 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    apart = [r for r in rows if r.held_out]
    assert np.mean([r.predicted for r in apart if r.toxic == 1]) >= 0.9
    assert np.mean([r.predicted for r in apart if r.toxic == 0]) < 0.02


GRAMMAR = toxicity.Grammar({"idiot": 3.0, "ß": 1.0}, {"lowei": 2.0})


@pytest.mark.parametrize("text, want", [
    ("", (0, 0, 0, 0)),
    ("a plain text.", (0, 0, 0, 0)),
    ("What an IDIOT", (3, 0, 0, 0)),
    ("You are an idiot!", (3, 3, 0, 0)),
    ("You. An idiot", (3, 0, 0, 0)),  # the target stands in another clause
    ("he is not an idiot", (0, 0, 3, 0)),
    ("not that anyone here is an idiot", (3, 0, 0, 0)),  # out of the negation's reach
    ("she said he was an idiot; idiot", (3, 0, 3, 0)),
    ("loweisch und Loweiß.", (4, 0, 0, 0)),  # words by their stem
    ("idiots slowei", (0, 0, 0, 0)),
    ("I kill you", (0, 0, 0, 1)),
    ("I will not kill you\nkill time", (0, 0, 0, 0)),
    ("he isn't an idiot", (0, 0, 3, 0)),
    ("they aren\u2019t idiot people", (0, 0, 3, 0)),
    ("don't kill you", (0, 0, 0, 0)),
    ("a t idiot", (3, 0, 0, 0)),
])
def test_clauses(text, want):
    matcher = toxicity.Matcher(GRAMMAR)
    clauses = [matcher.clause(c.split()) for c in toxicity.plain(text.encode()).split("\n")]
    assert tuple(sum(c[i] for c in clauses) for i in range(4)) == want
    found = matcher.features(text.encode())
    assert math.isclose(math.expm1(found[2]), want[0] + want[2], abs_tol=1e-9) and found[5] == want[3]


def test_threats_and_negations_by_the_default_layer():
    grammar = toxicity.Grammar({w: 3.0 for w in toxicity.INSULTS}, {})
    texts = [b"", b"I will kill you", b"you are an idiot", b"he isn't an idiot", b"I will not kill you"]
    empty, threat, insult, negated, spared = toxicity.Matcher(grammar).score(texts)
    assert threat > 0.5 and insult > 0.5 and empty < 0.1 and spared < 0.1 and negated < insult


def features_by_hand(grammar, text):
    """Every clause through the grammar, words and stems tried one by one."""
    groups = [(toxicity.THREATS, "threat"), (toxicity.TARGETS, "target"), (toxicity.NEGATIONS, "not"), (toxicity.REPORTS, "said")]
    best = total = aimed_total = bound_total = threat_total = 0.0
    for clause in re.split(r"[\n.!?;:]", text.lower()):
        words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", clause)
        free = bound = threats = 0.0
        since, said, aimed = 99, False, False
        for i, w in enumerate(words):
            weight = max([grammar.words.get(w, 0.0), *[x for s, x in grammar.stems.items() if w.startswith(s)]])
            kind = "insult" if weight else next((k for g, k in groups if w in g), "")
            if (w == "t" and i and words[i - 1].endswith("n")) or w.endswith("n\u2019t"):
                kind = "not"
            since = 0 if kind == "not" else since + 1
            under = since <= toxicity.NEGATION_REACH or said
            if kind == "insult":
                free, bound = (free, bound + weight) if under else (free + weight, bound)
            threats += kind == "threat" and not under
            said, aimed = said or kind == "said", aimed or kind == "target"
        best, total, bound_total = max(best, free + bound), total + free + bound, bound_total + bound
        aimed_total, threat_total = aimed_total + (free if aimed else 0), threat_total + (threats if aimed else 0)
    return [float(total > 0), best, math.log1p(total), math.log1p(aimed_total), math.log1p(bound_total), threat_total]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["idiot", "Idiots", "loweisch", "you", "kill", "not", "isn't", "don\u2019t", "said", "a", "ß", "t", "nicht", "x"]),
                          st.sampled_from([" ", " ", ", ", ". ", "\n", "! "])), max_size=25))
def test_scores_by_hand(parts):
    text = "".join(a + b for a, b in parts)
    matcher = toxicity.Matcher(GRAMMAR)
    found, want = matcher.features(text.encode()), features_by_hand(GRAMMAR, text)
    assert np.allclose(found, want)
    layer = np.array(GRAMMAR.layer)
    assert np.isclose(matcher.score([text.encode()])[0], 1 / (1 + np.exp(-(layer[0] + np.array(want) @ layer[1:]))))


def test_lexicon_finds_words_and_longest_stems(spark):
    rows = [(f"good words {i % 5} kalor{'abcdef'[i % 6]}x zorn".encode(), 1) for i in range(60)]
    rows += [(f"good words {i % 5} kal kalendar".encode(), 0) for i in range(200)]
    grammar = toxicity.learn_lexicon(spark.createDataFrame(rows, "text binary, toxic int"), 60, 200)
    assert "zorn" in grammar.words and "good" not in grammar.words and "kalendar" not in grammar.words
    assert set(grammar.stems) == {"kalor"}
