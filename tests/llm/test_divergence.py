"""The divergence audit against its definition worked out densely, its defined cases, and collapse of copies."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ruleharbor.llm import divergence
from tests.llm.conftest import ODD_ROWS, SHAPE


def audit_by_hand(rows, most=divergence.MOST_TERMS):
    docs = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in r[1] or ""))) for r in rows]
    among, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        among[lang].update(set(terms))
        counts[lang, source].update(terms)
        sources[lang].add(source)
    out = []
    for lang, own in sources.items():
        kept = sorted(t for t, n in among[lang].items() if n >= 3)

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        q = shares(sum((counts[lang, s] for s in own), Counter()))
        for s in own:
            p = shares(counts[lang, s])
            far = [(sum((p[t] - x[t]) ** 2 // x[t] for t in kept), o) for o in own - {s} for x in [shares(counts[lang, o])]]
            told = [((p[t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[t] > q[t]]
            for part, items in (("pair", far), ("term", told)):
                items = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k) for k, (v, i) in enumerate(items, 1) if part == "pair" or k <= most]
    return sorted(out)


def some_rows(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{c}{d}" for c in "abcdefgh" for d in "éßxyz"] + ["THE", "The", "漢字", "a-b", "x1y"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(words, k=rng.randrange(0, 30)))
        if rows and rng.random() < 0.4:
            text = rng.choice(rows)[1]
        rows.append((i, rng.choice([text, text, None]), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", "ü", None]), 0))
    return rows


@pytest.mark.parametrize("seed, most", [(1, 200), (2, 3)])
def test_audit_by_hand(spark, seed, most):
    rows = [*some_rows(seed), (900, None, "xx", "only", 0), (901, "q q", "yy", "s", 0), (902, "r", "yy", "t", 0)]
    found = divergence.audit(spark.createDataFrame(rows, SHAPE).repartition(5), most)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == audit_by_hand(rows, most)


def test_odd_rows(odd, none):
    assert sorted(map(tuple, divergence.audit(odd).collect())) == audit_by_hand(ODD_ROWS)
    clash = odd.withColumns({c: F.lit("x") for c in ("digest", "term", "n", "rank", "part", "item", "value", "profile")})
    assert sorted(map(tuple, divergence.audit(clash).collect())) == audit_by_hand(ODD_ROWS)
    assert divergence.audit(none).count() == 0


def test_identical_texts_are_one_row_with_their_copies(spark):
    rows = [(i, "same text", "en", "ab"[i % 3 == 0], 0) for i in range(30)] + [(40, "same text", "de", "a", 0), (41, None, "de", "a", 0)]
    found = divergence.collapsed(spark.createDataFrame(rows, SHAPE).repartition(4)).collect()
    assert sorted((r.lang, bytes(r.text), sorted((s.source, s.n) for s in r.sources)) for r in found) == [
        ("de", b"", [("a", 1)]), ("de", b"same text", [("a", 1)]), ("en", b"same text", [("a", 20), ("b", 10)])]


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 50])
def test_long_texts_in_pieces_lose_and_split_no_term(monkeypatch, piece):
    monkeypatch.setattr(divergence, "PIECE", piece)
    rng = random.Random(piece)
    for _ in range(200):
        text = "".join(rng.choices("aB é1-", k=rng.randrange(0, 40))).encode()
        assert list(divergence.terms_of(text)) == re.findall(rb"[A-Za-z\x80-\xff]+", text.lower())


def test_counts_are_passed_on_in_parts(spark):
    texts = ["a b a", "b c", "c c d", "a"] * 5
    rows = [("en", t, [("s", 2), ("t", 1)]) for t in texts]
    shape = "lang string, text binary, sources array<struct<source string, n long>>"
    given = spark.createDataFrame([(lang, t.encode(), s) for lang, t, s in rows], shape)
    for most in (1, 3, 10**6):
        found = given.coalesce(1).mapInArrow(divergence._counter(most), divergence._COUNTED).select("term", F.inline("sources"))
        total = found.groupBy("source", F.col("term").cast("string")).agg(F.sum("n"), F.sum("documents")).collect()
        assert sorted(map(tuple, total)) == sorted(
            (s, t, k * 5 * n, k * 5 * d) for s, k in (("s", 2), ("t", 1)) for t, n, d in (("a", 3, 2), ("b", 2, 2), ("c", 3, 2), ("d", 1, 1)))


def test_shares_of_counts_beyond_longs_are_exact(spark):
    rows = [(c, n, v) for c in (0, 7, divergence.WIDE - 1, divergence.WIDE, 10**14) for n in (c, c + 10**15 + 7) for v in (1, 999)]
    found = spark.createDataFrame(rows, "c long, n long, v long").select(
        "c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert [r.p for r in found] == [1 + 10**9 * (c + 1) // (n + v) for c, n, v in rows]
