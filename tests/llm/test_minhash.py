"""MinHash classes against all pairs of full sets, the parts of the join, and the defined cases."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleharbor.llm import minhash
from tests.llm.conftest import ODD_ROWS, SHAPE


def set_by_hand(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def classes_by_hand(rows):
    sets, root = [set_by_hand(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    out = []
    for i, r in enumerate(rows):
        component = min((x for x in least[find(i)] if x is not None), default=None)
        out.append((r[0], len(sets[i]), component, r[0] == component))
    return sorted(out, key=str)


def changed(rng, words, pool, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = rng.choice(pool)
    return words


def some_rows(seed, n=150):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(500)]
    made = []
    for _ in range(n):
        words = rng.choices(pool, k=rng.choice([1, 2, 3, 5, 8, 9, 30, 60, 200]))
        if made and rng.random() < 0.6:
            words = changed(rng, rng.choice(made), pool, rng.choice([0, 1, 1, 2, 4]))
        if made and rng.random() < 0.1:
            words = rng.choice(made) + words[:2]
        made.append(words)
    return [(i, "  ".join(w), "en", "s", 0) for i, w in enumerate(made)]


@pytest.mark.parametrize("seed, block", [(1, 256), (2, 2)])
def test_classes_by_hand(spark, seed, block):
    rows = [*some_rows(seed), *ODD_ROWS]
    found = minhash.near_duplicates(spark.createDataFrame(rows, SHAPE).repartition(6), block=block)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, found.collect()), key=str) == classes_by_hand(rows)


@pytest.mark.parametrize("centre", [True, False])
def test_families_that_hang_on_one_text_or_on_chains(spark, centre):
    """Variants of a text are linked with it and not with each other; a chain links neighbours only."""
    rng = random.Random(4)
    base, pool = [f"b{i}" for i in range(60)], [f"p{i}" for i in range(5000)]
    texts = [[*base[:i], pool[i], *base[i + 1:]] for i in range(4, 56)] + ([base] if centre else [])
    chain = [rng.choices(pool, k=70)]
    for _ in range(25):
        chain.append(changed(rng, chain[-1], pool, 1))
    texts += chain
    rng.shuffle(texts)
    rows = [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, SHAPE).repartition(4), block=5)
    assert sorted(map(tuple, found.collect()), key=str) == classes_by_hand(rows)


def test_second_round_joins_all_components_of_a_list(spark):
    """Blocks of a list, or of a region of lists, together find every link between components."""
    rng = np.random.default_rng(6)
    sets = [np.unique(np.r_[np.arange(40), rng.integers(40, 60, rng.integers(0, 16))]) for _ in range(33)]
    marks = minhash.signatures([s.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for s in sets]).view(np.int32)
    shape = "class long, n long, signature array<int>, prefix array<long>, set array<long>"
    root = {i: i % 2 for i in range(8)}
    for posts in ([5, 6], [5 + 1000]):
        near = spark.createDataFrame([(i, len(s), marks[i].tolist(), [posts[i % len(posts)], 900 + i // 11, 50], s.tolist())
                                      for i, s in enumerate(sets)], shape)
        roots = spark.createDataFrame(list(root.items()), "node long, root long")

        def linked(i, j):
            both = len(np.intersect1d(sets[i], sets[j]))
            return 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both)

        def classes(links):
            own = {i: root.get(i, i) for i in range(33)}
            for a, b in links:
                one, two = own[a], own[b]
                own = {k: min(one, two) if v in (one, two) else v for k, v in own.items()}
            return own

        want = classes([(i, j) for i in range(33) for j in range(i) if linked(i, j)])
        for block in (1, 4, 100):
            found = minhash.remaining_links(near.drop("set"), near.select("class", "set"), roots, 1, block).collect()
            assert all(linked(a, b) for a, b in found) and classes(found) == want


def test_classes_without_shingles_of_others_are_left_out(spark):
    rows = [(i, [1] * minhash.COORDINATES, [7], [*range(30), 100 + 9 * i, *range(101 + 9 * i, 109 + 9 * i)]) for i in range(5)]
    near = spark.createDataFrame([(i, len(s), m, p, s) for i, m, p, s in rows], "class long, n long, signature array<int>, prefix array<long>, set array<long>")
    none = spark.createDataFrame([], "node long, root long")
    assert minhash.remaining_links(near.drop("set"), near.select("class", "set"), none, 1).count() == 0


def test_prefixes_meet_wherever_the_threshold_is_reached(spark):
    rng = np.random.default_rng(8)
    marks = rng.integers(0, 2, (40, minhash.COORDINATES))
    marks[:, ::3] = np.arange(40)[:, None]
    rows = [(i, 10, marks[i].tolist()) for i in range(40)]
    near = minhash.posted(spark.createDataFrame(rows, "class long, n long, signature array<int>"), 30).collect()
    prefix = {r["class"]: set(r.prefix) for r in near}
    for i in range(40):
        for j in range(i):
            if (marks[i] == marks[j]).sum() >= 30:
                assert prefix[i] & prefix[j]


def test_signatures_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(3)
    counts = []
    for _ in range(60):
        both, one, two = (rng.integers(0, 1 << 63, n, np.uint64) for n in (160, 20, 20))
        a, b = minhash.signatures([np.concatenate((both, one)), np.concatenate((both, two))])
        counts.append((a == b).sum())
    assert abs(np.mean(counts) / minhash.COORDINATES - 0.8) < 0.02 and min(counts) >= minhash.MATCHES
    assert 2.5 < np.std(counts) < 4.8  # sqrt(80 * 0.8 * 0.2) = 3.6


def test_long_texts_in_pieces_give_the_same_sets(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choices(["a", "B", " ", "\n", "cd "], k=900)).encode()
    whole = minhash.shingle_sets([text, b"", text[:9], b" x "])
    for piece in (1, 5, 64):
        monkeypatch.setattr(minhash, "PIECE", piece)
        assert all(np.array_equal(a, b) for a, b in zip(whole, minhash.shingle_sets([text, b"", text[:9], b" x "]), strict=True))
    assert [len(s) for s in whole] == [len(set_by_hand(t.decode())) for t in (text, b"", text[:9], b" x ")]


def test_odd_rows(odd, none):
    clash = odd.withColumns({c: F.lit(1) for c in ("class", "n", "signature", "key", "post", "set", "component_id")})
    assert sorted(map(tuple, minhash.near_duplicates(clash).collect()), key=str) == classes_by_hand(ODD_ROWS)
    assert minhash.near_duplicates(none).count() == 0
