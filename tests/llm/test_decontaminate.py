import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ruleharbor.llm import decontaminate as dc
from tests.llm.conftest import SHAPE


def tiles_by_hand(a, b, least):
    """Greedy tiling as its definition says: mark all longest unmarked matches, then look for shorter ones."""
    ma, mb, covered = [False] * len(a), [False] * len(b), 0
    while True:
        best, found = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best and n >= least:
                    found.append((i, j))
        if best < least:
            return covered
        for i, j in found:
            if not any(ma[i:i + best]) and not any(mb[j:j + best]):
                ma[i:i + best] = mb[j:j + best] = [True] * best
                covered += best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=24), st.lists(st.integers(1, 4), max_size=24))
def test_tiles_are_equal_disjoint_and_maximal(a, b):
    found = dc.tiles(np.array(a, np.int64), np.array(b, np.int64), 3)
    for x, y, n in found:
        assert a[x:x + n] == b[y:y + n] and n >= 3
    for side in (0, 1):
        places = [p for t in found for p in range(t[side], t[side] + t[2])]
        assert len(places) == len(set(places))
    assert [n for _, _, n in found] == sorted((n for _, _, n in found), reverse=True)
    # Greedy choices among equal lengths may differ; the longest tile and an open match may not.
    assert bool(found) == bool(tiles_by_hand(a, b, 3))


def test_tiles_by_hand_on_texts():
    rng = random.Random(5)
    for _ in range(60):
        b = rng.sample(range(1000), 30)
        a = rng.sample(range(2000, 4000), 40)
        for _ in range(rng.randrange(4)):
            x, n = rng.randrange(20), rng.randrange(3, 12)
            at = rng.randrange(40)
            a[at:at] = b[x:x + n]
        found = dc.tiles(np.array(a), np.array(b), 5)
        assert sum(n for _, _, n in found) == tiles_by_hand(a, b, 5)


def test_rolling_hash_tells_windows_apart():
    numbers = np.array([1, 2, 3, 1, 2, 3, 4, 1, 2], np.int64)
    for n in range(1, 9):
        hashes = dc.rolling(numbers, n)
        windows = [tuple(numbers[i:i + n]) for i in range(len(numbers) - n + 1)]
        assert len(hashes) == len(windows) and len(set(hashes.tolist())) == len(set(windows))


def test_whole_reordered_and_cut_passages(spark):
    item = " ".join(f"word{i}" for i in range(40))
    words = item.split()
    rng = random.Random(2)
    noise = [" ".join(f"noise{rng.randrange(500)}" for _ in range(30)) for _ in range(4)]
    rows = [
        (1, f"{noise[0]} {item.upper()}! {noise[1]}", "en", "s", 0),
        (2, " ".join([*words[20:], noise[2], *words[:20]]), "en", "s", 0),  # reordered
        (3, " ".join([*words[:8], noise[3]]), "en", "s", 0),  # too little of it
        (4, noise[0], "en", "s", 0),
        (5, "\n".join(" ".join(words[i:i + 6]) for i in (30, 12, 0, 24, 6, 18)), "en", "s", 0),
    ]
    benchmark = spark.createDataFrame([(10, item), (11, "a b c"), (12, None), (13, "")], "item_id long, text string")
    docs = spark.createDataFrame(rows, SHAPE)
    for size in (1 << 20, 64):  # one block, and several
        found = dc.matches(docs, benchmark, block_bytes=size).collect()
        assert sorted((r.doc_id, r.item_id, r.n_tiles, r.longest) for r in found) == [(1, 10, 1, 40), (2, 10, 2, 20), (5, 10, 6, 6)]
    assert sorted(r.doc_id for r in dc.drop_contaminated(docs, benchmark).collect()) == [3, 4]


def test_a_phrase_in_common_is_judged_without_tiling():
    phrase = "once upon a time there was"
    items = [(i, f"{phrase} {' '.join(f'i{i}w{k}' for k in range(20))}".encode()) for i in range(300)]
    block = dc.Block(items)
    texts = [f"{phrase} {' '.join(f't{t}w{k}' for k in range(20))}".encode() for t in range(50)]
    assert block.seeds(texts, dc.COVER)[1] == []
    assert len(block.seeds(texts, 0.2)[1]) == 50 * 300  # six of 26 words
    assert block.seeds([*texts, items[7][1], b"", b"a b c"], dc.COVER)[1] == [(50, 7)]


@pytest.mark.parametrize("at_once", [1, 9, 1 << 20])
def test_the_bound_leaves_out_no_pair_that_tiles_would_cover(monkeypatch, at_once):
    monkeypatch.setattr(dc, "_AT_ONCE", at_once)
    rng = random.Random(11)
    for _ in range(40):
        items = [(i, " ".join(rng.choices("abcdef", k=rng.randrange(3, 25))).encode()) for i in range(5)]
        texts = [" ".join(rng.choices("abcdef", k=rng.randrange(0, 60))).encode() for _ in range(4)]
        block = dc.Block(items, 3)
        words, pairs = block.seeds(texts, 0.5)
        assert len(pairs) == len(set(pairs))
        want = {(t, k) for t in range(4) for k in range(len(block.items)) if block.judge(words[t], k, 0.5)}
        assert want <= set(pairs)
        # What is held by windows in common, word by word.
        for t in range(4):
            have = {tuple(words[t][i:i + 3]) for i in range(len(words[t]) - 2)}
            for k, (_, w) in enumerate(block.items):
                held = {i + j for i in range(len(w) - 2) if tuple(w[i:i + 3]) in have for j in range(3)}
                assert ((t, k) in pairs) == (2 * len(held) >= len(w) and bool(held))


def test_odd_rows(odd, none, spark):
    benchmark = spark.createDataFrame([(1, "the quick brown fox jumps over"), (2, "lorem ipsum dolor sit amet")],
                                      "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in dc.matches(odd, benchmark).collect()}
    assert found == {(1, 1), (2, 1), (6, 2)}
    clean = dc.drop_contaminated(odd, benchmark)
    assert clean.columns == odd.columns and clean.count() == 6
    assert dc.matches(none, benchmark).count() == 0 and dc.matches(odd, benchmark.where("false")).count() == 0
    assert dc.drop_contaminated(odd, benchmark.where("false")).count() == odd.count()


def test_rows_of_one_id_are_judged_each(spark):
    item = " ".join(f"word{i}" for i in range(20))
    docs = spark.createDataFrame([(1, item), (1, "clean"), (None, f"x {item}"), (None, "clean too"), (2, None)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(10, item), (11, "one two three four five six")], "item_id long, text string")
    for size in (1 << 20, 64):
        kept = dc.drop_contaminated(docs, benchmark, block_bytes=size).collect()
        assert sorted(str(r.text) for r in kept) == ["None", "clean", "clean too"]
