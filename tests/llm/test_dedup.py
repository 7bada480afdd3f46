import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ruleharbor.llm import exact_dedup, simhash
from ruleharbor.llm.graph import components
from tests.llm.conftest import ODD_ROWS, SHAPE


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def exact_by_hand(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[squeezed(text)].append(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        ids = groups[squeezed(text)]
        keep = min((i for i in ids if i is not None), default=None)
        out.append((doc_id, keep, len(ids), doc_id == keep, hashlib.sha256(squeezed(text).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [exact_dedup.digest128, lambda text: F.lit(b"same")])
def test_exact_groups_by_hand_even_if_all_hashes_collide(odd, digest):
    found = exact_dedup.decide(odd, digest)
    assert sorted(map(tuple, found.collect()), key=str) == exact_by_hand(ODD_ROWS)


def test_exact_stage_keeps_one_row_per_text_and_all_columns(odd, none):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    texts = [squeezed(r.text) for r in rows]
    assert len(texts) == len(set(texts)) == len({squeezed(r[1]) for r in ODD_ROWS})
    assert {r.doc_id for r in rows} == {1, 3, 5, None, 6, 7}
    assert exact_dedup.drop_copies(none).count() == 0 and exact_dedup.decide(none).count() == 0


def print_by_hand(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    values = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def classes_by_hand(rows, prints):
    n = len(rows)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    return sorted(((r[0], f"{p:016x}", min((x for x in least[find(i)] if x is not None), default=None))
                   for i, (r, p) in enumerate(zip(rows, prints, strict=True))), key=str)


def near_copies(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, made = [], []
    for i in range(n):
        text = " ".join(rng.choices(words, k=rng.randrange(1, 60)))
        if made and rng.random() < 0.6:
            some = rng.choice(made).split()
            some[rng.randrange(len(some))] = rng.choice(words)
            text = " ".join(some)
        made.append(text)
        rows.append((i, text, "en", "s", len(text)))
    return rows


@pytest.mark.parametrize("gathered", [512, 2])
def test_near_duplicates_by_hand(spark, gathered):
    rows = [*near_copies(3), *ODD_ROWS[3:6]]
    found = simhash.near_duplicates(spark.createDataFrame(rows, SHAPE), gathered)
    prints = [print_by_hand(r[1]) for r in rows]
    assert sorted(map(tuple, found.collect()), key=str) == classes_by_hand(rows, prints)


@pytest.mark.parametrize("gathered", [512, 8, 2])
def test_links_lose_no_pair_of_a_dense_family(spark, gathered):
    rng = random.Random(9)
    center = rng.getrandbits(64)
    prints = sorted({simhash.signed(center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 7)))) for _ in range(120)}
                    | {simhash.signed(rng.getrandbits(64)) for _ in range(40)})
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), gathered).collect()
    plain = [p % (1 << 64) for p in prints]
    rows = [(i,) for i in range(len(prints))]
    want = {r[0]: r[2] for r in classes_by_hand(rows, plain)}
    place, root = {p: i for i, p in enumerate(prints)}, list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        assert ((a ^ b) % (1 << 64)).bit_count() <= 4
        x, y = find(place[a]), find(place[b])
        root[max(x, y)] = min(x, y)
    assert {i: find(i) for i in range(len(prints))} == want


def test_masks_cover_every_pair_in_the_radius():
    rng = np.random.default_rng(1)
    masks = [m % (1 << 64) for m in simhash.MASKS]
    for _ in range(3000):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(not flips & m for m in masks)


def test_components_follow_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (200, 200)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_near_stage_keeps_the_smallest_id_and_all_columns(odd, none):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    # 2 differs from 1 by white space only; 3, 4 and 5 have no words; a row without id stays alone.
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, None, 6, 7], key=str)
    assert simhash.keep_one(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def test_near_stage_loses_no_other_text_of_an_id_or_of_rows_without_one(spark):
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcd"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1].upper()), (5, texts[2]), (5, texts[3]), (9, texts[3]), (None, texts[3])]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text.lower()) for r in kept.collect() if r.doc_id) == [(5, texts[2]), (5, texts[3])]
    assert sorted(r.text.lower() for r in kept.collect() if r.doc_id is None) == texts[:2]


@pytest.mark.parametrize("step", [1, 3, 7, 1000])
def test_buckets_are_read_in_order_however_batches_cut_them(step):
    rng = random.Random(step)
    rows = sorted((v, key, simhash.signed(rng.getrandbits(6))) for v in range(3) for key in range(8) for _ in range(rng.choice([1, 2, 3, 5, 12])))
    rows = sorted(set(rows))
    whole = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2))], names=["v", "key", "fp"])
    told = [r for batch in simhash._in_buckets(4)(whole.slice(i, step) for i in range(0, len(rows), step)) for r in batch.to_pylist()]
    buckets = defaultdict(list)
    for v, key, fp in rows:
        buckets[v, key].append(fp)
    wide = sorted((v, fp) for (v, _), fps in buckets.items() if len(fps) > 4 for fp in fps)
    assert sorted((r["v"], r["a"]) for r in told if r["b"] is None) == wide
    links = sorted(link for fps in buckets.values() if len(fps) <= 4 for link in simhash.forest(np.array(fps)))
    assert sorted((r["a"], r["b"]) for r in told if r["b"] is not None) == links
