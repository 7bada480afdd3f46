"""The alignment against whole texts encoded and compared byte by byte in plain loops, and its defined cases."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from ruleharbor.llm import alignment
from ruleharbor.llm.common import table
from tests.llm.conftest import LONG, ODD_ROWS, SHAPE

TEXTS = [
    "hello  world ", "  a", " ", "é漢😀x y", "a\n\nb\tc d", "a  b c", "ﬁ ① x", "x ▁ y", "▁", "<|endoftext|> a <s> </s>", "a\x00b c",
    " x y", "don't we'll  'tis x's", " \n x", " lead trail  ", "漢 字 é́ é x", "a　b c", "1 2 34567 8.9 $%^ &*", "\x1c a \x1d b",
    "👩‍👩‍👧 🇩🇪 x", "aaaaaaaaaaaa " * 3, "x" * 3000, "same words same words", "<0x41> <unk>", "﻿ a", "a   b",
]


def tokens_by_hand():
    a = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.FILES[0]}")
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.FILES[1]}")
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(x for x in range(256) if x not in plain)}

    def encode(text):
        one = a.encode(" " + text, add_special_tokens=False)
        left = [(i, bytes(alphabet[c] for c in t)) for i, t in zip(one.ids, one.tokens, strict=True)]
        right = []
        for i, piece in zip(b.encode(text), b.encode(text, out_type=str), strict=True):
            byte = len(piece) == 6 and piece.startswith("<0x")
            right.append((i, bytes([int(piece[3:5], 16)]) if byte and b.is_byte(i) else piece.replace("▁", " ").encode()))
        return left, right

    return encode


def by_hand(rows):
    encode, docs, total = tokens_by_hand(), [], Counter()
    for doc_id, text, *_ in rows:
        left, right = encode(text) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(p for _, p in left) != whole or b"".join(p for _, p in right) != whole:
            docs.append((doc_id, 0, 0, 0, [], ""))
            continue
        owner, ends = [], []
        for side in (left, right):
            owner.append([k for k, (_, p) in enumerate(side) for _ in p])
            found, at = {}, 0
            for k, (_, p) in enumerate(side):
                at += len(p)
                found[at] = k + 1
            ends.append(found)
        links = sorted(set(zip(*owner, strict=True)))
        told, i, j = [], 0, 0
        for cut in sorted(ends[0].keys() & ends[1].keys()):
            told.append(",".join(str(t) for t, _ in left[i:ends[0][cut]]) + "|" + ",".join(str(t) for t, _ in right[j:ends[1][cut]]))
            i, j = ends[0][cut], ends[1][cut]
        pairs = [(left[x][0], right[y][0]) for x, y in links]
        total.update(pairs)
        docs.append((doc_id, len(left), len(right), len(told), pairs, hashlib.sha256(";".join(told).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    return sorted(((d, a, b, g, len(p), sum(total[x] == most[x[1]] for x in p), sum(total[x] for x in p), s)
                   for d, a, b, g, p, s in docs), key=str)


def rows_of(found):
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 40, 0])
def test_alignment_by_hand(spark, frequent):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS * 2)]
    found = alignment.align(spark.createDataFrame(rows, SHAPE).repartition(5), frequent=frequent)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(found) == by_hand(rows)


def test_documents_of_the_table_by_hand(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert rows_of(alignment.align(docs)) == by_hand([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows(odd, none):
    clash = odd.withColumns({c: F.lit("x") for c in ("row_id", "pairs", "counts", "pair", "n", "best", "one", "many", "n_a")})
    assert rows_of(alignment.align(clash)) == by_hand(ODD_ROWS)
    assert by_hand(ODD_ROWS[8:9])[0][1] > len(LONG) / 8
    assert alignment.align(none).count() == 0


def test_invalid_bytes_have_no_tokens():
    known = alignment.Segments(alignment.tokenizers(alignment.FOLDER))
    found = alignment.per_document([b"ok \xff bad", b"ok"], known)
    assert found["n_a"].to_pylist()[0] == 0 < found["n_a"].to_pylist()[1] and found["groups_sha256"].to_pylist()[0] == ""


def test_forgotten_segments_are_learned_again():
    tools = alignment.tokenizers(alignment.FOLDER)
    known, texts = alignment.Segments(tools, most=3), [t.encode() for t in TEXTS]
    few = [alignment.per_document([t], known) for t in texts]
    whole = alignment.per_document(texts, alignment.Segments(tools))
    assert [x["groups_sha256"][0].as_py() for x in few] == whole["groups_sha256"].to_pylist()
    assert [x["pairs"][0].as_py() for x in few] == whole["pairs"].to_pylist()


def test_spans_are_refined_by_bytes():
    def ends(spans, pieces, last=None):
        begins, stops = np.array(spans).T
        return alignment.ends_of(begins, stops, np.arange(len(spans)) == len(spans) - 1 if last is None else np.array(last),
                                 np.array([len(p) for p in pieces])).tolist()

    # A character of three bytes in three tokens, told as one span each, then a plain one.
    assert ends([(0, 3), (0, 3), (0, 3), (3, 4)], [b"\xe6", b"\xbc", b"\xa2", b"x"]) == [1, 2, 3, 4]
    assert ends([(0, 0), (0, 0), (0, 3)], [b"\xe6", b"\xbc", b"\xa2"]) == [1, 2, 3]
    # Two texts one after the other.
    assert ends([(0, 2), (2, 4), (2, 4)], [b"ab", b"\xc3", b"\xa9"], [True, False, True]) == [2, 3, 4]
    for spans, pieces in (([(0, 2), (2, 4)], [b"a", b"bcd"]), ([(0, 1), (1, 2)], [b"a", b"bcd"])):
        with pytest.raises(ValueError):
            ends(spans, pieces)
