import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ruleharbor.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def base_by_hand(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    starts, labels = [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


PIECES = ["gnu", "General", "PUBLIC", "license", "licensé", "apache", "Apache License", "cc", "by", "mit", "MIT License",
          ",\n", " ", "-", "\u00a0", "x", "é", "gnu general public license", "cc by cc by", "İ", "\u2028", "7"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(PIECES), st.sampled_from(["", " ", ". ", "\t"])), max_size=25))
def test_places_by_hand(parts):
    text = "".join(a + b for a, b in parts)
    found = licenses.scan_text(text.encode())
    assert found[:5] == base_by_hand(text)
    assert set(found[4].split(",")) <= {*found[5].split(","), ""} and 0 <= found[6] <= 1


def test_whole_table_by_hand(spark):
    from ruleharbor.llm.common import table
    from ruleharbor.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    rows = QUERIES["op4_licenses"](spark, sf).collect()
    assert len(rows) == len(texts) and sum(r.n_base for r in rows)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_by_hand(texts[r.doc_id])


@pytest.mark.parametrize("expression, names, alternatives", [
    ("MIT", ["mit"], [{"mit"}]),
    ("MIT OR Apache-2.0", ["apache-2.0", "mit"], [{"mit"}, {"apache-2.0"}]),
    ("MIT AND ISC OR Zlib", ["isc", "mit", "zlib"], [{"mit", "isc"}, {"zlib"}]),
    ("MIT AND (ISC OR Zlib)", ["isc", "mit", "zlib"], [{"mit", "isc"}, {"mit", "zlib"}]),
    ("GPL-2.0+ WITH Classpath-exception-2.0 AND MIT", ["gpl-2.0+", "mit"],
     [{"gpl-2.0+ with classpath-exception-2.0", "mit"}]),
    ("((MIT", ["mit"], [{"mit"}]),
    (") OR MIT", ["mit"], [{"mit"}, set()]),
    ("", [], [set()]),
])
def test_expressions(expression, names, alternatives):
    found, listed = licenses.parse(expression)
    assert listed == names and found == {frozenset(a) for a in alternatives}


def test_an_expression_that_explodes_is_told_as_it_stands():
    text = " AND ".join(f"(a{i} OR b{i})" for i in range(13))
    found, names = licenses.parse(text)
    assert len(names) == 26 and found is None
    row = licenses.scan_text(f"SPDX-License-Identifier: {text}".encode())
    assert row[7].startswith("( a0 or b0 ) and ( a1") and len(row[5].split(",")) == 26
    few = licenses.scan_text(f"SPDX-License-Identifier: {' AND '.join(f'(a{i} OR b{i})' for i in range(12))}".encode())
    assert few[7].count(" | ") == 2**12 - 1


@pytest.mark.parametrize("text, labels, alternatives", [
    ("// SPDX-License-Identifier: MIT. This file is part of a tool and was written by Ann", "mit", "mit"),
    ("spdx-license-identifier: (MIT OR Apache-2.0) */ int main() { return 0; }", "apache-2.0,mit", "apache-2.0 | mit"),
    ("SPDX-License-Identifier: MIT and the rest", "mit,the", "mit & the"),
    ("SPDX-License-Identifier: MIT, see LICENSE", "mit", "mit"),
    ("SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0 text", "gpl-2.0+", "gpl-2.0+ with classpath-exception-2.0"),
    ("SPDX-License-Identifier:\nMIT", "", ""),
    ("SPDX-License-Identifier: ) MIT", "", ""),
    ("SPDX-License-Identifier: ((MIT", "mit", "mit"),
    ("SPDX-License-Identifier: OR MIT", "", ""),
    ("SPDX-License-Identifier: ISC\r\nspdx-license-identifier:Zlib", "isc,zlib", "isc | zlib"),
    ("SPDX License Identifier MIT", "", ""),
    ("xSPDX-License-Identifier: MIT", "", ""),
    ("é SPDX-License-Identifier: BSD-3-Clause é", "bsd-3-clause", "bsd-3-clause"),
])
def test_expressions_end_where_the_grammar_does(text, labels, alternatives):
    row = licenses.scan_text(text.encode())
    assert (row[5], row[7]) == (labels, alternatives) and row[6] == (licenses.SURE if labels else 0.0)


def labels_by_hand(text):
    """All phrases word by word, all tags by a pattern, expressions by recursive descent."""
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    stands = lambda p: any(words[i:i + len(p)] == p for i in range(len(words)))
    base = {v for k, v in licenses.BASE.items() if stands(k.split())}
    more = {v for k, v in licenses.NOTICES.items() if stands(k.split())}
    named = set()
    for found in re.finditer(r"(?<![0-9a-z\x80-\uffff])spdx-license-identifier:([^\r\n]*)", text.lower()):
        for token in re.findall(r"[a-z0-9.+:-]+", found[1]):
            if token not in ("and", "or", "with"):
                named.add(token)
    doubt = [1.0] + [1 - licenses.NAMED] * bool(base) + [1 - licenses.NOTICED] * bool(more) + [1 - licenses.SURE] * bool(named)
    return ",".join(sorted(base | more | named)), 1 - min(doubt)


NOTICE_PIECES = [*(k.upper() for k in licenses.NOTICES), "Apache License", "the", "version 2.0", "MIT License", "4.0", "public", "x"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(NOTICE_PIECES), max_size=12),
       st.sampled_from(["", "SPDX-License-Identifier: MIT", "spdx-license-identifier: (isc or zlib) and MIT"]))
def test_labels_and_score_by_hand(parts, tag):
    text = " - ".join(parts) + "\n" + tag
    found = licenses.scan_text(text.encode())
    assert (found[5], found[6]) == labels_by_hand(text)


def test_tags_and_notices():
    row = licenses.scan_text(b"# SPDX-License-Identifier: (MIT OR Apache-2.0)\nthe Apache\n * License, Version 2.0")
    assert row[4] == "apache" and row[5] == "apache,apache-2.0,mit" and row[6] == licenses.SURE
    assert row[7] == "apache-2.0 | mit"


def test_odd_rows(odd, none):
    rows = {r.doc_id: r for r in licenses.scan(odd).collect()}
    assert rows[4].n_words == 0 and rows[4].labels == "" and rows[4].first_word is None
    assert rows[6].n_words == 200_000
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(none).count() == 0
