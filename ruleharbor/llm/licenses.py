"""License scan: an Aho-Corasick pass for tags and notice phrases, and a parser of license expressions.

A text becomes words (runs of a-z, 0-9 and non-ASCII characters, A-Z lower-cased) joined by single
spaces; an Aho-Corasick automaton finds phrases in it, so marks, line ends and case between the words of a
notice do not matter. *Base* phrases name license families and are counted at all their places.
The method adds labels of its own: notice phrases with versions, and the licenses named by the expression behind
an ``SPDX-License-Identifier:`` tag. Where the phrases of a tag stand among the words, a second automaton over
the lower-cased text finds the tags themselves. An expression (``and``, ``or``, ``with``, brackets) begins behind its tag and
ends with the line or where the grammar cannot go on: an operand behind an operand, a closing bracket
without an opening one, any other mark. It is put into postfix order by a shunting yard and evaluated to
alternatives: each a set of licenses that hold together.

Defined cases: a null text is empty and has no words; a broken expression gives the identifiers read
so far; an expression of more than ``MOST_ALTERNATIVES`` alternatives is told as it stands, not multiplied
out; repeated rows and null ids are scanned row by row.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ruleharbor.llm.common import per_text

# Phrases and labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NOTICES = {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "apache license version 2 0": "apache-2.0",
    "mozilla public license": "mpl",
    "mozilla public license version 2 0": "mpl-2.0",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by 4 0": "cc-by-4.0",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
SURE, NOTICED, NAMED = 0.95, 0.85, 0.6  # weight of a tag, of a versioned notice, of a base phrase
TAG = "spdx-license-identifier:"
TAG_WORDS = "spdx license identifier"
MOST_ALTERNATIVES = 4096  # an expression with more is not multiplied out
RANKS = {"or": 1, "and": 2, "with": 3}

_TABLE = bytes(
    i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else i + 32 if 65 <= i <= 90 else 32 for i in range(256))
_TOKEN = re.compile(r"[()]|[0-9A-Za-z.+:-]+")
_NEXT = re.compile(r"[ \t]*([()]|[0-9A-Za-z][0-9A-Za-z.+:-]*)")


def to_postfix(tokens: list[str]) -> list[str]:
    """The shunting yard: operators wait until one of lower rank or a bracket releases them."""
    out: list[str] = []
    waiting: list[str] = []
    for token in tokens:
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if waiting:
                waiting.pop()
        elif token in RANKS:
            while waiting and RANKS.get(waiting[-1], 0) >= RANKS[token]:
                out.append(waiting.pop())
            waiting.append(token)
        else:
            out.append(token)
    return out + [w for w in reversed(waiting) if w != "("]


def expression_at(text: str, at: int) -> list[str]:
    """The tokens, in lower case, of the expression that begins at a place of a text; dots that close it are left out."""
    out: list[str] = []
    depth, operand = 0, True  # whether an operand must come
    while (found := _NEXT.match(text, at)) is not None:
        token, at = found[1].lower(), found.end()
        name = token.rstrip(".:")
        if operand and token == "(" and (not out or out[-1] != "with"):
            depth += 1
        elif not operand and token == ")" and depth:
            depth -= 1
        elif not operand and token in RANKS:
            operand = True
        elif operand and token not in RANKS and name and token not in "()":
            token, operand = name, False
        else:
            break
        out.append(token)
        if name != found[1].lower() and token == name:  # a closing dot
            break
    return out


Alternatives = frozenset[frozenset[str]]


def evaluate(postfix: list[str]) -> Alternatives | None:
    """The alternatives of a license expression, None if there are too many; missing operands count as nothing asked for."""
    stack: list[Alternatives] = []
    nothing: Alternatives = frozenset([frozenset()])
    for token in postfix:
        if token not in RANKS:
            stack.append(frozenset([frozenset([token])]))
            continue
        right = stack.pop() if stack else nothing
        left = stack.pop() if stack else nothing
        if token == "or":
            stack.append(left | right)
        elif token == "and":
            if len(left) * len(right) > MOST_ALTERNATIVES:
                return None
            stack.append(frozenset(a | b for a in left for b in right))
        else:
            names = sorted({n for b in right for n in b})
            stack.append(frozenset(frozenset(f"{n} with {x}" for n in a for x in names or [""]) for a in left))
    out = stack.pop() if stack else nothing
    while stack:  # operands without an operator between them are alternatives
        out |= stack.pop()
    return out


def parse(expression: str) -> tuple[Alternatives | None, list[str]]:
    """The alternatives of an expression and the license identifiers it names."""
    return understood([t.lower() for t in _TOKEN.findall(expression)])


def understood(tokens: list[str]) -> tuple[Alternatives | None, list[str]]:
    names, exception = [], False
    for token in tokens:
        if token not in RANKS and token not in "()" and not exception:
            names.append(token)
        exception = token == "with"
    return evaluate(to_postfix(tokens)), sorted(set(names))


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG_WORDS}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


@lru_cache(maxsize=1)
def tags() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word(TAG, TAG)
    found.make_automaton()
    return found


def scan_text(text: bytes) -> tuple[int, int, int | None, int | None, str, str, float, str]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score and the expressions' alternatives."""
    words = text.translate(_TABLE).split()
    flat = f" {b' '.join(words).decode('latin-1')} "
    base, labels, starts = set(), set(), []
    doubt, at, seen, tagged = 1.0, 0, 0, False
    for end, phrase in automaton().iter(flat):
        start = end - len(phrase) - 1  # of the space before the phrase
        if phrase in BASE:
            if start < at:
                at = seen = 0
            seen += flat.count(" ", at, start)
            at = start
            starts.append(seen)
            base.add(BASE[phrase])
            doubt = min(doubt, 1 - NAMED)
        tagged = tagged or phrase == TAG_WORDS
        if phrase in NOTICES:
            labels.add(NOTICES[phrase])
            doubt = min(doubt, 1 - NOTICED)
    alternatives: list[str] = []
    if tagged:
        raw = text.decode("latin-1")
        for end, _ in tags().iter(text.lower().decode("latin-1")):
            tokens = expression_at(raw, end + 1)
            choices, names = understood(tokens)
            labels.update(names)
            alternatives += [" ".join(tokens)] if choices is None else sorted(" & ".join(sorted(c)) for c in choices if c)
            doubt = min(doubt, 1 - SURE) if names else doubt
    labels |= base
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), 1 - doubt, " | ".join(alternatives))


SHAPE = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
         "score double, alternatives string")
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())


def scan(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, the places and labels of licenses in its whole text, and a score in [0, 1]."""
    names = [part.split()[0] for part in SHAPE.split(", ")]

    def work(texts: list[bytes]) -> dict[str, pa.Array]:
        rows = [scan_text(t) for t in texts]
        return {n: pa.array([r[i] for r in rows], kind) for i, (n, kind) in enumerate(zip(names, _KINDS, strict=True))}

    return per_text(documents, work, SHAPE, ["doc_id"])
