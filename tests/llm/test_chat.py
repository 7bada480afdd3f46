import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from ruleharbor.llm import chat
from ruleharbor.llm.common import table

SHAPE = "conv_id long, turn long, role string, text string"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\\<#:\n/tlhcn é語", max_size=12), st.text(alphabet="ab\\<#:\n/turnlhc >é語", max_size=30))
def test_template_reads_back(role, text):
    turn, start, length = chat.formatted(role, text)
    assert chat.read_turn(turn) == (role, text)
    turn, start, length = chat.formatted("assistant", text)
    assert chat.unescape(turn[start:start + length]) == text
    assert turn.count("### ") == 1 and turn.count("</turn>") == 1


def rows_by_hand(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t if t is not None else -1, role or "", text or ""))
    out = []
    for c, turns in convs.items():
        turns.sort()
        told = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss),
                    hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat.formatted(r, x)[0]) for _, r, x in turns)))
    return sorted(out)


def branching(seed):
    """Conversations that share starts of many lengths, some equal, some the start of others."""
    rng, rows = random.Random(seed), []
    for c in range(70):
        n = rng.randrange(1, 8)
        rows += [(c, t, ("user", "assistant")[t % 2], "abc"[rng.randrange(2 if t else 1)] * (1 + t)) for t in range(n)]
    rows += [(100 + c, t, "user", f"turn {t}") for c in range(3) for t in range(30)]
    rows += [(200 + k, t, "user", f"turn {min(t, k)} {k if t > k else ''}") for k in range(12) for t in range(k + 2)]
    return rows


def test_read_back_and_stream(spark):
    rows = branching(4)
    nodes, paths = chat.tree(spark.createDataFrame(rows, SHAPE).repartition(5))
    assert sorted(map(tuple, chat.read_back(nodes, paths).collect())) == rows_by_hand(rows)
    found = nodes.collect()
    by_node = {bytes(n.node): n for n in found}
    prefixes, convs = set(), {}
    for c, _, role, text in rows:
        convs.setdefault(c, []).append((role, text))
    for turns in convs.values():
        prefixes |= {tuple(turns[:i + 1]) for i in range(len(turns))}
    assert len(found) == len(prefixes)  # shared turns once
    # The stream has no gaps, and each node stands behind its parent.
    order = sorted(found, key=lambda n: n.stream_start)
    at = 0
    for n in order:
        assert n.stream_start == at
        at += n.n_chars
    stream = "".join(n.formatted for n in order)
    open_path = []
    for n in order:  # depth first: the parent is on the path of the node emitted before
        while open_path and open_path[-1] != n.parent:
            open_path.pop()
        assert n.parent is None or open_path
        open_path.append(n.node)
    # Ancestors' intervals, the own tail so far and the node give exactly the conversation so far.
    for path in paths.collect():
        n = by_node[bytes(path.node)]
        text, up = n.formatted, n
        while up.parent is not None:
            up = by_node[bytes(up.parent)]
            text = up.formatted + text
        seen = "".join(stream[a.start:a.stop] for a in n.ancestors)
        tail = n.position + n.n_chars - len(seen)
        assert seen + stream[n.stream_start + n.n_chars - tail:n.stream_start + n.n_chars] == text
        assert n.position == len(text) - n.n_chars


@pytest.mark.parametrize("broken", ["n_chars", "stream_start", "tail_start", "position", "ancestors"])
def test_broken_places_and_intervals_are_not_read_back(spark, broken):
    rows = branching(4)
    nodes, paths = chat.tree(spark.createDataFrame(rows, SHAPE))
    assert sorted(map(tuple, chat.read_back(nodes, paths, block=7).collect())) == rows_by_hand(rows)
    later = F.transform("ancestors", lambda a: F.struct((a["start"] + 1).alias("start"), a["stop"].alias("stop")))
    wrong = chat.read_back(nodes.withColumn(broken, later if broken == "ancestors" else F.col(broken) + 1 + F.col("n_chars")), paths)
    try:
        assert sorted(map(tuple, wrong.collect())) != rows_by_hand(rows)
    except PythonException:
        pass


def test_query_by_hand(spark):
    from ruleharbor.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    said = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    assert sorted(map(tuple, QUERIES["op10_chat_tree"](spark, sf).collect())) == rows_by_hand(rows)


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (2, None, "user", "x"), (None, 0, "user", "y"),
            (3, 0, "user", "long " * 100_000), (4, 0, "", ""), (1, 1, "assistant", "a")]
    nodes, paths = chat.tree(spark.createDataFrame(rows, SHAPE))
    assert sorted(map(tuple, chat.read_back(nodes, paths).collect())) == rows_by_hand(rows)
    nodes, paths = chat.tree(spark.createDataFrame([], SHAPE))
    assert chat.read_back(nodes, paths).count() == 0 and nodes.count() == 0


def test_turns_alike_only_when_role_and_text_are_put_together_stay_apart(spark):
    rows = [(1, 0, "a\0b", "c"), (2, 0, "a", "b\0c"), (3, 0, "1:a", "b"), (4, 0, "1", ":ab")]
    nodes, paths = chat.tree(spark.createDataFrame(rows, SHAPE))
    assert nodes.count() == 4
    assert sorted(map(tuple, chat.read_back(nodes, paths).collect())) == rows_by_hand(rows)
