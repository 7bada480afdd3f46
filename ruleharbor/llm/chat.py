"""Chat formatting into prefix trees.

Conversations that begin with the same turns share these turns: a node of the tree is a sequence of
turns from the start, known by a digest chained over them, and its text is emitted once. Every
conversation *owns* the nodes for which it has the smallest id; they are the tail of its path and stand
together in the stream. Tails hang on the tail of a smaller conversation, and the order "own tail first,
then tails from the deepest branching upwards" is a depth-first walk. A node carries its place in the
stream, its position (the length of the path before it, where position ids start) and the stream intervals
of its ancestors in other tails, which its tokens attend to besides their own tail so far. Tokens are
characters (code points).

The template of a turn is ``### role:`` and a line feed, the text, ``</turn>`` and a line feed. In texts and
roles ``\\``, ``<`` and ``#`` are written ``\\\\``, ``\\l`` and ``\\h`` (in roles also ``:`` and the line feed as ``\\c`` and
``\\n``), so no control string can stand inside them and reading back is exact. The loss mask is the text
of assistant turns.

At scale: turns are sorted by conversation within partitions and streamed, never collected; nodes are
pre-aggregated groups, so a first turn that a third of all conversations share is one row per task;
branches are joined by doubling, in rounds that grow with the logarithm of the branching depth; stream
places are running sums over range partitions.

Defined cases: a null text or role is empty; rows without conversation belong to none and are left out;
turns of equal number are ordered by role and text and all kept; equal conversations share all nodes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ruleharbor.llm.common import cut

ASSISTANT = "assistant"
BLOCK = 4096  # characters of the stream that are looked up together
_OUT = {"\\": "\\\\", "<": "\\l", "#": "\\h", ":": "\\c", "\n": "\\n"}
_BACK = {v[1]: k for k, v in _OUT.items()}
_TEXT, _ROLE = re.compile(r"[\\<#]"), re.compile(r"[\\<#:\n]")
_TURN = re.compile(r"### ([^:]*):\n([^<#]*)</turn>\n")


def escape(text: str) -> str:
    return _TEXT.sub(lambda m: _OUT[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """The turn by the template, and start and length of its loss mask in it."""
    head, body = f"### {_ROLE.sub(lambda m: _OUT[m[0]], role)}:\n", escape(text)
    return f"{head}{body}</turn>\n", len(head), len(body) if role == ASSISTANT else 0


def read_turn(turn: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    found = _TURN.fullmatch(turn)
    if found is None:
        raise ValueError("not a formatted turn")
    return unescape(found[1]), unescape(found[2])


_TURN_SHAPE = ("conv_id long, depth long, node binary, parent binary, formatted string, position long, n_chars long, "
               "loss_start long, loss_chars long")
_TURN_KINDS = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())


def _batch(rows: list[tuple], kinds: tuple, shape: str) -> pa.RecordBatch:
    names = [part.split()[0] for part in shape.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the turns of sorted conversations and chains the digests of their prefixes."""
    conv, depth, node, position = None, 0, None, 0
    for batch in batches:
        rows = []
        for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
            if c != conv:
                conv, depth, node, position = c, 0, None, 0
            out, start, loss = formatted(role, text)
            digest = blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16, key=node or b"").digest()
            rows.append((c, depth, digest, node, out, position, len(out), start, loss))
            depth, node, position = depth + 1, digest, position + len(out)
        yield _batch(rows, _TURN_KINDS, _TURN_SHAPE)


def turns(conversations: DataFrame) -> DataFrame:
    """Every turn of every conversation with the node it leads to."""
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select(
        "conv_id", "role", "text").mapInArrow(_chain, _TURN_SHAPE)


def _owned(narrow: DataFrame) -> DataFrame:
    """Every node once, with the smallest conversation that passes it."""
    return narrow.groupBy("node").agg(
        F.min("conv_id").alias("owner"), F.first("parent").alias("parent"), F.first("depth").alias("depth"),
        F.first("position").alias("position"), F.first("n_chars").alias("n_chars"))


def _tails(owned: DataFrame) -> DataFrame:
    """Per owning conversation: its chain of tails from the root (start depth, owner, position), and its length."""
    tails = owned.groupBy("owner").agg(
        F.min("depth").alias("depth"), F.min("position").alias("position"), F.sum("n_chars").alias("n_chars"),
        F.min_by("parent", "depth").alias("parent"))
    above = owned.select(F.col("node").alias("parent"), F.col("owner").alias("next"))
    hung = tails.join(above, "parent", "left")
    state = cut(hung.select("owner", "n_chars", "next", F.array(
        F.struct("depth", "owner", "position")).alias("chain")))
    while not state.where("next is not null").isEmpty():
        upper = state.select(F.col("owner").alias("next"), F.col("chain").alias("before"), F.col("next").alias("after"))
        state = cut(state.join(upper, "next", "left").select(
            "owner", "n_chars", F.col("after").alias("next"),
            F.concat(F.coalesce("before", F.array().cast(state.schema["chain"].dataType)), "chain").alias("chain")))
    return state.drop("next")


def _placed(tails: DataFrame) -> DataFrame:
    """Adds each tail's start in the stream: running sums within range partitions and over their totals."""
    key = F.transform("chain", lambda x: F.struct((-x["depth"]).alias("up"), x["owner"].alias("owner")))
    parts = int(tails.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(tails.withColumn("key", key).repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("n_chars").alias("total"))  # as many rows as partitions
    offsets = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("offset"))
    return ranged.withColumn("within", F.coalesce(F.sum("n_chars").over(before), F.lit(0))).join(offsets, "part").select(
        "owner", "chain", (F.col("within") + F.col("offset")).alias("tail_start"))


def tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, paths): the stream of nodes, each once, and the node of every turn of every conversation."""
    all_turns = turns(conversations)
    narrow = cut(all_turns.select("conv_id", "depth", "node", "parent", "position", "n_chars"))
    owned = cut(_owned(narrow))
    placed = cut(_placed(_tails(owned)))
    links = placed.select("owner", F.posexplode(F.transform(
        F.slice("chain", 1, F.size("chain") - 1), lambda x, i: F.struct(
            x["owner"].alias("at"), (F.element_at("chain", i + 2)["position"] - x["position"]).alias("length")))).alias(
        "level", "link")).select("owner", "level", "link.at", "link.length")
    starts = placed.select(F.col("owner").alias("at"), F.col("tail_start").alias("start"))
    spans = links.join(starts, "at").groupBy("owner").agg(F.array_sort(F.collect_list(
        F.struct("level", "start", (F.col("start") + F.col("length")).alias("stop")))).alias("spans"))
    ancestors = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))
    tails = placed.join(spans, "owner", "left").select(
        "owner", "tail_start", F.element_at("chain", -1)["position"].alias("tail_position"),
        F.coalesce(ancestors, F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("ancestors"))
    # The owner's turn stands for the node: an equal join on both keys, which no shared turn makes uneven.
    once = all_turns.withColumnRenamed("conv_id", "owner").join(owned.select("node", "owner"), ["node", "owner"])
    nodes = once.join(tails, "owner").withColumn(
        "stream_start", F.col("tail_start") + F.col("position") - F.col("tail_position")).drop("tail_position")
    return nodes, narrow.select("conv_id", "depth", "node")


READ_SHAPE = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long")
_READ_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads conversations back from the turns that their intervals hold, in order, a turn at a time."""
    conv = None
    for batch in batches:
        rows = []
        columns = (batch.column(n).to_pylist() for n in ("conv_id", "position", "formatted", "loss_start", "loss_chars"))
        for c, position, turn, start, length in zip(*columns, strict=True):
            if c != conv:
                if conv is not None:
                    rows.append((conv, n, told.hexdigest(), loss, learned.hexdigest(), chars))
                conv, n, loss, chars, told, learned = c, 0, 0, 0, sha256(), sha256()
            if position != chars:
                raise ValueError(f"conversation {c}: position {position} stands behind {chars} characters")
            role, text = read_turn(turn)
            masked = unescape(turn[start:start + length])
            told.update(f"{role}\n{text}\n".encode())
            learned.update(masked.encode())
            n, loss, chars = n + 1, loss + len(masked), chars + len(turn)
        yield _batch(rows, _READ_KINDS, READ_SHAPE)
    if conv is not None:
        yield _batch([(conv, n, told.hexdigest(), loss, learned.hexdigest(), chars)], _READ_KINDS, READ_SHAPE)


def intervals(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Per conversation the stream intervals that its last turn attends to and stands in: conv_id, level, start, stop."""
    last = paths.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    own = F.struct(F.col("tail_start").alias("start"), (F.col("stream_start") + F.col("n_chars")).alias("stop"))
    ends = last.join(nodes.select("node", F.concat("ancestors", F.array(own)).alias("spans")), "node")
    return ends.select("conv_id", F.posexplode("spans").alias("level", "span")).select("conv_id", "level", "span.start", "span.stop")


def read_back(nodes: DataFrame, paths: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per conversation what the stream says at the intervals of its last turn: turns, digests, loss text and length.

    Nothing else is read: a node's text is found by its place in the stream, in blocks of ``block`` characters, and its
    position id must be the length of what was read before.
    """
    nodes = cut(nodes)
    spans = intervals(nodes, paths).withColumn("block", F.explode(F.sequence(
        F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))))
    stream = nodes.select(F.floor(F.col("stream_start") / block).alias("block"), "stream_start", "position", "formatted", "loss_start", "loss_chars")
    found = spans.join(stream, "block").where((F.col("stream_start") >= F.col("start")) & (F.col("stream_start") < F.col("stop")))
    return found.repartition("conv_id").sortWithinPartitions("conv_id", "level", "stream_start").select(
        "conv_id", "position", "formatted", "loss_start", "loss_chars").mapInArrow(_read, READ_SHAPE)


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and number -7, whose texts hold a control string and an escape."""
    said = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                "role", "text").unionByName(probe)
