"""Exact decision reuse on streams by keyed state: stored decisions are held per key and expire by themselves.

Entries and requests are one stream, dealt by the hash of text and role. A key's state are its entries; a request takes
the last one born before it, if that one's own lifetime reaches it, just as in the batch (``reuse.exact_hits``): also if
entry or request came late, or the stream was restarted between them.

State lives in RocksDB and is given up in two ways. An entry whose end, by its own lifetime or because another one
replaced it, lies more than the slack before the latest event of its key is dropped when the key is met. A key that
is never met again loses its entries by time to live: an entry goes to the state variable of the shortest class of
``CLASSES`` that is no shorter than its lifetime, and stays there for that class and the slack. So no lifetime is cut
short as long as rows come at most the slack late; entries that outlive all classes are kept until they are replaced.

The session must name ``RocksDBStateStoreProvider`` as ``spark.sql.streaming.stateStore.providerClass``. Time to live keeps
a stream making batches; for a run over what is there (``availableNow``) set
``spark.sql.streaming.noDataMicroBatches.enabled`` to false.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CLASSES = (6 * 3600, 7 * 86_400, 90 * 86_400)  # seconds
SLACK_SECONDS = 7 * 86_400
_ENTRY = "entry_id string, decision string, born long, dies long"
_EVENT = "key string, query_id string, entry_id string, decision string, at long, dies long"
ANSWER = "query_id string, key string, at long, entry_id string, decision string"

Entry = tuple[str, str, int, int]


class Decisions(StatefulProcessor):
    """Answers the requests of a key from the entries it holds."""

    def __init__(self, slack_seconds: int = SLACK_SECONDS):
        self.slack = slack_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        spans = [*CLASSES, None]
        self.states = [
            handle.getListState(f"entries{i}", _ENTRY, None if s is None else s * 1000 + self.slack // 1000) for i, s in enumerate(spans)]

    def _state_of(self, entry: Entry) -> int:
        return next((i for i, s in enumerate(CLASSES) if entry[3] - entry[2] <= s * 1_000_000), len(CLASSES))

    def kept(self, entries: list[Entry], latest: int) -> list[Entry]:
        """Of entries in the order of their birth those that may still answer a request from ``latest`` less the slack.

        One that is over by itself stays until the one that replaces it ends all that was before.
        """
        ends = [after[2] for after in entries[1:]]
        out = [e for e, end in zip(entries, ends, strict=False) if end >= latest - self.slack]
        return out + [e for e in entries[-1:] if e[3] >= latest - self.slack or out]

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        events = list(rows)
        held = [tuple(r) for s in self.states for r in s.get()]
        new = [(r["entry_id"], r["decision"], r["at"], r["dies"]) for r in events if r["query_id"] is None]
        entries = sorted(dict.fromkeys([*held, *new]), key=lambda e: (e[2], e[0]))
        for r in events:
            if r["query_id"] is not None:
                last = next((e for e in reversed(entries) if e[2] < r["at"]), None)
                found = last if last is not None and r["at"] <= last[3] else (None, None)
                yield Row(query_id=r["query_id"], key=key[0], at=r["at"], entry_id=found[0], decision=found[1])
        kept = self.kept(entries, max(r["at"] for r in events))
        stay = set(kept)
        for i, state in enumerate(self.states):
            mine = [e for e in kept if self._state_of(e) == i]
            fresh = [e for e in mine if e in new and e not in held]
            if any(self._state_of(e) == i and e not in stay for e in held):
                # What stays is written anew; that only lengthens its time in the state.
                state.put(mine) if mine else state.clear()
            elif fresh:
                state.appendList(fresh)

    def close(self) -> None:
        pass


def exact_answers(requests: DataFrame, entries: DataFrame, slack_seconds: int = SLACK_SECONDS) -> DataFrame:
    """The stored entry that answers each request of a stream, a row per request (``ANSWER``; no entry: NULL).

    ``requests`` are a stream of query_id, key and ts, ``entries`` one of entry_id, key, decision, created_at and
    ttl_seconds. In one batch entries count for all requests after their birth, wherever they stand in it.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    none = F.lit(None).cast("string")
    asked = requests.select(F.col("key"), F.col("query_id").cast("string").alias("query_id"), none.alias("entry_id"), none.alias("decision"),
                            micros("ts").alias("at"), F.lit(None).cast("long").alias("dies"))
    born = micros("created_at")
    stored = entries.select(F.col("key"), none.alias("query_id"), F.col("entry_id").cast("string").alias("entry_id"), "decision", born.alias("at"),
                            (born + F.col("ttl_seconds").cast("long") * 1_000_000).alias("dies"))
    return asked.unionByName(stored).groupBy("key").transformWithState(
        Decisions(slack_seconds), ANSWER, "Append", "ProcessingTime")
