"""Source divergence audit: how far the word use of the sources of a language lies apart.

1. *Duplicate-text collapse.* Identical texts of a language become one row with the number of copies that
   each source holds. Only counts and one text per digest (SHA-256) move.
2. *Counting.* Each such text is cut into terms once. Its term counts enter every source times the source's
   copies, and so do the document frequencies. Tasks add up before they pass rows on, so a term that
   every document holds is a row per task.
3. *Kept terms* of a language stand in at least ``LEAST_DOCUMENTS`` of its documents. A kept term has one
   row with its profile: the sources that hold it and its count in each. Every share is smoothed,
   ``p = 1 + floor(1e9 (count + 1) / (N + V))``, and ``f(p, q) = floor((p - q)^2 / q)`` measures a term.
4. *Sparse pair evaluation.* A term that neither source holds adds the same number for the whole pair. A
   term of one source depends on its count alone, so a histogram of counts stands for all of them. Only
   terms that both sources hold are met pair by pair.

All arithmetic is on whole numbers. Sources and languages are compared as they are written.

Defined cases: null text, language or source is the empty string; a text without terms counts as a document
of its group and holds nothing; a group without kept terms has shares by smoothing alone; a language
without kept terms gives pairs of value 0 and no terms; repeated rows and repeated ids are documents of
their own; ties rank by the bytes of the item; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleharbor.llm.common import bytes_of, cut, sliced, small

LEAST_DOCUMENTS = 3
UNIT = 1_000_000_000
WIDE = 9_000_000_000
MOST_TERMS = 200  # ranks of the report on terms
PIECE = 1 << 22  # bytes of a long text that are cut into terms at a time
HELD = 400_000  # entries that a task adds up before it passes them on
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")


def terms_of(text: bytes) -> Iterator[bytes]:
    """Runs of letters of the alphabet and of characters beyond it, only A-Z lower-cased."""
    for start in range(0, len(text), PIECE):
        # A piece begins behind the run that crosses its border and ends with the last one that begins in it.
        at = _TERM.match(text, start).end() if start and _TERM.match(text, start - 1, start) and _TERM.match(text, start) else start
        end = min(start + PIECE, len(text))
        if at < end:
            last = _TERM.match(text, end) if _TERM.match(text, end - 1, end) else None
            yield from _TERM.findall(text[at:last.end() if last else end].lower())


def collapsed(documents: DataFrame) -> DataFrame:
    """Per language and text: lang, text and ``sources``, how many rows of each source hold the text."""
    rows = documents.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    copies = rows.groupBy("lang", "digest", "source").agg(F.count(F.lit(1)).alias("n")).groupBy("lang", "digest").agg(
        F.collect_list(F.struct("source", "n")).alias("sources"))
    return rows.groupBy("lang", "digest").agg(F.first("text").alias("text")).join(copies, ["lang", "digest"]).select(
        "lang", "text", "sources")


_COUNTED = "lang string, term binary, sources array<struct<source:string,n:bigint,documents:bigint>>"


def _counter(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per language and term the counts and document frequencies of its sources, passed on when a task holds over ``most``."""
    entry = pa.struct([("source", pa.string()), ("n", pa.int64()), ("documents", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang in dict.fromkeys(lang for lang, _ in held):
                names: dict[str, int] = {}
                columns: list[list] = [[], [], [], []]  # term, number of the source, n, documents
                for (own, sources), (counts, documents) in held.items():
                    for source, copies in sources if own == lang else ():
                        columns[0] += counts
                        columns[1] += [names.setdefault(source, len(names))] * len(counts)
                        columns[2] += [copies * n for n in counts.values()]
                        columns[3] += [copies * documents[t] for t in counts]
                number: dict[bytes, int] = {}
                at = np.array([number.setdefault(t, len(number)) for t in columns[0]], np.int64)
                order = np.argsort(at, kind="stable")
                offsets = pa.array(np.r_[0, np.cumsum(np.bincount(at))] if len(at) else [0], pa.int32())
                source = pa.DictionaryArray.from_arrays(pa.array(np.array(columns[1], np.int64)[order]), pa.array(list(names), pa.string()))
                cells = pa.StructArray.from_arrays(
                    [source.dictionary_decode(), *(pa.array(np.array(c, np.int64)[order]) for c in columns[2:])], fields=list(entry))
                terms = pa.array(list(number), pa.binary())
                table = pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(terms), pa.string()), terms, pa.ListArray.from_arrays(offsets, cells)], names=["lang", "term", "sources"])
                yield from (table.slice(i, 10_000) for i in range(0, table.num_rows, 10_000))
            held.clear()

        for batch in batches:
            for part in sliced([batch]):
                columns = (part.column(c).to_pylist() for c in ("lang", "sources"))
                for text, lang, sources in zip(bytes_of(part.column("text")), *columns, strict=True):
                    terms = list(terms_of(text)) if len(text) <= PIECE else Counter(terms_of(text))
                    key = (lang, tuple(sorted((s["source"], s["n"]) for s in sources)))
                    counts, documents = held.setdefault(key, (Counter(), Counter()))
                    counts.update(terms)
                    documents.update(set(terms))
                if sum(len(c) for c, _ in held.values()) > most:
                    yield from told()
        yield from told()

    return count


def profiles(documents: DataFrame) -> DataFrame:
    """Per language and kept term: lang, term, n (in the language) and profile, the sources' counts in order."""
    # A row per term and task: a term that every document holds is as many rows as there are tasks.
    counted = collapsed(documents).mapInArrow(_counter(HELD), _COUNTED).repartition("lang", "term")
    each = counted.select("lang", "term", F.inline("sources"))
    by_source = each.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    return by_source.groupBy("lang", "term").agg(
        F.sum("documents").alias("documents"), F.sum("n").alias("n"),
        F.sort_array(F.collect_list(F.struct("source", "n"))).alias("profile")).where(
        F.col("documents") >= LEAST_DOCUMENTS).select("lang", F.col("term").cast("string").alias("term"), "n", "profile")


def share(count: Column, total: Column, terms: Column) -> Column:
    """The smoothed share of a count, in billionths and one more; longs hold the product up to ``WIDE``."""
    exact = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), (total + terms).cast("decimal(20,0)"))
    fast = F.call_function("div", F.lit(UNIT).cast("long") * (count + 1), total + terms)
    return F.lit(1).cast("long") + F.when(count < WIDE, fast).otherwise(exact)


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _groups(documents: DataFrame, kept: DataFrame) -> DataFrame:
    """Per language and source: total (N) and held (terms) of the source, terms (V) and whole (N) of the language."""
    told = kept.select("lang", F.explode("profile").alias("g")).groupBy("lang", F.col("g.source").alias("source")).agg(
        F.sum("g.n").alias("total"), F.count(F.lit(1)).alias("held"))
    languages = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("whole"))
    occurring = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    return occurring.join(told, ["lang", "source"], "left").join(languages, "lang", "left").na.fill(0)


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Value of every ordered pair of sources of a language: lang, source, item, value."""
    def side(name: str) -> DataFrame:
        # The share of a term that the source does not hold; no kept term, no share.
        none = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms")))
        return groups.select("lang", F.col("terms").alias("v"), F.col("source").alias(f"{name}"), F.col("total").alias(f"{name}_total"),
                             F.col("held").alias(f"{name}_held"), none.alias(f"{name}_none"))

    ours, theirs = side("s"), side("t")
    counts = kept.select("lang", F.explode("profile").alias("g")).groupBy(
        "lang", F.col("g.source").alias("source"), F.col("g.n").alias("n")).agg(F.count(F.lit(1)).alias("terms"))
    other = F.col("s") != F.col("t")
    no = F.lit(0).cast("long")

    one = counts.withColumnsRenamed({"source": "s", "terms": "many"}).join(small(ours), ["lang", "s"]).join(
        small(theirs.drop("v")), "lang").where(other).select(
        "lang", "s", "t", (F.col("many") * distance(share(F.col("n"), F.col("s_total"), F.col("v")), F.col("t_none"))).alias("value"),
        no.alias("both"))
    two = counts.withColumnsRenamed({"source": "t", "terms": "many"}).join(small(theirs), ["lang", "t"]).join(
        small(ours.drop("v")), "lang").where(other).select(
        "lang", "s", "t", (F.col("many") * distance(F.col("s_none"), share(F.col("n"), F.col("t_total"), F.col("v")))).alias("value"),
        no.alias("both"))
    met = kept.where(F.size("profile") > 1).select("lang", "profile", F.explode("profile").alias("x")).select(
        "lang", "x", F.explode("profile").alias("y")).select(
        "lang", F.col("x.source").alias("s"), F.col("y.source").alias("t"), F.col("x.n").alias("s_n"), F.col("y.n").alias("t_n")).where(other)
    p, q = share(F.col("s_n"), F.col("s_total"), F.col("v")), share(F.col("t_n"), F.col("t_total"), F.col("v"))
    shared = met.join(small(ours), ["lang", "s"]).join(small(theirs.drop("v")), ["lang", "t"]).select(
        "lang", "s", "t", (distance(p, q) - distance(p, F.col("t_none")) - distance(F.col("s_none"), q)).alias("value"),
        F.lit(1).cast("long").alias("both"))
    found = one.union(two).union(shared).groupBy("lang", "s", "t").agg(F.sum("value").alias("value"), F.sum("both").alias("both"))
    every = ours.join(small(theirs.drop("v")), "lang").where(other).join(found, ["lang", "s", "t"], "left")
    neither = F.col("v") - F.col("s_held") - F.col("t_held") + F.coalesce("both", no)
    rest = F.coalesce(neither * distance(F.col("s_none"), F.col("t_none")), no)
    return every.select("lang", F.col("s").alias("source"), F.col("t").alias("item"),
                        (F.coalesce("value", no) + rest).alias("value"))


def _terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Terms that a source holds more often than its language: lang, source, item, value."""
    rows = kept.select("lang", "term", F.col("n").alias("among"), F.explode("profile").alias("g")).select(
        "lang", "term", "among", F.col("g.source").alias("source"), F.col("g.n").alias("n"))
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("among"), F.col("whole"), F.col("terms"))
    return rows.join(small(groups), ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select(
        "lang", "source", "item", distance(F.col("p"), F.col("q")).alias("value"))


def audit(documents: DataFrame, most_terms: int = MOST_TERMS) -> DataFrame:
    """Per language and source: the other sources by distance, and the terms that set it apart.

    Columns lang, source, part (``pair`` or ``term``), item (source or term), value and rank.
    """
    kept = cut(profiles(documents))
    groups = cut(_groups(documents, kept))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(kept, groups).withColumn("rank", F.row_number().over(order))
    terms = _terms(kept, groups).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms)
    shape = ("item", "value", F.col("rank").cast("int").alias("rank"))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), *shape).union(
        terms.select("lang", "source", F.lit("term").alias("part"), *shape))
