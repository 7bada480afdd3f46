"""Chunking, tagging and redaction of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleharbor.functions import fixed_values as K
from ruleharbor.functions.expr import let
from ruleharbor.functions.pii import contains_any


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(K.EDGE_SPACE))


# --- chunks --------------------------------------------------------------------------


def _step_pattern(size: int, overlap: int, overlapping: bool) -> str:
    """Pattern that walks a text from the start of each chunk to the start of the next.

    A chunk is the rest of the text when that fits, else it ends behind the last ``.`` or
    line break past its half, else it is exactly ``size`` long.
    """
    rest = rf".{{1,{size}}}+\z"
    half, stride = size // 2, size - overlap
    if overlapping:
        return rf"(?s)\G(?:{rest}|.{{{half + 2 - overlap},{stride}}}(?=.{{{overlap - 1}}}[.\n])|.{{{stride}}})"
    late_cut = rf".{{{stride - 1},{size - 1}}}[.\n]"
    early_cut = rf".{{{half + 1},{stride - 2}}}[.\n]"
    return rf"(?s)\G(?:{rest}|{late_cut}|(?={early_cut}).{{{stride}}}|.{{{size}}})"


def chunk_spans(
    text: Column, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP, overlapping: bool = False
) -> Column:
    """Array of (content, start, end), end inclusive, in text order; blank chunks are left out.

    By default the overlap only bounds the step between chunks: the next chunk starts at the
    end of this one, but at least ``size - overlap`` further on, so neighbours never share
    text and an early cut leaves a gap. With ``overlapping`` neighbours share ``overlap``
    characters and nothing is skipped.
    """
    if not 0 < overlap <= size // 4:
        raise ValueError("the overlap must lie between 1 and a quarter of the chunk size")
    stride = size - overlap
    early_chunk = rf"(?s)\A.{{{size // 2 + 1},{stride - 2}}}[.\n]"

    def content_at(steps: Column, i: Column) -> Column:
        step, last = F.get(steps, i), i == F.size(steps) - 1
        if overlapping:
            return F.when(last, step).otherwise(F.concat(step, F.left(F.get(steps, i + 1), F.lit(overlap))))
        early = ~last & (F.length(step) == stride) & ~F.right(step, F.lit(1)).isin(".", "\n")
        return F.when(early, F.regexp_extract(step, early_chunk, 0)).otherwise(step)

    def spans(steps: Column) -> Column:
        starts = F.aggregate(
            steps,
            F.array(F.lit(0)),
            lambda acc, step: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(step))),
        )
        pieces = F.transform(
            F.arrays_zip(F.slice(starts, F.lit(1), F.size(steps)).alias("start"), steps.alias("step")),
            lambda z, i: F.struct(z["start"].alias("start"), content_at(steps, i).alias("piece")),
        )
        cut = F.transform(
            pieces,
            lambda p: F.struct(
                strip(p["piece"]).alias("content"),
                p["start"].alias("start"),
                (p["start"] + F.length(p["piece"]) - 1).alias("end"),
            ),
        )
        return F.filter(cut, lambda s: s["content"] != "")

    return let(F.regexp_extract_all(text, F.lit(_step_pattern(size, overlap, overlapping)), F.lit(0)), spans)


def chunk_documents(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    page_col: str | None = None,
    size: int = K.CHUNK_SIZE,
    overlap: int = K.CHUNK_OVERLAP,
    overlapping: bool = False,
    context: int | None = None,
) -> DataFrame:
    """One row per chunk, with its tags and, if asked, the text of its neighbours.

    Everything is worked out inside the document's own row: no shuffle.
    """
    spans = documents.withColumn("_spans", chunk_spans(F.col(text_col), size, overlap, overlapping))
    if context:
        # Worked out inside the array, so that no chunk row carries the chunks of its whole document.
        spans = spans.withColumn("_spans", F.transform("_spans", lambda s, i: F.struct(
            s["content"].alias("content"), s["start"].alias("start"), s["end"].alias("end"),
            neighbour_text(F.col("_spans"), i, context).alias("context"))))
    pages = [page_col] if page_col else []
    kept = [id_col, *pages]
    rows = spans.select(*kept, F.posexplode("_spans").alias("chunk_index", "c"))
    content = F.col("c.content")
    name = F.concat_ws("_", F.col(id_col).cast("string"), *[F.col(p).cast("string") for p in pages])
    out = rows.select(
        *kept,
        "chunk_index",
        content.alias("content"),
        F.col("c.start").alias("start_char"),
        F.col("c.end").alias("end_char"),
        chunk_id(name, F.col("chunk_index"), content).alias("chunk_id"),
        section_header(content).alias("section_header"),
        has_obligation(content).alias("has_obligation"),
        *([F.col("c.context").alias("context")] if context else []),
    )
    return out


def neighbour_text(spans: Column, index: Column, width: int) -> Column:
    """Contents of the chunks ``width`` around ``index``, joined by a blank line."""
    first = F.greatest(index - width, F.lit(0))
    near = F.slice(spans, first + 1, index + width - first + 1)
    return F.array_join(F.transform(near, lambda s: s["content"]), "\n\n")


def chunk_id(source: Column, index: Column, content: Column) -> Column:
    return F.concat_ws("_", source.cast("string"), index.cast("string"), F.substring(F.md5(content), 1, 8))


def citation(row_source: Column, row_chunk_id: Column, index: Column, start: Column, end: Column) -> Column:
    return F.struct(
        row_source.alias("source"),
        row_chunk_id.alias("chunk_id"),
        index.alias("chunk_index"),
        F.concat_ws("-", start.cast("string"), end.cast("string")).alias("char_range"),
    )


def section_header(content: Column) -> Column:
    """The header a chunk starts with: first fitting pattern, else NULL."""
    found = [F.regexp_extract(content, r"\A(?:" + p + ")", 0) for p in K.SECTION_PATTERNS]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found])


def has_obligation(content: Column) -> Column:
    return contains_any(F.lower(content), K.OBLIGATION_TERMS)


# --- guardrail -----------------------------------------------------------------------


def redact(text: Column) -> Column:
    """Social security numbers, 16-digit card numbers and e-mail addresses, in this order.

    The look at the first character spares the costlier word-boundary test at most places,
    and the address pattern runs only where there is an ``@``.
    """
    (ssn, ssn_mark), (card, card_mark), (mail, mail_mark) = K.REDACTIONS
    text = F.regexp_replace(text, r"(?U)(?=\d)" + ssn, ssn_mark)
    text = F.regexp_replace(text, r"(?U)(?=\d)" + card, card_mark)
    address = "(?U)(?=[A-Za-z0-9._%+-])" + mail.replace("]+@", "]++@")
    return let(text, lambda t: F.when(t.contains("@"), F.regexp_replace(t, address, mail_mark)).otherwise(t))


def guard_text(
    text: Column,
    min_chars: int = K.GUARD_MIN_CHARS,
    max_chars: int | None = None,
    redact_pii: bool = True,
) -> Column:
    """Stripped and redacted text, or NULL when shorter than ``min_chars``.

    ``max_chars`` cuts longer texts before redaction; by default they are kept whole.
    """

    def guarded(clean: Column) -> Column:
        kept = clean if max_chars is None else F.substring(clean, 1, max_chars)
        return F.when(F.length(clean) >= min_chars, redact(kept) if redact_pii else kept)

    return let(strip(text), guarded)


# --- texts made for embedding ----------------------------------------------------------


def embedding_text(content: Column, document_type: Column, rules: Column, entities: Column) -> Column:
    """Content, then type, rules and entities in brackets. NULL parts of a rule read ``None``."""
    word = lambda c: F.coalesce(c, F.lit("None"))
    rule_parts = F.transform(
        rules,
        lambda r: F.concat(
            F.lit("[Rule: "), word(r["rule_type"]), F.lit(" - "), word(r["action"]),
            F.lit(" when "), word(r["condition"]), F.lit("]"),
        ),
    )
    entity_parts = F.transform(
        F.filter(F.map_entries(entities), lambda e: F.size(e["value"]) > 0),
        lambda e: F.concat(F.lit("["), e["key"], F.lit(": "), F.array_join(e["value"], ", "), F.lit("]")),
    )
    kind = F.when(
        document_type != "informational", F.concat(F.lit("[Document Type: "), document_type, F.lit("]"))
    )
    empty = F.array().cast("array<string>")
    parts = F.concat(
        F.array_compact(F.array(content, kind)), F.coalesce(rule_parts, empty), F.coalesce(entity_parts, empty)
    )
    return F.array_join(parts, " ")


def policy_text(rule_text: Column, rule_type: Column, column: Column, operator: Column, value: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.format_string(
        "Compliance rule: %s. Type: %s. Column: %s. Operator: %s. Value: %s.",
        blank(rule_text), blank(rule_type), blank(column), blank(operator), F.coalesce(value, F.lit("None")),
    )


def concept_tags(text: Column, rule_type: Column) -> Column:
    """Concepts whose words occur in the text, plus the rule type; sorted, each once."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    tags = [F.when(contains_any(lower, words), F.lit(tag)) for tag, words in K.CONCEPT_WORDS.items()]
    own = F.when(F.coalesce(rule_type, F.lit("")) != "", F.replace(rule_type, F.lit("data_"), F.lit("")))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*tags, own))))


def high_confidence_rules(rules: Column, floor: float = K.HIGH_RULE_CONFIDENCE) -> Column:
    return F.filter(rules, lambda r: r["confidence"] >= floor)


def mask_credentials(text: Column) -> Column:
    return F.regexp_replace(text, r":[^:@]+@", ":***@")
