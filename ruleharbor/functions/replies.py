"""Reading JSON out of model replies and stored records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleharbor.functions import fixed_values as K
from ruleharbor.functions.expr import let

VERDICT_SCHEMA = (
    "decision string, reasoning string, cited_policies array<string>, sensitive_columns array<string>, "
    "required_controls array<string>, confidence double"
)


def json_object_text(reply: Column) -> Column:
    """Text from the first ``{`` to the last ``}`` once code fences are gone, or NULL."""
    bare = F.regexp_replace(reply, r"```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def unfenced(reply: Column) -> Column:
    return F.btrim(
        F.regexp_replace(F.regexp_replace(reply, r"```json\s*", ""), r"```\s*", ""), F.lit(K.EDGE_SPACE)
    )


def parse_object(text: Column, schema: str) -> Column:
    """Struct of a JSON object, NULL when the text is no valid JSON object."""
    valid = F.get_json_object(text, "$").isNotNull() & F.ltrim(text).startswith("{")
    return F.when(valid, F.from_json(text, schema))


def parse_verdict(reply: Column, max_chars: int | None = None) -> Column:
    """Normalised verdict. Unknown decisions block; an unreadable reply blocks and asks for manual review.

    ``max_chars`` bounds what the reasoning quotes of an unreadable reply; by default all of it.
    """
    none = F.array().cast("array<string>")

    def normalised(v: Column, text: Column) -> Column:
        decision = F.btrim(F.upper(v["decision"]), F.lit(K.EDGE_SPACE))
        parsed = F.struct(
            F.when(decision.isin("APPROVE", "BLOCK"), decision).otherwise("BLOCK").alias("decision"),
            F.coalesce(v["reasoning"], F.lit("")).alias("reasoning"),
            F.coalesce(v["cited_policies"], none).alias("cited_policies"),
            F.coalesce(v["sensitive_columns"], none).alias("sensitive_columns"),
            F.coalesce(v["required_controls"], none).alias("required_controls"),
            F.coalesce(v["confidence"], F.lit(0.7)).alias("confidence"),
        )
        fallback = F.struct(
            F.lit("BLOCK").alias("decision"),
            F.concat(
                F.lit("Verdict generation failed: Unparseable LLM response: "),
                text if max_chars is None else F.substring(text, 1, max_chars),
                F.lit(". Blocking by default for safety."),
            ).alias("reasoning"),
            none.alias("cited_policies"),
            none.alias("sensitive_columns"),
            F.array(F.lit("manual_review")).alias("required_controls"),
            F.lit(0.0).alias("confidence"),
        )
        return F.when(v.isNotNull(), parsed).otherwise(fallback)

    return let(
        unfenced(reply),
        lambda text: let(parse_object(text, VERDICT_SCHEMA), lambda v: normalised(v, text)),
    )


def record_entries(record: Column, n: int) -> Column:
    """The first ``n`` (key, value) pairs of a JSON record, in text order."""
    return F.slice(F.map_entries(F.from_json(record, "map<string,string>")), 1, n)


def column_value(record: Column, key_names: tuple[str, ...] = ("id", "rowid")) -> Column:
    """First value of a JSON record that is not the key and not null."""
    entries = F.filter(
        F.map_entries(F.from_json(record, "map<string,string>")),
        lambda e: ~F.lower(e["key"]).isin(*key_names) & e["value"].isNotNull(),
    )
    return F.get(entries, F.lit(0))["value"]


def clean_steps(text: Column) -> Column:
    """List of texts from a JSON list or a plain text; blank gives an empty list."""
    listed = F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>"))
    single = F.when(F.btrim(text, F.lit(K.EDGE_SPACE)) != "", F.array(text))
    return F.coalesce(listed, single, F.array().cast("array<string>"))


def join_letters(steps: Column) -> Column:
    """Repair a list that was split into single letters."""
    letters = (F.size(steps) > 0) & F.forall(steps, lambda s: F.length(s) <= 1)
    return F.when(letters, clean_steps(F.array_join(steps, ""))).otherwise(steps)
