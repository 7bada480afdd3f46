"""Nearly equal texts by an index of segments: pairs that cannot match are never compared.

Two texts of edit distance ``D`` share pieces: of any ``m`` pieces one is cut into, at least ``m - D`` stand
unchanged in the other, moved by at most ``D`` places. A stored text is cut into ``SPREAD`` times ``D + 1``
segments, where ``D`` is the most that the ratio allows for its length class, and is posted under the
``D + 1`` rarest of them (two sets that share ``m - D`` of ``m`` cannot miss each other there). Segments
that a whole family of texts has in common are so left out, and their long lists are never read.

An asked text probes the segment places of its own and the neighbouring length classes, moved by up to
``D``. A hit must leave enough edits for what stands before and behind it; what remains is compared by a
Levenshtein distance that stops beyond the allowed number. A probe costs about ``2 * SPREAD * D * D`` rows
for each class, so the cost of a text grows with the square of its length and not with the number of stored
texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPREAD = 3
SPARE = 1e-9


def near_enough(a: Column, b: Column, ratio: float) -> Column:
    """Whether 1 - distance / longer length reaches ``ratio``; counting stops beyond the allowed distance."""
    longest = F.greatest(F.length(a), F.length(b))
    allowed = F.ceil(longest * F.lit(1 - ratio)).cast("int")
    distance = F.call_function("levenshtein", a, b, allowed)
    return (a == b) | ((distance >= 0) & (1.0 - distance / longest >= ratio))


def _width(ratio: float) -> float:
    """Length classes on a log scale: lengths of two matching texts lie in one class or in neighbouring ones."""
    return -math.log(ratio - 0.001)


def length_class(text: Column, ratio: float) -> Column:
    return F.floor(F.log(F.greatest(F.length(text), F.lit(1)).cast("double")) / F.lit(_width(ratio))).cast("int")


def layout(step: Column, ratio: float, spread: int = SPREAD) -> dict[str, Column]:
    """How texts of a length class are cut: ``edits`` (D), ``parts`` (m) and the ``size`` of a segment.

    ``parts`` is 0 for classes too short for the ratio: their texts meet all others of neighbouring classes. With
    the default ratio there are none.
    """
    shortest = F.greatest(F.lit(1), F.floor(F.exp(step * F.lit(_width(ratio))) + F.lit(SPARE)))
    longest = F.floor(F.exp((step + 1) * F.lit(_width(ratio)))) + 1
    edits = F.floor(longest * F.lit((1 - ratio) / ratio) + F.lit(SPARE))
    parts = F.when(shortest > edits, F.least(shortest, spread * (edits + 1))).otherwise(0)
    size = F.when(parts > 0, F.floor(shortest / F.greatest(parts, F.lit(1)))).otherwise(0)
    return {"edits": edits.cast("int"), "parts": parts.cast("int"), "size": size.cast("int")}


def _posting(group: str, number: Column, piece: Column) -> Column:
    return F.xxhash64(F.col(group), F.col("step"), number, piece)


def segment_index(stored: DataFrame, ratio: float, spread: int = SPREAD) -> DataFrame:
    """Postings (group, step, posting, key, length) of ``stored`` (group, key, text): the rarest segments of each text."""
    own = stored.withColumn("step", length_class(F.col("text"), ratio))
    own = own.withColumns(layout(F.col("step"), ratio, spread)).withColumn("length", F.length("text"))
    piece = F.substring(F.col("text"), F.col("number") * F.col("size") + 1, F.col("size"))
    cut = own.withColumn("number", F.explode(F.sequence(F.lit(0), F.greatest(F.col("parts") - 1, F.lit(0))))).select(
        "group", "key", "step", "length", "edits", _posting("group", F.col("number"), piece).alias("posting"))
    among = cut.groupBy("posting").agg(F.count(F.lit(1)).alias("among"))
    ranked = cut.join(among, "posting").groupBy("group", "key", "step", "length", "edits").agg(
        F.sort_array(F.collect_list(F.struct("among", "posting"))).alias("postings"))
    return ranked.withColumn("posting", F.explode(F.slice("postings", F.lit(1), F.col("edits") + 1))).select(
        "group", "step", F.col("posting.posting").alias("posting"), "key", "length")


def probes(asked: DataFrame, classes: DataFrame, ratio: float, spread: int = SPREAD) -> DataFrame:
    """Segments of ``asked`` (group, id, text) at the places of the stored ``classes`` (group, step), moved by up to D.

    Columns posting, id, long (the length of the text) and moved.
    """
    own = length_class(F.col("text"), ratio)
    rows = asked.withColumn("step", F.explode(F.array(own - 1, own, own + 1))).join(classes, ["group", "step"])
    rows = rows.withColumns(layout(F.col("step"), ratio, spread)).withColumn(
        "number", F.explode(F.sequence(F.lit(0), F.greatest(F.col("parts") - 1, F.lit(0)))))
    place = F.col("number") * F.col("size")
    first = F.greatest(F.lit(0), place - F.col("edits"))
    around = F.substring(F.col("text"), F.col("first") + 1, place + F.col("edits") + F.col("size") - F.col("first"))
    # An empty text is its only segment.
    room = F.when(F.length("text") == 0, 0).otherwise(F.length("around") - F.col("size"))
    rows = rows.withColumn("first", first).withColumn("around", around)
    found = F.when(F.col("parts") == 0, F.array(F.struct(_posting("group", F.lit(0), F.lit("")).alias("posting"), F.lit(None).cast("int").alias("moved")))).when(
        room >= 0, F.transform(F.sequence(F.lit(0), F.greatest(room, F.lit(0))), lambda j: F.struct(
            _posting("group", F.col("number"), F.substring(F.col("around"), j + 1, F.col("size"))).alias("posting"),
            (F.col("first") + j - place).alias("moved"))))
    return rows.select("id", F.length("text").alias("long"), F.explode(found).alias("p")).select(
        "p.posting", "id", "long", "p.moved")


def candidates(asked: DataFrame, stored: DataFrame, ratio: float, spread: int = SPREAD) -> DataFrame:
    """(id, key): the pairs that the index cannot rule out, each once."""
    index = segment_index(stored, ratio, spread)
    classes = stored.select("group", length_class(F.col("text"), ratio).alias("step")).distinct()
    behind = F.col("long") - F.col("length") - F.col("moved")
    allowed = F.greatest("long", "length") * F.lit(1 - ratio) + F.lit(SPARE)
    fits = (F.abs("moved") + F.abs(behind) <= allowed) | F.col("moved").isNull()
    return probes(asked, classes, ratio, spread).join(index.select("posting", "key", "length"), "posting").where(fits).select(
        "id", "key").distinct()


def near_texts(asked: DataFrame, stored: DataFrame, ratio: float, spread: int = SPREAD) -> DataFrame:
    """(group, text, key): the stored keys of the same group whose text is nearly equal to an asked text.

    ``asked`` holds group and text, ``stored`` group, key and text; a key names one text. Rows without group or text match nothing.
    """
    asked = asked.where("group IS NOT NULL AND text IS NOT NULL").select("group", "text").distinct()
    stored = stored.where("group IS NOT NULL AND text IS NOT NULL").select("group", "key", "text").distinct()
    # Asked texts that share an id by chance are told apart by the comparison of the texts themselves.
    asked = asked.withColumn("id", F.xxhash64("group", "text"))
    near = candidates(asked, stored, ratio, spread)
    other = stored.select(F.col("group").alias("other_group"), "key", F.col("text").alias("other"))
    return near.join(asked, "id").join(other, "key").where(
        (F.col("group") == F.col("other_group")) & near_enough(F.col("text"), F.col("other"), ratio)).select("group", "text", "key")
