import pytest
from pyspark.sql import functions as F

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 40_000

ODD_ROWS = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
    (2, "the quick  brown\tfox jumps over the\n\nlazy dog", "en", "a", None),
    (2, "the quick  brown\tfox jumps over the\n\nlazy dog", "en", "a", None),
    (3, "", None, None, 0),
    (4, None, None, "", None),
    (5, " \t\n", "de", "b", 3),
    (None, "a text without an id stands here", "en", None, 5),
    (None, "a text without an id stands here", "en", None, 5),
    (6, LONG, "fr", "b", len(LONG)),
    (7, "größe ist schön und Übel <tag> ### \\", "de", "b", 7),
]


@pytest.fixture
def odd(spark):
    """Documents with nulls, empty, blank and very long texts, repeated rows, and extra columns of awkward names."""
    rows = spark.createDataFrame(ODD_ROWS, SHAPE)
    return rows.withColumns({"hash": F.lit("x"), "content": F.lit(1), "score": F.lit(None).cast("double"),
                             "kept": F.lit(True), "fp": F.lit(3), "root": F.lit("r"), "steps": F.lit(2)})


@pytest.fixture
def none(odd):
    return odd.where("false")
