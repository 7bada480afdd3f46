"""Personal data recognised by column name."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleharbor.functions.fixed_values import PII_CATEGORY_PARTS, PII_NAME_PARTS, PII_NAMES


def contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


# The one definition of a personal column name, read by Spark and on the driver alike.
PII_NAME_PATTERN = f"^(?:{'|'.join(map(re.escape, PII_NAMES))})$|{'|'.join(map(re.escape, PII_NAME_PARTS))}"


def is_pii(name: Column) -> Column:
    return F.translate(F.lower(name), " ", "_").rlike(PII_NAME_PATTERN)


def names_personal_data(names: Iterable[str]) -> bool:
    """Whether a schema has a column that ``is_pii`` holds for."""
    shape = re.compile(PII_NAME_PATTERN)
    return any(shape.search("_".join(n.lower().split(" "))) for n in names)


def pii_categories(name: Column) -> Column:
    plain = F.lower(name)
    return F.array_compact(F.array(*[
        F.when(contains_any(plain, parts), F.lit(category)) for category, parts in PII_CATEGORY_PARTS.items()
    ]))


def classification(pii: Column) -> Column:
    return F.when(pii, F.lit("confidential")).otherwise(F.lit("internal"))
