"""Expression helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once per row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """``value`` as a column that a later filter cannot work out a second time.

    A filter moves below a projection together with a copy of the expression it tests, but
    not below a generator.
    """
    return F.explode(F.array(value))
