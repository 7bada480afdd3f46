"""Reading numbers and dates out of cells and rule values."""

from __future__ import annotations

import calendar
import re
from datetime import datetime, timedelta
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"
# Year first, with or without a time; then day first, then month first.
DATE_SHAPE = r"^(\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}:\d{1,2})?|\d{1,2}/\d{1,2}/\d{4})$"
DATE_FORMATS = ("yyyy-M-d[['T'][ ]H:m:s]", "d/M/yyyy", "M/d/yyyy")
NOW_WORDS = ("NOW()", "NOW", "CURRENT_TIMESTAMP", "CURRENT_DATE")
# A dated base: ISO date, with or without a time of day.
BASE_SHAPE = re.compile(r"\s*['(]*\s*(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ](\d{1,2}):(\d{1,2}):(\d{1,2}))?(?![\d-])")
# One part of an offset; a sign may stand before it or before the word INTERVAL.
PART_SHAPE = re.compile(
    r"(?P<sign>[+-])?[\s']*(?:interval\b[\s']*(?P<inner>[+-])?\s*)?(?P<count>\d+)[\s']*"
    r"(?P<unit>second|minute|hour|day|week|month|year)s?\b", re.IGNORECASE)
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
MONTHS = {"month": 1, "year": 12}


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def as_number(col: Column, dtype: T.DataType) -> Column:
    """Double value of a cell; commas are ignored, anything unreadable is NULL."""
    if isinstance(dtype, T.NumericType):
        return col.cast("double")
    text = F.replace(col.cast("string"), F.lit(","), F.lit(""))
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def as_timestamp(col: Column, dtype: T.DataType) -> Column:
    """Timestamp of a cell: typed columns as they are, texts by the first fitting format."""
    if is_temporal(dtype):
        return col
    text = F.trim(col.cast("string"))
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]
    return F.when(text.rlike(DATE_SHAPE), F.coalesce(*tries)).cast("timestamp_ntz")


def parse_number(text: str | None) -> Decimal | None:
    """The exact number a rule value names; commas are ignored."""
    try:
        return None if text is None else Decimal(str(text).replace(",", "").strip())
    except InvalidOperation:
        return None


def number_literal(value: Decimal, dtype: T.DataType) -> Column:
    """A literal that compares exactly with a column of ``dtype``, of the column's own kind where it can be.

    Then the filter reaches the scan. Beyond 38 digits, and against binary fractions, it is a double.
    """
    if value.is_finite() and not isinstance(dtype, (T.FloatType, T.DoubleType)):
        if is_integral(dtype) and value == value.to_integral_value() and -(2**63) <= value < 2**63:
            return F.lit(int(value))
        places = max(0, -value.as_tuple().exponent)
        if places <= 38 and value.adjusted() + 1 + places <= 38:
            return F.lit(Decimal(f"{value:f}"))
    return F.lit(float(value))


def _shifted(moment: datetime, seconds: int, months: int) -> datetime:
    """Months first, with the day kept inside the month, then seconds."""
    year, month = divmod(moment.year * 12 + moment.month - 1 + months, 12)
    day = min(moment.day, calendar.monthrange(year, month + 1)[1])
    return moment.replace(year=year, month=month + 1, day=day) + timedelta(seconds=seconds)


def parse_threshold(text: str | None, as_of: datetime) -> datetime | None:
    """Point in time named by a rule value: ``[base] [offset part ..]``; None for anything else.

    The base is a date or, where none is written, ``as_of``; all parts of the offset add up. A part takes the
    sign next to it or before its ``INTERVAL``, else that of the part before; the first one is added by
    default. Points outside the years 1 to 9999 are none.
    """
    value = (text or "").strip()
    dated = BASE_SHAPE.match(value)
    rest = value[dated.end():] if dated else value
    parts = list(PART_SHAPE.finditer(rest))
    try:
        base = datetime(*(int(x or 0) for x in dated.groups())) if dated else as_of
        if not parts:
            named = value.upper() in NOW_WORDS or (dated is not None and not rest)
            return base if named else None
        sign, seconds, months = 1, 0, 0
        for part in parts:
            written = (part["sign"] or "") + (part["inner"] or "")
            sign = (-1 if "-" in written else 1) if written else sign
            unit = part["unit"].lower()
            seconds += sign * int(part["count"]) * SECONDS.get(unit, 0)
            months += sign * int(part["count"]) * MONTHS.get(unit, 0)
        return _shifted(base, seconds, months)
    except (OverflowError, ValueError):
        return None


def moment_literal(moment: datetime, dtype: T.DataType) -> Column:
    kind = "timestamp" if isinstance(dtype, T.TimestampType) else "timestamp_ntz"
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(kind)
