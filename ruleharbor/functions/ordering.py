"""First-row-per-key selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_rows(
    df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int, rank_col: str = "rank"
) -> DataFrame:
    """The first ``n`` rows per key, numbered from 1 in ``rank_col``.

    Spark limits each group inside the map tasks before it shuffles
    (``WindowGroupLimit``), so a hot key sends at most ``n`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def first_row(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    return top_rows(df, keys, order, 1, "_first").drop("_first")
