"""Small frames made on the driver: rules, schema rows, pairs of rule and table."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def small_frame(spark: SparkSession, rows: Iterable[tuple], ddl: str) -> DataFrame:
    """A frame whose size the optimiser knows, so that it decides on a broadcast by itself."""
    schema = T.StructType.fromDDL(ddl)
    names = schema.names
    table = pa.Table.from_pylist(
        [dict(zip(names, row, strict=True)) for row in rows], schema=to_arrow_schema(schema)
    )
    return spark.createDataFrame(table, schema)
