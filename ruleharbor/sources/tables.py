"""Table sources and the schema catalogue."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleharbor.sources.local import small_frame

FILE_FORMATS = ("parquet", "orc", "csv", "json")
JDBC_DIALECTS = {"sqlite": "org.sqlite.JDBC", "postgresql": "org.postgresql.Driver"}

CATALOG_SCHEMA = (
    "table_name string, column_name string, position int, data_type string, nullable boolean, is_key boolean"
)


@dataclass(frozen=True)
class TableSpec:
    """Where a table lives and which columns identify a row (empty: no key)."""

    name: str
    location: str
    key: tuple[str, ...] = ()
    format: str = "parquet"
    options: Mapping[str, str] = field(default_factory=dict)


def jdbc_options(spec: TableSpec) -> dict[str, str]:
    """Reader options for a database table.

    ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` in
    ``spec.options`` split the read over the executors; the filter of a rule is sent
    to the database by Spark itself.
    """
    return {"url": spec.location, "driver": JDBC_DIALECTS[spec.format], "dbtable": spec.name, **spec.options}


def read_table(spark: SparkSession, spec: TableSpec) -> DataFrame:
    if spec.format in FILE_FORMATS:
        return spark.read.format(spec.format).options(**spec.options).load(spec.location)
    if spec.format in JDBC_DIALECTS:
        return spark.read.format("jdbc").options(**jdbc_options(spec)).load()
    raise ValueError(f"unsupported source type {spec.format!r} for table {spec.name!r}")


def schema_catalog(
    spark: SparkSession, tables: Mapping[str, DataFrame], keys: Mapping[str, tuple[str, ...]]
) -> DataFrame:
    """One row per (table, column). Reads schemas only, never rows."""
    rows = [
        (table, f.name, i + 1, f.dataType.simpleString(), f.nullable, f.name in keys.get(table, ()))
        for table, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return small_frame(spark, rows, CATALOG_SCHEMA)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, row_count), one counting pass per table."""
    counts = [df.agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
              for t, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def table_profile(catalog: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per table: number of columns, ordered key columns, row count."""
    per_table = catalog.groupBy("table_name").agg(
        F.count("*").alias("column_count"),
        F.array_sort(F.collect_list(F.when(F.col("is_key"), F.struct("position", "column_name")))).alias("k"),
    )
    return per_table.join(counts, "table_name", "left").select(
        "table_name", "column_count", F.col("k.column_name").alias("primary_key"), "row_count"
    )


def schema_stats(catalog: DataFrame, counts: DataFrame) -> DataFrame:
    """Number of tables, columns and rows, and the tables that lack a key."""
    per_table = catalog.groupBy("table_name").agg(
        F.count("*").alias("n"), F.bool_or("is_key").alias("keyed")
    ).join(counts, "table_name", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per_table.agg(
        F.count("*").alias("table_count"),
        total("n").alias("column_count"),
        total("row_count").alias("row_count"),
        F.array_sort(F.collect_list(F.when(~F.col("keyed"), F.col("table_name")))).alias("tables_without_key"),
    )
