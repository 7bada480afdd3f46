"""Rule-based data compliance on Spark DataFrames.

Everything in this package builds DataFrames and Columns; Spark runs them.
"""

from ruleharbor.operators.predicates import Rule, register_evaluator
from ruleharbor.operators.scan import ScanResult, count_violations, scan
from ruleharbor.sources.tables import TableSpec, read_table, schema_catalog

__all__ = [
    "Rule",
    "ScanResult",
    "TableSpec",
    "count_violations",
    "read_table",
    "register_evaluator",
    "scan",
    "schema_catalog",
]
