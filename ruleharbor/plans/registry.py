"""All registered queries and their checking SQL."""

from ruleharbor.plans import gate_queries, report_queries, rule_queries, scan_queries, text_queries

_MODULES = (scan_queries, rule_queries, report_queries, text_queries, gate_queries)

QUERIES = {name: run for m in _MODULES for name, run in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
