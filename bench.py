"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Arguments, if any, name the queries to run instead of the headline ones.
"""

from __future__ import annotations

import json
import os
import sys
import time

from ruleharbor.plans.registry import QUERIES
from ruleharbor.session import build_session

HEADLINE = (
    "violations_per_rule", "scan_all", "scan_summary", "report_by_rule", "validation_sample", "compliance_score",
    "rule_complexity", "chunk_documents", "redact_documents", "verdict_parse", "query_context", "intent_class",
    "reuse_exact", "reuse_fuzzy", "reuse_semantic", "vector_topk_l2", "vector_topk_cosine", "policy_rerank",
    "final_decisions", "audit_stats",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.master": f"local[{cpus}]",
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "12g",
        # The tables are small and the work per row is not: keep all cores busy.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = build_session("bench", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        begun = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begun, 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
