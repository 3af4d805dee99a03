"""Runs the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from siltworks import queries as engine
from siltworks.session import session

HEADLINE = ("corpus_scan_by_source", "finding_lines", "redact_documents", "severity_histogram", "file_score", "latency_stats", "sliding_rate", "sessions", "asof_view_to_action", "feedback_accuracy", "topk_per_group", "interval_overlap", "quality_gate", "priority_score", "report_csv", "builtin_rules", "infra_findings", "confidence_parts", "false_positives", "custom_matches", "version_scopes", "circuit_breaker", "resolved_findings")


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session("bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            engine.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "sum of best-of-two wall seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
