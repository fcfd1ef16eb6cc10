"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from vitalgauge.plans import load  # noqa: E402
from vitalgauge.session import build_session  # noqa: E402

HEADLINES = (
    "scope_window_filter",
    "window_facts",
    "release_counts",
    "release_health",
    "release_incident_trend",
    "top_fingerprints",
    "issue_distribution",
    "data_quality",
    "normalize_fields",
    "fingerprint_java_anr",
    "percentile_linear",
    "performance_report",
    "metric_trend",
    "weighted_fps",
    "category_distribution",
    "classify_span_relations",
    "summarize_traces",
    "alert_rule_state",
    "alert_episodes",
    "rolling_incident_alert",
    "validate_events",
    "canonical_payload_hash",
    "pseudonymize_ids",
    "dedup_events",
    "detect_event_conflicts",
    "admit_quota",
    "read_line_batches",
    "read_protobuf_batches",
    "select_expired_raw",
    "match_native_artifacts",
    "otlp_logs",
    "otlp_metrics",
    "panel_startup_p90",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load.queries()
    wanted = sys.argv[1:] or HEADLINES

    def run(name: str) -> float:
        start = time.perf_counter()
        # The sink evaluates every column of every row and keeps nothing.
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("release_counts")
    timings = {name: round(run(name), 3) for name in wanted}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
