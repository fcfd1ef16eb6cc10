"""Dashboard panels: counts, percentiles over time and newest errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgauge.functions import events as E
from vitalgauge.operators.alerts import drop_rate_windows
from vitalgauge.operators.percentiles import percentile_aggregates


def panel_counts(rows: DataFrame) -> DataFrame:
    """Events, Java crashes and ANRs per app and environment."""
    return rows.groupBy("app_id", "environment").agg(
        F.count("*").alias("event_count"),
        F.expr(f"count_if({E.FAMILY} = 'JAVA_CRASH') AS java_crash_count"),
        F.expr(f"count_if({E.FAMILY} = 'ANR') AS anr_count"),
    )


def panel_drop_rate_p95(rows: DataFrame, width: str = "1 hour") -> DataFrame:
    """p95 of the reported drop rate per release and time window."""
    keys = ["app_id", "release_version", "window_start_ms"]
    return percentile_aggregates(drop_rate_windows(rows, width), keys, "rate", {"p95": 0.95})


def panel_startup_p90(rows: DataFrame, width: str = "1 hour") -> DataFrame:
    """p90 launch duration per start type and time window."""
    starts = rows.filter(
        "module = 'launch' AND name IN ('cold_start', 'warm_start', 'hot_start')"
    ).select(
        "app_id",
        "environment",
        F.col("name").alias("start_type"),
        F.unix_millis(
            F.window(F.timestamp_millis("occurrence_timestamp_ms"), width)["start"]
        ).alias("window_start_ms"),
        F.expr("try_element_at(nums, 'launchDurationMs') AS duration"),
    ).filter("duration IS NOT NULL")
    keys = ["app_id", "environment", "start_type", "window_start_ms"]
    return percentile_aggregates(starts, keys, "duration", {"p90": 0.9})


def panel_recent_errors(rows: DataFrame, limit: int = 100) -> DataFrame:
    """Newest ERROR and FATAL events."""
    return (
        rows.filter("severity IN ('ERROR', 'FATAL')")
        .orderBy(F.desc("occurrence_timestamp_ms"), F.desc("id"))
        .limit(limit)
        .selectExpr(
            "occurrence_timestamp_ms",
            "concat(module, '.', name) AS body",
            "severity",
            "event_id",
            f"if({E.BOUND}, app_version, NULL) AS service_version",
        )
    )
