"""Retention, backlog and export bookkeeping over the inbox."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgauge import constants as C
from vitalgauge.functions.metrics import ladder, lit
from vitalgauge.session import small_table

DAY_MS = 86_400_000
RETENTION_ACTOR = "worker:retention"


def select_expired_raw(
    inbox: DataFrame,
    jobs: DataFrame,
    now_ms: int,
    delivered_days: int = 7,
    dead_letter_days: int = 30,
) -> DataFrame:
    """Terminal rows past their retention whose symbolization is not pending."""
    unfinished = jobs.filter(
        F.col("job_status").isin(*C.UNFINISHED_SYMBOL_STATUSES)
    ).select(F.col("inbox_event_id").alias("id"))
    terminal = "coalesce(finalized_ms, delivered_ms, next_attempt_ms)"
    due = (
        f"raw_pruned_ms IS NULL AND ((inbox_status = 'delivered' AND {terminal} <="
        f" {now_ms - delivered_days * DAY_MS}) OR (inbox_status = 'dead_letter' AND {terminal} <="
        f" {now_ms - dead_letter_days * DAY_MS}))"
    )
    return inbox.filter(due).join(unfinished, "id", "left_anti")


def prune_raw_evidence(expired: DataFrame, now_ms: int) -> DataFrame:
    """Normalized rows without raw evidence: numeric and boolean indexed fields stay.

    Text fields become EXPIRED, only the presence of the scene survives. Write the result over the
    partitions of the input.
    """
    keep = "(k, v) -> array_contains(indexed_fields, k)"
    empty = "cast(map() AS map<string,string>)"
    replaced = {
        "retained_scene_state": f"if(coalesce(scene, '') <> '', '{C.EXPIRED}', '{C.MISSING}')",
        "scene": "cast(NULL AS string)",
        "process_name": "cast(NULL AS string)",
        "thread_name": "cast(NULL AS string)",
        "fields": empty,
        "field_types": empty,
        "ints": f"map_filter(ints, {keep})",
        "nums": f"map_filter(nums, {keep})",
        "bools": f"map_filter(bools, {keep})",
        "strs": empty,
        "field_states": "transform_values(field_states, (k, s) -> if(s = 'AVAILABLE' AND NOT"
        " (array_contains(indexed_fields, k) AND (map_contains_key(ints, k) OR"
        " map_contains_key(nums, k) OR map_contains_key(bools, k))), 'EXPIRED', s))",
        "indexed_fields": "filter(indexed_fields, k -> map_contains_key(ints, k) OR"
        " map_contains_key(nums, k) OR map_contains_key(bools, k))",
        "native_frames": "filter(native_frames, f -> false)",
        "raw_pruned_ms": f"cast({now_ms} AS bigint)",
        "payload_size_bytes": "cast(0 AS bigint)",
    }
    return expired.selectExpr(
        *[f"{replaced[c]} AS {c}" if c in replaced else c for c in expired.columns]
    )


def expire_rate_windows(windows: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Split quota windows into kept ones and those older than a day."""
    old = F.col("window_ms") < now_ms - DAY_MS
    return windows.filter(~old), windows.filter(old)


def prune_alert_history(
    episodes: DataFrame, deliveries: DataFrame, now_ms: int, days: int = 90
) -> tuple[DataFrame, DataFrame]:
    """Drop episodes resolved long ago and, with them, their deliveries; open ones stay."""
    gone = episodes.filter(F.col("resolved_ms") <= now_ms - days * DAY_MS)
    kept = episodes.filter(
        F.col("resolved_ms").isNull() | (F.col("resolved_ms") > now_ms - days * DAY_MS)
    )
    return kept, deliveries.join(gone.select("episode_id"), "episode_id", "left_anti")


def retention_audit(pruned: DataFrame, action: str = "inbox.raw.prune") -> DataFrame:
    """One audit row per tenant with its pruned count."""
    return pruned.groupBy("tenant_id").agg(F.count("*").alias("pruned_count")).selectExpr(
        "tenant_id",
        f"'{RETENTION_ACTOR}' AS actor",
        f"'{action}' AS action",
        "'retention_batch' AS object_type",
        "'success' AS result",
        "pruned_count",
    )


_DUE = (
    "(inbox_status = 'pending' AND next_attempt_ms <= {now})"
    " OR (inbox_status = 'processing' AND lease_expires_ms <= {now})"
)


def inbox_backlog(inbox: DataFrame, now_ms: int) -> DataFrame:
    """Rows, due rows and oldest due age per status; every known status has a row."""
    due = _DUE.format(now=now_ms)
    counts = inbox.groupBy("inbox_status").agg(
        F.count("*").alias("row_count"),
        F.expr(f"count_if({due}) AS due_count"),
        F.expr(f"min(if({due}, received_ms, NULL)) AS oldest_ms"),
    )
    spine = small_table(
        inbox.sparkSession, [(s,) for s in C.INBOX_STATES], "inbox_status string"
    )
    return spine.join(counts, "inbox_status", "left").selectExpr(
        "inbox_status",
        "coalesce(row_count, 0) AS row_count",
        "coalesce(due_count, 0) AS due_count",
        f"greatest(0, ({now_ms} - oldest_ms) / 1000D) AS oldest_due_seconds",
    )


def pipeline_status(inbox: DataFrame, jobs: DataFrame) -> DataFrame:
    """Inbox rows and symbolization jobs by status, for scoped ``inbox`` rows."""
    rows = inbox.groupBy(F.col("inbox_status").alias("status")).agg(
        F.count("*").alias("row_count")
    )
    scoped = jobs.join(
        inbox.select(F.col("id").alias("inbox_event_id")), "inbox_event_id", "left_semi"
    )
    symbol = scoped.groupBy(F.col("job_status").alias("status")).agg(
        F.count("*").alias("row_count")
    )
    return rows.select(F.lit("inbox").alias("pipeline"), "*").unionByName(
        symbol.select(F.lit("symbolization").alias("pipeline"), "*")
    )


def plan_export_signals(claimed: DataFrame, metrics: bool, traces: bool) -> DataFrame:
    """Freeze the required signals of a row when it is first claimed; later changes do not apply."""
    wanted = ["'logs', 'pending'"]
    wanted += ["'metrics', 'pending'"] if metrics else []
    wanted += ["'traces', 'pending'"] if traces else []
    return claimed.withColumn(
        "signal_states",
        F.expr(f"if(coalesce(size(signal_states), 0) > 0, signal_states, map({', '.join(wanted)}))"),
    )


def backoff_seconds(attempts: str, cap: int = 300) -> str:
    """SQL of the exponential retry delay."""
    return f"cast(least(pow(2, least({attempts}, 8)), {cap}) AS bigint)"


def retry_backoff(failures: DataFrame) -> DataFrame:
    """Add ``delay_seconds``: the server's Retry-After when given, else exponential."""
    return failures.withColumn(
        "delay_seconds",
        F.expr(f"coalesce(nullif(retry_after, 0), {backoff_seconds('attempt_count')})"),
    )


def finalize_export(claimed: DataFrame, now_ms: int, max_attempts: int = 10) -> DataFrame:
    """Roll per-signal states up to the row outcome.

    Delivered needs no pending and no failed signal. A pending signal retries while attempts are
    left; a row claimed beyond its budget is dead-lettered without another send.
    """
    states = "map_values(signal_states)"
    pending, failed = (f"array_contains({states}, '{s}')" for s in ("pending", "failed"))
    outcome = ladder(
        (f"attempt_count > {max_attempts} AND {pending}", lit("dead_letter")),
        (f"NOT {pending} AND NOT {failed}", lit("delivered")),
        (f"{pending} AND attempt_count < {max_attempts}", lit("retry")),
        otherwise=lit("dead_letter"),
    )
    delay = f"coalesce(nullif(retry_after, 0), {backoff_seconds('attempt_count')})"
    return claimed.withColumn("outcome", F.expr(outcome)).selectExpr(
        "*",
        "if(outcome = 'retry', 'pending', outcome) AS new_status",
        f"if(outcome = 'retry', NULL, {now_ms}) AS finalized_at_ms",
        f"if(outcome = 'delivered', NULL, {now_ms} + {delay} * 1000) AS next_attempt_at_ms",
    )
