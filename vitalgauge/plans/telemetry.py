"""Telemetry view of the shared ``events`` table.

Every column is one SQL expression that means the same in Spark SQL and in DuckDB, so the
registered queries and their SQL counterparts start from identical rows. The only engine-specific
expressions are reading ``props`` and turning the timestamp into epoch milliseconds.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgauge.operators.normalize import normalize_fields
from vitalgauge.operators.scope import Scope

SCOPE = Scope("tenant-a", "com.example", "production")
FROM_MS = 1_704_412_800_000  # 2024-01-05
TO_MS = 1_706_140_800_000  # 2024-01-25
NEW, BASE = "2.0.0", "1.0.0"
NOW_MS = 1_706_832_000_000  # 2024-02-02, evaluation instant of retention and alert reports
DAY_MS = 86_400_000

SPARK_BASE = (
    "event_id AS id",
    "user_id",
    "event_type",
    "cast(get_json_object(props, '$.k') AS int) AS k",
    "unix_millis(cast(ts AS timestamp)) AS occurrence_timestamp_ms",
    "cast(round(value * 100) AS bigint) AS v100",
)
DUCK_BASE = (
    "event_id AS id",
    "user_id",
    "event_type",
    "cast(json_extract_string(props, '$.k') AS int) AS k",
    "epoch_us(ts) // 1000 AS occurrence_timestamp_ms",
    "cast(round(value * 100) AS bigint) AS v100",
)

# Layer 1: scalar columns of the inbox row.
COLUMNS = {
    "id": "id",
    "k": "k",
    "user_id": "user_id",
    "v100": "v100",
    "occurrence_timestamp_ms": "occurrence_timestamp_ms",
    "received_ms": "occurrence_timestamp_ms + k * 20000",
    "event_id": "'e' || cast(id AS string)",
    "tenant_id": "CASE WHEN user_id % 2 = 0 THEN 'tenant-a' ELSE 'tenant-b' END",
    "app_id": "'com.example'",
    "environment": "'production'",
    "app_version": "CASE WHEN user_id % 5 IN (0, 1) THEN '1.0.0'"
    " WHEN user_id % 5 IN (2, 3) THEN '2.0.0' ELSE '3.0.0' END",
    "release_identity_quality": "CASE WHEN id % 20 = 0 THEN 'BATCH_DECLARED'"
    " ELSE 'OCCURRENCE_BOUND' END",
    "installation_hmac": "CASE WHEN id % 33 <> 0 THEN 'inst-' || cast(user_id AS string) END",
    "installation_hmac_key_version": "CASE WHEN id % 33 = 0 THEN NULL"
    " WHEN user_id % 5 = 4 AND occurrence_timestamp_ms >= 1705276800000 THEN 'v2' ELSE 'v1' END",
    "installation_identity_quality": "CASE WHEN id % 33 = 0 THEN 'ABSENT'"
    " WHEN id % 20 = 0 THEN 'BATCH_DECLARED' ELSE 'OCCURRENCE_BOUND' END",
    "session_hmac": "CASE WHEN id % 29 <> 0 THEN 'sess-' || cast(user_id AS string) || '-' ||"
    " cast(cast(floor(occurrence_timestamp_ms / 86400000e0) AS bigint) AS string) END",
    "session_hmac_key_version": "CASE WHEN id % 29 = 0 THEN NULL WHEN user_id % 5 = 4"
    " AND occurrence_timestamp_ms >= 1705276800000 THEN 'v2' ELSE 'v1' END",
    "session_identity_quality": "CASE WHEN id % 29 = 0 THEN 'ABSENT' ELSE 'OCCURRENCE_BOUND' END",
    "module": "CASE event_type WHEN 'error' THEN CASE WHEN k % 4 = 1 THEN 'anr' ELSE 'crash' END"
    " WHEN 'click' THEN 'network' WHEN 'view' THEN 'launch' WHEN 'purchase' THEN 'fps'"
    " ELSE 'core' END",
    "name": "CASE event_type WHEN 'error' THEN CASE k % 4 WHEN 0 THEN 'java_crash'"
    " WHEN 1 THEN 'anr_detected' WHEN 2 THEN 'native_crash' ELSE 'tombstone_crash' END"
    " WHEN 'click' THEN 'network_request'"
    " WHEN 'view' THEN CASE k % 3 WHEN 0 THEN 'cold_start' WHEN 1 THEN 'warm_start'"
    " ELSE 'hot_start' END"
    " WHEN 'purchase' THEN 'fps_stats'"
    " ELSE CASE WHEN k % 3 = 0 THEN 'session_start' ELSE 'sdk_health' END END",
    "incident_fingerprint": "CASE WHEN event_type = 'error' AND k % 7 <> 0 THEN"
    " 'fp-' || cast(k % 4 AS string) || '-' || cast(k % 10 AS string) END",
    "raw_incident_fingerprint": "CASE WHEN event_type = 'error' AND k % 7 <> 0 THEN"
    " 'raw-' || cast(k % 4 AS string) || '-' || cast(k % 5 AS string) END",
    "inbox_status": "CASE id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing'"
    " WHEN 2 THEN 'dead_letter' ELSE 'delivered' END",
    "scene": "CASE WHEN k % 9 <> 0 THEN 'Scene' || cast(k % 6 AS string) END",
    "value_state": "CASE WHEN k % 11 = 0 THEN 'MISSING' WHEN k % 13 = 0 THEN 'INVALID'"
    " ELSE 'AVAILABLE' END",
    "device_model": "CASE WHEN k % 8 <> 0 THEN 'model-' || cast(user_id % 7 AS string) END",
    "os_version": "CASE WHEN k % 8 <> 1 THEN 'os-' || cast(user_id % 4 AS string) END",
    "schema_version": "CASE WHEN id % 20 = 0 THEN '2' ELSE '3' END",
    "protocol": "CASE WHEN id % 20 = 0 THEN 'protobuf_envelope_v2' ELSE 'protobuf_envelope_v3' END",
    "sdk_version": "'1.' || cast(user_id % 3 AS string)",
    "version_code": "cast(user_id % 5 + 10 AS string)",
    "app_build": "'b' || cast(user_id % 5 AS string)",
    "variant": "CASE WHEN k % 31 = 0 THEN NULL ELSE 'release' END",
    "kind": "CASE WHEN event_type = 'error' THEN 'ALERT' ELSE 'METRIC' END",
    "severity": "CASE WHEN event_type <> 'error' THEN 'INFO' WHEN k % 2 = 0 THEN 'FATAL'"
    " ELSE 'ERROR' END",
    "priority": "CASE WHEN event_type = 'error' THEN 'CRITICAL' ELSE 'NORMAL' END",
    "process_name": "'com.example' || CASE WHEN k % 5 = 0 THEN ':push' ELSE '' END",
    "thread_name": "CASE WHEN k % 2 = 0 THEN 'main' ELSE 'worker-' || cast(k % 4 AS string) END",
    "payload_size_bytes": "cast(100 + k AS bigint)",
    "attempt_count": "k % 10",
    "raw_pruned_ms": "CASE WHEN id % 5 = 4 AND k % 6 = 0 THEN occurrence_timestamp_ms + 700000000 END",
    "retained_scene_state": "CASE WHEN id % 5 = 4 AND k % 12 = 0 THEN 'EXPIRED'"
    " WHEN id % 5 = 4 AND k % 18 = 6 THEN 'MISSING' END",
    "finalized_ms": "CASE WHEN id % 5 IN (2, 3, 4) AND k % 3 <> 0"
    " THEN occurrence_timestamp_ms + 3600000 END",
    "delivered_ms": "CASE WHEN id % 5 IN (3, 4) AND k % 2 = 0"
    " THEN occurrence_timestamp_ms + 3700000 END",
    "next_attempt_ms": "occurrence_timestamp_ms + k * 60000",
    "lease_expires_ms": "CASE WHEN id % 5 = 1 THEN occurrence_timestamp_ms + k * 90000 END",
}

# Columns stored as the sha256 of their text.
HASHED = ("incident_fingerprint", "raw_incident_fingerprint")

# Layer 2: raw sender fields as text; a null means the sender did not send the field.
FIELD_TEXT = {
    "launchDurationMs": "CASE WHEN module = 'launch' THEN {dur} END",
    "isColdStart": "CASE WHEN module = 'launch' AND k % 5 <> 1 THEN CASE WHEN k % 5 = 0 THEN 'yes'"
    " WHEN name = 'cold_start' THEN 'true' ELSE 'false' END END",
    "phaseContentProviderCount": "CASE WHEN name = 'cold_start' THEN CASE WHEN k % 17 = 0"
    " THEN '1.5' ELSE cast(k % 8 AS string) END END",
    "durationMs": "CASE WHEN module IN ('network', 'anr') THEN {dur} END",
    "statusCode": "CASE WHEN module = 'network' THEN CASE k % 7 WHEN 0 THEN '-1' WHEN 1 THEN '0'"
    " WHEN 2 THEN '500' ELSE '200' END END",
    "fps": "CASE WHEN module = 'fps' THEN cast(k % 61 AS string) END",
    "windowDurationMs": "CASE WHEN module = 'fps' THEN {dur} END",
    "frameCount": "CASE WHEN module = 'fps' THEN cast(k + 20 AS string) END",
    "jankCount": "CASE WHEN module = 'fps' THEN cast(k % 30 AS string) END",
    "dropSeverity": "CASE WHEN module = 'fps' AND k % 19 <> 0 THEN cast(k % 5 AS string) END",
    "emitCount": "CASE WHEN name = 'sdk_health' THEN cast(k * 10 AS string) END",
    "dropCount": "CASE WHEN name = 'sdk_health' THEN CASE WHEN k % 10 = 0 THEN '3' ELSE '0' END END",
    "dropRate": "CASE WHEN name = 'sdk_health' THEN CASE WHEN k % 10 = 0"
    " THEN '0.0' || cast(k % 7 AS string) ELSE '0.0' END END",
    "dispatcherStage.resolve.count": "CASE WHEN name = 'sdk_health' THEN cast(k % 3 AS string) END",
    "dispatcherStage.resolve.avgMicros": "CASE WHEN name = 'sdk_health' THEN {dur} END",
    "session_schema_version": "CASE WHEN name = 'session_start' THEN '1' END",
    "session_count": "CASE WHEN name = 'session_start' THEN CASE WHEN k % 9 = 0 THEN '2'"
    " ELSE '1' END END",
    "stackTrace": "CASE WHEN name = 'java_crash' AND k % 12 <> 0 THEN 'java.lang.Error: boom' ||"
    " chr(10) || '  at com.example.A.m' || cast(k % 10 AS string) || '(A.java:' ||"
    " cast(k AS string) || ')' || chr(13) || chr(10) || chr(10) ||"
    " ' at 0x7f00ab' || cast(k + 10 AS string) || ' (B.java:1)' END",
    "threadName": "CASE WHEN name = 'java_crash' THEN 'main' END",
    "mainThreadStack": "CASE WHEN name = 'anr_detected' AND k % 8 < 5 THEN"
    " 'at android.os.Looper.loop(Looper.java:' || cast(k AS string) || ')' END",
    "stackSamples": "CASE WHEN name = 'anr_detected' THEN CASE WHEN k % 8 = 5 THEN '' ELSE"
    " 'sample' || cast(k % 3 AS string) END END",
    "backtrace": "CASE WHEN name IN ('native_crash', 'tombstone_crash') AND k % 14 <> 0 THEN"
    " '#00 pc 000000000004A' || cast(k % 6 AS string) || 'f0  /system/lib64/libc.so (abort+12)' ||"
    " chr(10) || 'note' || chr(10) || '#01 pc 00b' || cast(k % 3 AS string) ||"
    " '  C:\\lib\\libapp.so' END",
    "signal": "CASE WHEN name IN ('native_crash', 'tombstone_crash') THEN"
    " CASE WHEN k % 4 = 2 THEN '11' ELSE '6' END END",
    "custom": "CASE WHEN k % 4 = 0 THEN 'x' END",
}
_DUR = (
    "CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN '-1' ELSE cast(v100 AS string) END"
)


def field_sql(name: str) -> str:
    """SQL text of one raw field, for use in the comparison queries."""
    return FIELD_TEXT[name].replace("{dur}", _DUR)


def _spark_literal(expression: str) -> str:
    """Spark SQL string literals treat a backslash as an escape; DuckDB's do not."""
    return expression.replace("\\", "\\\\")


def _spark_column(name: str, sql: str) -> Column:
    column = F.expr(_spark_literal(sql))
    return F.sha2(column, 256) if name in HASHED else column


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared events table.

    A table with fewer splits than cores (one small file) is spread by event id so that the mapping
    runs on all of them; a table with more splits is read as it is, without a shuffle.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cores = spark.sparkContext.defaultParallelism
    return events.repartition(cores, "event_id") if _splits(events) < cores else events


def _splits(df: DataFrame) -> int:
    return df.rdd.getNumPartitions()


def map_events(events: DataFrame) -> DataFrame:
    """Inbox rows with raw sender fields in a ``fields`` map, from batch or streaming events."""
    base = events.selectExpr(*SPARK_BASE)
    rows = base.select(*[_spark_column(name, sql).alias(name) for name, sql in COLUMNS.items()])
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("key"), F.expr(_spark_literal(field_sql(name))).alias("value")
            )
            for name in FIELD_TEXT
        ]
    )
    return rows.withColumn(
        "fields", F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    ).withColumn("field_types", F.lit(None).cast("map<string,string>"))


@lru_cache(maxsize=8)
def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapped table (the plan object is kept, no data)."""
    return map_events(raw_events(spark, sf_dir))


@lru_cache(maxsize=8)
def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inbox rows with normalized fields (``ints``, ``nums``, ``bools``, ``strs``, states)."""
    return normalize_fields(telemetry(spark, sf_dir), timestamp="occurrence_timestamp_ms")


def duck_cte(*fields: str, extra: str = "") -> str:
    """``WITH t AS (...)``: the mapped rows, plus the named raw fields as ``f_...`` columns."""
    columns = ", ".join(
        f"{f'sha256({sql})' if name in HASHED else sql} AS {name}" for name, sql in COLUMNS.items()
    )
    raw = "".join(
        f", {field_sql(name)} AS f_{name.replace('.', '_')}" for name in fields
    )
    return (
        f"WITH base AS (SELECT {', '.join(DUCK_BASE)} FROM events), "
        f"t0 AS (SELECT {columns} FROM base), t AS (SELECT *{raw} FROM t0)"
        + (f", {extra}" if extra else "")
    )


WINDOW_SQL = (
    "tenant_id = 'tenant-a' AND app_id = 'com.example' AND environment = 'production'"
    f" AND occurrence_timestamp_ms >= {FROM_MS} AND occurrence_timestamp_ms < {TO_MS}"
)
