"""Scan, filter and page queries over the telemetry rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from vitalgauge.operators import scope as S
from vitalgauge.plans import telemetry as T
from vitalgauge.plans.registry import query

CURSOR = (1_705_500_000_000, 5_000)
FINGERPRINT = hashlib.sha256(b"fp-0-4").hexdigest()


def window(df):
    return S.scope_window_filter(df, T.SCOPE, T.FROM_MS, T.TO_MS)


BUCKET = S.bucket_width(T.FROM_MS, T.TO_MS)
LATE_SQL = "received_ms - occurrence_timestamp_ms > 900000"
SCENE_SQL = (
    "CASE WHEN raw_pruned_ms IS NOT NULL THEN CASE WHEN retained_scene_state IN ('EXPIRED',"
    " 'MISSING') THEN retained_scene_state ELSE 'RETENTION_UNKNOWN' END"
    " WHEN coalesce(scene, '') <> '' THEN 'AVAILABLE' ELSE 'MISSING' END"
)
FAMILY_SQL = (
    "CASE WHEN module = 'crash' AND name = 'java_crash' THEN 'JAVA_CRASH'"
    " WHEN module = 'crash' AND name = 'native_crash' THEN 'NATIVE_CRASH'"
    " WHEN module = 'crash' AND name = 'tombstone_crash' THEN 'NATIVE_TOMBSTONE'"
    " WHEN module = 'anr' AND name = 'anr_detected' THEN 'ANR'"
    " WHEN module = 'crash' AND name = 'app_exit' THEN 'APP_EXIT'"
    " WHEN module = 'core' AND name = 'sdk_health' THEN 'SDK_HEALTH'"
    " WHEN module = 'core' AND name = 'session_start' THEN 'SESSION_START'"
    " ELSE 'UNREGISTERED' END"
)
SESSION_START_SQL = (
    "coalesce(name = 'session_start' AND f_session_schema_version = '1'"
    " AND f_session_count = '1', FALSE)"
)
# emitCount and dropCount are canonical integers and dropRate a plain decimal in the mapping.
SDK_FIELDS = ("emitCount", "dropCount", "dropRate", "session_schema_version", "session_count")
SDK_VALID_SQL = (
    "coalesce(cast(f_emitCount AS bigint) > 0 AND cast(f_dropCount AS bigint) >= 0"
    " AND cast(f_dropRate AS double) BETWEEN 0 AND 1, FALSE)"
)
SDK_DROPPED_SQL = (
    "(coalesce(cast(f_dropCount AS bigint) > 0, FALSE)"
    " OR coalesce(cast(f_dropRate AS double) > 0, FALSE))"
)


@query(
    "scope_window_filter",
    T.duck_cte() + f" SELECT id, event_id, app_version, module, name, occurrence_timestamp_ms"
    f" FROM t WHERE {T.WINDOW_SQL}",
)
def _(spark, sf):
    return window(T.telemetry(spark, sf)).select(
        "id", "event_id", "app_version", "module", "name", "occurrence_timestamp_ms"
    )


@query(
    "release_filter",
    T.duck_cte() + f" SELECT id, app_version, incident_fingerprint FROM t WHERE {T.WINDOW_SQL}"
    " AND app_version IN ('2.0.0', '1.0.0') AND incident_fingerprint = sha256('fp-0-4')",
)
def _(spark, sf):
    return S.release_filter(
        window(T.telemetry(spark, sf)), T.NEW, T.BASE, fingerprint=FINGERPRINT
    ).select("id", "app_version", "incident_fingerprint")


@query(
    "time_bucket",
    T.duck_cte() + f" SELECT bucket, {T.FROM_MS} + bucket * {BUCKET} AS bucket_start_ms,"
    f" least({T.FROM_MS} + (bucket + 1) * {BUCKET}, {T.TO_MS}) AS bucket_end_ms,"
    " count(*) AS event_count FROM (SELECT"
    f" (occurrence_timestamp_ms - {T.FROM_MS}) // {BUCKET} AS bucket FROM t"
    f" WHERE {T.WINDOW_SQL}) GROUP BY bucket",
)
def _(spark, sf):
    rows = S.time_bucket(window(T.telemetry(spark, sf)), T.FROM_MS, T.TO_MS)
    return rows.groupBy("bucket", "bucket_start_ms", "bucket_end_ms").agg(
        F.count("*").alias("event_count")
    )


@query(
    "late_flag",
    T.duck_cte() + f" SELECT id, received_ms - occurrence_timestamp_ms AS delay_ms,"
    f" {LATE_SQL} AS late FROM t WHERE {T.WINDOW_SQL}",
)
def _(spark, sf):
    return S.late_flag(window(T.telemetry(spark, sf))).select(
        "id", (F.col("received_ms") - F.col("occurrence_timestamp_ms")).alias("delay_ms"), "late"
    )


@query(
    "scene_state",
    T.duck_cte() + " SELECT id, CASE WHEN raw_pruned_ms IS NULL THEN scene END AS visible_scene,"
    f" {SCENE_SQL} AS scene_state FROM t WHERE {T.WINDOW_SQL}",
)
def _(spark, sf):
    return S.scene_evidence(window(T.telemetry(spark, sf))).select(
        "id", "visible_scene", "scene_state"
    )


@query(
    "session_start_valid",
    T.duck_cte("session_schema_version", "session_count")
    + f" SELECT id, {SESSION_START_SQL} AS session_start_valid FROM t WHERE {T.WINDOW_SQL}",
)
def _(spark, sf):
    from vitalgauge.functions.events import session_start_valid

    return window(T.inbox(spark, sf)).select(
        "id", session_start_valid().alias("session_start_valid")
    )


@query(
    "valid_sdk_health",
    T.duck_cte(*SDK_FIELDS) + f" SELECT id, {SDK_VALID_SQL} AS valid, {SDK_DROPPED_SQL} AS dropped"
    f" FROM t WHERE {T.WINDOW_SQL} AND name = 'sdk_health'",
)
def _(spark, sf):
    from vitalgauge.functions.events import sdk_dropped, valid_sdk_health

    return (
        window(T.inbox(spark, sf))
        .filter("name = 'sdk_health'")
        .select("id", valid_sdk_health().alias("valid"), sdk_dropped().alias("dropped"))
    )


FACT_DIMENSIONS = (
    "app_version, release_identity_quality, installation_identity_quality, installation_hmac,"
    " installation_hmac_key_version, session_identity_quality, session_hmac,"
    " session_hmac_key_version, device_model, os_version, session_start_valid,"
    " incident_fingerprint, schema_version, protocol, inbox_status, module, name, scene,"
    " scene_state, sdk_emit_count, late, bucket"
)


@query(
    "window_facts",
    T.duck_cte(*SDK_FIELDS)
    + f", x AS (SELECT * REPLACE (CASE WHEN raw_pruned_ms IS NULL THEN scene END AS scene),"
    f" {SESSION_START_SQL} AS session_start_valid, {SCENE_SQL} AS scene_state,"
    f" CASE WHEN {SDK_VALID_SQL} THEN 1 END AS sdk_emit_count, {LATE_SQL} AS late,"
    f" (occurrence_timestamp_ms - {T.FROM_MS}) // {BUCKET} AS bucket"
    f" FROM t WHERE {T.WINDOW_SQL})"
    f" SELECT {FACT_DIMENSIONS}, min(id) AS id, min(event_id) AS event_id,"
    " min(occurrence_timestamp_ms) AS occurrence_timestamp_ms,"
    " max(occurrence_timestamp_ms) AS last_occurrence_timestamp_ms,"
    " max(received_ms) AS received_ms, max(cast(f_dropCount AS bigint)) AS sdk_drop_count,"
    " max(cast(f_dropRate AS double)) AS sdk_drop_rate, count(*) AS weight"
    f" FROM x GROUP BY {FACT_DIMENSIONS}",
)
def _(spark, sf):
    return S.window_facts(window(T.inbox(spark, sf)), T.FROM_MS, T.TO_MS)


PAGE_SQL = (
    f"occurrence_timestamp_ms < {CURSOR[0]} OR (occurrence_timestamp_ms = {CURSOR[0]}"
    f" AND id < {CURSOR[1]})"
)


@query(
    "list_events",
    T.duck_cte() + " SELECT id, event_id, module, name, occurrence_timestamp_ms FROM t"
    f" WHERE {T.WINDOW_SQL} AND module = 'crash' AND ({PAGE_SQL})"
    " ORDER BY occurrence_timestamp_ms DESC, id DESC LIMIT 51",
)
def _(spark, sf):
    return S.list_events(window(T.telemetry(spark, sf)), 50, module="crash", cursor=CURSOR).select(
        "id", "event_id", "module", "name", "occurrence_timestamp_ms"
    )


JOBS_SQL = (
    "jobs AS (SELECT id AS inbox_event_id, CASE name WHEN 'java_crash' THEN 'java' ELSE 'native'"
    " END AS job_type, CASE k % 5 WHEN 0 THEN 'symbolized' WHEN 1 THEN 'pending'"
    " WHEN 2 THEN 'symbols_missing' WHEN 3 THEN 'failed' ELSE 'partially_symbolized' END"
    " AS job_status, CASE WHEN k % 5 IN (0, 4) THEN sha256('sym-' || cast(k % 3 AS string)) END"
    " AS fingerprint_sha256 FROM t WHERE name IN ('java_crash', 'native_crash')"
    " AND k % 3 <> 1)"
)


def symbol_jobs(spark, sf):
    """Symbolization jobs of the mapped crashes."""
    k = F.col("k")
    return (
        T.telemetry(spark, sf)
        .filter("name IN ('java_crash', 'native_crash') AND k % 3 <> 1")
        .select(
            F.col("id").alias("inbox_event_id"),
            F.expr("CASE name WHEN 'java_crash' THEN 'java' ELSE 'native' END").alias("job_type"),
            F.expr(
                "CASE k % 5 WHEN 0 THEN 'symbolized' WHEN 1 THEN 'pending' WHEN 2 THEN"
                " 'symbols_missing' WHEN 3 THEN 'failed' ELSE 'partially_symbolized' END"
            ).alias("job_status"),
            F.when(
                (k % 5).isin(0, 4),
                F.sha2(F.concat(F.lit("sym-"), (k % 3).cast("string")), 256),
            ).alias("fingerprint_sha256"),
        )
    )


SUMMARY = (
    "event_id, module, name, event_family, app_version, app_build, version_code, variant,"
    " release_identity_quality, installation_identity_quality, installation_hmac,"
    " session_identity_quality, device_model, os_version, occurrence_timestamp_ms, received_ms,"
    " scene, process_name, thread_name, incident_fingerprint, inbox_status,"
    " symbolization_status, symbolization_fingerprint"
)


@query(
    "event_summary",
    T.duck_cte() + f", {JOBS_SQL}, x AS (SELECT * REPLACE ("
    "CASE WHEN raw_pruned_ms IS NULL THEN scene END AS scene,"
    " CASE WHEN raw_pruned_ms IS NULL THEN process_name END AS process_name,"
    " CASE WHEN raw_pruned_ms IS NULL THEN thread_name END AS thread_name),"
    f" {FAMILY_SQL} AS event_family, job_status AS symbolization_status,"
    " fingerprint_sha256 AS symbolization_fingerprint FROM t"
    f" LEFT JOIN jobs ON id = inbox_event_id WHERE {T.WINDOW_SQL})"
    f" SELECT {SUMMARY} FROM x",
)
def _(spark, sf):
    return S.event_summary(window(T.telemetry(spark, sf)), symbol_jobs(spark, sf))


@query(
    "event_metadata",
    T.duck_cte("launchDurationMs", "isColdStart", "phaseContentProviderCount")
    + ", u AS (SELECT *, unnest(["
    "{'field': 'launchDurationMs', 'state': CASE WHEN f_launchDurationMs IS NULL THEN 'MISSING'"
    " WHEN f_launchDurationMs = '-1' THEN 'INVALID' ELSE 'AVAILABLE' END},"
    "{'field': 'backgroundDurationMs', 'state': 'MISSING'},"
    "{'field': 'isColdStart', 'state': CASE WHEN f_isColdStart IS NULL THEN 'MISSING'"
    " WHEN f_isColdStart = 'yes' THEN 'INVALID' ELSE 'AVAILABLE' END}]) AS x FROM t"
    " WHERE tenant_id = 'tenant-a' AND app_id = 'com.example' AND environment = 'production'"
    " AND name = 'warm_start') SELECT event_id, module, name, schema_version, protocol,"
    " raw_pruned_ms IS NULL AS raw_available, x.field AS field, x.state AS"
    " field_state FROM u WHERE event_id = (SELECT min(event_id) FROM t"
    " WHERE tenant_id = 'tenant-a' AND name = 'warm_start')",
)
def _(spark, sf):
    rows = T.inbox(spark, sf)
    wanted = T.telemetry(spark, sf).filter("tenant_id = 'tenant-a' AND name = 'warm_start'").agg(
        F.min("event_id")
    )
    return S.event_metadata(rows, T.SCOPE, wanted.scalar())


@query(
    "raw_access_audit",
    T.duck_cte() + ", r AS (SELECT 'req-' || cast(k AS string) || '-' || event_id AS request_id,"
    " 'tenant-a' AS tenant_id, 'com.example' AS app_id, 'production' AS environment,"
    " event_id, 'actor-' || cast(k % 3 AS string) AS actor, CASE WHEN k % 10 = 0 THEN 'curiosity'"
    " ELSE 'incident_diagnosis' END AS purpose_code FROM t WHERE k % 4 = 0)"
    " SELECT request_id, r.tenant_id, actor, 'query.event.raw.read' AS action,"
    " 'inbox_event' AS object_type, r.event_id AS object_id,"
    " CASE WHEN t.event_id IS NULL THEN 'not_found' WHEN raw_pruned_ms IS NOT NULL THEN 'expired'"
    " ELSE 'success' END AS result, purpose_code FROM r LEFT JOIN t ON r.tenant_id = t.tenant_id"
    " AND r.app_id = t.app_id AND r.environment = t.environment AND r.event_id = t.event_id"
    " WHERE purpose_code = 'incident_diagnosis'",
)
def _(spark, sf):
    rows = T.telemetry(spark, sf)
    requests = rows.filter("k % 4 = 0").selectExpr(
        "'req-' || cast(k AS string) || '-' || event_id AS request_id",
        "'tenant-a' AS tenant_id",
        "app_id",
        "environment",
        "event_id",
        "'actor-' || cast(k % 3 AS string) AS actor",
        "CASE WHEN k % 10 = 0 THEN 'curiosity' ELSE 'incident_diagnosis' END AS purpose_code",
    )
    return S.raw_access_audit(requests, rows)


@query(
    "resolve_issue_alias",
    T.duck_cte() + f", w AS (SELECT * FROM t WHERE {T.WINDOW_SQL}), a AS (SELECT DISTINCT"
    " raw_incident_fingerprint AS alias FROM t WHERE raw_incident_fingerprint IS NOT NULL"
    " UNION ALL SELECT 'unseen'), m AS (SELECT alias, count(DISTINCT incident_fingerprint) AS n,"
    " min(incident_fingerprint) AS lo FROM a LEFT JOIN w ON alias = raw_incident_fingerprint"
    " GROUP BY alias) SELECT alias, CASE WHEN n > 1 THEN NULL ELSE coalesce(lo, alias) END"
    " AS fingerprint, CASE WHEN n = 0 THEN 'UNCHANGED' WHEN n > 1 THEN 'AMBIGUOUS'"
    " ELSE 'RESOLVED' END AS resolution FROM m",
)
def _(spark, sf):
    rows = T.telemetry(spark, sf)
    aliases = (
        rows.select(F.col("raw_incident_fingerprint").alias("alias"))
        .filter("alias IS NOT NULL")
        .distinct()
        .union(spark.range(1).select(F.lit("unseen")))
    )
    return S.resolve_issue_alias(aliases, window(rows))
