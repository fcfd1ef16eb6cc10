"""Retention, symbol, export, panel and management queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgauge.operators import export as X
from vitalgauge.operators import management as MG
from vitalgauge.operators import panels as PN
from vitalgauge.operators import retention as RT
from vitalgauge.operators import symbols as SY
from vitalgauge.plans import telemetry as T
from vitalgauge.plans.ingest_queries import _columns
from vitalgauge.plans.performance_queries import FIELDS_CTE, UNSENT, observed_sql, rounded
from vitalgauge.plans.registry import query
from vitalgauge.plans.scan_queries import JOBS_SQL, symbol_jobs, window
from vitalgauge.plans.signal_queries import SPAN_CTE, span_events

NOW = T.NOW_MS
DAY = T.DAY_MS

EXPIRED_SQL = (
    "ex AS (SELECT * FROM t WHERE raw_pruned_ms IS NULL AND ((inbox_status = 'delivered' AND"
    f" coalesce(finalized_ms, delivered_ms, next_attempt_ms) <= {NOW - 7 * DAY}) OR (inbox_status ="
    f" 'dead_letter' AND coalesce(finalized_ms, delivered_ms, next_attempt_ms) <= {NOW - 30 * DAY}))"
    " AND NOT EXISTS (SELECT 1 FROM jobs WHERE inbox_event_id = t.id AND job_status IN ('pending',"
    " 'processing', 'symbols_missing')))"
)


@query("select_expired_raw", T.duck_cte() + f", {JOBS_SQL}, {EXPIRED_SQL} SELECT id FROM ex")
def _(spark, sf):
    return RT.select_expired_raw(T.telemetry(spark, sf), symbol_jobs(spark, sf), NOW).select("id")


@query(
    "prune_raw_evidence",
    f"{FIELDS_CTE}, {JOBS_SQL}, {EXPIRED_SQL} SELECT ex.id, {NOW} AS raw_pruned_ms, CASE WHEN"
    " ex.scene IS NULL THEN 'MISSING' ELSE 'EXPIRED' END AS retained_scene_state, v.field, CASE"
    " WHEN v.state = 'AVAILABLE' AND v.type = 'string' THEN 'EXPIRED' ELSE v.state END AS state,"
    " CASE WHEN v.state = 'AVAILABLE' AND v.type IN ('integer', 'number') THEN cast(v.raw AS"
    " double) END AS number_value FROM ex JOIN v ON v.id = ex.id",
)
def _(spark, sf):
    expired = RT.select_expired_raw(T.inbox(spark, sf), symbol_jobs(spark, sf), NOW)
    return (
        RT.prune_raw_evidence(expired, NOW)
        .select(
            "id", "raw_pruned_ms", "retained_scene_state", "ints", "nums",
            F.explode("field_states").alias("field", "state"),
        )
        .selectExpr(
            "id", "raw_pruned_ms", "retained_scene_state", "field", "state",
            "coalesce(cast(try_element_at(ints, field) AS double), try_element_at(nums, field))"
            " AS number_value",
        )
    )


WINDOWS = (
    "event_id AS key_id", "occurrence_timestamp_ms - occurrence_timestamp_ms % 60000 AS window_ms",
    "k AS request_count",
)


@query(
    "expire_rate_windows",
    T.duck_cte() + f", w AS (SELECT {', '.join(WINDOWS)} FROM t) SELECT key_id, window_ms,"
    f" window_ms >= {T.TO_MS - DAY} AS kept FROM w",
)
def _(spark, sf):
    windows = T.telemetry(spark, sf).selectExpr(*WINDOWS)
    kept, old = RT.expire_rate_windows(windows, T.TO_MS)
    return (
        kept.withColumn("kept", F.lit(True))
        .unionByName(old.withColumn("kept", F.lit(False)))
        .select("key_id", "window_ms", "kept")
    )


EPISODES = (
    "id AS episode_id", "CASE WHEN k % 3 <> 0 THEN occurrence_timestamp_ms + cast(k AS bigint) * 100000000 END AS"
    " resolved_ms",
)
LATER = T.TO_MS + 95 * DAY


@query(
    "prune_alert_history",
    T.duck_cte() + f", e AS (SELECT {', '.join(EPISODES)} FROM t), d AS (SELECT id AS delivery_id,"
    f" id - id % 3 AS episode_id FROM t), g AS (SELECT episode_id FROM e WHERE resolved_ms <="
    f" {LATER - 90 * DAY}) SELECT 'episode' AS kind, episode_id AS item_id FROM e WHERE episode_id"
    " NOT IN (SELECT episode_id FROM g) UNION ALL SELECT 'delivery', delivery_id FROM d WHERE"
    " episode_id NOT IN (SELECT episode_id FROM g)",
)
def _(spark, sf):
    rows = T.telemetry(spark, sf)
    episodes = rows.selectExpr(*EPISODES)
    deliveries = rows.selectExpr("id AS delivery_id", "id - id % 3 AS episode_id")
    kept, sent = RT.prune_alert_history(episodes, deliveries, LATER)
    return kept.selectExpr("'episode' AS kind", "episode_id AS item_id").unionByName(
        sent.selectExpr("'delivery' AS kind", "delivery_id AS item_id")
    )


@query(
    "retention_audit",
    T.duck_cte() + f", {JOBS_SQL}, {EXPIRED_SQL} SELECT tenant_id, 'worker:retention' AS actor,"
    " 'inbox.raw.prune' AS action, 'retention_batch' AS object_type, 'success' AS result, count(*)"
    " AS pruned_count FROM ex GROUP BY tenant_id",
)
def _(spark, sf):
    return RT.retention_audit(
        RT.select_expired_raw(T.telemetry(spark, sf), symbol_jobs(spark, sf), NOW)
    )


DUE_SQL = (
    f"(inbox_status = 'pending' AND next_attempt_ms <= {T.TO_MS}) OR (inbox_status = 'processing'"
    f" AND lease_expires_ms <= {T.TO_MS})"
)


@query(
    "inbox_backlog",
    T.duck_cte() + ", s AS (SELECT unnest(['pending', 'processing', 'awaiting_symbols',"
    " 'delivered', 'dead_letter']) AS inbox_status) SELECT s.inbox_status, count(id) AS row_count,"
    f" count(id) FILTER ({DUE_SQL.replace('inbox_status', 't.inbox_status')}) AS due_count,"
    f" round(greatest(0, ({T.TO_MS} - min(received_ms) FILTER"
    f" ({DUE_SQL.replace('inbox_status', 't.inbox_status')})) / 1000.0), 3) AS oldest_due_seconds"
    " FROM s LEFT JOIN t ON t.inbox_status = s.inbox_status GROUP BY 1",
)
def _(spark, sf):
    out = RT.inbox_backlog(T.telemetry(spark, sf), T.TO_MS)
    return out.withColumn("oldest_due_seconds", F.round("oldest_due_seconds", 3))


@query(
    "pipeline_status",
    T.duck_cte() + f", {JOBS_SQL}, w AS (SELECT * FROM t WHERE {T.WINDOW_SQL}) SELECT 'inbox' AS"
    " pipeline, inbox_status AS status, count(*) AS row_count FROM w GROUP BY 2 UNION ALL SELECT"
    " 'symbolization', job_status, count(*) FROM jobs JOIN w ON id = inbox_event_id GROUP BY 2",
)
def _(spark, sf):
    return RT.pipeline_status(window(T.telemetry(spark, sf)), symbol_jobs(spark, sf))


SIGNALS = (
    "id", "attempt_count", "CASE WHEN k % 9 = 0 THEN 7 WHEN k % 9 = 1 THEN 0 END AS retry_after",
    "CASE k % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'delivered' ELSE 'failed' END AS logs_state",
    "CASE k % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'not_applicable' ELSE 'delivered' END AS"
    " metrics_state",
)


def claimed(spark, sf):
    return T.telemetry(spark, sf).selectExpr(
        *SIGNALS, "if(k % 5 = 0, NULL, map('logs', 'delivered')) AS frozen"
    ).selectExpr(
        "*", "map('logs', logs_state, 'metrics', metrics_state) AS signal_states"
    )


@query(
    "plan_export_signals",
    T.duck_cte() + " SELECT id, CASE WHEN k % 5 = 0 THEN 'pending' ELSE 'delivered' END AS logs,"
    " CASE WHEN k % 5 = 0 THEN 'pending' END AS metrics, cast(NULL AS varchar) AS traces FROM t",
)
def _(spark, sf):
    rows = claimed(spark, sf).drop("signal_states").withColumnRenamed("frozen", "signal_states")
    return RT.plan_export_signals(rows, metrics=True, traces=False).selectExpr(
        "id", "signal_states['logs'] AS logs", "try_element_at(signal_states, 'metrics') AS metrics",
        "try_element_at(signal_states, 'traces') AS traces",
    )


BACKOFF_SQL = (
    "coalesce(nullif(retry_after, 0), cast(least(pow(2, least(attempt_count, 8)), 300) AS bigint))"
)


@query(
    "finalize_export",
    T.duck_cte() + f", s AS (SELECT {', '.join(SIGNALS)} FROM t), o AS (SELECT *, CASE WHEN"
    " attempt_count > 6 AND 'pending' IN (logs_state, metrics_state) THEN 'dead_letter' WHEN"
    " logs_state NOT IN ('pending', 'failed') AND metrics_state <> 'pending' THEN 'delivered' WHEN"
    " 'pending' IN (logs_state, metrics_state) AND attempt_count < 6 THEN 'retry' ELSE"
    " 'dead_letter' END AS outcome FROM s) SELECT id, outcome, CASE outcome WHEN 'retry' THEN"
    f" 'pending' ELSE outcome END AS new_status, CASE WHEN outcome <> 'retry' THEN {NOW} END AS"
    f" finalized_at_ms, CASE WHEN outcome <> 'delivered' THEN {NOW} + {BACKOFF_SQL} * 1000 END AS"
    " next_attempt_at_ms FROM o",
)
def _(spark, sf):
    return RT.finalize_export(claimed(spark, sf), NOW, max_attempts=6).select(
        "id", "outcome", "new_status", "finalized_at_ms", "next_attempt_at_ms"
    )


@query(
    "retry_backoff",
    T.duck_cte() + f", s AS (SELECT {', '.join(SIGNALS)} FROM t) SELECT id, {BACKOFF_SQL} AS"
    " delay_seconds FROM s",
)
def _(spark, sf):
    return RT.retry_backoff(claimed(spark, sf)).select("id", "delay_seconds")


# Native frames of the mapped native crashes; some disagree with the backtrace.
FRAMES = (
    "if(name = 'native_crash', array(named_struct('abi', if(k % 22 = 0, 'mips', 'arm64-v8a'),"
    " 'module_build_id', concat('ABCDEF0', k % 5), 'module_name', 'libc.so', 'module_relative_pc',"
    " cast(conv(concat('4A', k % 6, 'f0'), 16, 10) AS decimal(20,0))), named_struct('abi',"
    " 'arm64-v8a', 'module_build_id', concat('0123456', k % 3), 'module_name', if(k % 10 = 4,"
    " 'other.so', 'libapp.so'), 'module_relative_pc', cast(conv(concat('b', k % 3), 16, 10) AS"
    " decimal(20,0)))), NULL) AS native_frames"
)


def crashes(spark, sf):
    return T.telemetry(spark, sf).filter("module = 'crash'").selectExpr("*", FRAMES)


HAS_BUILD_SQL = "release_identity_quality = 'OCCURRENCE_BOUND' AND variant IS NOT NULL"
STACK_TEXT_SQL = "coalesce(CASE name WHEN 'java_crash' THEN f_stackTrace ELSE f_backtrace END, '')"
FIRST_FRAME_SQL = "(name = 'java_crash' OR k % 22 <> 0)"


@query(
    "derive_symbol_jobs",
    T.duck_cte("stackTrace", "backtrace") + f", x AS (SELECT *, CASE WHEN {STACK_TEXT_SQL} <> ''"
    f" AND {HAS_BUILD_SQL} AND {FIRST_FRAME_SQL} THEN 'pending' ELSE 'metadata_missing' END AS"
    " job_status FROM t WHERE name IN ('java_crash', 'native_crash') AND id % 4 <> 1) SELECT id AS"
    " inbox_event_id, CASE name WHEN 'java_crash' THEN 'java' ELSE 'native' END AS job_type,"
    f" job_status, sha256({STACK_TEXT_SQL}) AS input_sha256, CASE WHEN job_status = 'pending' AND"
    " inbox_status = 'pending' THEN 'awaiting_symbols' ELSE inbox_status END AS new_inbox_status"
    " FROM x",
)
def _(spark, sf):
    rows = crashes(spark, sf)
    known = rows.filter("id % 4 = 1").select(F.col("id").alias("inbox_event_id"))
    return SY.derive_symbol_jobs(rows, known).select(
        "inbox_event_id", "job_type", "job_status", "input_sha256", "new_inbox_status"
    )


ARTIFACT = (
    "id AS upload_id", "tenant_id", "'java_mapping' AS artifact_type", "app_id", "version_code",
    "app_build", "'release' AS variant", "CASE WHEN k % 2 = 0 THEN NULL ELSE 'x' END AS tag",
)


def uploads(spark, sf):
    return T.telemetry(spark, sf).selectExpr(
        "id AS upload_id", "k", "tenant_id", "'java_mapping' AS artifact_type", "app_id",
        "concat(version_code, '-', id % 40) AS version_code", "app_build", "'release' AS variant",
        "'' AS abi", "'' AS build_id", "concat('sha-', k % 3) AS sha256",
        "cast(k % 2 AS bigint) AS size",
    )


@query(
    "register_artifacts",
    T.duck_cte() + ", u AS (SELECT id AS upload_id, tenant_id, app_build, version_code || '-' ||"
    " cast(id % 40 AS varchar) AS vc, 'sha-' || cast(k % 3 AS varchar) AS sha, k % 2 AS size FROM"
    " t), s AS (SELECT DISTINCT ON (tenant_id, app_build, vc) tenant_id, app_build, vc, sha AS"
    " ssha, size AS ssize FROM u WHERE upload_id % 40 < 10 ORDER BY tenant_id, app_build, vc,"
    " upload_id), w AS (SELECT *, first_value(upload_id) OVER p AS wid, first_value(sha) OVER p AS"
    " wsha, first_value(size) OVER p AS wsize FROM u WINDOW p AS (PARTITION BY tenant_id,"
    " app_build, vc ORDER BY upload_id)) SELECT upload_id, ssha IS NULL AND upload_id = wid AS"
    " inserted, NOT (ssha IS NULL AND upload_id = wid) AND (sha <> coalesce(ssha, wsha) OR size <>"
    " coalesce(ssize, wsize)) AS conflict FROM w LEFT JOIN s ON s.tenant_id = w.tenant_id AND"
    " s.app_build = w.app_build AND s.vc = w.vc",
)
def _(spark, sf):
    rows = uploads(spark, sf)
    keys = list(SY.ARTIFACT_KEY)
    existing = rows.filter("upload_id % 40 < 10").groupBy(*keys).agg(
        F.min_by("sha256", "upload_id").alias("sha256"), F.min_by("size", "upload_id").alias("size")
    )
    return SY.register_artifacts(rows, existing)


def artifacts(spark, sf):
    """Registered mappings and native modules of some of the mapped builds."""
    builds = T.telemetry(spark, sf).select(
        "tenant_id", "app_id", "version_code", "app_build"
    ).distinct().withColumn("variant", F.lit("release"))
    java = builds.filter("app_build <> 'b3'").selectExpr(
        "*", "'java_mapping' AS artifact_type", "'' AS abi", "'' AS build_id",
        "'active' AS artifact_status", "concat(tenant_id, '/', app_build) AS artifact_id",
    )
    native = builds.selectExpr(
        "*", "'native_elf' AS artifact_type", "'arm64-v8a' AS abi",
        "explode(array('abcdef00', 'abcdef02', 'abcdef04', '01234560', '01234562')) AS build_id",
        "'active' AS artifact_status",
    ).withColumn("artifact_id", F.concat_ws("/", "tenant_id", "app_build", "build_id"))
    return java.unionByName(native)


def crash_jobs(spark, sf):
    return (
        crashes(spark, sf)
        .filter("name IN ('java_crash', 'native_crash')")
        .selectExpr(
            "id AS inbox_event_id",
            "if(name = 'java_crash', 'java', 'native') AS job_type",
            "if(k % 3 = 0, 'symbols_missing', 'pending') AS job_status",
            "*",
        )
    )


@query(
    "match_java_artifacts",
    T.duck_cte() + " SELECT id AS inbox_event_id, tenant_id || '/' || app_build AS artifact_id FROM"
    f" t WHERE name = 'java_crash' AND {HAS_BUILD_SQL} AND app_build <> 'b3'",
)
def _(spark, sf):
    return SY.match_java_artifacts(crash_jobs(spark, sf), artifacts(spark, sf))


@query(
    "match_native_artifacts",
    T.duck_cte() + " SELECT id AS inbox_event_id, tenant_id || '/' || app_build || '/0123456' ||"
    " cast(k % 3 AS varchar) || ',' || tenant_id || '/' || app_build || '/abcdef0' ||"
    f" cast(k % 5 AS varchar) AS artifact_ids FROM t WHERE name = 'native_crash' AND {HAS_BUILD_SQL}"
    " AND k % 22 <> 0 AND k % 5 IN (0, 2, 4) AND k % 3 IN (0, 2)",
)
def _(spark, sf):
    return SY.match_native_artifacts(crash_jobs(spark, sf), artifacts(spark, sf)).selectExpr(
        "inbox_event_id", "array_join(artifact_ids, ',') AS artifact_ids"
    )


@query(
    "align_native_frames",
    T.duck_cte("backtrace") + " SELECT id, CASE WHEN f_backtrace IS NULL THEN"
    " 'INVALID_NATIVE_STACK' WHEN k % 22 = 0 OR k % 10 = 4 THEN 'FRAME_IDENTITY_MISMATCH' ELSE"
    " 'ALIGNED' END AS alignment FROM t WHERE name = 'native_crash'",
)
def _(spark, sf):
    rows = crashes(spark, sf).filter("name = 'native_crash'")
    return SY.align_native_frames(rows).select("id", "alignment")


FRAME_TEXT = (
    "id - id % 4 AS inbox_event_id",
    "CASE k % 6 WHEN 0 THEN '??' WHEN 1 THEN '' ELSE 'fn' || cast(k AS {s}) END AS function",
    "CASE k % 5 WHEN 0 THEN '??:0:0' WHEN 1 THEN 'a.cc:0:3' WHEN 2 THEN 'unknown' ELSE"
    " 'src/a.cc:' || cast(k + 1 AS {s}) || ':2' END AS location",
)
STATE_SQL = (
    "CASE WHEN function IN ('', '??') THEN 'UNRESOLVED' WHEN location LIKE 'src/%' THEN 'RESOLVED'"
    " ELSE 'FUNCTION_ONLY' END"
)


@query(
    "frame_resolution",
    T.duck_cte() + f", f AS (SELECT {', '.join(c.format(s='varchar') for c in FRAME_TEXT)} FROM t),"
    f" r AS (SELECT *, {STATE_SQL} AS st FROM f) SELECT inbox_event_id, CASE WHEN count(*) FILTER"
    " (st <> 'UNRESOLVED') = 0 THEN 'failed' WHEN count(*) FILTER (st = 'RESOLVED') = count(*) THEN"
    " 'symbolized' ELSE 'partially_symbolized' END AS job_status, count(*) FILTER (st <>"
    " 'UNRESOLVED') AS resolved_frames, count(*) AS total_frames FROM r GROUP BY 1",
)
def _(spark, sf):
    frames = T.telemetry(spark, sf).selectExpr(*[c.format(s="string") for c in FRAME_TEXT])
    return SY.resolution_status(SY.frame_resolution(frames))


@query(
    "symbol_fingerprint",
    T.duck_cte("stackTrace") + ", o AS (SELECT id, list_filter(list_transform(string_split(replace("
    "f_stackTrace, chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    " AS ls FROM t WHERE f_stackTrace IS NOT NULL) SELECT id, sha256(array_to_string(ls[1:32],"
    " chr(10))) AS fingerprint_sha256 FROM o",
)
def _(spark, sf):
    outputs = T.telemetry(spark, sf).selectExpr(
        "id", "try_element_at(fields, 'stackTrace') AS output"
    ).filter("output IS NOT NULL")
    return SY.symbol_fingerprint(outputs).select("id", "fingerprint_sha256")


@query(
    "requeue_missing_jobs",
    T.duck_cte() + " SELECT id AS inbox_event_id FROM t WHERE k % 3 = 0 AND ((name = 'java_crash'"
    f" AND {HAS_BUILD_SQL} AND app_build <> 'b3') OR (name = 'native_crash' AND variant IS NOT NULL"
    " AND ((k % 5 IN (0, 2, 4) AND k % 22 <> 0) OR k % 3 IN (0, 2))))",
)
def _(spark, sf):
    return SY.requeue_missing_jobs(crash_jobs(spark, sf), artifacts(spark, sf))


RESOURCE_SQL = (
    "cast(floor(id / 100e0) AS bigint) AS export_batch, tenant_id, app_id, environment, CASE WHEN"
    " release_identity_quality = 'OCCURRENCE_BOUND' THEN app_version ELSE '' END AS"
    " service_version, sdk_version"
)


LOG_ATTRIBUTES = ", ".join(
    f"coalesce(try_element_at(r.attributes, 'apm.{key}'), '-')"
    for key in (
        "event_id", "module", "name", "kind", "priority", "thread.name", "protocol", "schema_version",
        "release_identity_quality", "installation_identity_quality", "scene", "installation.hmac",
        "installation.hmac_key_version", "incident.fingerprint",
    )
)


@query(
    "otlp_logs",
    T.duck_cte() + f", r AS (SELECT {RESOURCE_SQL}, id, CASE WHEN release_identity_quality ="
    " 'OCCURRENCE_BOUND' THEN app_build ELSE '' END AS build, process_name, event_id, CASE severity"
    " WHEN 'INFO' THEN 9 WHEN 'ERROR' THEN 17 ELSE 21 END AS num, occurrence_timestamp_ms AS ts,"
    " received_ms, scene, installation_hmac, incident_fingerprint, module || '.' || name AS body, concat_ws('|', severity,"
    " event_id, module, name, kind, priority, thread_name, protocol, schema_version, release_identity_quality,"
    " installation_identity_quality, coalesce(scene, '-'), coalesce(installation_hmac, '-'),"
    " coalesce(installation_hmac_key_version, '-'), coalesce(incident_fingerprint, '-')) AS attribute_text FROM t) SELECT"
    " export_batch, string_agg(body, ',' ORDER BY id) AS bodies, string_agg(attribute_text, ',' ORDER BY id) AS"
    " attribute_texts,"
    " tenant_id, app_id, environment, service_version, sdk_version, build, process_name,"
    " string_agg(event_id, ',' ORDER BY id) AS event_ids, cast(sum(num) AS bigint) AS"
    " severity_sum, cast(max(ts) * 1000000 AS bigint) AS last_nano, cast(sum(10 + (scene IS NOT"
    " NULL)::int + 2 * (installation_hmac IS NOT NULL)::int + (incident_fingerprint IS NOT"
    " NULL)::int) AS bigint) AS plain_attributes FROM r GROUP BY ALL",
)
def _(spark, sf):
    return X.otlp_logs(T.inbox(spark, sf)).selectExpr(
        "export_batch", "tenant_id", "app_id", "environment", "service_version", "sdk_version",
        "build", "process_name", "array_join(event_ids, ',') AS event_ids",
        "array_join(transform(records, r -> r.body), ',') AS bodies",
        f"array_join(transform(records, r -> concat_ws('|', r.severity_text, {LOG_ATTRIBUTES})), ',') AS attribute_texts",
        "cast(aggregate(records, 0, (a, r) -> a + r.severity_number) AS bigint) AS severity_sum",
        "array_max(transform(records, r -> r.time_unix_nano)) AS last_nano",
        "cast(aggregate(records, 0, (a, r) -> a + size(map_filter(r.attributes, (k, v) -> NOT"
        " startswith(k, 'apm.field.')))) AS bigint) AS plain_attributes",
    )


OBSERVED_CTE = T.duck_cte(*T.FIELD_TEXT) + (
    f", {UNSENT}, o AS ({observed_sql('TRUE', RESOURCE_SQL + ', occurrence_timestamp_ms AS ts')})"
)


@query(
    "otlp_metrics",
    f"{OBSERVED_CTE} SELECT export_batch, tenant_id, app_id, environment, service_version,"
    " sdk_version, 'apm.observation.' || metric_id AS metric, count(*) AS point_count,"
    " round(sum(value), 6) AS value_sum, cast(max(ts) * 1000000 AS bigint) AS last_nano FROM o"
    " WHERE value IS NOT NULL GROUP BY ALL",
)
def _(spark, sf):
    out = X.otlp_metrics(T.inbox(spark, sf))
    return rounded(
        out.selectExpr(
            "export_batch", "tenant_id", "app_id", "environment", "service_version",
            "sdk_version", "metric", "cast(size(points) AS bigint) AS point_count",
            "aggregate(points, 0D, (a, p) -> a + p.as_double) AS value_sum",
            "array_max(transform(points, p -> p.time_unix_nano)) AS last_nano",
        )
    )


SPAN_OK_SQL = (
    "timing_state = 'AVAILABLE' AND NOT parent_invalid AND status <> 'UNKNOWN' AND parent_span_id"
    " IS DISTINCT FROM span_id"
)


@query(
    "otlp_traces",
    f"{SPAN_CTE}, g AS (SELECT t.id, cast(floor(t.id / 100e0) AS bigint) AS export_batch,"
    " t.tenant_id, t.app_id, t.environment, CASE WHEN t.release_identity_quality ="
    " 'OCCURRENCE_BOUND' THEN t.app_version ELSE '' END AS service_version, t.sdk_version,"
    " s.span_id, s.status FROM s JOIN t ON t.event_id = s.event_id WHERE"
    f" {SPAN_OK_SQL.replace('status', 's.status')}) SELECT export_batch, tenant_id, app_id,"
    " environment, service_version, sdk_version, string_agg(span_id, ',' ORDER BY span_id) AS"
    " span_ids, count(*) FILTER (status = 'ERROR') AS error_count FROM g GROUP BY ALL",
)
def _(spark, sf):
    rows = window(span_events(spark, sf)).filter("raw_pruned_ms IS NULL")
    return X.otlp_traces(rows).selectExpr(
        "export_batch", "tenant_id", "app_id", "environment", "service_version", "sdk_version",
        "array_join(transform(spans, x -> x.span_id), ',') AS span_ids",
        "cast(size(filter(spans, x -> x.status_code = 2)) AS bigint) AS error_count",
    )


@query(
    "isolate_bad_rows",
    T.duck_cte(*T.FIELD_TEXT) + f", {UNSENT}, o AS ({observed_sql('TRUE')}), v AS (SELECT DISTINCT id FROM o"
    " WHERE value IS NOT NULL) SELECT id, CASE WHEN k % 50 = 0 THEN 'failed' ELSE 'pending' END AS"
    " logs, CASE WHEN id IN (SELECT id FROM v) THEN 'pending' ELSE 'not_applicable' END AS metrics,"
    " 'not_applicable' AS traces FROM t",
)
def _(spark, sf):
    rows = T.inbox(spark, sf).withColumn("priority", F.expr("if(k % 50 = 0, NULL, priority)"))
    return X.isolate_bad_rows(rows)


@query(
    "panel_counts",
    T.duck_cte() + " SELECT app_id, environment, count(*) AS event_count, count(*) FILTER (name ="
    " 'java_crash') AS java_crash_count, count(*) FILTER (name = 'anr_detected') AS anr_count FROM"
    " t GROUP BY ALL",
)
def _(spark, sf):
    return PN.panel_counts(T.telemetry(spark, sf))


HOUR_SQL = "cast(floor(occurrence_timestamp_ms / 3600000e0) AS bigint) * 3600000 AS window_start_ms"


@query(
    "panel_drop_rate_p95",
    T.duck_cte("dropRate") + ", h AS (SELECT app_id, CASE WHEN release_identity_quality ="
    f" 'OCCURRENCE_BOUND' THEN app_version END AS release_version, {HOUR_SQL}, cast(f_dropRate AS"
    " double) AS rate FROM t WHERE name = 'sdk_health') SELECT app_id, release_version,"
    " window_start_ms, round(quantile_cont(rate, 0.95), 6) AS p95 FROM h GROUP BY ALL",
)
def _(spark, sf):
    return rounded(PN.panel_drop_rate_p95(T.inbox(spark, sf)))


@query(
    "panel_startup_p90",
    T.duck_cte("launchDurationMs") + f", h AS (SELECT app_id, environment, name AS start_type,"
    f" {HOUR_SQL}, cast(f_launchDurationMs AS double) AS d FROM t WHERE module = 'launch' AND"
    " f_launchDurationMs <> '-1') SELECT app_id, environment, start_type, window_start_ms,"
    " round(quantile_cont(d, 0.9), 6) AS p90 FROM h GROUP BY ALL",
)
def _(spark, sf):
    return rounded(PN.panel_startup_p90(T.inbox(spark, sf)))


@query(
    "panel_recent_errors",
    T.duck_cte() + " SELECT occurrence_timestamp_ms, module || '.' || name AS body, severity,"
    " event_id, CASE WHEN release_identity_quality = 'OCCURRENCE_BOUND' THEN app_version END AS"
    " service_version FROM t WHERE severity IN ('ERROR', 'FATAL') ORDER BY occurrence_timestamp_ms"
    " DESC, id DESC LIMIT 100",
)
def _(spark, sf):
    return PN.panel_recent_errors(T.telemetry(spark, sf))


DECISIONS = (
    "id AS decision_id", "tenant_id", "app_id", "environment", "app_version AS release_version",
    "CASE k % 3 WHEN 0 THEN 'continue' WHEN 1 THEN 'pause' ELSE 'rollback' END AS decision",
    "received_ms AS created_ms",
)


@query(
    "release_decisions",
    T.duck_cte() + f", d AS (SELECT {', '.join(DECISIONS)} FROM t) SELECT decision_id,"
    " release_version, decision, created_ms FROM d WHERE tenant_id = 'tenant-a' AND"
    " release_version = '2.0.0' ORDER BY created_ms DESC, decision_id DESC LIMIT 50",
)
def _(spark, sf):
    rows = T.telemetry(spark, sf).selectExpr(*DECISIONS)
    return MG.release_decisions(rows, T.SCOPE, 50, T.NEW).select(
        "decision_id", "release_version", "decision", "created_ms"
    )


CONFIGS = (
    "tenant_id", "app_id", "CASE k % 4 WHEN 0 THEN 'production' WHEN 1 THEN 'staging' ELSE"
    " 'env-' || cast(user_id % 20 AS {s}) END AS environment", "id AS revision", "k % 3 <> 0 AS"
    " active", "occurrence_timestamp_ms AS expires_ms", "k * 100 AS rollout_basis_points",
)


def _configs(s: str) -> str:
    return ", ".join(c.format(s=s) for c in CONFIGS)


@query(
    "active_config",
    T.duck_cte() + f", c AS (SELECT {_configs('varchar')} FROM t) SELECT DISTINCT ON (tenant_id,"
    " app_id, environment) tenant_id, app_id, environment, revision, rollout_basis_points,"
    f" expires_ms FROM c WHERE active AND expires_ms > {T.FROM_MS} ORDER BY tenant_id, app_id,"
    " environment, revision DESC",
)
def _(spark, sf):
    return MG.active_config(
        T.telemetry(spark, sf).selectExpr(*_columns(_configs("string"))), T.FROM_MS
    )


@query(
    "next_revision",
    T.duck_cte() + f", c AS (SELECT {_configs('varchar')} FROM t) SELECT tenant_id, app_id,"
    " environment, max(revision) + 1 AS next_revision FROM c GROUP BY ALL",
)
def _(spark, sf):
    return MG.next_revision(T.telemetry(spark, sf).selectExpr(*_columns(_configs("string"))))


SALTS = {"tenant-a": "0a" * 32, "tenant-b": "0b" * 32}


def _bucket_sql() -> str:
    cases = []
    for tenant, salt in SALTS.items():
        ipad, opad = (pad.hex() for pad in MG.key_pads(bytes.fromhex(salt)))
        cases.append(
            f"WHEN '{tenant}' THEN sha256(from_hex('{opad}' || sha256(from_hex('{ipad}' ||"
            " hex(encode(installation_id))))))"
        )
    digest = "CASE tenant_id " + " ".join(cases) + " END"
    return f"cast(cast('0x' || substring({digest}, 1, 16) AS ubigint) % 10000 AS int)"


@query(
    "rollout_bucket",
    T.duck_cte() + ", i AS (SELECT DISTINCT tenant_id, 'user-' || cast(user_id AS varchar) AS"
    " installation_id, cast(user_id % 3 * 5000 AS int) AS rollout_basis_points FROM t), b AS"
    f" (SELECT *, {_bucket_sql()} AS bucket FROM i) SELECT *, rollout_basis_points >= 10000 OR"
    " (rollout_basis_points > 0 AND bucket < rollout_basis_points) AS included FROM b",
)
def _(spark, sf):
    installs = T.telemetry(spark, sf).selectExpr(
        "tenant_id", "concat('user-', user_id) AS installation_id",
        "cast(user_id % 3 * 5000 AS int) AS rollout_basis_points",
    ).distinct()
    return MG.rollout_bucket(installs, MG.rollout_keys(spark, SALTS))


AUDIT = (
    "id AS audit_id", "tenant_id", "'actor-' || cast(k AS {s}) AS actor", "CASE WHEN k % 2 = 0 THEN"
    " 'query.trace.read' ELSE 'alert.acknowledge' END AS action", "'{{\"app_id\":\"' || CASE WHEN"
    " k % 7 = 0 THEN 'other' ELSE app_id END || '\"' || CASE WHEN k % 5 = 0 THEN '' ELSE"
    " ',\"environment\":\"' || CASE WHEN k % 3 = 0 THEN 'staging' ELSE 'production' END || '\"' END"
    " || '}}' AS details",
)


@query(
    "audit_trail",
    T.duck_cte() + f", a AS (SELECT {', '.join(c.format(s='varchar') for c in AUDIT)} FROM t)"
    " SELECT audit_id, tenant_id, actor, action FROM a WHERE tenant_id = 'tenant-a' AND"
    " json_extract_string(details, '$.app_id') = 'com.example' AND coalesce(json_extract_string("
    "details, '$.environment'), 'production') = 'production' ORDER BY audit_id DESC LIMIT 100",
)
def _(spark, sf):
    rows = T.telemetry(spark, sf).selectExpr(*[c.format(s="string") for c in AUDIT])
    return MG.audit_trail(rows, T.SCOPE)


CREDENTIAL = (
    "'key-' || cast(id AS {s}) AS key_id", "tenant_id", "app_id", "environment",
    "'desc ' || cast(k AS {s}) AS description", "'viewer' AS role", "k % 4 <> 0 AS active",
    "received_ms AS expires_ms", "occurrence_timestamp_ms AS created_ms",
)


@query(
    "credential_inventory",
    T.duck_cte() + f", c AS (SELECT id, {', '.join(x.format(s='varchar') for x in CREDENTIAL)} FROM"
    " t), a AS (SELECT CASE id % 3 WHEN 0 THEN 'query' WHEN 1 THEN 'ingest' ELSE 'ci' END AS kind,"
    " * FROM c WHERE tenant_id = 'tenant-a'), n AS (SELECT *, row_number() OVER (PARTITION BY kind"
    " ORDER BY created_ms DESC, key_id) AS rn FROM a) SELECT kind, key_id, description, CASE WHEN"
    " kind = 'query' THEN role END AS role, active, expires_ms, created_ms FROM n WHERE rn <= 200",
)
def _(spark, sf):
    keys = T.telemetry(spark, sf).selectExpr("id", *[x.format(s="string") for x in CREDENTIAL])
    return MG.credential_inventory(
        keys.filter("id % 3 = 0"), keys.filter("id % 3 = 1"), keys.filter("id % 3 = 2"), T.SCOPE
    )
