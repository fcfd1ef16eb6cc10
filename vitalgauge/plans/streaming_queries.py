"""Streaming jobs drained over files derived from the shared table, several micro-batches each."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vitalgauge.operators.admission import IdentityLayout
from vitalgauge.plans import telemetry as T
from vitalgauge.plans.registry import query
from vitalgauge.plans.scan_queries import FAMILY_SQL
from vitalgauge.plans.signal_queries import EPISODE_SQL, SLIDE_SQL, ticks
from vitalgauge.session import ensure_checkpoint_dir
from vitalgauge.streaming import jobs as J

SLICES = 3


def workspace(spark) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def in_slices(spark, df, order: str, folder: str, launch) -> None:
    """Feed rows in time order: write a slice, drain the stream, go on from its checkpoint."""
    path = f"{folder}/source"
    low, high = df.agg(F.min(order), F.max(order)).first()
    width = (high - low) // SLICES + 1
    for i in range(SLICES):
        start = low + i * width
        part = df.filter((F.col(order) >= start) & (F.col(order) < start + width))
        part.write.mode("append").parquet(path)
        launch(spark.readStream.schema(df.schema).parquet(path)).awaitTermination()


def sliced_events(spark, sf):
    """Event ids follow time; slicing by batch keeps the 25 events of a batch together."""
    return T.raw_events(spark, sf).withColumn("slice", F.expr("event_id - event_id % 25"))


@query(
    "stream_release_counts",
    T.duck_cte() + f", h AS (SELECT app_id, environment, app_version, {FAMILY_SQL} AS family,"
    " cast(floor(occurrence_timestamp_ms / 3600000e0) AS bigint) * 3600000 AS window_start_ms FROM"
    " t WHERE release_identity_quality = 'OCCURRENCE_BOUND') SELECT *, count(*) AS event_count FROM"
    " h GROUP BY ALL",
)
def _(spark, sf):
    folder = workspace(spark)
    log = J.release_count_log(f"{folder}/set")

    def launch(events):
        return J.stream_release_counts(T.map_events(events), log, f"{folder}/checkpoint", True, compact_every=2)

    in_slices(spark, sliced_events(spark, sf), "slice", folder, launch)
    return J.summed(log.read(spark, "counts"))


@query(
    "stream_rolling_alerts",
    T.duck_cte() + f", h AS (SELECT app_id, environment, {FAMILY_SQL} AS family, {SLIDE_SQL} FROM t,"
    " range(5) r(i) WHERE release_identity_quality = 'OCCURRENCE_BOUND' AND name IN ('java_crash',"
    " 'anr_detected')) SELECT *, count(*) AS incident_count FROM h GROUP BY ALL",
)
def _(spark, sf):
    folder = workspace(spark)
    log = J.rolling_alert_log(f"{folder}/set")

    def launch(events):
        return J.stream_rolling_alerts(T.map_events(events), log, f"{folder}/checkpoint", True, compact_every=2)

    in_slices(spark, sliced_events(spark, sf), "slice", folder, launch)
    return J.rolling_alerts(log.read(spark, "counts"))


@query(
    "stream_alert_episodes",
    f"{EPISODE_SQL} SELECT rule_id, evaluated_ms, 'FIRING' AS transition FROM f UNION ALL SELECT"
    " rule_id, evaluated_ms, 'RESOLVED' FROM r",
)
def _(spark, sf):
    folder = workspace(spark)
    source = ticks(spark, sf).selectExpr(
        "cast(rule_id AS bigint) AS rule_id", "evaluated_ms", "value", "sample_count", "state"
    )
    log = J.episode_log(f"{folder}/set")

    def launch(stream):
        return J.stream_alert_episodes(stream, log, f"{folder}/checkpoint", True, compact_every=2)

    in_slices(spark, source, "evaluated_ms", folder, launch)
    return log.read(spark, "transitions").select("rule_id", "evaluated_ms", "transition")


@query("stream_quota")
def _(spark, sf):
    """The same batches as ``admit_quota`` in three micro-batches; the test compares both."""
    folder = workspace(spark)
    source = quota_batches(spark, sf)
    log = J.quota_log(f"{folder}/set")

    def launch(stream):
        return J.stream_quota(stream, quota_limits(source), log, f"{folder}/checkpoint", True, compact_every=2)

    in_slices(spark, source, "received_ms", folder, launch)
    return log.read(spark, "admissions")


def quota_batches(spark, sf):
    return T.telemetry(spark, sf).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('key-', user_id % 5) END AS key_id",
        "occurrence_timestamp_ms - occurrence_timestamp_ms % 3600000 + k * 500 AS received_ms",
        "event_id AS batch_id",
        "cast(k AS bigint) AS event_count",
    )


def quota_limits(batches):
    return batches.select("key_id").distinct().selectExpr(
        "key_id", "3L AS requests_per_minute", "120L AS events_per_minute"
    )


# Requests of 25 events as line text. Every seventh request comes again 40 requests later, some with another scene;
# some carry one id twice with two contents; a few lines break a rule.
WIRE_BATCH = {
    "b": "cast(floor(id / 25e0) AS bigint)",
    "inst": "CASE WHEN cast(floor(id / 25e0) AS bigint) % 5 <> 0 THEN 'inst-' ||"
    " cast(cast(floor(id / 25e0) AS bigint) % 7 AS string) || '-device' END",
    "field": "CASE WHEN name = 'java_crash' THEN 'stackTrace' WHEN module = 'network' THEN 'statusCode' ELSE 'note' END",
    "field_value": "CASE WHEN name = 'java_crash' THEN 'at com.example.A.m' || cast(k % 10 AS string) || '(A.java:' ||"
    " cast(k AS string) || ')' WHEN module = 'network' THEN cast(200 + k AS string) ELSE 'n' || cast(k AS string) END",
}
WIRE_SCENE = (
    "CASE WHEN copy = 'z' AND b % 3 = 0 AND id % 25 = 0 THEN 'changed' WHEN copy = 'd' THEN 'twice' ELSE scene END"
)
WIRE_LINE = (
    "'ts=' || cast(occurrence_timestamp_ms AS string) || '|eventId=' || event_id || '|module=' || module || '|name=' ||"
    " name || '|kind=' || kind || '|severity=' || CASE WHEN id % 400 = 7 THEN 'LOUD' ELSE severity END || '|priority=' ||"
    " priority || '|process=' || process_name || '|thread=' || thread_name || CASE WHEN wire_scene IS NULL THEN '' ELSE"
    " '|scene=' || wire_scene END || '|fields=' || field || '=' || field_value || '|context=screen=home,user=' ||"
    " coalesce(inst, 'none') || CASE WHEN id % 400 = 133 THEN '|ts=1' ELSE '' END"
)
REQUEST = {
    "request_id": "CASE WHEN copy = 'z' THEN 'z' ELSE 'r' END || lpad(cast(b AS string), 9, '0')",
    "tenant_id": "CASE WHEN b % 2 = 0 THEN 'tenant-a' ELSE 'tenant-b' END",
    "declared_app_version": "CASE WHEN b % 4 <> 0 THEN '1.' || cast(b % 3 AS string) END",
    "ord": "CASE WHEN copy = 'z' THEN b + 40 ELSE b END",
}
STORED_JSON = (
    "'{\"event_id\":\"' || event_id || '\",\"extras\":{},\"field_types\":{},\"fields\":{\"' || field || '\":\"' ||"
    " field_value || '\"},\"foreground\":null,\"global_context\":{\"screen\":\"home\"' || CASE WHEN inst IS NULL THEN"
    " ',\"user\":\"none\"' ELSE '' END || '},\"kind\":\"' || kind || '\",\"module\":\"' || module || '\",\"name\":\"' ||"
    " name || '\",\"occurrence\":null,\"priority\":\"' || priority || '\",\"process_name\":\"' || process_name ||"
    " '\",\"scene\":' || CASE WHEN wire_scene IS NULL THEN 'null' ELSE '\"' || wire_scene || '\"' END ||"
    " ',\"severity\":\"' || severity || '\",\"thread_name\":\"' || thread_name || '\",\"timestamp\":' ||"
    " cast(occurrence_timestamp_ms AS string) || ',\"unknown\":{}}'"
)


def wire_batches(spark, sf):
    """The requests with their bytes, one row each; ``ord`` is the order of arrival."""
    copies = (
        "explode(concat(array('r'), if(b % 7 = 0, array('z'), array()), if(b % 11 = 5 AND id % 25 = 1, array('d'),"
        " array()))) AS copy"
    )
    rows = (
        T.telemetry(spark, sf)
        .drop("fields", "tenant_id")
        .selectExpr("*", *[f"{sql} AS {name}" for name, sql in WIRE_BATCH.items()])
        .selectExpr("*", copies)
        .selectExpr("*", f"{WIRE_SCENE} AS wire_scene", *[f"{sql} AS {name}" for name, sql in REQUEST.items()])
        .selectExpr("*", f"{WIRE_LINE} AS line", "if(copy = 'd', 1, 0) AS late")
    )
    body = "encode(array_join(transform(array_sort(collect_list(struct(late, id, line))), x -> x.line), '\n'), 'UTF-8') AS body"
    return (
        rows.groupBy("request_id", "tenant_id", "ord", "declared_app_version", "inst")
        .agg(F.expr(body.replace("\n", "\\n")))
        .selectExpr(
            "request_id", "tenant_id", "'com.example' AS app_id", "'production' AS environment", "'1' AS schema_version",
            "'1.0' AS sdk_version", "'line' AS protocol", "declared_app_version", "cast(NULL AS string) AS declared_app_build",
            "'77' AS declared_version_code", "cast(NULL AS string) AS declared_variant", "inst AS declared_installation_id",
            f"{T.NOW_MS} + ord AS received_ms", "body", "ord",
        )
    )


def ingested(spark, sf, compact_every: int = 2):
    """The log after three micro-batches; the third runs under a new key version."""
    from vitalgauge.plans.ingest_queries import keys

    folder = workspace(spark)
    versions = iter(("v1", "v1", "v2"))

    def launch(batches):
        return J.stream_ingest(
            batches, f"{folder}/set", f"{folder}/checkpoint", keys(spark), next(versions), True, compact_every,
            IdentityLayout(buckets=2),  # each micro-batch here spans many days
        )

    in_slices(spark, wire_batches(spark, sf), "ord", folder, launch)
    return J.ingest_log(f"{folder}/set")


def _ingest_sql() -> str:
    from vitalgauge.operators import identity as ID
    from vitalgauge.plans.ingest_queries import hmac_duck

    digests = " ".join(
        f"WHEN key_version = '{v}' THEN {hmac_duck(v, ID.INSTALLATION_DOMAIN, 'tenant_id', 'inst')}" for v in ("v1", "v2")
    )
    columns = ", ".join(f"{sql} AS {name}" for name, sql in WIRE_BATCH.items())
    request = ", ".join(f"{sql} AS {name}" for name, sql in REQUEST.items())
    return (
        T.duck_cte(
            extra=f"w AS (SELECT * EXCLUDE (tenant_id), {columns}, cast(row_number() OVER (PARTITION BY floor(id / 25e0)"
            " ORDER BY id) - 1 AS int) AS event_index FROM t), bad AS (SELECT DISTINCT b FROM w WHERE id % 400 IN (7, 133)),"
            " o AS (SELECT b AS ord FROM w UNION SELECT b + 40 FROM w WHERE b % 7 = 0), span AS (SELECT min(ord) AS lo,"
            " (max(ord) - min(ord)) // 3 + 1 AS width FROM o), taken AS (SELECT *, 'r' AS copy FROM w WHERE b % 11 <> 5 UNION"
            " ALL SELECT *, 'z' FROM w WHERE b % 11 = 5 AND b % 7 = 0), q AS (SELECT *,"
            f" {WIRE_SCENE} AS wire_scene, {request} FROM taken WHERE b NOT IN (SELECT b FROM bad)), h AS (SELECT q.*, CASE"
            " WHEN inst IS NOT NULL THEN CASE WHEN (ord - lo) // width < 2 THEN 'v1' ELSE 'v2' END END AS key_version FROM q,"
            f" span), p AS (SELECT *, {STORED_JSON} AS payload FROM h)"
        )
        + " SELECT tenant_id, event_id, app_id, environment, request_id, event_index, declared_app_version AS app_version,"
        " cast(NULL AS varchar) AS app_build, '77' AS version_code, 'line' AS protocol, 'AUTHENTICATED' AS"
        " scope_identity_quality, CASE WHEN declared_app_version IS NULL THEN 'ABSENT' ELSE 'REQUEST_DECLARED' END AS"
        " release_identity_quality, CASE WHEN inst IS NULL THEN 'ABSENT' ELSE 'REQUEST_DECLARED' END AS"
        f" installation_identity_quality, CASE {digests} END AS installation_hmac, key_version AS"
        " installation_hmac_key_version, 'ABSENT' AS session_identity_quality, cast(NULL AS varchar) AS session_hmac,"
        " occurrence_timestamp_ms AS event_timestamp_ms, occurrence_timestamp_ms, occurrence_timestamp_ms AS"
        " collection_timestamp_ms, 'EVENT_DECLARED' AS timestamp_quality, module, name, kind, severity, priority,"
        " process_name, thread_name, wire_scene AS scene, field || '=' || field_value AS field, CASE WHEN inst IS NULL THEN 2"
        " ELSE 1 END AS context_count, sha256(payload) AS payload_sha256, octet_length(encode(payload)) AS"
        " payload_size_bytes, 4 AS normalization_version, CASE WHEN module = 'network' THEN 200 + k END AS status_code, CASE"
        " WHEN name = 'java_crash' THEN sha256('[\"at com.example.A.m' || cast(k % 10 AS varchar) ||"
        f" '(A.java:<line>)\"]') END AS stack_fingerprint, {T.NOW_MS} + ord AS received_ms, 'pending' AS inbox_status FROM p"
    )


@query("stream_ingest", _ingest_sql())
def _(spark, sf):
    """The stored rows, from bytes: validation, conflicts, replays, key rotation, compaction."""
    stored = ingested(spark, sf).read(spark, "inbox")
    return stored.selectExpr(
        "tenant_id", "event_id", "app_id", "environment", "request_id", "event_index", "app_version", "app_build",
        "version_code", "protocol", "scope_identity_quality", "release_identity_quality", "installation_identity_quality",
        "installation_hmac", "installation_hmac_key_version", "session_identity_quality", "session_hmac",
        "event_timestamp_ms", "occurrence_timestamp_ms", "collection_timestamp_ms", "timestamp_quality", "module", "name",
        "kind", "severity", "priority", "process_name", "thread_name", "scene",
        "array_join(transform(map_entries(fields), e -> concat(e.key, '=', e.value)), ',') AS field",
        "size(global_context) AS context_count", "payload_sha256", "payload_size_bytes", "normalization_version",
        "try_element_at(ints, 'statusCode') AS status_code",
        # native families hash their backtrace, which line text doesn't carry
        "if(name = 'java_crash', incident_fingerprint, NULL) AS stack_fingerprint", "received_ms", "inbox_status",
    )


@query(
    "ingest_requests",
    T.duck_cte(
        extra="w AS (SELECT id, k, cast(floor(id / 25e0) AS bigint) AS b FROM t), n AS (SELECT b, count(*) AS n,"
        " bool_or(id % 400 IN (7, 133)) AS bad FROM w GROUP BY b), x AS (SELECT *, 'r' AS copy FROM n UNION ALL SELECT *, 'z'"
        " FROM n WHERE b % 7 = 0), y AS (SELECT *, CASE WHEN bad THEN 'QUARANTINED' WHEN copy = 'r' AND b % 11 = 5 THEN"
        " 'CONFLICT' WHEN copy = 'z' AND b % 11 <> 5 AND b % 3 = 0 THEN 'CONFLICT' ELSE 'ACCEPTED' END AS outcome, CASE WHEN"
        " copy = 'r' AND b % 11 = 5 THEN n + 1 ELSE n END AS received, copy = 'r' OR b % 11 = 5 AS first FROM x)"
    )
    + " SELECT copy || lpad(cast(b AS varchar), 9, '0') AS request_id, outcome, received, CASE WHEN outcome = 'ACCEPTED' AND"
    " first THEN received ELSE 0 END AS inserted, CASE WHEN outcome = 'ACCEPTED' AND NOT first THEN received ELSE 0 END AS"
    " duplicates FROM y",
)
def _(spark, sf):
    """What came of each request of ``stream_ingest``."""
    return ingested(spark, sf, 3).read(spark, "requests").select("request_id", "outcome", "received", "inserted", "duplicates")
