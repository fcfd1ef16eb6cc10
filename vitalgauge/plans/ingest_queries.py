"""Ingest queries: wire batches derived from the shared table, then every admission rule."""

from __future__ import annotations

import base64
from functools import lru_cache

from pyspark.sql import Window
from pyspark.sql import functions as F

from vitalgauge.operators import identity as ID
from vitalgauge.operators import ingest as IN
from vitalgauge.plans import telemetry as T
from vitalgauge.plans.registry import query
from vitalgauge.sources import line_batches as LB
from vitalgauge.sources import protobuf_batches as PB

BATCH = 25  # events per derived batch
ENCODED_BYTES = 1 << 20  # envelopes leave the encoder when they have so many bytes

# Events before validation; some values of k break one rule each.
WIRE = {
    "batch_no": "cast(floor(id / 25e0) AS bigint)",
    "event_index": "cast(id % 25 AS int)",
    "timestamp": f"CASE k WHEN 96 THEN -1 WHEN 89 THEN {T.NOW_MS} + 1000000000"
    " ELSE occurrence_timestamp_ms END",
    "event_id": "CASE k WHEN 93 THEN 'bad' || chr(7) WHEN 92 THEN '' WHEN 91 THEN repeat('x', 129)"
    " ELSE 'e' || cast(id AS string) END",
    "module": "CASE k WHEN 90 THEN '' ELSE module END",
    "name": "name",
    "kind": "CASE k WHEN 97 THEN 'BOGUS' ELSE kind END",
    "severity": "CASE k WHEN 88 THEN 'LOUD' ELSE severity END",
    "priority": "CASE k WHEN 87 THEN 'ASAP' ELSE priority END",
    "process_name": "process_name",
    "thread_name": "thread_name",
    "scene": "CASE k WHEN 86 THEN repeat('s', 257) ELSE scene END",
    "service_version": "CASE k WHEN 80 THEN ' 1.0' ELSE app_version END",
    "version_code": "CASE k WHEN 82 THEN '007' ELSE version_code END",
    "app_build": "app_build",
    "session_id": "CASE k WHEN 81 THEN 'nobody' ELSE '00000000-0000-4000-8000-' ||"
    " lpad(cast(user_id AS string), 12, '0') END",
    "installation_id": "'user-' || cast(user_id AS string) || '-id'",
    "device_model": "device_model",
    "os_version": "os_version",
    "map_key": "CASE k WHEN 85 THEN repeat('k', 129) ELSE 'note' END",
    "map_value": "CASE k WHEN 84 THEN repeat('v', 8193) ELSE 'text ' || cast(k AS string) END",
    "extra_entries": "CASE k WHEN 83 THEN 256 ELSE 0 END",
}


@lru_cache(maxsize=8)
def wire_events(spark, sf):
    """Events as decoded from the wire, with an occurrence snapshot."""
    flat = T.telemetry(spark, sf).selectExpr(
        "id", "k", "user_id", "tenant_id", "app_id", "environment", "sdk_version",
        "schema_version AS declared_schema",
        *[f"{sql} AS {name}" for name, sql in WIRE.items()],
    )
    return flat.selectExpr(
        "*",
        "concat('batch-', batch_no) AS batch_id",
        "true AS foreground",
        "map_concat(map(map_key, map_value), map_from_entries(transform(if(extra_entries > 0,"
        " sequence(1, extra_entries), cast(array() AS array<int>)), i -> struct(cast(i AS string),"
        " 'x')))) AS fields",
        "cast(map() AS map<string,string>) AS field_types",
        "map('user', installation_id, 'screen', 'home') AS global_context",
        "cast(map() AS map<string,string>) AS extras",
        "cast(map() AS map<string,string>) AS unknown",
        "named_struct('service_version', service_version, 'version_code', version_code,"
        " 'app_build', app_build, 'variant', 'release', 'installation_id', installation_id,"
        " 'session_id', session_id, 'device_model', device_model, 'os_version', os_version,"
        f" 'native_frames', cast(array() AS array<{PB._FRAME}>)) AS occurrence",
    )


WIRE_CTE = T.duck_cte(
    extra="wire AS (SELECT id, k, user_id, tenant_id, app_id, environment, sdk_version, "
    + ", ".join(f"{sql} AS {name}" for name, sql in WIRE.items())
    + ", 'batch-' || cast(cast(floor(id / 25e0) AS bigint) AS varchar) AS batch_id FROM t)"
)
ERROR_SQL = (
    "CASE WHEN timestamp <= 0 THEN 'INVALID_TIMESTAMP' WHEN octet_length(encode(event_id)) NOT BETWEEN"
    " 1 AND 128 OR event_id LIKE '%' || chr(7) THEN 'INVALID_EVENT_ID' WHEN module = '' THEN"
    " 'INVALID_MODULE' WHEN kind NOT IN ('METRIC', 'ALERT', 'FILE') THEN 'INVALID_KIND' WHEN"
    " severity NOT IN ('DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL') THEN 'INVALID_SEVERITY' WHEN"
    " priority NOT IN ('LOW', 'NORMAL', 'HIGH', 'CRITICAL') THEN 'INVALID_PRIORITY' WHEN"
    " length(scene) > 256 THEN 'INVALID_SCENE' WHEN length(map_key) > 128 OR length(map_value) >"
    " 8192 OR extra_entries + 1 > 256 THEN 'INVALID_FIELDS' WHEN service_version <>"
    " trim(service_version) THEN 'INVALID_OCCURRENCE' WHEN NOT regexp_full_match(version_code,"
    " '0|[1-9][0-9]*') THEN 'INVALID_VERSION_CODE' WHEN length(session_id) NOT IN (32, 36) THEN"
    f" 'INVALID_SESSION' WHEN timestamp > {T.NOW_MS} + 600000 THEN 'TIMESTAMP_IN_FUTURE' END"
)


def validated(spark, sf):
    return IN.validate_events(wire_events(spark, sf), T.NOW_MS)


@query("validate_events", f"{WIRE_CTE} SELECT id, {ERROR_SQL} AS error_code FROM wire")
def _(spark, sf):
    return validated(spark, sf).select("id", "error_code")


BAD_SQL = (
    f"{WIRE_CTE}, v AS (SELECT *, {ERROR_SQL} AS error_code FROM wire), b AS (SELECT batch_id,"
    " min(event_index) AS first_bad_index, arg_min(error_code, event_index) AS batch_error FROM v"
    " WHERE error_code IS NOT NULL GROUP BY 1)"
)


@query(
    "reject_invalid_batches",
    f"{BAD_SQL} SELECT v.batch_id, count(*) AS event_count, first_bad_index, batch_error FROM v"
    " LEFT JOIN b USING (batch_id) GROUP BY ALL",
)
def _(spark, sf):
    accepted, rejected = IN.reject_invalid_batches(validated(spark, sf))
    keys = ["batch_id", "first_bad_index", "batch_error"]
    return (
        accepted.selectExpr(
            "batch_id", "cast(NULL AS int) AS first_bad_index",
            "cast(NULL AS string) AS batch_error",
        )
        .unionByName(rejected.select(*keys))
        .groupBy(*keys)
        .agg(F.count("*").alias("event_count"))
    )


TYPES = (
    "NULL", "STRING", "BOOLEAN", "BYTE", "SHORT", "INT", "LONG", "FLOAT", "DOUBLE", "CHAR",
    "BIG_INTEGER", "BIG_DECIMAL", "OTHER",
)
TYPED = {
    "kind": "CASE id % 13 "
    + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TYPES))
    + " END",
    "text": "CASE k % 12 WHEN 0 THEN '' WHEN 1 THEN 'true' WHEN 2 THEN '007' WHEN 3 THEN 'NaN'"
    " WHEN 4 THEN '9223372036854775808' WHEN 5 THEN 'x' WHEN 6 THEN '1e9999' WHEN 7 THEN"
    " cast(v100 AS string) WHEN 8 THEN '-0' WHEN 9 THEN '12.50' WHEN 10 THEN"
    " cast(k - 60 AS string) ELSE '40000' END",
}
_CANON = "regexp_full_match(text, '0|-?[1-9][0-9]*')"


def _range_sql(low: int, high: int) -> str:
    return (
        f"CASE WHEN NOT {_CANON} THEN 'NOT_CANONICAL' WHEN try_cast(text AS hugeint) BETWEEN"
        f" {low} AND {high} THEN NULL ELSE 'OUT_OF_RANGE' END"
    )


@query(
    "decode_typed_values",
    T.duck_cte() + f", x AS (SELECT id, {TYPED['kind']} AS kind, {TYPED['text']} AS text FROM t)"
    " SELECT id, kind, CASE WHEN kind <> 'NULL' THEN text END AS value, CASE kind WHEN 'NULL' THEN"
    " CASE WHEN text <> '' THEN 'NULL_WITH_TEXT' END WHEN 'STRING' THEN NULL WHEN 'BOOLEAN' THEN"
    " CASE WHEN text NOT IN ('true', 'false') THEN 'NOT_BOOLEAN' END"
    f" WHEN 'BYTE' THEN {_range_sql(-128, 127)} WHEN 'SHORT' THEN {_range_sql(-32768, 32767)}"
    f" WHEN 'INT' THEN {_range_sql(-2147483648, 2147483647)}"
    f" WHEN 'LONG' THEN {_range_sql(-9223372036854775808, 9223372036854775807)}"
    " WHEN 'FLOAT' THEN CASE WHEN text <> 'NaN' AND NOT coalesce(isfinite(try_cast(text AS"
    " double)), FALSE) THEN 'NOT_A_NUMBER' END WHEN 'DOUBLE' THEN CASE WHEN text <> 'NaN' AND NOT"
    " coalesce(isfinite(try_cast(text AS double)), FALSE) THEN 'NOT_A_NUMBER' END WHEN 'CHAR' THEN"
    f" CASE WHEN length(text) <> 1 THEN 'NOT_ONE_CHARACTER' END WHEN 'BIG_INTEGER' THEN CASE WHEN"
    f" NOT {_CANON} THEN 'NOT_CANONICAL' END WHEN 'BIG_DECIMAL' THEN CASE WHEN NOT"
    " regexp_full_match(text, '-?(?:0|[1-9][0-9]*)(?:\\.[0-9]+)?') THEN 'NOT_CANONICAL' END ELSE"
    " 'UNKNOWN_TYPE' END AS error FROM x",
)
def _(spark, sf):
    typed = T.telemetry(spark, sf).selectExpr(
        "id",
        f"map('f', named_struct('type', {TYPED['kind']}, 'value', {TYPED['text']}))"
        " AS typed_fields",
    )
    return IN.decode_typed_values(typed).selectExpr(
        "id",
        "try_element_at(field_types, 'f') AS kind",
        "try_element_at(fields, 'f') AS value",
        "get(typed_errors, 0).error AS error",
    )


def ordered_batches(spark, sf):
    """Batches of 25 consecutive events with their ordered ids; the size is fixed."""
    return (
        T.telemetry(spark, sf)
        .selectExpr(
            "cast(floor(id / 25e0) AS bigint) AS batch_no", "id", "event_id",
            "if(cast(floor(id / 25e0) AS bigint) % 2 = 0, '3', '2') AS schema_version",
        )
        .groupBy("batch_no", "schema_version")
        .agg(
            F.expr("transform(array_sort(collect_list(struct(id, event_id))), x -> x.event_id)"
                   " AS event_ids")
        )
    )


@query(
    "verify_batch_identity",
    T.duck_cte() + ", x AS (SELECT id // 25 AS batch_no, CASE WHEN (id // 25) % 2 = 0 THEN '3'"
    " ELSE '2' END AS v, string_agg(lpad(to_hex(octet_length(encode(event_id))), 8, '0') ||"
    " hex(encode(event_id)), '' ORDER BY id) AS body FROM t GROUP BY 1, 2), y AS (SELECT batch_no,"
    " 'b' || v || '-' || substring(sha256(from_hex('0' || v || body)), 1, 32) AS"
    " expected_batch_id FROM x) SELECT batch_no, expected_batch_id, batch_no % 5 <> 0 AS"
    " batch_id_ok FROM y",
)
def _(spark, sf):
    batches = ordered_batches(spark, sf)
    claimed = batches.withColumn(
        "batch_id",
        F.expr(
            f"if(batch_no % 5 = 0, 'b3-wrong', {IN.stable_batch_id('schema_version', 'event_ids')})"
        ),
    )
    return IN.verify_batch_identity(claimed).select(
        "batch_no", "expected_batch_id", "batch_id_ok"
    )


HEADERS = (
    "id", "'com.example' AS service_name", "CASE k WHEN 1 THEN 'other' ELSE 'com.example' END AS"
    " header_app_id", "'production' AS deployment_environment", "CASE k WHEN 2 THEN 'staging' ELSE"
    " 'production' END AS header_environment", "sdk_version", "CASE k WHEN 3 THEN '9' ELSE"
    " sdk_version END AS header_sdk_version", "schema_version", "CASE k WHEN 4 THEN '1' ELSE"
    " schema_version END AS header_schema_version", "event_id AS batch_id", "CASE k WHEN 5 THEN"
    " NULL ELSE event_id END AS header_batch_id", "k AS event_count", "CASE k WHEN 6 THEN 0 ELSE k"
    " END AS header_event_count", "app_version AS service_version", "CASE WHEN k % 3 = 0 THEN NULL"
    " WHEN k % 7 = 0 THEN '0' ELSE app_version END AS header_app_version",
)


@query(
    "check_envelope_headers",
    T.duck_cte() + f", h AS (SELECT {', '.join(HEADERS)} FROM t) SELECT id, CASE WHEN header_app_id"
    " <> service_name THEN 'APP_ID_MISMATCH' WHEN header_environment <> deployment_environment THEN"
    " 'ENVIRONMENT_MISMATCH' WHEN header_sdk_version <> sdk_version THEN 'SDK_VERSION_MISMATCH'"
    " WHEN header_schema_version <> schema_version THEN 'SCHEMA_VERSION_MISMATCH' WHEN"
    " header_batch_id IS NULL THEN 'BATCH_ID_MISMATCH' WHEN header_event_count <> event_count THEN"
    " 'EVENT_COUNT_MISMATCH' WHEN schema_version = '2' AND header_app_version <> service_version"
    " THEN 'APP_VERSION_MISMATCH' END AS header_error FROM h",
)
def _(spark, sf):
    return IN.check_envelope_headers(T.telemetry(spark, sf).selectExpr(*HEADERS)).select(
        "id", "header_error"
    )


def declared(spark, sf):
    """Wire events, a third of them without an occurrence snapshot."""
    return wire_events(spark, sf).drop(
        "service_version", "version_code", "app_build", "session_id", "installation_id"
    ).selectExpr(
        "* EXCEPT (occurrence)",
        "if(id % 3 = 0, NULL, occurrence) AS occurrence",
        "if(id % 2 = 0, '2', '1') AS schema_version",
        "if(id % 5 = 0, NULL, '9.9') AS declared_app_version",
        "cast(NULL AS string) AS declared_app_build",
        "'77' AS declared_version_code",
        "'debug' AS declared_variant",
        "if(id % 7 = 0, NULL, concat('head-', user_id)) AS declared_installation_id",
    )


@query(
    "resolve_identity",
    f"{WIRE_CTE} SELECT id, CASE WHEN id % 3 <> 0 THEN service_version WHEN id % 5 <> 0 THEN '9.9'"
    " END AS app_version, CASE WHEN id % 3 <> 0 THEN version_code ELSE '77' END AS version_code,"
    " CASE WHEN id % 3 <> 0 THEN 'release' ELSE 'debug' END AS variant, CASE WHEN id % 3 <> 0 THEN"
    " 'OCCURRENCE_BOUND' WHEN id % 2 = 0 THEN 'BATCH_DECLARED' WHEN id % 5 <> 0 THEN"
    " 'REQUEST_DECLARED' ELSE 'ABSENT' END AS release_identity_quality, CASE WHEN id % 3 <> 0 THEN"
    " 'OCCURRENCE_BOUND' WHEN id % 2 = 0 THEN 'BATCH_DECLARED' WHEN id % 7 <> 0 THEN"
    " 'REQUEST_DECLARED' ELSE 'ABSENT' END AS installation_identity_quality, CASE WHEN id % 3 <> 0"
    " THEN 'OCCURRENCE_BOUND' ELSE 'ABSENT' END AS session_identity_quality FROM wire",
)
def _(spark, sf):
    return ID.resolve_identity(declared(spark, sf)).select(
        "id", "app_version", "version_code", "variant", "release_identity_quality",
        "installation_identity_quality", "session_identity_quality",
    )


# Test keys of the derived rows; never used outside these queries.
KEYS = {v: bytes(range(i, i + 32)) for i, v in enumerate(("v1", "v2"), start=1)}


def keys(spark):
    return ID.key_ring(spark, {v: base64.b64encode(k).decode() for v, k in KEYS.items()})


def identified(spark, sf):
    rows = ID.resolve_identity(declared(spark, sf))
    return rows


def hmac_duck(version: str, domain: str, tenant: str, identity: str) -> str:
    ipad, opad = (pad.hex() for pad in ID.key_pads(KEYS[version]))
    message = (
        f"'{domain.encode().hex()}00' || hex(encode({tenant})) || '00' ||"
        f" hex(encode({identity}))"
    )
    return f"sha256(from_hex('{opad}' || sha256(from_hex('{ipad}' || {message}))))"


PLAIN_SQL = (
    "CASE WHEN id % 3 <> 0 THEN installation_id WHEN id % 7 <> 0 THEN 'head-' || cast(user_id AS"
    " varchar) END"
)
SESSION_SQL = "CASE WHEN id % 3 <> 0 THEN session_id END"


@query(
    "pseudonymize_ids",
    f"{WIRE_CTE}, p AS (SELECT *, {PLAIN_SQL} AS plain, {SESSION_SQL} AS sess FROM wire) SELECT id,"
    f" CASE WHEN plain IS NOT NULL THEN"
    f" {hmac_duck('v2', ID.INSTALLATION_DOMAIN, 'tenant_id', 'plain')} END AS installation_hmac,"
    " CASE WHEN plain IS NOT NULL THEN 'v2' END AS installation_hmac_key_version, CASE WHEN sess IS"
    f" NOT NULL THEN {hmac_duck('v2', ID.SESSION_DOMAIN, 'tenant_id', 'sess')} END AS session_hmac,"
    " CASE WHEN sess IS NOT NULL THEN 'v2' END AS session_hmac_key_version FROM p",
)
def _(spark, sf):
    return ID.pseudonymize_ids(identified(spark, sf), keys(spark), "v2").select(
        "id", "installation_hmac", "installation_hmac_key_version", "session_hmac",
        "session_hmac_key_version",
    )


@query(
    "match_rotated_identity",
    f"{WIRE_CTE}, p AS (SELECT *, {PLAIN_SQL} AS plain FROM wire), s AS (SELECT *, CASE WHEN plain IS NULL THEN NULL WHEN"
    " k % 10 = 0 THEN 'v9' WHEN k % 2 = 0 THEN 'v1' ELSE 'v2' END AS v FROM p QUALIFY row_number() OVER (PARTITION BY"
    " tenant_id, event_id ORDER BY id) = 1) SELECT p.tenant_id, p.event_id, s.v AS key_version, CASE WHEN p.plain IS NULL"
    " THEN s.plain IS NULL WHEN s.plain IS NULL OR s.v = 'v9' THEN FALSE ELSE s.k % 5 <> 1 AND s.plain = p.plain END AS"
    " matches FROM p JOIN s ON s.tenant_id = p.tenant_id AND s.event_id = p.event_id",
)
def _(spark, sf):
    """Replays of every wire event against the first stored row of its id; a few ids carry many events."""
    rows = identified(spark, sf)
    old = ID.pseudonymize_ids(rows, keys(spark), "v1").select("id", "installation_hmac")
    new = ID.pseudonymize_ids(rows, keys(spark), "v2").select(
        "id", F.col("installation_hmac").alias("other_hmac")
    )
    first = Window.partitionBy("tenant_id", "event_id").orderBy("id")
    stored = (
        rows.select("id", "k", "tenant_id", "event_id")
        .withColumn("copy", F.row_number().over(first))
        .filter("copy = 1")
        .join(old, "id")
        .join(new, "id")
        .selectExpr(
            "tenant_id",
            "event_id",
            "CASE WHEN installation_hmac IS NULL THEN NULL WHEN k % 10 = 0 THEN 'v9' WHEN k % 2 = 0"
            " THEN 'v1' ELSE 'v2' END AS installation_hmac_key_version",
            "CASE WHEN installation_hmac IS NULL THEN NULL WHEN k % 5 = 1 THEN 'tampered' WHEN"
            " k % 2 = 0 THEN installation_hmac ELSE other_hmac END AS installation_hmac",
        )
    )
    return ID.match_rotated_identity(rows, stored, keys(spark))


@query(
    "scrub_identifiers",
    f"{WIRE_CTE}, p AS (SELECT *, {PLAIN_SQL} AS plain FROM wire) SELECT id, extra_entries + 1 AS"
    " field_count, CASE WHEN coalesce(contains(installation_id, plain), FALSE) THEN 1 ELSE 2 END"
    " AS context_count FROM p",
)
def _(spark, sf):
    return ID.scrub_identifiers(identified(spark, sf)).selectExpr(
        "id", "size(fields) AS field_count", "size(global_context) AS context_count"
    )


@query(
    "reject_identity_leak",
    T.duck_cte() + " SELECT id, coalesce(contains(process_name, 'push') AND k % 10 = 0, FALSE) OR"
    " (k % 10 = 5 AND contains(name, 'crash')) AS identity_leak FROM t",
)
def _(spark, sf):
    rows = T.telemetry(spark, sf).selectExpr(
        "*",
        "CASE WHEN k % 10 = 0 THEN 'push' WHEN k % 10 = 1 THEN '' END AS installation_plaintext",
        "CASE WHEN k % 10 = 5 THEN 'crash' END AS session_plaintext",
    )
    # Versions and thread names of the mapped rows never contain either word.
    return ID.reject_identity_leak(rows.drop("event_id").withColumn("event_id", F.lit("e"))
                                   .withColumn("module", F.lit("m"))).select(
        "id", "identity_leak"
    )


# Payload rows also carry a typed double and one native frame, with a load bias in every second.
RATIO = (
    "CASE k % 5 WHEN 0 THEN '1e16' WHEN 1 THEN '0.0001' WHEN 2 THEN '-12345678.5' WHEN 3 THEN"
    " '1E-7' ELSE '250' END"
)
JSON_SQL = (
    "'{\"event_id\":\"' || replace(event_id, chr(7), '\\u0007') ||"
    " '\",\"extras\":{},\"field_types\":{\"ratio\":\"DOUBLE\"},\"fields\":{' || CASE WHEN"
    " extra_entries > 0 THEN (SELECT string_agg('\"' || n || '\":\"x\",', '' ORDER BY n) FROM"
    " (SELECT cast(unnest(range(1, 257)) AS varchar) AS n)) ELSE '' END || '\"' ||"
    " map_key || '\":\"' || map_value || '\",\"ratio\":' ||"
    f" cast(cast({RATIO} AS double) AS varchar)"
    " || '},\"foreground\":true,\"global_context\":{\"screen\":"
    "\"home\",\"user\":\"' || installation_id || '\"},\"kind\":\"' || kind || '\",\"module\":\"' ||"
    " module || '\",\"name\":\"' || name || '\",\"occurrence\":{\"app_build\":\"' || app_build ||"
    " '\",' || CASE WHEN device_model IS NULL THEN '' ELSE '\"device_model\":\"' || device_model ||"
    " '\",' END || '\"native_frames\":[{\"abi\":\"arm64\",\"load_bias\":' || CASE WHEN k % 2 = 0"
    " THEN 'null' ELSE '4096' END || ',\"module_build_id\":\"b1\",\"module_name\":\"lib.so\","
    "\"module_relative_pc\":' || cast(k AS varchar) || '}],' || CASE WHEN os_version IS NULL THEN '' ELSE"
    " '\"os_version\":\"' || os_version || '\",' END || '\"service_version\":\"' || service_version"
    " || '\",\"variant\":\"release\",\"version_code\":\"'"
    " || version_code || '\"},\"priority\":\"' || priority || '\",\"process_name\":\"' ||"
    " process_name || '\",\"scene\":' || CASE WHEN scene IS NULL THEN 'null' ELSE '\"' || scene ||"
    " '\"' END || ',\"severity\":\"' || severity || '\",\"thread_name\":\"' || thread_name ||"
    " '\",\"timestamp\":' || cast(timestamp AS varchar) || ',\"unknown\":{}}'"
)


def payload_rows(spark, sf):
    frame = (
        "named_struct('abi', 'arm64', 'module_build_id', 'b1', 'module_name', 'lib.so',"
        " 'module_relative_pc', k, 'load_bias', if(k % 2 = 0, NULL, 4096))"
    )
    frames = F.expr(f"cast(array({frame}) AS array<{PB._FRAME}>)")
    return wire_events(spark, sf).withColumns({
        "fields": F.expr(f"map_concat(fields, map('ratio', {RATIO}))"),
        "field_types": F.expr("map('ratio', 'DOUBLE')"),
        "occurrence": F.col("occurrence").withField("native_frames", frames),
    })


@query(
    "canonical_payload_hash",
    f"{WIRE_CTE} SELECT id, sha256({JSON_SQL}) AS payload_sha256, octet_length(encode({JSON_SQL})) AS"
    " payload_size_bytes FROM wire",
)
def _(spark, sf):
    rows = payload_rows(spark, sf)
    return IN.canonical_payload_hash(rows).select("id", "payload_sha256", "payload_size_bytes")


@query(
    "event_size_limit",
    f"{WIRE_CTE} SELECT id, octet_length(encode({JSON_SQL})) > 1000 AS too_large FROM wire",
)
def _(spark, sf):
    rows = payload_rows(spark, sf)
    return IN.event_size_limit(IN.canonical_payload_hash(rows), limit=1_000).select(
        "id", "too_large"
    )


# Arrivals: most rows once, every seventh twice, and copies whose content differs for k % 25 = 3.
# One event id carries a third of all arrivals.
ARRIVAL = (
    "tenant_id, CASE WHEN id % 3 = 1 THEN 'e-hot' ELSE event_id END AS event_id, 'b' ||"
    " lpad(cast(cast(floor(id / 25e0) AS bigint) AS {s}), 9, '0') AS batch_id,"
    " cast(id % 25 AS int) AS event_index"
)
SIGN = (
    "CASE WHEN id % 3 = 1 THEN 'same' ELSE 'sha-' || cast(id AS {s}) END AS payload_sha256,"
    " CASE WHEN id % 3 = 1 THEN '1.0.0' ELSE app_version END AS app_version, 'b' AS app_build,"
    " '1' AS version_code, 'release' AS variant, 'OCCURRENCE_BOUND' AS release_identity_quality,"
    " 'OCCURRENCE_BOUND' AS installation_identity_quality, CASE WHEN id % 3 = 1 THEN NULL ELSE"
    " installation_hmac END AS installation_hmac, session_hmac, app_id, environment"
)


def arrivals(spark, sf):
    rows = T.telemetry(spark, sf).withColumn(
        "session_hmac", F.expr("if(id % 3 = 1, NULL, session_hmac)")
    )
    once = rows.selectExpr(
        *_columns(ARRIVAL.format(s="string")), *_columns(SIGN.format(s="string"))
    )
    again = rows.filter("id % 7 = 0").selectExpr(
        *_columns(ARRIVAL.format(s="string")), *_columns(SIGN.format(s="string")), "k", "id"
    )
    changed = F.expr("if(k % 25 = 3 AND id % 3 <> 1, 'other', payload_sha256)")
    return once.unionByName(
        again.withColumn("payload_sha256", changed)
        .withColumn("event_index", F.expr("event_index + 25"))
        .drop("k", "id")
    )


def stored_rows(spark, sf):
    rows = T.telemetry(spark, sf).withColumn(
        "session_hmac", F.expr("if(id % 3 = 1, NULL, session_hmac)")
    ).filter("inbox_status = 'delivered'")
    mine = rows.selectExpr(
        "tenant_id", "event_id", *_columns(SIGN.format(s="string")), "k"
    )
    return mine.withColumn(
        "app_version", F.expr("if(k % 20 = 9, '0.0', app_version)")
    ).drop("k")


def _columns(text: str) -> list[str]:
    from vitalgauge.plans.signal_queries import _split

    return _split(text)


ARRIVAL_CTE = T.duck_cte(
    extra="t2 AS (SELECT * REPLACE (CASE WHEN id % 3 = 1 THEN NULL ELSE session_hmac END AS"
    f" session_hmac) FROM t), once AS (SELECT {ARRIVAL.format(s='varchar')},"
    f" {SIGN.format(s='varchar')} FROM t2), again AS (SELECT"
    f" {ARRIVAL.format(s='varchar')}, {SIGN.format(s='varchar')}, k, id FROM t2 WHERE"
    " id % 7 = 0), a AS (SELECT * FROM once UNION ALL BY NAME SELECT * EXCLUDE (k, id) REPLACE"
    " (CASE WHEN k % 25 = 3 AND id % 3 <> 1 THEN 'other' ELSE payload_sha256 END AS payload_sha256,"
    " event_index + 25 AS event_index) FROM again), st AS (SELECT tenant_id, event_id,"
    f" {SIGN.format(s='varchar')}, k FROM t2 WHERE inbox_status = 'delivered'), s AS"
    " (SELECT * EXCLUDE (k) REPLACE (CASE WHEN k % 20 = 9 THEN '0.0' ELSE app_version END AS"
    " app_version) FROM st)"
)


@query(
    "dedup_events",
    f"{ARRIVAL_CTE}, f AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, event_id ORDER BY"
    " batch_id, event_index) AS rn FROM a WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.tenant_id ="
    " a.tenant_id AND s.event_id = a.event_id)) SELECT tenant_id, event_id, batch_id, event_index"
    " FROM f WHERE rn = 1",
)
def _(spark, sf):
    return IN.dedup_events(arrivals(spark, sf), stored_rows(spark, sf)).select(
        "tenant_id", "event_id", "batch_id", "event_index"
    )


_SIG = ", ".join(IN.SIGNATURE)


@query(
    "detect_event_conflicts",
    f"{ARRIVAL_CTE} SELECT tenant_id, batch_id, event_id, 'BATCH' AS conflict FROM a GROUP BY ALL"
    f" HAVING count(DISTINCT ({_SIG})) > 1 UNION ALL SELECT DISTINCT a.tenant_id, a.batch_id,"
    " a.event_id, 'STORED' FROM a JOIN s ON s.tenant_id = a.tenant_id AND s.event_id = a.event_id"
    " WHERE " + " OR ".join(f"a.{c} IS DISTINCT FROM s.{c}" for c in IN.SIGNATURE),
)
def _(spark, sf):
    return IN.detect_event_conflicts(arrivals(spark, sf), stored_rows(spark, sf))


@query(
    "ingest_summary",
    f"{ARRIVAL_CTE}, f AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, event_id ORDER BY"
    " batch_id, event_index) AS rn, EXISTS (SELECT 1 FROM s WHERE s.tenant_id = a.tenant_id AND"
    " s.event_id = a.event_id) AS stored FROM a) SELECT batch_id, count(*) AS received, count(*)"
    " FILTER (rn = 1 AND NOT stored) AS inserted, count(*) - count(*) FILTER (rn = 1 AND NOT"
    " stored) AS duplicates FROM f GROUP BY batch_id",
)
def _(spark, sf):
    new = arrivals(spark, sf)
    return IN.ingest_summary(new, IN.dedup_events(new, stored_rows(spark, sf)))


@query("admit_quota")
def _(spark, sf):
    """Every event is a batch of k events; one key sends a third of them."""
    from vitalgauge.plans.streaming_queries import quota_batches, quota_limits

    batches = quota_batches(spark, sf)
    return IN.admit_quota(batches, quota_limits(batches))


@query(
    "admit_capacity",
    T.duck_cte() + " SELECT count(*) FILTER (inbox_status IN ('pending', 'processing',"
    " 'awaiting_symbols')) AS live_events, cast(sum(payload_size_bytes) FILTER (raw_pruned_ms IS"
    " NULL) AS bigint) AS raw_bytes, count(*) FILTER (inbox_status IN ('pending', 'processing'))"
    " <= 100000 AND sum(payload_size_bytes) FILTER (raw_pruned_ms IS NULL) <= 10737418240 AS"
    " admitted FROM t",
)
def _(spark, sf):
    return IN.admit_capacity(T.telemetry(spark, sf))


# Line protocol text of the mapped events; some lines are malformed.
LINE = (
    "'ts=' || cast(occurrence_timestamp_ms AS string) || '|eventId=' || event_id || '|module=' ||"
    " module || '|name=' || name || '|kind=' || kind || '|severity=' || severity || '|priority=' ||"
    " priority || '|process=' || process_name || '|thread=' || thread_name ||"
    " CASE WHEN k % 4 = 0 THEN '|foreground=true' ELSE '' END ||"
    " CASE WHEN k = 3 THEN '|foreground=yes' ELSE '' END ||"
    " '|fields=a=1,b=x=y,c=' || cast(k AS string) || CASE WHEN k = 5 THEN ',a=2' ELSE '' END ||"
    " CASE WHEN k = 7 THEN '|ts=1' ELSE '' END || '|extra=z' ||"
    " CASE WHEN k % 6 = 0 THEN chr(13) ELSE '' END"
)


def line_bodies(spark, sf):
    """Wire text of batches of 25 events; the size is fixed."""
    return (
        T.telemetry(spark, sf)
        .selectExpr("concat('line-', cast(floor(id / 25e0) AS bigint)) AS batch_id", "id",
                    f"{LINE} AS line")
        .groupBy("batch_id")
        .agg(
            F.expr(
                "encode(concat(array_join(transform(array_sort(collect_list(struct(id, line))),"
                " x -> x.line), chr(10)), chr(10)), 'UTF-8') AS body"
            )
        )
    )


@query(
    "read_line_batches",
    T.duck_cte() + " SELECT 'line-' || cast(cast(floor(id / 25e0) AS bigint) AS varchar) AS"
    " batch_id, cast(row_number() OVER (PARTITION BY floor(id / 25e0) ORDER BY id) - 1 AS int) AS"
    " event_index, CASE WHEN k NOT IN (7) THEN event_id END AS event_id, CASE WHEN k NOT IN (7)"
    " THEN occurrence_timestamp_ms END AS timestamp, CASE WHEN k IN (5, 7) THEN 0 ELSE 3 END AS"
    " field_count, CASE WHEN k NOT IN (5, 7) THEN 'x=y' END AS b, CASE WHEN k <> 7 THEN 'z' END AS"
    " extra, CASE k WHEN 3 THEN 'INVALID_FOREGROUND' WHEN 5 THEN 'INVALID_MAP' WHEN 7 THEN"
    " 'INVALID_SEGMENTS' END AS decode_error FROM t",
)
def _(spark, sf):
    return LB.decode_line_batches(line_bodies(spark, sf)).selectExpr(
        "batch_id", "event_index", "event_id", "timestamp", "size(fields) AS field_count",
        "try_element_at(fields, 'b') AS b", "try_element_at(unknown, 'extra') AS extra",
        "decode_error",
    )


def plain_rows(frames):
    """Rows of Arrow batches as dictionaries, some hundreds at a time."""
    import pyarrow as pa

    def values(column):
        if column.null_count and not pa.types.is_string(column.type):
            return column.to_pylist()  # numpy has no missing integers
        return column.to_numpy(zero_copy_only=False).tolist()

    for frame in frames:
        for at in range(0, frame.num_rows, 500):
            part = frame.slice(at, 500)
            for row in zip(*map(values, part.columns)):
                yield dict(zip(part.schema.names, row))


def encode_envelopes(batches):
    """Schema-3 envelopes of ``(source, batch_id, events)`` rows, for deriving wire bytes.

    Events are handed to Python one a row: an Arrow batch holds as many whatever the size of batches.
    """

    def encode(frames):
        import pyarrow as pa

        new = PB.message_classes()["Envelope"]
        schema = pa.schema({"source": pa.string(), "body": pa.binary()})
        done, size, left = [], 0, 0
        for row in plain_rows(frames):
            if not left:
                left = max(row["n"], 1)
                envelope = new(
                    schema_version=3, sdk_name="sdk", sdk_version="1.0", batch_id=row["batch_id"],
                    sent_at_ms=1,
                )
                envelope.resource.service_name = "com.example"
                envelope.resource.service_version = "1.0.0"
                envelope.resource.deployment_environment = "production"
            if row["n"]:
                message = envelope.events.add(
                    timestamp=row["timestamp"], event_id=row["event_id"], module=row["module"],
                    name=row["name"], kind=row["kind"], severity=row["severity"],
                    priority=row["priority"], process_name=row["process_name"],
                    thread_name=row["thread_name"],
                )
                typed, occurrence = message.typed_fields["k"], message.occurrence
                typed.type = "INT"
                typed.value = row["k"]
                occurrence.service_version = row["app_version"]
                occurrence.version_code = "1"
                occurrence.app_build = "b"
                occurrence.variant = "release"
                occurrence.installation_id = "i"
            left -= 1
            if not left:
                done.append({"source": row["source"], "body": envelope.SerializeToString()})
                size += len(done[-1]["body"])
            if size >= ENCODED_BYTES:
                yield pa.RecordBatch.from_pylist(done, schema)
                done, size = [], 0
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    events = batches.selectExpr("source", "batch_id", "size(events) AS n", "inline_outer(events)")
    return events.mapInArrow(encode, "source string, body binary")


@query(
    "read_protobuf_batches",
    T.duck_cte() + " SELECT event_id, occurrence_timestamp_ms AS timestamp, module, name,"
    " cast(row_number() OVER (PARTITION BY floor(id / 25e0) ORDER BY id) - 1 AS int) AS"
    " event_index, app_version, 'INT' AS k_type, cast(k AS varchar) AS k_value, cast(NULL AS"
    " varchar) AS error_code FROM t",
)
def _(spark, sf):
    columns = (
        "id", "event_id", "occurrence_timestamp_ms AS timestamp", "module", "name", "kind",
        "severity", "priority", "process_name", "thread_name", "app_version",
        "cast(k AS string) AS k",
    )
    batches = (
        T.telemetry(spark, sf)
        .selectExpr(
            "concat('p-', cast(floor(id / 25e0) AS bigint)) AS source",
            f"struct({', '.join(c.split(' AS ')[0] for c in columns[:2])},"
            " occurrence_timestamp_ms AS timestamp, module, name, kind, severity, priority,"
            " process_name, thread_name, app_version, cast(k AS string) AS k) AS e",
        )
        .groupBy("source")
        .agg(F.array_sort(F.collect_list("e")).alias("events"))
        .selectExpr(
            "source",
            f"{IN.stable_batch_id(repr('3'), 'transform(events, e -> e.event_id)')} AS batch_id",
            "events",
        )
    )
    decoded = PB.decode_protobuf_batches(encode_envelopes(batches), enveloped=True)
    return PB.check_envelopes(decoded, "3", sdk_name="sdk").selectExpr(
        "event_id", "timestamp", "module", "name", "event_index",
        "occurrence.service_version AS app_version",
        "try_element_at(typed_fields, 'k').type AS k_type",
        "try_element_at(typed_fields, 'k').value AS k_value",
        "error_code",
    )


INBOX_COLUMNS = (
    "tenant_id", "event_id", "app_id", "environment", "app_version", "release_identity_quality", "installation_hmac",
    "session_hmac", "device_model", "os_version", "occurrence_timestamp_ms", "module", "name", "kind", "severity", "scene",
    "received_ms", "inbox_status",
)


@query(
    "write_inbox",
    T.duck_cte() + f" SELECT {', '.join(INBOX_COLUMNS)}, cast(to_timestamp(occurrence_timestamp_ms / 1000) AT TIME ZONE"
    " 'UTC' AS date) AS occurrence_date FROM t",
)
def _(spark, sf):
    """The mapped rows in four commits, one of them tried twice, read back behind a compaction."""
    import uuid

    from vitalgauge.session import ensure_checkpoint_dir
    from vitalgauge.sources.commit_log import CommitLog
    from vitalgauge.sources.inbox import INBOX, PARTITIONS, with_partition_date

    schema = ", ".join(f"{c} {'bigint' if c.endswith('_ms') else 'string'}" for c in INBOX_COLUMNS)
    layout = type(INBOX)(f"{schema}, occurrence_date date", PARTITIONS, INBOX.order)
    log = CommitLog(f"{ensure_checkpoint_dir(spark)}/inbox-{uuid.uuid4().hex}", {"inbox": layout})
    rows = with_partition_date(T.telemetry(spark, sf).select("id", *INBOX_COLUMNS))
    for epoch in (0, 1, 1, 2, 3):
        log.append(spark, {"inbox": rows.where(F.col("id") % 4 == epoch)}, epoch)
    log.compact(spark, "inbox")
    return log.read(spark, "inbox")
