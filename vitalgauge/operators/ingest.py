"""Ingest rules: validation, batch identity, whole-batch rejection, dedup, conflicts, admission."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalgauge import constants as C
from vitalgauge.functions.events import quoted
from vitalgauge.functions.metrics import ladder, lit
from vitalgauge.functions.text import (
    CANONICAL_INTEGER,
    json_string,
    lower_escapes,
    parse_double,
    python_double,
    raw,
    untrimmed,
)

KINDS = quoted(("METRIC", "ALERT", "FILE"))
SEVERITIES = quoted(("DEBUG", "INFO", "WARN", "ERROR", "FATAL"))
PRIORITIES = quoted(("LOW", "NORMAL", "HIGH", "CRITICAL"))
MAPS = ("fields", "field_types", "global_context", "extras", "unknown")
_UUID = raw(
    r"^([0-9a-fA-F]{32}|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-"
    r"[0-9a-fA-F]{12})$"
)
_CONTROL = raw(r"[\x00-\x1F\x7F]")
_INTEGER_RANGES = {
    "BYTE": (-128, 127),
    "SHORT": (-32_768, 32_767),
    "INT": (-2_147_483_648, 2_147_483_647),
    "LONG": (-9_223_372_036_854_775_808, 9_223_372_036_854_775_807),
}
_MAX_PRECISE_TEXT = 4_096
# Last millisecond a calendar date can express.
_LAST_MS = 253_402_300_799_999


def typed_value_error(kind: str, value: str) -> str:
    """SQL: why a typed scalar is rejected, or null. Text must be canonical for its type."""
    integer = f"({value} rlike {raw(CANONICAL_INTEGER)})"
    rules = [
        (f"{kind} = 'NULL'", f"if({value} <> '', 'NULL_WITH_TEXT', NULL)"),
        (f"{kind} = 'STRING'", "NULL"),
        (f"{kind} = 'BOOLEAN'", f"if({value} IN ('true', 'false'), NULL, 'NOT_BOOLEAN')"),
    ]
    for name, (low, high) in _INTEGER_RANGES.items():
        number = f"try_cast({value} AS decimal(38,0))"
        rules.append(
            (
                f"{kind} = '{name}'",
                f"CASE WHEN NOT {integer} THEN 'NOT_CANONICAL' WHEN"
                f" coalesce({number} BETWEEN {low}BD AND {high}BD, false) THEN NULL"
                " ELSE 'OUT_OF_RANGE' END",
            )
        )
    rules += [
        (
            f"{kind} IN ('FLOAT', 'DOUBLE')",
            f"if({value} IN ('NaN', 'Infinity', '-Infinity') OR {parse_double(value)} IS NOT NULL,"
            " NULL, 'NOT_A_NUMBER')",
        ),
        (f"{kind} = 'CHAR'", f"if(length({value}) = 1, NULL, 'NOT_ONE_CHARACTER')"),
        (
            f"{kind} = 'BIG_INTEGER'",
            f"if({integer} AND length({value}) <= {_MAX_PRECISE_TEXT}, NULL, 'NOT_CANONICAL')",
        ),
        (
            f"{kind} = 'BIG_DECIMAL'",
            f"if({value} rlike r'^-?(?:0|[1-9][0-9]*)(?:\\.[0-9]+)?$'"
            f" AND length({value}) <= {_MAX_PRECISE_TEXT}, NULL, 'NOT_CANONICAL')",
        ),
    ]
    return ladder(*rules, otherwise="'UNKNOWN_TYPE'")


def decode_typed_values(events: DataFrame, typed: str = "typed_fields") -> DataFrame:
    """Split a map of ``struct<type,value>`` into ``fields`` and ``field_types``.

    ``typed_errors`` lists the rejected entries; NULL values become null, everything else keeps its
    exact text so that no precision is lost before normalization.
    """
    bad = (
        f"filter(transform(map_entries({typed}), e -> struct(e.key AS field,"
        f" {typed_value_error('e.value.type', 'e.value.value')} AS error)), e -> e.error IS NOT"
        " NULL)"
    )
    return events.selectExpr(
        *[c for c in events.columns if c not in (typed, "fields", "field_types")],
        f"transform_values({typed}, (k, v) -> if(v.type = 'NULL', NULL, v.value)) AS fields",
        f"transform_values({typed}, (k, v) -> v.type) AS field_types",
        f"{bad} AS typed_errors",
    )


def stable_batch_id(version: str, ids: str) -> str:
    """SQL of the client's batch id: hash of length-prefixed ids in order."""
    body = (
        f"aggregate({ids}, unhex(lpad({version}, 2, '0')), (acc, id) -> concat(acc,"
        " unhex(lpad(hex(octet_length(id)), 8, '0')), encode(id, 'UTF-8')))"
    )
    return f"concat('b', {version}, '-', substring(sha2({body}, 256), 1, 32))"


def verify_batch_identity(batches: DataFrame) -> DataFrame:
    """Recompute ``batch_id`` from the ordered ``event_ids`` of the envelope."""
    expected = stable_batch_id("schema_version", "event_ids")
    return batches.selectExpr("*", f"{expected} AS expected_batch_id").selectExpr(
        "*", "expected_batch_id = batch_id AS batch_id_ok"
    )


def _bounded(column: str, limit: int = C.MAX_IDENTIFIER_BYTES) -> str:
    return f"octet_length({column}) BETWEEN 1 AND {limit}"


def _trimmed(column: str) -> str:
    return f"({_bounded(column)} AND NOT {untrimmed(column)})"


def _map_error(column: str) -> str:
    entries = f"map_entries({column})"
    return (
        f"size({column}) > {C.MAX_MAP_ENTRIES} OR exists({entries}, e -> e.key = '' OR"
        f" octet_length(e.key) > {C.MAX_MAP_KEY_BYTES}"
        f" OR octet_length(e.value) > {C.MAX_MAP_VALUE_BYTES})"
    )


def validate_events(events: DataFrame, now_ms: int | str) -> DataFrame:
    """Add ``error_code``: the first contract violation of the event, or null.

    ``now_ms``: the instant of receipt, or the name of the column that holds it.
    """
    o = "occurrence"
    labels = [
        f"({o}.{c} IS NULL OR ({_trimmed(f'{o}.{c}')} AND NOT {o}.{c} rlike {_CONTROL}))"
        for c in ("device_model", "os_version")
    ]
    frame_ok = (
        " AND ".join(_trimmed(f"f.{c}") for c in ("abi", "module_build_id", "module_name"))
        + " AND f.module_relative_pc >= 0 AND coalesce(f.load_bias >= 0, true)"
    )
    rules = [
        (f"NOT coalesce(timestamp BETWEEN 1 AND {_LAST_MS}, false)", "INVALID_TIMESTAMP"),
        (
            f"NOT coalesce({_bounded('event_id', C.MAX_EVENT_ID_BYTES)}, false)"
            f" OR event_id rlike {_CONTROL}",
            "INVALID_EVENT_ID",
        ),
        *[
            (f"NOT coalesce({_bounded(c)}, false)", f"INVALID_{c.upper()}")
            for c in ("module", "name")
        ],
        (f"NOT coalesce(kind IN {KINDS}, false)", "INVALID_KIND"),
        (f"NOT coalesce(severity IN {SEVERITIES}, false)", "INVALID_SEVERITY"),
        (f"NOT coalesce(priority IN {PRIORITIES}, false)", "INVALID_PRIORITY"),
        *[
            (f"NOT coalesce({_bounded(c)}, false)", f"INVALID_{c.upper()}")
            for c in ("process_name", "thread_name")
        ],
        (f"coalesce(octet_length(scene) > {C.MAX_IDENTIFIER_BYTES}, false)", "INVALID_SCENE"),
        *[(f"coalesce({_map_error(m)}, false)", f"INVALID_{m.upper()}") for m in MAPS],
        (
            f"{o} IS NOT NULL AND NOT coalesce("
            + " AND ".join(
                _trimmed(f"{o}.{c}")
                for c in ("service_version", "app_build", "variant", "installation_id")
            )
            + ", false)",
            "INVALID_OCCURRENCE",
        ),
        (
            f"{o} IS NOT NULL AND NOT coalesce({o}.version_code rlike '^(0|[1-9][0-9]{{0,63}})$',"
            " false)",
            "INVALID_VERSION_CODE",
        ),
        (f"coalesce(NOT {o}.session_id rlike {_UUID}, false)", "INVALID_SESSION"),
        (f"{o} IS NOT NULL AND NOT ({' AND '.join(labels)})", "INVALID_DEVICE"),
        (
            f"coalesce(size({o}.native_frames) > {C.MAX_NATIVE_FRAMES}"
            f" OR exists({o}.native_frames, f -> NOT coalesce({frame_ok}, false)), false)",
            "INVALID_NATIVE_FRAMES",
        ),
        (f"timestamp > {now_ms} + {C.MAX_FUTURE_SKEW_MS}", "TIMESTAMP_IN_FUTURE"),
    ]
    return events.withColumn(
        "error_code", F.expr(ladder(*[(condition, lit(code)) for condition, code in rules]))
    )


def _map_json(column: str, typed: bool) -> str:
    value = json_string("e.value")
    if typed:
        kind = "coalesce(try_element_at(field_types, e.key), 'STRING')"
        finite = "e.value NOT IN ('NaN', 'Infinity', '-Infinity')"
        value = (
            f"CASE WHEN e.value IS NULL THEN 'null' WHEN {kind} IN ('BOOLEAN', 'BYTE', 'SHORT',"
            f" 'INT', 'LONG') THEN e.value WHEN {kind} IN ('FLOAT', 'DOUBLE') AND {finite}"
            f" THEN {python_double('cast(e.value AS double)')} ELSE {value} END"
        )
    return (
        f"concat('{{', array_join(transform(array_sort(map_entries({column})), e ->"
        f" concat({json_string('e.key')}, ':', {value})), ','), '}}')"
    )


def _occurrence_json() -> str:
    """Key-sorted JSON of an occurrence as it is stored: without installation and session id.

    An absent device model or system version leaves its key out; an absent load bias stays as null.
    """

    def pair(key: str, sql: str) -> str:
        return f"""concat('"{key}":', {sql})"""

    def frame(key: str) -> str:
        number = f"coalesce(cast(f.{key} AS string), 'null')"
        return pair(key, number if key in ("load_bias", "module_relative_pc") else json_string(f"f.{key}"))

    frame_keys = ("abi", "load_bias", "module_build_id", "module_name", "module_relative_pc")
    frame_json = "concat('{', " + ", ',', ".join(frame(k) for k in frame_keys) + ", '}')"
    frames = f"array_join(transform(occurrence.native_frames, f -> {frame_json}), ',')"
    parts = []
    for key in (
        "app_build", "device_model", "native_frames", "os_version", "service_version", "variant",
        "version_code",
    ):
        if key == "native_frames":
            parts.append(pair(key, f"concat('[', coalesce({frames}, ''), ']')"))
        elif key in ("device_model", "os_version"):
            value = pair(key, json_string(f"occurrence.{key}"))
            parts.append(f"if(occurrence.{key} IS NULL, NULL, {value})")
        else:
            parts.append(pair(key, json_string(f"occurrence.{key}")))
    # array_join leaves out the null parts.
    return f"concat('{{', array_join(array({', '.join(parts)}), ','), '}}')"


def canonical_json(has_occurrence: bool) -> str:
    """SQL of the key-sorted compact JSON of one event, with absent optional keys left out."""

    def text(column: str) -> str:
        return f"if({column} IS NULL, 'null', {json_string(column)})"

    parts = {
        "event_id": text("event_id"),
        "extras": _map_json("extras", False),
        "field_types": _map_json("field_types", False),
        "fields": _map_json("fields", True),
        "foreground": "coalesce(cast(foreground AS string), 'null')",
        "global_context": _map_json("global_context", False),
        "kind": text("kind"),
        "module": text("module"),
        "name": text("name"),
        "occurrence": "'null'",
        "priority": text("priority"),
        "process_name": text("process_name"),
        "scene": text("scene"),
        "severity": text("severity"),
        "thread_name": text("thread_name"),
        "timestamp": "cast(timestamp AS string)",
        "unknown": _map_json("unknown", False),
    }
    if has_occurrence:
        parts["occurrence"] = f"if(occurrence IS NULL, 'null', {_occurrence_json()})"
    body = ", ',', ".join(f"""'"{key}":', {sql}""" for key, sql in parts.items())
    return f"concat('{{', {body}, '}}')"


def canonical_payload_hash(events: DataFrame) -> DataFrame:
    """Add ``payload_sha256`` and ``payload_size_bytes`` of the canonical JSON."""
    return (
        events.withColumn("_json", F.expr(canonical_json("occurrence" in events.columns)))
        .withColumn("_json", F.expr(lower_escapes("_json")))
        .selectExpr(
            *events.columns,
            "sha2(_json, 256) AS payload_sha256",
            "octet_length(_json) AS payload_size_bytes",
        )
    )


def event_size_limit(hashed: DataFrame, limit: int = C.MAX_EVENT_JSON_BYTES) -> DataFrame:
    """Add ``too_large``."""
    return hashed.withColumn("too_large", F.col("payload_size_bytes") > limit)


def reject_invalid_batches(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into accepted events and quarantined batches; one bad event rejects its batch.

    The aggregate combines on the map side to one row per batch. It tests the error inside the
    aggregate: a filter on it would be pushed below the validation and repeat its expressions.
    """
    broken = "error_code IS NOT NULL"
    bad = (
        events.groupBy("batch_id")
        .agg(
            F.expr(f"min(event_index) FILTER (WHERE {broken}) AS first_bad_index"),
            F.expr(f"min_by(error_code, event_index) FILTER (WHERE {broken}) AS batch_error"),
        )
        .filter("first_bad_index IS NOT NULL")
    )
    accepted = events.join(bad, "batch_id", "left_anti")
    return accepted, events.join(bad, "batch_id")


# Header that must repeat a value of the body (fixed pairs).
HEADER_PAIRS = (
    ("header_app_id", "service_name"),
    ("header_environment", "deployment_environment"),
    ("header_sdk_version", "sdk_version"),
    ("header_schema_version", "schema_version"),
    ("header_batch_id", "batch_id"),
    ("header_event_count", "event_count"),
)


def check_envelope_headers(batches: DataFrame) -> DataFrame:
    """Add ``header_error``: the first header that disagrees with the envelope body.

    The release header is optional and only compared for schema 2.
    """
    rules = [
        (f"NOT ({header} <=> {body})", lit(header.removeprefix("header_").upper() + "_MISMATCH"))
        for header, body in HEADER_PAIRS
    ]
    rules.append(
        (
            "schema_version = '2' AND header_app_version IS NOT NULL"
            " AND NOT (header_app_version <=> service_version)",
            lit("APP_VERSION_MISMATCH"),
        )
    )
    return batches.withColumn("header_error", F.expr(ladder(*rules)))


def dedup_events(new: DataFrame, existing: DataFrame) -> DataFrame:
    """First copy of every (tenant, event id) that is not stored yet.

    The ranking comes first and keeps one row per key before its shuffle as well (window group
    limit), so a key with very many copies gathers neither there nor in the join with stored rows.
    """
    first = Window.partitionBy("tenant_id", "event_id").orderBy("batch_id", "event_index")
    ranked = new.withColumn("_copy", F.row_number().over(first)).filter("_copy = 1").drop("_copy")
    return ranked.join(
        existing.select("tenant_id", "event_id"), ["tenant_id", "event_id"], "left_anti"
    )


SIGNATURE = (
    "payload_sha256", "app_version", "app_build", "version_code", "variant",
    "release_identity_quality", "installation_identity_quality", "installation_hmac",
    "session_hmac",
)
_STORED_SCOPE = ("app_id", "environment")


def detect_event_conflicts(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Event ids reused for other content: inside one batch, or against a stored row.

    One conflict rejects its whole batch; rows name the batch, the id and where it clashed. Copies
    fold to the distinct contents of an id before they meet stored rows, and only clashing contents
    are led back to their batches.
    """
    signature = F.sha2(F.to_json(F.struct(*SIGNATURE)), 256)
    marked = new.select(
        "tenant_id",
        "batch_id",
        "event_id",
        signature.alias("signature"),
        *_STORED_SCOPE,
        F.sha2(F.to_json(F.struct(*SIGNATURE, *_STORED_SCOPE)), 256).alias("content"),
    )
    inside = (
        marked.groupBy("tenant_id", "batch_id", "event_id")
        .agg(F.count_distinct("signature").alias("variants"))
        .filter("variants > 1")
        .select("tenant_id", "batch_id", "event_id", F.lit("BATCH").alias("conflict"))
    )
    stored = existing.select(
        "tenant_id",
        "event_id",
        signature.alias("stored"),
        *[F.col(c).alias(f"stored_{c}") for c in _STORED_SCOPE],
    )
    differs = "signature <> stored OR app_id <> stored_app_id OR environment <> stored_environment"
    clashing = (
        marked.drop("batch_id")
        .distinct()
        .join(stored, ["tenant_id", "event_id"])
        .filter(differs)
        .select("tenant_id", "event_id", "content")
        .distinct()
    )
    against = (
        marked.select("tenant_id", "batch_id", "event_id", "content")
        .distinct()
        .join(clashing, ["tenant_id", "event_id", "content"], "left_semi")
        .select("tenant_id", "batch_id", "event_id", F.lit("STORED").alias("conflict"))
        .distinct()
    )
    return inside.unionByName(against)


def ingest_summary(received: DataFrame, inserted: DataFrame) -> DataFrame:
    """Received, inserted and duplicate events per batch."""
    counts = received.groupBy("batch_id").agg(F.count("*").alias("received"))
    stored = inserted.groupBy("batch_id").agg(F.count("*").alias("inserted"))
    return counts.join(stored, "batch_id", "left").selectExpr(
        "batch_id",
        "received",
        "coalesce(inserted, 0) AS inserted",
        "received - coalesce(inserted, 0) AS duplicates",
    )


_QUOTA_SCHEMA = (
    "key_id string, window_ms bigint, received_ms bigint, batch_id string, event_count bigint,"
    " admitted boolean, retry_after bigint"
)


def _fold_quota(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk sorted batches with one pair of counters; constant memory however hot a key is."""
    current, requests, events = None, 0, 0
    for frame in frames:
        admitted = []
        columns = (
            "key_id", "window_ms", "event_count", "used_requests", "used_events",
            "requests_per_minute", "events_per_minute",
        )
        for key, window, size, used_r, used_e, max_r, max_e in zip(*(frame[c] for c in columns)):
            if (key, window) != current:
                current, requests, events = (key, window), used_r, used_e
            # The first request of a window is only checked against the per-request limits.
            fits = max_r >= 1 and size <= max_e and (
                requests == 0 or (requests + 1 <= max_r and events + size <= max_e)
            )
            if fits:
                requests, events = requests + 1, events + size
            admitted.append(bool(fits))
        out = frame[["key_id", "window_ms", "received_ms", "batch_id", "event_count"]].copy()
        out["admitted"] = admitted
        seconds = (frame["received_ms"] // 1000) % 60
        never = (frame["requests_per_minute"] < 1) | (
            frame["event_count"] > frame["events_per_minute"]
        )
        wait = (60 - seconds).where(~never, 60)
        out["retry_after"] = wait.where(~out["admitted"]).astype("Int64")
        yield out


def admit_quota(
    batches: DataFrame, limits: DataFrame, used: DataFrame | None = None
) -> DataFrame:
    """Admit batches per key and UTC minute; a rejected batch consumes nothing.

    Whether a batch fits depends on which earlier ones were admitted, so this is a fold in arrival
    order. Batches are spread by (key, minute), sorted by Spark, and each task streams through its
    rows with two counters. ``used`` carries counters of minutes that are already partly consumed.
    A batch whose key has no limits is rejected.
    """
    windowed = batches.withColumn("window_ms", F.expr("received_ms - received_ms % 60000"))
    if used is None:
        seeded = windowed.withColumns({"used_requests": F.lit(0), "used_events": F.lit(0)})
    else:
        seeded = windowed.join(used, ["key_id", "window_ms"], "left").na.fill(
            0, ["used_requests", "used_events"]
        )
    ordered = (
        seeded.join(limits, "key_id", "left")
        .na.fill(0, ["requests_per_minute", "events_per_minute"])
        .repartition("key_id", "window_ms")
        .sortWithinPartitions("key_id", "window_ms", "received_ms", "batch_id")
    )
    return ordered.mapInPandas(_fold_quota, _QUOTA_SCHEMA)


def admit_capacity(
    inbox: DataFrame, max_live_events: int = 100_000, max_raw_bytes: int = 10 * 1024**3
) -> DataFrame:
    """One row: live events, retained raw bytes, and whether new inserts are admitted."""
    live = quoted(C.LIVE_STATUSES)
    counts = inbox.agg(
        F.expr(f"count_if(inbox_status IN {live}) AS live_events"),
        F.expr("coalesce(sum(if(raw_pruned_ms IS NULL, payload_size_bytes, 0)), 0) AS raw_bytes"),
    )
    return counts.selectExpr(
        "*", f"live_events <= {max_live_events} AND raw_bytes <= {max_raw_bytes} AS admitted"
    )
