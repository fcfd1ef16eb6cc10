"""Scan, filter and page operators over the inbox."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgauge import constants as C
from vitalgauge.functions import events as E
from vitalgauge.operators.normalize import field_availability
from vitalgauge.session import small_table


@dataclass(frozen=True)
class Scope:
    """Mandatory tenant, app and environment of every report."""

    tenant_id: str
    app_id: str
    environment: str

    def predicate(self) -> Column:
        return (
            (F.col("tenant_id") == self.tenant_id)
            & (F.col("app_id") == self.app_id)
            & (F.col("environment") == self.environment)
        )


def scope_window_filter(inbox: DataFrame, scope: Scope, from_ms: int, to_ms: int) -> DataFrame:
    """Scope equality and the half-open occurrence window; pruned and pushed to the scan.

    When the table carries the ``occurrence_date`` partition column the window also prunes
    directories.
    """
    rows = inbox.filter(
        scope.predicate()
        & (F.col("occurrence_timestamp_ms") >= from_ms)
        & (F.col("occurrence_timestamp_ms") < to_ms)
    )
    if "occurrence_date" in inbox.columns:
        rows = rows.filter(
            F.col("occurrence_date").between(
                F.to_date(F.timestamp_millis(F.lit(from_ms))),
                F.to_date(F.timestamp_millis(F.lit(to_ms))),
            )
        )
    return rows


def release_filter(rows: DataFrame, *releases: str, fingerprint: str | None = None) -> DataFrame:
    """Keep the named releases, and one fingerprint when given."""
    if releases:
        rows = rows.filter(F.col("app_version").isin(*releases))
    if fingerprint is not None:
        rows = rows.filter(F.col("incident_fingerprint") == fingerprint)
    return rows


def bucket_width(from_ms: int, to_ms: int) -> int:
    """At most 24 buckets, each a whole number of minutes."""
    raw = -(-(to_ms - from_ms) // C.MAX_BUCKETS)
    return max(60_000, -(-raw // 60_000) * 60_000)


def bucket_index(from_ms: int, to_ms: int) -> Column:
    """Bucket number of the row's occurrence."""
    width = bucket_width(from_ms, to_ms)
    return F.floor((F.col("occurrence_timestamp_ms") - F.lit(from_ms)) / F.lit(width)).cast(
        "bigint"
    )


def bucket_spine(spark, from_ms: int, to_ms: int) -> DataFrame:
    """All buckets of the window (24 at most), the last one clipped at its end."""
    width = bucket_width(from_ms, to_ms)
    starts = range(from_ms, to_ms, width)
    rows = [(i, start, min(start + width, to_ms)) for i, start in enumerate(starts)]
    return small_table(spark, rows, "bucket bigint, bucket_start_ms bigint, bucket_end_ms bigint")


def time_bucket(rows: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Add bucket number, start and clipped end."""
    width = bucket_width(from_ms, to_ms)
    start = F.lit(from_ms) + F.col("bucket") * F.lit(width)
    return rows.withColumn("bucket", bucket_index(from_ms, to_ms)).withColumns(
        {"bucket_start_ms": start, "bucket_end_ms": F.least(start + width, F.lit(to_ms))}
    )


def late_flag(rows: DataFrame, late_after_ms: int = C.LATE_AFTER_MS) -> DataFrame:
    """Add ``late``."""
    return rows.withColumn("late", E.is_late(late_after_ms))


def scene_evidence(rows: DataFrame) -> DataFrame:
    """Add the visible scene and its evidence state."""
    return rows.withColumns(
        {"visible_scene": E.visible_scene(), "scene_state": E.scene_state()}
    )


def window_facts(
    rows: DataFrame, from_ms: int, to_ms: int, late_after_ms: int = C.LATE_AFTER_MS
) -> DataFrame:
    """Group equal events to weighted facts; counts survive as ``weight``.

    A partial aggregate runs before the only shuffle, and the 22 grouping columns spread even a
    dominating release or source over all partitions.
    """
    keyed = rows.select(
        "id",
        "event_id",
        "occurrence_timestamp_ms",
        "received_ms",
        "app_version",
        "release_identity_quality",
        "installation_identity_quality",
        "installation_hmac",
        "installation_hmac_key_version",
        "session_identity_quality",
        "session_hmac",
        "session_hmac_key_version",
        "device_model",
        "os_version",
        E.session_start_valid().alias("session_start_valid"),
        "incident_fingerprint",
        "schema_version",
        "protocol",
        "inbox_status",
        "module",
        "name",
        E.visible_scene().alias("scene"),
        E.scene_state().alias("scene_state"),
        F.expr(f"if({E.SDK_VALID}, 1, NULL) AS sdk_emit_count"),
        E.is_late(late_after_ms).alias("late"),
        bucket_index(from_ms, to_ms).alias("bucket"),
        F.expr(f"{E.DROPS} AS _drops"),
        F.expr(f"{E.RATE} AS _rate"),
    )
    measures = ("id", "event_id", "occurrence_timestamp_ms", "received_ms", "_drops", "_rate")
    dimensions = [c for c in keyed.columns if c not in measures]
    return keyed.groupBy(*dimensions).agg(
        F.min("id").alias("id"),
        F.min("event_id").alias("event_id"),
        F.min("occurrence_timestamp_ms").alias("occurrence_timestamp_ms"),
        F.max("occurrence_timestamp_ms").alias("last_occurrence_timestamp_ms"),
        F.max("received_ms").alias("received_ms"),
        F.max("_drops").alias("sdk_drop_count"),
        F.max("_rate").alias("sdk_drop_rate"),
        F.count("*").alias("weight"),
    )


def list_events(
    rows: DataFrame,
    limit: int,
    *,
    release: str | None = None,
    module: str | None = None,
    name: str | None = None,
    fingerprint: str | None = None,
    cursor: tuple[int, int] | None = None,
) -> DataFrame:
    """Newest-first page after a (timestamp, id) cursor; one extra row tells if more follow."""
    for column, wanted in (
        ("app_version", release),
        ("module", module),
        ("name", name),
        ("incident_fingerprint", fingerprint),
    ):
        if wanted is not None:
            rows = rows.filter(F.col(column) == wanted)
    if cursor is not None:
        stamp, last_id = cursor
        rows = rows.filter(
            (F.col("occurrence_timestamp_ms") < stamp)
            | ((F.col("occurrence_timestamp_ms") == stamp) & (F.col("id") < last_id))
        )
    return rows.orderBy(F.desc("occurrence_timestamp_ms"), F.desc("id")).limit(limit + 1)


def event_summary(rows: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Allow-listed projection of an event with the state of its symbolization job."""
    if jobs is not None:
        rows = rows.join(
            jobs.select(
                F.col("inbox_event_id").alias("id"),
                F.col("job_status").alias("symbolization_status"),
                F.col("fingerprint_sha256").alias("symbolization_fingerprint"),
            ),
            "id",
            "left",
        )
    else:
        rows = rows.withColumns(
            {
                "symbolization_status": F.lit(None).cast("string"),
                "symbolization_fingerprint": F.lit(None).cast("string"),
            }
        )
    # Pruned payloads keep only module and name.
    kept = F.col("raw_pruned_ms").isNull()
    return rows.select(
        "event_id",
        F.coalesce("module", F.lit("")).alias("module"),
        F.coalesce("name", F.lit("")).alias("name"),
        E.event_family().alias("event_family"),
        "app_version",
        "app_build",
        "version_code",
        "variant",
        "release_identity_quality",
        "installation_identity_quality",
        "installation_hmac",
        "session_identity_quality",
        "device_model",
        "os_version",
        "occurrence_timestamp_ms",
        "received_ms",
        F.when(kept, F.col("scene")).alias("scene"),
        F.when(kept, F.col("process_name")).alias("process_name"),
        F.when(kept, F.col("thread_name")).alias("thread_name"),
        "incident_fingerprint",
        "inbox_status",
        "symbolization_status",
        "symbolization_fingerprint",
    )


def event_metadata(inbox: DataFrame, scope: Scope, event_id: str) -> DataFrame:
    """One event of the scope with retention-aware field states."""
    pruned = F.col("raw_pruned_ms").isNotNull()
    return (
        inbox.filter(scope.predicate() & (F.col("event_id") == event_id))
        .select(
            "event_id",
            "module",
            "name",
            "schema_version",
            "protocol",
            (~pruned).alias("raw_available"),
            F.explode_outer(
                field_availability(F.col("field_states"), pruned, *retained_values(pruned))
            ).alias("field", "field_state"),
        )
    )


def retained_values(pruned: Column) -> list[Column]:
    """Typed maps that still hold values: strings leave with the raw evidence."""
    indexed = F.col("indexed_fields")

    def keep(values: Column) -> Column:
        return F.map_filter(values, lambda key, _: ~pruned | F.array_contains(indexed, key))

    strings = F.map_filter(F.col("strs"), lambda key, _: ~pruned)
    return [keep(F.col("ints")), keep(F.col("nums")), keep(F.col("bools")), strings]


# Purposes that may open raw evidence (fixed values).
RAW_PURPOSES = (
    "incident_diagnosis",
    "release_validation",
    "customer_support",
    "security_investigation",
)


def raw_access_audit(requests: DataFrame, inbox: DataFrame) -> DataFrame:
    """Outcome and audit row of each raw-evidence request.

    ``requests`` carries the requester's scope, ``event_id``, ``actor``, ``purpose_code`` and
    ``request_id``; an event outside that scope is indistinguishable from an absent one.
    """
    key = ["tenant_id", "app_id", "environment", "event_id"]
    known = inbox.select(*key, F.lit(True).alias("_found"), "raw_pruned_ms")
    found = F.col("_found").isNotNull()
    return (
        requests.join(known, key, "left")
        .filter(F.col("purpose_code").isin(*RAW_PURPOSES))
        .select(
            "request_id",
            "tenant_id",
            "actor",
            F.lit("query.event.raw.read").alias("action"),
            F.lit("inbox_event").alias("object_type"),
            F.col("event_id").alias("object_id"),
            F.when(~found, "not_found")
            .when(F.col("raw_pruned_ms").isNotNull(), "expired")
            .otherwise("success")
            .alias("result"),
            "purpose_code",
        )
    )


def resolve_issue_alias(aliases: DataFrame, rows: DataFrame) -> DataFrame:
    """Follow raw fingerprints to the current issue: resolved, ambiguous, or unchanged."""
    current = (
        rows.filter(F.col("incident_fingerprint").isNotNull())
        .groupBy(F.col("raw_incident_fingerprint").alias("alias"))
        .agg(
            F.min("incident_fingerprint").alias("_low"),
            F.max("incident_fingerprint").alias("_high"),
        )
    )
    ambiguous = F.col("_low") != F.col("_high")
    return aliases.join(current, "alias", "left").select(
        "alias",
        F.when(ambiguous, None)
        .otherwise(F.coalesce("_low", "alias"))
        .alias("fingerprint"),
        F.when(F.col("_low").isNull(), "UNCHANGED")
        .when(ambiguous, "AMBIGUOUS")
        .otherwise("RESOLVED")
        .alias("resolution"),
    )
