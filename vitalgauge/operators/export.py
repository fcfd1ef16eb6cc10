"""Export shapes: log records, gauge points and spans grouped by resource, and bad-row isolation.

Groups are formed inside export batches of 100 consecutive rows, as the exporter sends them, so a
group never grows with the size of its resource.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgauge import constants as C
from vitalgauge.functions import events as E
from vitalgauge.functions.metrics import ladder, lit
from vitalgauge.operators.performance import observe_value, reported_values
from vitalgauge.operators.traces import parse_spans

BATCH_ROWS = 100
NAMESPACE = "apm"
# Severity numbers of the log data model (fixed values).
SEVERITY_NUMBERS = {"DEBUG": 5, "INFO": 9, "WARN": 13, "ERROR": 17, "FATAL": 21}
# Registry unit -> export unit where they differ (fixed values).
EXPORT_UNITS = {
    "events": "{event}", "frames": "{frame}", "fps": "{frame}/s", "ratio": "1",
    "ratio_delta": "1", "bytes": "By", "KiB": "KiBy", "KiB/s": "KiBy/s", "MiB": "MiBy",
    "cores": "{core}", "depth": "{level}", "objects": "{object}", "http_status": "1",
}
REQUIRED_LOG_FIELDS = ("module", "name", "severity", "kind", "priority", "thread_name")

_BOUND_VERSION = f"if({E.BOUND}, coalesce(app_version, ''), '')"
_RESOURCE = ("tenant_id", "app_id", "environment", "service_version", "sdk_version")


def with_export_batch(rows: DataFrame) -> DataFrame:
    """Add ``export_batch``: runs of 100 consecutive row ids."""
    return rows.withColumn("export_batch", F.expr(f"cast(floor(id / {BATCH_ROWS}D) AS bigint)"))


def log_records(rows: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """One log record per row: severity, body and reviewed attributes only.

    Manual span names are free text and never leave the store; neither do raw maps.
    """
    name = "if(module = 'trace', 'manual_span', name)"
    plain = {
        "event_id": "event_id",
        "module": "module",
        "name": name,
        "kind": "kind",
        "priority": "priority",
        "thread.name": "thread_name",
        "protocol": "protocol",
        "schema_version": "schema_version",
        "release_identity_quality": "release_identity_quality",
        "installation_identity_quality": "installation_identity_quality",
        "scene": "scene",
        "installation.hmac": "installation_hmac",
        "installation.hmac_key_version": "installation_hmac_key_version",
        "incident.fingerprint": "incident_fingerprint",
    }
    attributes = ", ".join(
        f"'{namespace}.{key}', cast({sql} AS string)" for key, sql in plain.items()
    )
    indexed = (
        f"map_from_entries(transform(indexed_fields, f -> struct(concat('{namespace}.field.', f)"
        " AS k, coalesce(cast(try_element_at(ints, f) AS string), cast(try_element_at(nums, f) AS"
        " string), cast(try_element_at(bools, f) AS string), try_element_at(strs, f)) AS v)))"
    )
    number = ladder(
        *[(f"severity = '{s}'", str(n)) for s, n in SEVERITY_NUMBERS.items()], otherwise="0"
    )
    return with_export_batch(rows).selectExpr(
        "export_batch",
        "id",
        "tenant_id",
        "app_id",
        "environment",
        f"{_BOUND_VERSION} AS service_version",
        f"if({E.BOUND}, coalesce(app_build, ''), '') AS build",
        "sdk_version",
        "coalesce(process_name, '') AS process_name",
        "named_struct('event_id', event_id, 'time_unix_nano', occurrence_timestamp_ms * 1000000,"
        f" 'observed_time_unix_nano', received_ms * 1000000, 'severity_number', {number},"
        f" 'severity_text', severity, 'body', concat(module, '.', {name}), 'attributes',"
        f" map_concat(map_filter(map({attributes}), (k, v) -> v IS NOT NULL), {indexed})) AS record",
    )


def otlp_logs(rows: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """Log records grouped by export batch and resource, in order of their ids."""
    return (
        log_records(rows, namespace)
        .groupBy("export_batch", *_RESOURCE, "build", "process_name")
        .agg(
            F.expr(
                "transform(array_sort(collect_list(struct(id, record)),"
                " (a, b) -> cast(sign(a.id - b.id) AS int)), x -> x.record) AS records"
            )
        )
        .withColumn("event_ids", F.expr("transform(records, r -> r.event_id)"))
    )


def otlp_metrics(rows: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """One gauge per batch, resource and metric with a point per reported value."""
    prepared = with_export_batch(rows).withColumn("service_version", F.expr(_BOUND_VERSION))
    unit = ladder(
        *[(f"unit = '{u}'", lit(out)) for u, out in EXPORT_UNITS.items()], otherwise="unit"
    )
    points = observe_value(
        prepared, "export_batch", *_RESOURCE, "occurrence_timestamp_ms"
    ).filter("value IS NOT NULL")
    return points.groupBy("export_batch", *_RESOURCE, "metric_id", "unit").agg(
        F.expr(
            "array_sort(collect_list(struct(occurrence_timestamp_ms * 1000000 AS time_unix_nano,"
            " value AS as_double))) AS points"
        )
    ).selectExpr(
        "export_batch",
        *_RESOURCE,
        f"concat('{namespace}.observation.', metric_id) AS metric",
        f"{unit} AS unit",
        "points",
    )


OPERATION = "manual_span"


_EXPORTABLE = (
    f"timing_state = '{C.AVAILABLE}' AND NOT parent_invalid AND status <> 'UNKNOWN'"
    " AND NOT (parent_span_id <=> span_id)"
)


def exportable_spans(rows: DataFrame, *keep: str) -> DataFrame:
    """Valid, timed spans with a known status; names and custom attributes stay behind."""
    spans = parse_spans(rows, late_after_ms=0, keep=keep).filter(_EXPORTABLE)
    return spans.selectExpr(
        *keep,
        "event_id",
        "trace_id",
        "span_id",
        "coalesce(parent_span_id, '') AS parent_span_id",
        f"'{OPERATION}' AS name",
        "start_ms * 1000000 AS start_time_unix_nano",
        "end_ms * 1000000 AS end_time_unix_nano",
        "duration_ms AS monotonic_duration_ms",
        "if(status = 'ERROR', 2, 1) AS status_code",
    )


def otlp_traces(rows: DataFrame) -> DataFrame:
    """Exportable spans grouped by export batch and resource."""
    prepared = with_export_batch(rows).withColumn("service_version", F.expr(_BOUND_VERSION))
    return (
        exportable_spans(prepared, "export_batch", *_RESOURCE)
        .groupBy("export_batch", *_RESOURCE)
        .agg(F.expr("array_sort(collect_list(struct(span_id, start_time_unix_nano, status_code)))"
                    " AS spans"))
    )


def isolate_bad_rows(rows: DataFrame) -> DataFrame:
    """Add per-signal status before sending: pending, failed or not_applicable.

    A row without the required log fields cannot be mapped to a log record; a row without any
    reported value or valid span has nothing truthful to send for that signal.
    """
    missing = " OR ".join(f"{c} IS NULL" for c in REQUIRED_LOG_FIELDS)
    judged = reported_values(rows).selectExpr(
        "*",
        f"if({missing}, 'failed', 'pending') AS logs",
        "if(has_value, 'pending', 'not_applicable') AS metrics",
    )
    # Everything is decided inside the row: one row in, one row out, no shuffle.
    return parse_spans(
        judged, late_after_ms=0, keep=("id", "logs", "metrics"), keep_rows=True
    ).selectExpr(
        "id",
        "logs",
        "metrics",
        f"if(coalesce({_EXPORTABLE}, false), 'pending', 'not_applicable') AS traces",
    )
