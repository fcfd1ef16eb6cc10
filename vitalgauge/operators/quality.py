"""Data quality of a window: identity, SDK health, lateness and ingest coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgauge import constants as C
from vitalgauge.functions import events as E
from vitalgauge.functions import metrics as M
from vitalgauge.functions.metrics import ladder, lit

# coverage metric -> (part, whole, reason when the part is empty)
COVERAGES = {
    "release_identity": ("bound", "samples", C.OCCURRENCE_REASON),
    "installation_identity": ("identified", "bound", C.INSTALLATION_REASON),
    "session_identity": ("sessions", "bound", C.SESSION_REASON),
    "device_model_coverage": ("devices", "bound", C.DEVICE_REASON),
    "os_version_coverage": ("os_versions", "bound", C.OS_REASON),
}
QUALITY_METRICS = (*COVERAGES, "sdk_health", "late_data")


def quality_counts(rows: DataFrame, late_after_ms: int = C.LATE_AFTER_MS) -> DataFrame:
    """Everything the data quality report needs, in one aggregate of one row."""
    flagged = rows.selectExpr(
        "installation_hmac",
        "installation_hmac_key_version",
        f"{E.BOUND} AS is_bound",
        "coalesce(session_hmac, '') <> '' AS has_session",
        "coalesce(device_model, '') <> '' AS has_device",
        "coalesce(os_version, '') <> '' AS has_os",
        f"{E.late(late_after_ms)} AS is_late",
        f"{E.FAMILY} = 'SDK_HEALTH' AS sdk",
        f"{E.SDK_VALID} AS sdk_valid",
        f"{E.SDK_DROPPED} AS sdk_dropped",
        f"{E.RATE} AS sdk_rate",
    )
    aggregates = (
        "count(*) AS samples",
        "count_if(is_bound) AS bound",
        "count_if(is_bound AND installation_hmac IS NOT NULL) AS identified",
        "count_if(is_bound AND has_session) AS sessions",
        "count_if(is_bound AND has_device) AS devices",
        "count_if(is_bound AND has_os) AS os_versions",
        "count_if(is_late) AS late",
        "count_if(sdk) AS sdk_rows",
        "count_if(sdk AND NOT sdk_valid) AS sdk_invalid",
        "count_if(sdk AND sdk_dropped) AS sdk_drops",
        "max(if(sdk, sdk_rate, NULL)) AS sdk_worst_rate",
        f"{M.continuity()} AS continuity",
    )
    return flagged.agg(*[F.expr(a) for a in aggregates])


def identity_coverages(counts: DataFrame, to_ms: int) -> DataFrame:
    """Coverage metrics of release, installation, session, device and OS identity."""
    return counts.selectExpr(
        "*",
        *[
            f"{M.coverage_metric(part, whole, to_ms, reason)} AS {name}"
            for name, (part, whole, reason) in COVERAGES.items()
        ],
    )


def data_quality(
    rows: DataFrame, to_ms: int, release: str | None = None, late_after_ms: int = C.LATE_AFTER_MS
) -> DataFrame:
    """State of the window with all coverage metrics, one row."""
    if release is not None:
        rows = rows.filter(F.col("app_version") == release)
    broken = "continuity IS NOT NULL AND samples > 0"
    state = ladder(
        ("samples = 0", lit(C.NO_DATA)),
        (f"({broken}) OR bound = 0", lit(C.UNAVAILABLE)),
        ("bound < samples OR identified < bound OR sdk_drops > 0", lit(C.DEGRADED)),
        ("late > 0", lit(C.LATE)),
        (f"{M.SDK_STATE} = '{C.UNAVAILABLE}'", lit(C.UNAVAILABLE)),
        otherwise=lit(C.PRESENT),
    )
    withheld = M.metric(lit(C.UNAVAILABLE), "samples", to_ms, reason="continuity")
    empty = M.metric(lit(C.NO_DATA), "0", to_ms)
    late = M.metric(
        f"if(late > 0, '{C.LATE}', '{C.ZERO}')",
        "samples",
        to_ms,
        value=M.ratio("late", "samples"),
        numerator="late",
        denominator="samples",
    )
    others = [name for name in COVERAGES if name != "installation_identity"]
    return identity_coverages(quality_counts(rows, late_after_ms), to_ms).selectExpr(
        f"cast({'NULL' if release is None else lit(release)} AS string) AS release_version",
        f"{state} AS state",
        "samples AS sample_count",
        f"if({broken}, {withheld}, installation_identity) AS installation_identity",
        *others,
        f"if(samples = 0, {empty}, {M.sdk_health_metric(to_ms)}) AS sdk_health",
        f"if(samples = 0, {empty}, {late}) AS late_data",
    )


def quality_metrics(report: DataFrame) -> DataFrame:
    """Long form of the report: one row per coverage metric."""
    return report.selectExpr(*M.long_form(QUALITY_METRICS, "state AS window_state")).select(
        "window_state", "metric", *M.flat("m")
    )


def quality_distributions(rows: DataFrame) -> DataFrame:
    """Counts by protocol, schema version and inbox status from one grouping-sets aggregate."""
    dims = ["protocol", "schema_version", "inbox_status"]
    grouped = rows.groupingSets([[F.col(d)] for d in dims], *dims).agg(
        F.count("*").alias("event_count"), F.grouping_id().alias("left_out")
    )
    # grouping_id sets one bit per column left out, the first column in the highest bit.
    return grouped.selectExpr(
        "CASE left_out WHEN 3 THEN 'protocol' WHEN 5 THEN 'schema_version'"
        " ELSE 'inbox_status' END AS dimension",
        "coalesce(protocol, schema_version, inbox_status) AS label",
        "event_count",
    )
