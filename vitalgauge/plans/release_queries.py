"""Release health, issue and data quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgauge.functions import metrics as M
from vitalgauge.operators import issues as I
from vitalgauge.operators import quality as Q
from vitalgauge.operators import release as R
from vitalgauge.plans import telemetry as T
from vitalgauge.plans.registry import query
from vitalgauge.plans.scan_queries import (
    BUCKET,
    FAMILY_SQL,
    FINGERPRINT,
    LATE_SQL,
    SCENE_SQL,
    SDK_DROPPED_SQL,
    SDK_FIELDS,
    SDK_VALID_SQL,
    SESSION_START_SQL,
    window,
)

WINDOW = R.Window(T.FROM_MS, T.TO_MS)
RELEASES = (T.NEW, T.BASE)


def _rows(spark, sf, span=WINDOW):
    return R.release_rows(T.inbox(spark, sf), T.SCOPE, span, RELEASES)


RELEASE_CTE = (
    T.duck_cte(*SDK_FIELDS)
    + f""",
w AS (SELECT *, {FAMILY_SQL} AS family, release_identity_quality = 'OCCURRENCE_BOUND' AS eligible,
  {LATE_SQL} AS late, {SESSION_START_SQL} AS session_start, {SDK_VALID_SQL} AS sdk_valid,
  {SDK_DROPPED_SQL} AS sdk_dropped, cast(f_dropRate AS double) AS sdk_rate
  FROM t WHERE {T.WINDOW_SQL} AND app_version IN ('2.0.0', '1.0.0')),
e AS (SELECT *, family IN ('JAVA_CRASH', 'NATIVE_CRASH', 'ANR') AS incident,
  family NOT IN ('APP_EXIT', 'NATIVE_TOMBSTONE') AS runtime,
  family NOT IN ('APP_EXIT', 'NATIVE_TOMBSTONE') AND session_hmac IS NOT NULL
    AND session_identity_quality = 'OCCURRENCE_BOUND' AS known FROM w WHERE eligible),
d AS (SELECT app_version, count(*) AS declared FROM w GROUP BY 1),
c AS (SELECT app_version, count(*) AS eligible,
  count(*) FILTER (family = 'JAVA_CRASH') AS java, count(*) FILTER (family = 'NATIVE_CRASH')
  AS native, count(*) FILTER (family = 'NATIVE_TOMBSTONE') AS tombstone,
  count(*) FILTER (family = 'ANR') AS anr, count(*) FILTER (incident) AS incidents,
  count(*) FILTER (incident AND installation_hmac IS NOT NULL) AS incidents_identified,
  count(*) FILTER (incident AND incident_fingerprint IS NOT NULL) AS fingerprinted,
  count(installation_hmac) AS identified, count(*) FILTER (late) AS late,
  count(*) FILTER (family = 'SDK_HEALTH') AS sdk_rows,
  count(*) FILTER (family = 'SDK_HEALTH' AND NOT sdk_valid) AS sdk_invalid,
  count(*) FILTER (family = 'SDK_HEALTH' AND sdk_dropped) AS sdk_drops,
  max(sdk_rate) FILTER (family = 'SDK_HEALTH') AS sdk_worst_rate,
  count(*) FILTER (runtime) AS runtime, count(*) FILTER (known) AS known_sessions,
  count(DISTINCT installation_hmac) AS active,
  count(DISTINCT installation_hmac) FILTER (incident) AS affected,
  count(DISTINCT installation_hmac) FILTER (family = 'SDK_HEALTH' AND sdk_valid)
    AS sdk_installations,
  count(DISTINCT incident_fingerprint) FILTER (incident) AS fingerprints,
  count(DISTINCT session_hmac_key_version) FILTER (known) AS session_epochs,
  count(DISTINCT session_hmac) FILTER (known AND session_start) AS sessions_started,
  count(DISTINCT session_hmac) FILTER (known) AS sessions_seen
  FROM e GROUP BY 1),
st AS (SELECT DISTINCT app_version, session_hmac FROM e WHERE known AND session_start),
f AS (SELECT st.app_version,
  count(*) FILTER (EXISTS (SELECT 1 FROM e WHERE known AND e.app_version = st.app_version
    AND e.session_hmac = st.session_hmac AND family IN ('JAVA_CRASH', 'NATIVE_CRASH')))
    AS sessions_crashed,
  count(*) FILTER (EXISTS (SELECT 1 FROM e WHERE known AND e.app_version = st.app_version
    AND e.session_hmac = st.session_hmac AND family = 'ANR')) AS sessions_anr
  FROM st GROUP BY 1),
b AS (SELECT *, CASE WHEN eligible < declared THEN 'RELEASE_IDENTITY_COVERAGE_INCOMPLETE'
  WHEN identified < eligible THEN 'INSTALLATION_IDENTITY_COVERAGE_INCOMPLETE'
  WHEN sdk_drops > 0 THEN 'SDK_REPORTED_DROPS' WHEN late > 0 THEN 'LATE_DATA_PRESENT' END
  AS quality_reason, CASE WHEN eligible < declared OR identified < eligible OR sdk_drops > 0
  THEN 'DEGRADED' WHEN late > 0 THEN 'LATE' ELSE 'PRESENT' END AS quality
  FROM d JOIN c USING (app_version) LEFT JOIN f USING (app_version))"""
)


def _counts_sql(columns: str) -> str:
    return f"{RELEASE_CTE} SELECT app_version, {columns} FROM b"


COUNTS = (
    "declared", "eligible", "java", "native", "tombstone", "anr", "incidents", "identified",
    "late", "sdk_rows", "runtime", "known_sessions",
)


@query("release_counts", _counts_sql(", ".join(COUNTS)))
def _(spark, sf):
    return R.release_counts(_rows(spark, sf), RELEASES).select("app_version", *COUNTS)


@query(
    "identity_coverage",
    _counts_sql(
        "round(eligible / declared, 6) AS release_identity_coverage,"
        " round(identified / eligible, 6) AS installation_identity_coverage"
    ),
)
def _(spark, sf):
    covered = R.identity_coverage(R.release_counts(_rows(spark, sf), RELEASES))
    return covered.select(
        "app_version",
        F.round("release_identity_coverage", 6).alias("release_identity_coverage"),
        F.round("installation_identity_coverage", 6).alias("installation_identity_coverage"),
    )


# Every row of the mapped releases is present, eligible and partly identified, so these follow the
# DEGRADED branches; the other branches are covered by the tests.
METRIC_SQL = {
    "java_crash_events": ("quality", "java", "NULL", "NULL", "eligible", "NULL", "quality_reason"),
    "native_crash_events": ("quality", "native", "NULL", "NULL", "eligible", "NULL",
                            "quality_reason"),
    "native_tombstone_events": ("quality", "tombstone", "NULL", "NULL", "eligible", "NULL",
                                "quality_reason"),
    "anr_events": ("quality", "anr", "NULL", "NULL", "eligible", "NULL", "quality_reason"),
    "active_installations": (
        "CASE WHEN identified < eligible THEN 'DEGRADED' ELSE 'PRESENT' END", "active", "NULL",
        "NULL", "eligible", "identified / eligible", "NULL"),
    "affected_installations": (
        "CASE WHEN identified < eligible THEN 'DEGRADED' WHEN affected = 0 THEN 'ZERO'"
        " ELSE 'PRESENT' END", "affected", "NULL", "NULL", "incidents",
        "CASE WHEN incidents = 0 THEN 1.0 ELSE incidents_identified / incidents END", "NULL"),
    "affected_installation_ratio": (
        "quality", "NULL", "affected", "active", "eligible", "identified / eligible",
        "quality_reason"),
    "incident_fingerprint_count": (
        "CASE WHEN incidents = 0 THEN 'ZERO' WHEN fingerprints = 0 THEN 'UNAVAILABLE'"
        " WHEN fingerprinted < incidents THEN 'DEGRADED' ELSE 'PRESENT' END",
        "CASE WHEN incidents = 0 THEN 0 WHEN fingerprints > 0 THEN fingerprints END", "NULL",
        "NULL", "CASE WHEN incidents = 0 THEN eligible ELSE incidents END",
        "CASE WHEN fingerprints > 0 THEN fingerprinted / incidents END",
        "CASE WHEN incidents > 0 AND fingerprints = 0 THEN 'INCIDENT_FINGERPRINT_NOT_PROVIDED'"
        " END"),
    "late_ratio": (
        "CASE WHEN late > 0 THEN 'LATE' ELSE 'ZERO' END", "late / eligible", "late", "eligible",
        "eligible", "NULL", "NULL"),
    "sdk_drop_rate": (
        "CASE WHEN sdk_rows = 0 OR sdk_invalid > 0 THEN 'UNAVAILABLE' WHEN sdk_drops > 0 THEN"
        " 'DEGRADED' ELSE 'ZERO' END",
        "CASE WHEN sdk_rows > 0 AND sdk_invalid = 0 THEN sdk_worst_rate END", "NULL", "NULL",
        "sdk_rows", "sdk_installations / active",
        "CASE WHEN sdk_rows = 0 THEN 'SDK_HEALTH_NOT_PROVIDED' WHEN sdk_invalid > 0 THEN"
        " 'SDK_HEALTH_FIELDS_OR_SAMPLE_INVALID' WHEN sdk_drops > 0 THEN 'SDK_REPORTED_DROPS' END"),
}
for _name, _failed in (("crash_free_sessions", "sessions_crashed"),
                       ("anr_free_sessions", "sessions_anr")):
    METRIC_SQL[_name] = (
        "CASE WHEN known_sessions = 0 OR session_epochs > 1 THEN 'UNAVAILABLE'"
        " WHEN known_sessions < runtime OR eligible < declared OR sessions_started = 0"
        " OR sessions_seen > sessions_started THEN 'UNKNOWN_COVERAGE' ELSE quality END",
        "NULL",
        f"CASE WHEN sessions_started > 0 THEN sessions_started - coalesce({_failed}, 0) END",
        "CASE WHEN sessions_started > 0 THEN sessions_started END", "runtime",
        "known_sessions / runtime",
        "CASE WHEN known_sessions = 0 THEN 'SESSION_ID_NOT_PROVIDED' WHEN session_epochs > 1 THEN"
        " 'SESSION_KEY_ROTATION_BREAKS_CONTINUITY' WHEN known_sessions < runtime"
        " OR eligible < declared THEN 'SESSION_IDENTITY_COVERAGE_INCOMPLETE'"
        " WHEN sessions_started = 0 OR sessions_seen > sessions_started"
        " THEN 'SESSION_START_NOT_IN_WINDOW' ELSE quality_reason END",
    )


def metric_select(name: str, source: str = "b", extra: str = "") -> str:
    """One metric of the release CTE as plain columns."""
    state, value, top, bottom, samples, coverage, reason = METRIC_SQL[name]
    return (
        f"SELECT {extra}app_version, {state} AS state, round(cast({value} AS double), 6) AS value,"
        f" cast({top} AS bigint) AS numerator, cast({bottom} AS bigint) AS denominator,"
        f" cast({samples} AS bigint) AS sample_count, round(cast({coverage} AS double), 6)"
        f" AS coverage, cast({T.TO_MS} AS bigint) AS as_of_ms, 'durable_inbox' AS source,"
        f" cast({reason} AS varchar) AS reason FROM {source}"
    )


def _register_metric(key: str, metric: str) -> None:
    @query(key, f"{RELEASE_CTE} {metric_select(metric)}")
    def _(spark, sf):
        slices = R.release_slices(_rows(spark, sf), WINDOW, RELEASES)
        return slices.select("app_version", *M.flat(metric))


for _key, _metric in (
    ("affected_installation_ratio", "affected_installation_ratio"),
    ("incident_fingerprint_count", "incident_fingerprint_count"),
    ("late_ratio", "late_ratio"),
    ("sdk_drop_rate", "sdk_drop_rate"),
    ("crash_free_sessions", "crash_free_sessions"),
    ("anr_free_sessions", "anr_free_sessions"),
):
    _register_metric(_key, _metric)


def _long_sql(metrics) -> str:
    parts = [
        metric_select(m, extra=f"CASE app_version WHEN '2.0.0' THEN 'new' ELSE 'baseline' END"
                      f" AS role, '{m}' AS metric, ")
        for m in metrics
    ]
    return f"{RELEASE_CTE} " + " UNION ALL ".join(parts)


@query(
    "active_affected_installations",
    f"{RELEASE_CTE} "
    + " UNION ALL ".join(
        metric_select(m, extra=f"'{m}' AS metric, ")
        for m in ("active_installations", "affected_installations")
    ),
)
def _(spark, sf):
    slices = R.release_slices(_rows(spark, sf), WINDOW, RELEASES)
    return slices.selectExpr(
        *M.long_form(("active_installations", "affected_installations"), "app_version")
    ).select("app_version", "metric", *M.flat("m"))


@query("release_quality_state", _counts_sql("quality AS state, quality_reason AS reason"))
def _(spark, sf):
    counts = R.with_quality(R.release_counts(_rows(spark, sf), RELEASES))
    return counts.select(
        "app_version",
        F.col("quality").alias("state"),
        F.col("quality_reason").alias("reason"),
    )


@query("release_health", _long_sql(R.METRICS))
def release_health(spark, sf):
    health = R.release_health(T.inbox(spark, sf), T.SCOPE, WINDOW, T.NEW, T.BASE)
    return R.release_metrics(health)


def _delta(column: str) -> str:
    return (
        f"cast(max({column}) FILTER (app_version = '2.0.0') -"
        f" max({column}) FILTER (app_version = '1.0.0') AS bigint)"
    )


@query(
    "release_comparison",
    f"{RELEASE_CTE} SELECT {_delta('java')} AS java_crash_event_delta,"
    f" {_delta('native')} AS native_crash_event_delta,"
    f" {_delta('tombstone')} AS native_tombstone_event_delta, {_delta('anr')} AS anr_event_delta,"
    f" {_delta('affected')} AS affected_installation_delta,"
    " cast(NULL AS double) AS affected_installation_ratio_delta FROM b",
)
def _(spark, sf):
    return R.release_comparison(
        R.release_health(T.inbox(spark, sf), T.SCOPE, WINDOW, T.NEW, T.BASE)
    )


@query(
    "hmac_continuity",
    T.duck_cte() + f" SELECT CASE WHEN count(DISTINCT installation_hmac_key_version) > 1 THEN"
    " 'INSTALLATION_HMAC_CONTINUITY_BREAK' END AS reason FROM t"
    f" WHERE {T.WINDOW_SQL} AND app_version IN ('2.0.0', '3.0.0')"
    " AND release_identity_quality = 'OCCURRENCE_BOUND' AND installation_hmac IS NOT NULL",
)
def _(spark, sf):
    releases = (T.NEW, "3.0.0")
    rows = R.release_rows(T.inbox(spark, sf), T.SCOPE, WINDOW, releases)
    return R.hmac_continuity(R.release_measures(rows, releases))


def _trend_columns() -> str:
    out = []
    for role, release in (("new", "2.0.0"), ("baseline", "1.0.0")):
        mine = f"app_version = '{release}'"
        ok = f"{mine} AND release_identity_quality = 'OCCURRENCE_BOUND'"
        seen = f"count(*) FILTER ({ok} AND family IN ('JAVA_CRASH', 'ANR', 'NATIVE_CRASH'," \
               " 'NATIVE_TOMBSTONE'))"
        for name, family in (("java_crash_events", "JAVA_CRASH"), ("anr_events", "ANR"),
                             ("native_crash_events", "NATIVE_CRASH"),
                             ("native_tombstone_events", "NATIVE_TOMBSTONE")):
            out.append(
                f"CASE WHEN count(*) FILTER ({ok}) > 0 THEN count(*) FILTER ({ok} AND"
                f" family = '{family}') END AS {role}_{name}"
            )
        out.append(
            f"CASE WHEN count(*) FILTER ({mine}) = 0 THEN 'NO_DATA' WHEN count(*) FILTER ({ok}) = 0"
            f" THEN 'UNAVAILABLE' WHEN count(*) FILTER ({ok}) < count(*) FILTER ({mine}) THEN"
            f" 'DEGRADED' WHEN {seen} > 0 THEN 'PRESENT' ELSE 'ZERO' END AS {role}_state"
        )
    return ", ".join(out)


SPINE_SQL = (
    f"spine AS (SELECT b AS bucket, {T.FROM_MS} + b * {BUCKET} AS bucket_start_ms,"
    f" least({T.FROM_MS} + (b + 1) * {BUCKET}, {T.TO_MS}) AS bucket_end_ms"
    f" FROM range({-(-(T.TO_MS - T.FROM_MS) // BUCKET)}) r(b))"
)


@query(
    "release_incident_trend",
    T.duck_cte(extra=SPINE_SQL)
    + f", w AS (SELECT *, {FAMILY_SQL} AS family, (occurrence_timestamp_ms - {T.FROM_MS})"
    f" // {BUCKET} AS bucket FROM t WHERE {T.WINDOW_SQL})"
    f" SELECT bucket_start_ms, bucket_end_ms, {_trend_columns()}"
    " FROM spine LEFT JOIN w USING (bucket) GROUP BY bucket_start_ms, bucket_end_ms",
)
def _(spark, sf):
    return R.release_incident_trend(T.telemetry(spark, sf), T.SCOPE, WINDOW, T.NEW, T.BASE)


INCIDENT_SQL = "('JAVA_CRASH', 'NATIVE_CRASH', 'ANR', 'NATIVE_TOMBSTONE')"
INSTALLS_SQL = "CASE WHEN bool_and(installation_hmac IS NOT NULL) THEN" \
    " count(DISTINCT installation_hmac) END"


@query(
    "top_fingerprints",
    T.duck_cte() + f" SELECT incident_fingerprint AS fingerprint, {FAMILY_SQL} AS event_family,"
    f" count(*) AS event_count, {INSTALLS_SQL} AS affected_installation_count,"
    " min(occurrence_timestamp_ms) AS first_seen_ms, max(occurrence_timestamp_ms) AS last_seen_ms"
    f" FROM t WHERE {T.WINDOW_SQL} AND app_version = '2.0.0' AND incident_fingerprint IS NOT NULL"
    " AND release_identity_quality = 'OCCURRENCE_BOUND'"
    f" AND {FAMILY_SQL} IN {INCIDENT_SQL} GROUP BY 1, 2"
    " ORDER BY event_count DESC, last_seen_ms DESC, fingerprint, event_family LIMIT 20",
)
def _(spark, sf):
    return I.top_fingerprints(window(T.telemetry(spark, sf)), T.NEW, 20)


@query(
    "affected_installation_count",
    T.duck_cte() + " SELECT app_version, count(*) AS event_count, CASE WHEN"
    " count(DISTINCT installation_hmac_key_version) <= 1 THEN"
    f" {INSTALLS_SQL} END AS affected_installation_count FROM t WHERE {T.WINDOW_SQL}"
    f" AND release_identity_quality = 'OCCURRENCE_BOUND' AND {FAMILY_SQL} IN {INCIDENT_SQL}"
    " AND installation_hmac IS NOT NULL GROUP BY app_version",
)
def _(spark, sf):
    rows = window(T.telemetry(spark, sf))
    incidents = I.incident_rows(rows).filter("eligible AND installation_hmac IS NOT NULL")
    return I.affected_installation_count(incidents, "app_version")


ISSUE_SQL = (
    f"i AS (SELECT *, {FAMILY_SQL} AS family, {SCENE_SQL} AS scene_state,"
    f" (occurrence_timestamp_ms - {T.FROM_MS}) // {BUCKET} AS bucket FROM t WHERE {T.WINDOW_SQL}"
    " AND incident_fingerprint = sha256('fp-0-4') AND release_identity_quality ="
    " 'OCCURRENCE_BOUND'),"
    " k2 AS (SELECT count(DISTINCT installation_hmac_key_version) > 1 AS broken FROM i"
    " WHERE installation_hmac IS NOT NULL)"
)


def _issue(spark, sf):
    return I.issue_rows(window(T.telemetry(spark, sf)), FINGERPRINT)


@query(
    "issue_detail",
    T.duck_cte(extra=ISSUE_SQL)
    + " SELECT sha256('fp-0-4') AS fingerprint, CASE WHEN (SELECT broken FROM k2) THEN"
    " 'UNAVAILABLE' ELSE 'PRESENT' END AS state, CASE WHEN (SELECT broken FROM k2) THEN"
    " 'INSTALLATION_HMAC_CONTINUITY_BREAK' END AS reason, CASE WHEN count(DISTINCT family) > 1"
    " THEN 'MIXED' ELSE min(family) END AS event_family, count(*) AS event_count,"
    f" CASE WHEN NOT (SELECT broken FROM k2) THEN {INSTALLS_SQL} END"
    " AS affected_installation_count, min(occurrence_timestamp_ms) AS first_seen_ms,"
    " max(occurrence_timestamp_ms) AS last_seen_ms FROM i",
)
def _(spark, sf):
    return I.issue_detail(window(T.telemetry(spark, sf)), FINGERPRINT)


DIMS_SQL = (
    "u AS (SELECT 'release' AS dimension, app_version AS label, 'AVAILABLE' AS state, * FROM i"
    " UNION ALL SELECT 'scene', CASE WHEN raw_pruned_ms IS NULL THEN scene END, scene_state, *"
    " FROM i UNION ALL SELECT 'device_model', device_model, CASE WHEN device_model IS NULL THEN"
    " 'MISSING' ELSE 'AVAILABLE' END, * FROM i UNION ALL SELECT 'android_version', os_version,"
    " CASE WHEN os_version IS NULL THEN 'MISSING' ELSE 'AVAILABLE' END, * FROM i)"
)


@query(
    "issue_distribution",
    T.duck_cte(extra=f"{ISSUE_SQL}, {DIMS_SQL}")
    + ", g AS (SELECT dimension, label, count(*) AS event_count, CASE WHEN NOT (SELECT broken FROM"
    f" k2) THEN {INSTALLS_SQL} END AS affected_installation_count FROM u WHERE state = 'AVAILABLE'"
    " AND label IS NOT NULL GROUP BY dimension, label), n AS (SELECT *, row_number() OVER"
    " (PARTITION BY dimension ORDER BY event_count DESC, label) AS rank FROM g)"
    " SELECT * FROM n WHERE rank <= 10",
)
def _(spark, sf):
    return I.issue_distribution(_issue(spark, sf))


@query(
    "issue_coverage",
    T.duck_cte(extra=f"{ISSUE_SQL}, {DIMS_SQL}")
    + ", g AS (SELECT dimension, count(*) AS total_event_count,"
    " count(*) FILTER (state = 'AVAILABLE') AS available_event_count,"
    " count(*) FILTER (state = 'MISSING') AS missing_event_count,"
    " count(*) FILTER (state = 'EXPIRED') AS expired_event_count,"
    " count(*) FILTER (state = 'RETENTION_UNKNOWN') AS retention_unknown_event_count"
    " FROM u GROUP BY dimension) SELECT *, CASE WHEN available_event_count = 0 THEN 'UNAVAILABLE'"
    " WHEN available_event_count < total_event_count THEN 'DEGRADED' ELSE 'PRESENT' END AS state,"
    " CASE WHEN available_event_count = total_event_count THEN NULL"
    " WHEN retention_unknown_event_count > 0 THEN 'SCENE_RETENTION_UNKNOWN'"
    " WHEN expired_event_count > 0 THEN 'SCENE_EVIDENCE_EXPIRED'"
    " WHEN dimension = 'scene' THEN 'SCENE_NOT_PROVIDED'"
    " WHEN dimension = 'device_model' THEN 'STANDARD_DEVICE_RESOURCE_NOT_PROVIDED'"
    " ELSE 'STANDARD_OS_RESOURCE_NOT_PROVIDED' END AS reason FROM g",
)
def _(spark, sf):
    return I.issue_coverage(_issue(spark, sf))


@query(
    "issue_trend",
    T.duck_cte(extra=f"{ISSUE_SQL}, {SPINE_SQL}")
    + " SELECT bucket_start_ms, bucket_end_ms, CASE WHEN count(i.id) > 0 THEN count(i.id) END"
    " AS event_count, CASE WHEN count(i.id) > 0 AND NOT (SELECT broken FROM k2) AND"
    " count(i.id) = count(installation_hmac) THEN count(DISTINCT installation_hmac) END"
    " AS affected_installation_count FROM spine LEFT JOIN i USING (bucket)"
    " GROUP BY bucket_start_ms, bucket_end_ms",
)
def _(spark, sf):
    return I.issue_trend(_issue(spark, sf), T.FROM_MS, T.TO_MS)


@query(
    "fingerprint_summary",
    f"{RELEASE_CTE}, p AS (SELECT count(*) AS n, count(incident_fingerprint) AS printed FROM e"
    f" WHERE app_version = '2.0.0' AND family IN {INCIDENT_SQL})"
    " SELECT '2.0.0' AS release_version, CASE WHEN n = 0 THEN 'ZERO' WHEN printed = 0 THEN"
    " 'UNAVAILABLE' WHEN printed < n THEN 'DEGRADED' ELSE 'PRESENT' END AS state,"
    " n AS sample_count, round(printed / n, 6) AS fingerprint_coverage,"
    " cast(NULL AS varchar) AS installation_reason FROM p",
)
def _(spark, sf):
    out = I.fingerprint_summary(window(T.telemetry(spark, sf)), T.NEW)
    return out.withColumn("fingerprint_coverage", F.round("fingerprint_coverage", 6))


QUALITY_CTE = T.duck_cte(*SDK_FIELDS) + (
    f", w AS (SELECT *, release_identity_quality = 'OCCURRENCE_BOUND' AS bound, {LATE_SQL} AS late,"
    f" {SDK_VALID_SQL} AS sdk_valid, {SDK_DROPPED_SQL} AS sdk_dropped FROM t WHERE {T.WINDOW_SQL}"
    " AND app_version = '2.0.0'), q AS (SELECT count(*) AS samples, count(*) FILTER (bound) AS"
    " bound, count(installation_hmac) FILTER (bound) AS identified, count(session_hmac) FILTER"
    " (bound) AS sessions, count(device_model) FILTER (bound) AS devices, count(os_version) FILTER"
    " (bound) AS os_versions, count(*) FILTER (late) AS late, count(*) FILTER (name ="
    " 'sdk_health') AS sdk_rows, count(*) FILTER (name = 'sdk_health' AND NOT sdk_valid) AS"
    " sdk_invalid, count(*) FILTER (name = 'sdk_health' AND sdk_dropped) AS sdk_drops,"
    " max(cast(f_dropRate AS double)) AS worst FROM w)"
)
COVERAGES = (
    ("release_identity", "bound", "samples", "OCCURRENCE_IDENTITY_NOT_PROVIDED"),
    ("installation_identity", "identified", "bound", "INSTALLATION_IDENTITY_NOT_PROVIDED"),
    ("session_identity", "sessions", "bound", "SESSION_ID_NOT_PROVIDED"),
    ("device_model_coverage", "devices", "bound", "STANDARD_DEVICE_RESOURCE_NOT_PROVIDED"),
    ("os_version_coverage", "os_versions", "bound", "STANDARD_OS_RESOURCE_NOT_PROVIDED"),
)


def _quality_row(metric, state, value, top, bottom, samples, coverage, reason) -> str:
    return (
        f"SELECT '{metric}' AS metric, {state} AS state, round(cast({value} AS double), 6)"
        f" AS value, cast({top} AS bigint) AS numerator, cast({bottom} AS bigint) AS denominator,"
        f" cast({samples} AS bigint) AS sample_count, round(cast({coverage} AS double), 6) AS"
        f" coverage, cast({T.TO_MS} AS bigint) AS as_of_ms, 'durable_inbox' AS source,"
        f" cast({reason} AS varchar) AS reason FROM q"
    )


COVERAGE_ROWS = [
    _quality_row(
        metric,
        f"CASE WHEN {part} = 0 THEN 'UNAVAILABLE' WHEN {part} = {whole} THEN 'PRESENT'"
        " ELSE 'DEGRADED' END",
        f"CASE WHEN {part} > 0 THEN {part} / {whole} END", part, whole, whole,
        f"{part} / {whole}",
        f"CASE WHEN {part} = 0 THEN '{missing}' WHEN {part} < {whole} THEN"
        " 'IDENTITY_COVERAGE_INCOMPLETE' END",
    )
    for metric, part, whole, missing in COVERAGES
]
QUALITY_ROWS = COVERAGE_ROWS + [
    _quality_row(
        "sdk_health", METRIC_SQL["sdk_drop_rate"][0],
        "CASE WHEN sdk_rows > 0 AND sdk_invalid = 0 THEN worst END", "NULL", "NULL", "sdk_rows",
        "NULL", METRIC_SQL["sdk_drop_rate"][6],
    ),
    _quality_row(
        "late_data", "CASE WHEN late > 0 THEN 'LATE' ELSE 'ZERO' END", "late / samples", "late",
        "samples", "samples", "NULL", "NULL",
    ),
]


@query(
    "data_quality",
    f"{QUALITY_CTE}, s AS (SELECT CASE WHEN bound = 0 THEN 'UNAVAILABLE' WHEN bound < samples OR"
    " identified < bound OR sdk_drops > 0 THEN 'DEGRADED' WHEN late > 0 THEN 'LATE' WHEN"
    " sdk_rows = 0 OR sdk_invalid > 0 THEN 'UNAVAILABLE' ELSE 'PRESENT' END AS window_state"
    f" FROM q), m AS ({' UNION ALL '.join(QUALITY_ROWS)})"
    " SELECT (SELECT window_state FROM s) AS window_state, m.* FROM m",
)
def _(spark, sf):
    report = Q.data_quality(window(T.inbox(spark, sf)), T.TO_MS, T.NEW)
    return Q.quality_metrics(report)


@query(
    "identity_coverages",
    f"{QUALITY_CTE} {' UNION ALL '.join(COVERAGE_ROWS)}",
)
def _(spark, sf):
    rows = window(T.inbox(spark, sf)).filter(F.col("app_version") == T.NEW)
    report = Q.identity_coverages(Q.quality_counts(rows), T.TO_MS)
    names = [metric for metric, *_ in COVERAGES]
    return report.selectExpr(*M.long_form(names)).select("metric", *M.flat("m"))


@query(
    "quality_distributions",
    T.duck_cte(extra=f"w AS (SELECT * FROM t WHERE {T.WINDOW_SQL})")
    + " "
    + " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {d} AS label, count(*) AS event_count FROM w GROUP BY {d}"
        for d in ("protocol", "schema_version", "inbox_status")
    ),
)
def _(spark, sf):
    return Q.quality_distributions(window(T.telemetry(spark, sf)))
