"""Normalization and performance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgauge import catalog
from vitalgauge.operators import fingerprints as FP
from vitalgauge.operators import normalize as N
from vitalgauge.operators import performance as P
from vitalgauge.operators.percentiles import percentile_aggregates, spread_percentiles
from vitalgauge.plans import telemetry as T
from vitalgauge.plans.registry import query
from vitalgauge.plans.release_queries import SPINE_SQL
from vitalgauge.plans.scan_queries import (
    BUCKET,
    FAMILY_SQL,
    JOBS_SQL,
    LATE_SQL,
    symbol_jobs,
    window,
)

RELEASES = (T.NEW, T.BASE)


def rounded(df, *columns):
    """Round double columns for comparison."""
    doubles = columns or [c for c, kind in df.dtypes if kind == "double"]
    return df.select(*[F.round(c, 6).alias(c) if c in doubles else F.col(c) for c in df.columns])


# Registered fields of the mapped events: kind, SQL of INVALID, SQL of UNKNOWN.
SPEC = {
    "launchDurationMs": ("number", "f = '-1'", "FALSE"),
    "isColdStart": ("boolean", "f = 'yes'", "FALSE"),
    "phaseContentProviderCount": ("integer", "f = '1.5'", "FALSE"),
    "durationMs": ("number", "f = '-1'", "FALSE"),
    "statusCode": ("integer", "FALSE", "FALSE"),
    "fps": ("number", "FALSE", "FALSE"),
    "windowDurationMs": ("number", "f = '-1'", "FALSE"),
    "frameCount": ("integer", "FALSE", "FALSE"),
    "jankCount": ("integer", "FALSE", "FALSE"),
    "dropSeverity": ("integer", "FALSE", "f = '4'"),
    "emitCount": ("integer", "FALSE", "FALSE"),
    "dropCount": ("integer", "FALSE", "FALSE"),
    "dropRate": ("number", "FALSE", "FALSE"),
    "dispatcherStage.resolve.count": ("integer", "FALSE", "FALSE"),
    "dispatcherStage.resolve.avgMicros": ("number", "f = '-1'", "FALSE"),
    "session_schema_version": ("integer", "FALSE", "FALSE"),
    "session_count": ("integer", "FALSE", "FALSE"),
    "stackTrace": ("string", "FALSE", "FALSE"),
    "threadName": ("string", "FALSE", "FALSE"),
    "mainThreadStack": ("string", "FALSE", "FALSE"),
    "stackSamples": ("string", "FALSE", "FALSE"),
    "backtrace": ("string", "FALSE", "FALSE"),
    "signal": ("integer", "FALSE", "FALSE"),
}
SENSITIVE = ("stackTrace", "mainThreadStack", "stackSamples", "backtrace")


def _field_rows() -> str:
    parts = []
    for name, (kind, invalid, unknown) in SPEC.items():
        f = "f_" + name.replace(".", "_")
        state = (
            f"CASE WHEN {invalid.replace('f =', f + ' =')} THEN 'INVALID'"
            f" WHEN {unknown.replace('f =', f + ' =')} THEN 'UNKNOWN' ELSE 'AVAILABLE' END"
        )
        parts.append(
            f"SELECT id, module, name, raw_pruned_ms, '{name}' AS field, '{kind}' AS type,"
            f" {f} AS raw, {state} AS state FROM t WHERE {f} IS NOT NULL"
        )
    return " UNION ALL ".join(parts)


# The mapped events; the registry's rows for them enter the SQL as a table of literals.
MAPPED = (
    ("crash", "java_crash"), ("crash", "native_crash"), ("crash", "tombstone_crash"), ("anr", "anr_detected"),
    ("network", "network_request"), ("launch", "cold_start"), ("launch", "warm_start"), ("launch", "hot_start"),
    ("fps", "fps_stats"), ("core", "session_start"), ("core", "sdk_health"),
)


def literal_rows(name: str, columns: str, rows: list[tuple]) -> str:
    """``name AS (...)`` with the rows as SQL literals."""
    values = ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)
    return f"{name} AS (SELECT * FROM (VALUES {values}) r({columns}))"


REGISTERED = literal_rows(
    "reg", "module, name, field, type",
    [(f.module, f.name, f.field, f.type) for f in catalog.registry() if (f.module, f.name) in MAPPED],
)
FIELDS_CTE = (
    T.duck_cte(*T.FIELD_TEXT)
    + f", sent AS ({_field_rows()}), {REGISTERED}, v AS (SELECT t.id, t.module, t.name, t.raw_pruned_ms, reg.field, reg.type,"
    " sent.raw, coalesce(sent.state, 'MISSING') AS state FROM t JOIN reg ON reg.module = t.module AND reg.name = t.name LEFT"
    " JOIN sent ON sent.id = t.id AND sent.field = reg.field)"
)


@query(
    "normalize_fields",
    f"{FIELDS_CTE} SELECT id, field, state, CASE WHEN state = 'AVAILABLE' AND type <> 'number'"
    " THEN raw END AS text_value, CASE WHEN state = 'AVAILABLE' AND type = 'number' THEN"
    " cast(raw AS double) END AS number_value FROM v",
)
def _(spark, sf):
    return N.field_values(T.inbox(spark, sf), "id")


@query(
    "field_states",
    f"{FIELDS_CTE}, n AS (SELECT module, name, state, count(*) AS event_count FROM v"
    " GROUP BY 1, 2, 3) SELECT * FROM n",
)
def _(spark, sf):
    """Registered field states per event."""
    return (
        N.field_values(T.inbox(spark, sf), "module", "name")
        .groupBy("module", "name", "state")
        .agg(F.count("*").alias("event_count"))
    )


UNITS = ("events", "ratio", "%", "ratio_delta", "ms_epoch", "http_status", "ms", "none")
UNIT_CASE = "CASE k % 8 " + " ".join(f"WHEN {i} THEN '{u}'" for i, u in enumerate(UNITS)) + " END"
PROBE = (
    "CASE WHEN k % 8 = 4 THEN occurrence_timestamp_ms + (k - 50) * 30000"
    " WHEN k % 16 < 8 THEN cast(k - 30 AS double) / 25 ELSE k * 2 END"
)


@query(
    "check_unit_bounds",
    T.duck_cte() + f", p AS (SELECT id, cast({PROBE} AS double) AS probe, {UNIT_CASE} AS unit,"
    " occurrence_timestamp_ms AS ts FROM t) SELECT id, unit, probe,"
    " CASE unit WHEN 'events' THEN probe >= 0 WHEN 'ms' THEN probe >= 0 WHEN 'ratio' THEN"
    " probe >= 0 AND probe <= 1 WHEN '%' THEN probe >= 0 AND probe <= 100 WHEN 'ratio_delta'"
    " THEN probe >= -1 AND probe <= 1 WHEN 'ms_epoch' THEN probe > 0 AND probe <= ts + 600000"
    " ELSE TRUE END AS in_bounds FROM p",
)
def _(spark, sf):
    probes = T.telemetry(spark, sf).selectExpr(
        "id", f"cast({PROBE} AS double) AS probe", f"{UNIT_CASE} AS unit",
        "occurrence_timestamp_ms",
    )
    checked = N.check_unit_bounds(probes, "probe", "unit", "occurrence_timestamp_ms")
    return checked.select("id", "unit", "probe", "in_bounds")


@query(
    "normalize_categories",
    T.duck_cte("dropSeverity", "isColdStart")
    + " SELECT id, 'dropSeverity' AS field, CASE WHEN f_dropSeverity IS NULL THEN 'MISSING'"
    " WHEN f_dropSeverity IN ('0', '1', '2', '3') THEN 'AVAILABLE' ELSE 'UNKNOWN' END AS state,"
    " CASE WHEN f_dropSeverity IN ('0', '1', '2', '3') THEN f_dropSeverity END AS label FROM t"
    " WHERE name = 'fps_stats' UNION ALL SELECT id, 'isColdStart', CASE WHEN f_isColdStart IS NULL"
    " THEN 'MISSING' WHEN f_isColdStart IN ('true', 'false') THEN 'AVAILABLE' ELSE 'INVALID' END,"
    " CASE WHEN f_isColdStart IN ('true', 'false') THEN f_isColdStart END FROM t"
    " WHERE module = 'launch'",
)
def _(spark, sf):
    return N.normalize_categories(T.inbox(spark, sf), "id")


@query(
    "indexed_attributes",
    f"{FIELDS_CTE} SELECT id, field, CASE WHEN type IN ('integer', 'number') THEN"
    " cast(raw AS double) END AS number_value, CASE WHEN type IN ('boolean', 'string') THEN raw"
    " END AS text_value FROM v WHERE state = 'AVAILABLE' AND field NOT IN"
    f" ({', '.join(repr(s) for s in SENSITIVE)})",
)
def _(spark, sf):
    return N.indexed_attributes(T.inbox(spark, sf), "id")


@query(
    "count_unknown_fields",
    T.duck_cte("custom") + " SELECT id, CASE WHEN f_custom IS NULL THEN 0 ELSE 1 END"
    " AS unknown_field_count FROM t",
)
def _(spark, sf):
    return T.inbox(spark, sf).select("id", "unknown_field_count")


@query(
    "classify_event_family",
    T.duck_cte() + f" SELECT {FAMILY_SQL} AS event_family, count(*) AS event_count FROM t"
    " GROUP BY 1",
)
def _(spark, sf):
    rows = N.classify_event_family(T.telemetry(spark, sf))
    return rows.groupBy("event_family").agg(F.count("*").alias("event_count"))


EXIT_TEXT = (
    "CASE k % 4 WHEN 0 THEN cast(occurrence_timestamp_ms - k * 1000 AS string) WHEN 1 THEN '-5'"
    " WHEN 2 THEN cast(occurrence_timestamp_ms + (k - 50) * 100000 AS string) END"
)


@query(
    "resolve_occurrence_time",
    T.duck_cte() + f", x AS (SELECT id, occurrence_timestamp_ms AS ts, {EXIT_TEXT} AS raw FROM t"
    " WHERE module = 'crash'), y AS (SELECT *, CASE WHEN cast(raw AS bigint) > 0 AND"
    " cast(raw AS bigint) <= ts + 600000 THEN cast(raw AS bigint) END AS good FROM x)"
    " SELECT id, coalesce(good, ts) AS resolved_occurrence_ms, ts AS resolved_collection_ms,"
    " CASE WHEN good IS NULL THEN 'event.timestamp' ELSE 'fields.exitTimestamp' END"
    " AS timestamp_source FROM y",
)
def _(spark, sf):
    exits = (
        T.telemetry(spark, sf)
        .filter("module = 'crash'")
        .withColumn("name", F.lit("app_exit"))
        .withColumn(
            "fields",
            F.expr(f"map_filter(map('exitTimestamp', {EXIT_TEXT}), (k, v) -> v IS NOT NULL)"),
        )
    )
    normalized = N.normalize_fields(exits, "occurrence_timestamp_ms")
    return N.resolve_occurrence_time(normalized, "occurrence_timestamp_ms").select(
        "id", "resolved_occurrence_ms", "resolved_collection_ms", "timestamp_source"
    )


STACK_SQL = (
    "CASE WHEN name = 'java_crash' THEN nullif(f_stackTrace, '') WHEN name = 'anr_detected' THEN"
    " coalesce(nullif(f_mainThreadStack, ''), nullif(f_stackSamples, '')) END"
)
JAVA_PRINT_SQL = (
    f"CASE WHEN {STACK_SQL} IS NOT NULL THEN sha256(cast(to_json(list_filter(list_transform("
    f"string_split(replace({STACK_SQL}, chr(13) || chr(10), chr(10)), chr(10)), lambda x:"
    " regexp_replace(regexp_replace(trim(x), '(?:0x)?[0-9a-fA-F]{6,}', '<addr>', 'g'),"
    " ':[0-9]+\\)', ':<line>)', 'g')), lambda x: x <> '')) AS varchar)) END"
)
NATIVE_PRINT_SQL = (
    "CASE WHEN f_backtrace IS NOT NULL AND name IN ('native_crash', 'tombstone_crash') THEN"
    " sha256('{\"family\":\"' || CASE name WHEN 'native_crash' THEN 'NATIVE_CRASH' ELSE"
    " 'NATIVE_TOMBSTONE' END || '\",\"frames\":[[\"4a' || cast(k % 6 AS varchar) ||"
    " 'f0\",\"libc.so\",\"(abort+12)\"],[\"b' || cast(k % 3 AS varchar) ||"
    " '\",\"libapp.so\",\"\"]],\"signal\":\"' || f_signal || '\"}') END"
)
STACK_FIELDS = ("stackTrace", "mainThreadStack", "stackSamples", "backtrace", "signal")


@query(
    "fingerprint_java_anr",
    T.duck_cte(*STACK_FIELDS) + f" SELECT id, name, {JAVA_PRINT_SQL} AS stack_fingerprint FROM t"
    " WHERE name IN ('java_crash', 'anr_detected')",
)
def _(spark, sf):
    rows = T.telemetry(spark, sf).filter("name IN ('java_crash', 'anr_detected')")
    return FP.fingerprint_java_anr(rows).select("id", "name", "stack_fingerprint")


@query(
    "fingerprint_native",
    T.duck_cte(*STACK_FIELDS) + f" SELECT id, name, {NATIVE_PRINT_SQL} AS native_fingerprint"
    " FROM t WHERE name IN ('native_crash', 'tombstone_crash')",
)
def _(spark, sf):
    rows = T.telemetry(spark, sf).filter("name IN ('native_crash', 'tombstone_crash')")
    return FP.fingerprint_native(rows).select("id", "name", "native_fingerprint")


@query(
    "field_availability",
    f"{FIELDS_CTE} SELECT id, field, CASE WHEN raw_pruned_ms IS NOT NULL AND state = 'AVAILABLE'"
    " AND type = 'string' THEN 'EXPIRED' ELSE state END AS state FROM v",
)
def _(spark, sf):
    from vitalgauge.operators.scope import retained_values

    pruned = F.col("raw_pruned_ms").isNotNull()
    states = N.field_availability(F.col("field_states"), pruned, *retained_values(pruned))
    return T.inbox(spark, sf).select("id", F.explode(states).alias("field", "state"))


@query(
    "renormalize_backfill",
    T.duck_cte(*STACK_FIELDS, "custom")
    + ", x AS (SELECT *, CASE WHEN k % 3 = 0 THEN NULL ELSE incident_fingerprint END AS fp,"
    f" coalesce({JAVA_PRINT_SQL}, {NATIVE_PRINT_SQL}) AS fresh FROM t WHERE k % 5 < 4"
    " AND raw_pruned_ms IS NULL) SELECT id, 4 AS normalization_version, coalesce(fp, fresh) AS"
    " incident_fingerprint, CASE WHEN fp IS NULL AND fresh IS NOT NULL THEN fresh ELSE"
    " raw_incident_fingerprint END AS raw_incident_fingerprint, CASE WHEN f_custom IS NULL THEN 0"
    " ELSE 1 END AS unknown_field_count FROM x",
)
def _(spark, sf):
    rows = T.telemetry(spark, sf).selectExpr(
        "*", "k % 5 AS normalization_version", "occurrence_timestamp_ms AS event_timestamp_ms"
    ).withColumn("incident_fingerprint", F.expr("if(k % 3 = 0, NULL, incident_fingerprint)"))
    return N.renormalize_backfill(rows).select(
        "id",
        "normalization_version",
        "incident_fingerprint",
        "raw_incident_fingerprint",
        "unknown_field_count",
    )


@query(
    "canonicalize_issues",
    T.duck_cte() + f", {JOBS_SQL} SELECT id, incident_fingerprint AS raw_incident_fingerprint,"
    " CASE WHEN incident_fingerprint IS NOT NULL THEN coalesce(fingerprint_sha256,"
    " incident_fingerprint) END AS incident_fingerprint FROM t LEFT JOIN (SELECT * FROM jobs"
    " WHERE job_type = 'java' AND job_status = 'symbolized') j ON id = inbox_event_id"
    " WHERE module = 'crash'",
)
def _(spark, sf):
    rows = T.telemetry(spark, sf).filter("module = 'crash'")
    return N.canonicalize_issues(rows, symbol_jobs(spark, sf)).select(
        "id", "raw_incident_fingerprint", "incident_fingerprint"
    )


@query("field_registry")
def _(spark, sf):
    """The registry with the number of rows that sent each field."""
    sent = (
        T.telemetry(spark, sf)
        .select("module", "name", F.explode(F.map_keys("fields")).alias("field"))
        .groupBy("module", "name", "field")
        .agg(F.count("*").alias("sent_count"))
    )
    return catalog.field_registry(spark).join(sent, ["module", "name", "field"], "left")


KNOWN_SQL = (
    "known AS (SELECT unnest(["
    + ", ".join(
        f"{{'p': {p}, 'm': '{m}', 'n': '{n}'}}" for p, (m, n) in enumerate(catalog.known_events())
    )
    + "]) AS x)"
)


@query(
    "event_catalog",
    T.duck_cte(extra=KNOWN_SQL) + " SELECT x.p AS position, x.m AS module, x.n AS name,"
    " nullif(count(id), 0) AS event_count FROM known LEFT JOIN t ON module = x.m AND name = x.n"
    " GROUP BY 1, 2, 3",
)
def _(spark, sf):
    """Known events with the number of rows reporting each."""
    seen = T.telemetry(spark, sf).groupBy("module", "name").agg(F.count("*").alias("event_count"))
    return catalog.event_catalog(spark).join(seen, ["module", "name"], "left")


@query(
    "load_observations",
    T.duck_cte() + f" SELECT id, app_version, module, name FROM t WHERE {T.WINDOW_SQL}"
    " AND app_version IN ('2.0.0', '1.0.0')",
)
def _(spark, sf):
    rows = P.load_observations(T.telemetry(spark, sf), T.SCOPE, T.FROM_MS, T.TO_MS, RELEASES)
    return rows.select("id", "app_version", "module", "name")


# (metric, event predicate, raw field, INVALID text, gate)
OBSERVED = [
    (f"launch.{n}.launchDurationMs", f"name = '{n}'", "launchDurationMs", "-1", None)
    for n in ("cold_start", "warm_start", "hot_start")
] + [
    ("launch.cold_start.phaseContentProviderCount", "name = 'cold_start'",
     "phaseContentProviderCount", "1.5", None),
    ("network.network_request.durationMs", "name = 'network_request'", "durationMs", "-1", None),
    ("network.network_request.statusCode", "name = 'network_request'", "statusCode", "none", None),
    ("fps.fps_stats.fps", "name = 'fps_stats'", "fps", "none", None),
    ("fps.fps_stats.windowDurationMs", "name = 'fps_stats'", "windowDurationMs", "-1", None),
    ("fps.fps_stats.frameCount", "name = 'fps_stats'", "frameCount", "none", None),
    ("fps.fps_stats.jankCount", "name = 'fps_stats'", "jankCount", "none", None),
    ("anr.anr_detected.durationMs", "name = 'anr_detected'", "durationMs", "-1", None),
    ("core.sdk_health.emitCount", "name = 'sdk_health'", "emitCount", "none", None),
    ("core.sdk_health.dropCount", "name = 'sdk_health'", "dropCount", "none", None),
    ("core.sdk_health.dropRate", "name = 'sdk_health'", "dropRate", "none", None),
    ("core.sdk_health.dispatcherStage.resolve.count", "name = 'sdk_health'",
     "dispatcherStage.resolve.count", "none", None),
    ("core.sdk_health.dispatcherStage.resolve.avgMicros", "name = 'sdk_health'",
     "dispatcherStage.resolve.avgMicros", "-1", "cast(f_dispatcherStage_resolve_count AS int) > 0"),
]


def _unsent() -> list[tuple]:
    """Registered observations of the mapped events that are never sent, and what their gate says then.

    A gate on a field that isn't sent is closed; the one on ``resolve.count`` is open where that is above 0.
    """
    sent = {metric for metric, *_ in OBSERVED}
    rows = []
    for f in catalog.performance_fields():
        if f.id in sent or (f.module, f.name) not in MAPPED:
            continue
        gate = "closed" if f.availability_field else "none"
        if f.sample_count_field:
            gate = "resolve" if f.sample_count_field == "dispatcherStage.resolve.count" else "closed"
        rows.append((f.module, f.name, f.id, gate))
    return rows


UNSENT = literal_rows("unsent", "module, name, metric_id, gate", _unsent())


def observed_sql(where: str, columns: str = "id") -> str:
    """CTE body of the mapped observations in long form."""
    parts = []
    for metric, event, field, invalid, gate in OBSERVED:
        f = "f_" + field.replace(".", "_")
        closed = f"NOT ({gate})" if gate else "FALSE"
        ok = f"{f} IS NOT NULL AND {f} <> '{invalid}' AND NOT ({closed})"
        parts.append(
            f"SELECT {columns}, '{metric}' AS metric_id, CASE WHEN {closed} THEN 'UNAVAILABLE'"
            f" WHEN {f} IS NULL THEN 'MISSING' WHEN {f} = '{invalid}' THEN 'INVALID'"
            f" ELSE 'AVAILABLE' END AS state, CASE WHEN {ok} THEN try_cast({f} AS double) END"
            f" AS value FROM t WHERE {event} AND {where}"
        )
    parts.append(
        f"SELECT {columns}, metric_id, CASE WHEN gate = 'closed' OR (gate = 'resolve' AND NOT"
        " coalesce(cast(f_dispatcherStage_resolve_count AS int) > 0, FALSE)) THEN 'UNAVAILABLE' ELSE 'MISSING' END AS state,"
        " cast(NULL AS double) AS value FROM (SELECT t.*, unsent.metric_id, unsent.gate FROM t JOIN unsent ON unsent.module ="
        f" t.module AND unsent.name = t.name) t WHERE {where}"
    )
    return " UNION ALL ".join(parts)


@query(
    "observe_value",
    T.duck_cte(*T.FIELD_TEXT) + f", {UNSENT}, o AS ({observed_sql(T.WINDOW_SQL)})"
    " SELECT id, metric_id, state, value FROM o",
)
def _(spark, sf):
    rows = window(T.inbox(spark, sf))
    return P.observe_value(rows, "id").select("id", "metric_id", "state", "value")


PERCENTILE_SQL = (
    "SELECT l_returnflag, l_linestatus,"
    + ", ".join(
        f" round(quantile_cont(cast(l_extendedprice AS double), {p}), 6) AS {name}"
        for name, p in P.PERCENTILES.items()
    )
    + " FROM lineitem GROUP BY l_returnflag, l_linestatus"
)
PRICE_GROUPS = (["l_returnflag", "l_linestatus"], "l_extendedprice", P.PERCENTILES)


@query("percentile_linear", PERCENTILE_SQL)
def _(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    return rounded(percentile_aggregates(lines, *PRICE_GROUPS))


@query("percentile_spread", PERCENTILE_SQL)
def _(spark, sf):
    """The plan for groups too large for one buffer: few groups hold all rows."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    return rounded(spread_percentiles(lines, *PRICE_GROUPS))


BOUND_SQL = (
    f"{T.WINDOW_SQL} AND app_version IN ('2.0.0', '1.0.0')"
    " AND release_identity_quality = 'OCCURRENCE_BOUND'"
)
SUMMARY_SQL = (
    "CASE WHEN count(*) = 0 THEN 'NO_DATA' WHEN count(value) = 0 THEN 'UNAVAILABLE' WHEN"
    " count(value) < count(*) THEN 'DEGRADED' WHEN count(*) FILTER (value <> 0) = 0 THEN 'ZERO'"
    " ELSE 'PRESENT' END AS state, count(value) AS sample_count, count(*) AS event_count,"
    " count(*) FILTER (state = 'MISSING') AS missing_count, count(*) FILTER (state = 'INVALID')"
    " AS invalid_count, count(*) FILTER (state = 'UNAVAILABLE') AS unavailable_count,"
    " round(count(value) / count(*), 6) AS coverage, round(avg(value), 6) AS mean,"
    " round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75,"
    " round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS maximum, min(value) AS minimum"
)
SUMMARY_CTE = (
    T.duck_cte(*T.FIELD_TEXT) + f", {UNSENT}, o AS ({observed_sql(BOUND_SQL, 'app_version')}),"
    f" s AS (SELECT app_version, metric_id, {SUMMARY_SQL} FROM o GROUP BY ALL)"
)


@query("summarize_metric", f"{SUMMARY_CTE} SELECT * FROM s")
def _(spark, sf):
    rows = P.bound_rows(window(T.inbox(spark, sf)), RELEASES)
    observed = P.observe_value(rows, "app_version")
    return rounded(P.summarize_metric(observed, "app_version"))


@query(
    "compare_metrics",
    f"{SUMMARY_CTE} SELECT metric_id, max(p95) FILTER (app_version = '2.0.0') AS current_p95,"
    " max(p95) FILTER (app_version = '1.0.0') AS baseline_p95, round(max(p95) FILTER"
    " (app_version = '2.0.0') - max(p95) FILTER (app_version = '1.0.0'), 6) AS p95_delta FROM s"
    " GROUP BY metric_id",
)
def _(spark, sf):
    rows = P.bound_rows(window(T.inbox(spark, sf)), RELEASES)
    observed = P.observe_value(rows, "app_version")
    summary = P.summarize_metric(observed, "app_version")
    return rounded(P.compare_metrics(summary, T.NEW, T.BASE))


TREND_METRIC = "network.network_request.durationMs"


@query(
    "metric_trend",
    T.duck_cte(*T.FIELD_TEXT, extra=f"{SPINE_SQL}, {UNSENT}")
    + f", o AS ({observed_sql(BOUND_SQL, 'app_version, (occurrence_timestamp_ms - ' + str(T.FROM_MS) + ') // ' + str(BUCKET) + ' AS bucket')}),"
    f" o2 AS (SELECT * FROM o WHERE metric_id = '{TREND_METRIC}'), s AS (SELECT app_version,"
    f" bucket, {SUMMARY_SQL} FROM o2 GROUP BY ALL), r AS (SELECT unnest(['2.0.0', '1.0.0']) AS"
    " app_version) SELECT r.app_version, bucket_start_ms, bucket_end_ms, coalesce(state,"
    " 'NO_DATA') AS state, coalesce(sample_count, 0) AS sample_count, coalesce(event_count, 0) AS"
    " event_count, coalesce(missing_count, 0) AS missing_count, coalesce(invalid_count, 0) AS"
    " invalid_count, coalesce(unavailable_count, 0) AS unavailable_count, coverage, mean, p50,"
    " p75, p95, maximum, minimum FROM spine CROSS JOIN r LEFT JOIN s ON s.bucket = spine.bucket"
    " AND s.app_version = r.app_version",
)
def _(spark, sf):
    rows = window(T.inbox(spark, sf))
    return rounded(P.metric_trend(rows, RELEASES, TREND_METRIC, T.FROM_MS, T.TO_MS))


@query(
    "event_statistics",
    T.duck_cte(extra=KNOWN_SQL)
    + f", w AS (SELECT * FROM t WHERE {T.WINDOW_SQL} AND app_version IN ('2.0.0', '1.0.0'))"
    " SELECT x.m AS module, x.n AS name, count(id) FILTER (app_version = '2.0.0' AND"
    " release_identity_quality = 'OCCURRENCE_BOUND') AS current_count, count(id) FILTER"
    " (app_version = '1.0.0' AND release_identity_quality = 'OCCURRENCE_BOUND') AS baseline_count,"
    " count(id) AS total_count, count(id) FILTER (release_identity_quality <>"
    " 'OCCURRENCE_BOUND') AS non_occurrence_count FROM known LEFT JOIN w ON w.module = x.m AND"
    " w.name = x.n GROUP BY 1, 2",
)
def _(spark, sf):
    rows = P.load_observations(T.telemetry(spark, sf), T.SCOPE, T.FROM_MS, T.TO_MS, RELEASES)
    return P.event_statistics(rows, T.NEW, T.BASE)


@query(
    "late_count",
    T.duck_cte() + f" SELECT count(*) FILTER ({LATE_SQL}) AS late_count, count(*) FILTER"
    " (release_identity_quality <> 'OCCURRENCE_BOUND') AS non_occurrence_count, count(*) AS"
    f" row_count FROM t WHERE {T.WINDOW_SQL}",
)
def _(spark, sf):
    return P.late_count(window(T.telemetry(spark, sf)))


CATEGORY_CTE = T.duck_cte("dropSeverity", "isColdStart") + (
    f", b AS (SELECT * FROM t WHERE {BOUND_SQL}), c AS (SELECT app_version,"
    " 'fps.fps_stats.dropSeverity' AS metric_id, f_dropSeverity AS raw, f_dropSeverity IN ('0',"
    " '1', '2', '3') AS known, 'UNKNOWN' AS other FROM b WHERE name = 'fps_stats' UNION ALL SELECT"
    " app_version, 'launch.' || name || '.isColdStart', f_isColdStart, f_isColdStart IN ('true',"
    " 'false'), 'INVALID' FROM b WHERE module = 'launch')"
)


LABELS = literal_rows(
    "lab", "app_version, metric_id, label",
    [(r, f.id, label) for r in RELEASES for f in catalog.category_fields() for label in f.allowed],
)


@query(
    "category_distribution",
    f"{CATEGORY_CTE}, {LABELS}, g AS (SELECT app_version, metric_id, raw AS label, count(*) AS event_count FROM c"
    " WHERE known GROUP BY ALL) SELECT app_version, metric_id, label, coalesce(event_count, 0) AS event_count FROM lab LEFT"
    " JOIN g USING (app_version, metric_id, label)",
)
def _(spark, sf):
    return P.category_distribution(window(T.inbox(spark, sf)), RELEASES)


@query(
    "category_summary",
    f"{CATEGORY_CTE}, {LABELS}, g AS (SELECT app_version, metric_id, count(*) AS event_count, count(*) FILTER"
    " (known) AS available_count, count(*) FILTER (raw IS NULL) AS missing_count, count(*) FILTER"
    " (NOT known AND other = 'INVALID') AS invalid_count, count(*) FILTER (NOT known AND other ="
    " 'UNKNOWN') AS unknown_count FROM c GROUP BY ALL), m AS (SELECT DISTINCT app_version, metric_id FROM lab) SELECT"
    " app_version, metric_id, coalesce(event_count, 0) AS event_count, coalesce(available_count, 0) AS available_count,"
    " coalesce(missing_count, 0) AS missing_count, coalesce(invalid_count, 0) AS invalid_count, coalesce(unknown_count, 0)"
    " AS unknown_count, 0 AS expired_count, CASE WHEN event_count IS NULL THEN 'NO_DATA' WHEN available_count = 0 THEN"
    " 'UNAVAILABLE' WHEN available_count = event_count THEN 'PRESENT' ELSE 'DEGRADED' END AS state FROM m LEFT JOIN g USING"
    " (app_version, metric_id)",
)
def _(spark, sf):
    return P.category_summary(window(T.inbox(spark, sf)), RELEASES)


@query(
    "weighted_fps",
    T.duck_cte("fps", "windowDurationMs")
    + f", p AS (SELECT app_version, cast(f_fps AS double) AS fps, cast(f_windowDurationMs AS"
    " double) AS span, CASE WHEN f_windowDurationMs = '-1' OR cast(f_windowDurationMs AS double)"
    " <= 0 THEN 'INVALID' WHEN f_windowDurationMs IS NULL THEN 'MISSING' ELSE 'AVAILABLE' END AS"
    f" state FROM t WHERE {BOUND_SQL} AND name = 'fps_stats')"
    " SELECT app_version, CASE WHEN count(*) FILTER (state = 'AVAILABLE') < count(*) THEN"
    " 'DEGRADED' ELSE 'PRESENT' END AS state, round(sum(fps * span) FILTER (state = 'AVAILABLE') /"
    " sum(span) FILTER (state = 'AVAILABLE'), 6) AS value, count(*) FILTER (state = 'AVAILABLE')"
    " AS sample_count, count(*) AS event_count, round(sum(span) FILTER (state = 'AVAILABLE'), 2)"
    " AS total_window_ms, count(*) FILTER (state = 'MISSING') AS missing_count, count(*) FILTER"
    " (state = 'INVALID') AS invalid_count, 0 AS unavailable_count, round(count(*) FILTER (state ="
    " 'AVAILABLE') / count(*), 6) AS coverage FROM p GROUP BY app_version",
)
def _(spark, sf):
    pairs = P.fps_pairs(P.bound_rows(window(T.inbox(spark, sf)), RELEASES), "app_version")
    out = rounded(P.weighted_fps(pairs, "app_version"))
    return out.withColumn("total_window_ms", F.round("total_window_ms", 2))


@query(
    "paired_ratio",
    T.duck_cte("jankCount", "frameCount")
    + " SELECT app_version, round(sum(cast(f_jankCount AS double)) / sum(cast(f_frameCount AS"
    f" double)), 6) AS ratio, count(*) AS pair_count FROM t WHERE {BOUND_SQL} AND"
    " name = 'fps_stats' AND cast(f_jankCount AS double) <= cast(f_frameCount AS double)"
    " GROUP BY app_version",
)
def _(spark, sf):
    rows = P.bound_rows(window(T.inbox(spark, sf)), RELEASES)
    return rounded(
        P.paired_ratio(rows, "fps", "fps_stats", "jankCount", "frameCount", "app_version")
    )


@query(
    "window_event_counts",
    T.duck_cte() + " SELECT count(*) AS samples, count(*) FILTER (name = 'java_crash') AS"
    f" incidents FROM t WHERE {T.WINDOW_SQL} AND app_version = '2.0.0' AND"
    " release_identity_quality = 'OCCURRENCE_BOUND'",
)
def _(spark, sf):
    return P.window_event_counts(
        window(T.telemetry(spark, sf)), "crash", "java_crash", T.NEW
    )


METRIC_SPINE = literal_rows(
    "spine", "app_version, metric_id", [(r, f.id) for r in RELEASES for f in catalog.performance_fields()]
)


@query(
    "performance_report",
    f"{SUMMARY_CTE}, {METRIC_SPINE}, d AS (SELECT metric_id, round(max(p95) FILTER (app_version = '2.0.0') -"
    " max(p95) FILTER (app_version = '1.0.0'), 6) AS p95_delta FROM s GROUP BY metric_id)"
    " SELECT app_version, metric_id, coalesce(state, 'NO_DATA') AS state, coalesce(sample_count, 0) AS sample_count,"
    " coalesce(event_count, 0) AS event_count, coalesce(missing_count, 0) AS missing_count, coalesce(invalid_count, 0) AS"
    " invalid_count, coalesce(unavailable_count, 0) AS unavailable_count, coverage, mean, p50, p75, p95, maximum, minimum,"
    " p95_delta FROM spine LEFT JOIN s USING (app_version, metric_id) LEFT JOIN d USING (metric_id)",
)
def _(spark, sf):
    report = P.performance_report(
        T.inbox(spark, sf), T.SCOPE, T.FROM_MS, T.TO_MS, T.NEW, T.BASE
    )
    return rounded(report)
