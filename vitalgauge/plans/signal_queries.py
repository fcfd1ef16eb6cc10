"""Trace and alert queries."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from vitalgauge.operators import alerts as A
from vitalgauge.operators import traces as TR
from vitalgauge.plans import telemetry as T
from vitalgauge.plans.performance_queries import rounded
from vitalgauge.plans.registry import query
from vitalgauge.plans.scan_queries import FAMILY_SQL, LATE_SQL, window
from vitalgauge.session import small_table

# Span fields of the mapped events. A third of all spans belongs to one trace.
_DUR = T.field_sql("windowDurationMs").replace("CASE WHEN module = 'fps' THEN ", "", 1)[:-4]
SPAN_FIELDS = {
    "traceId": "CASE WHEN k = 99 THEN 'zz' WHEN id % 3 = 0 THEN lpad('ABC', 32, '0') ELSE"
    " lpad(cast(cast(floor(id / 8e0) AS bigint) + 1 AS string), 32, '0') END",
    "spanId": "lpad(cast(CASE WHEN k = 77 THEN id - 2 ELSE id + 1 END AS string), 16, '0')",
    "parentSpanId": "CASE k % 10 WHEN 0 THEN NULL WHEN 1 THEN"
    " lpad(cast(id + 90000000 AS string), 16, '0') WHEN 2 THEN 'nothex' WHEN 3 THEN"
    " lpad(cast(id + 4 AS string), 16, '0') ELSE lpad(cast(id - 2 AS string), 16, '0') END",
    "duration_ms": _DUR,
    "status": "CASE k % 6 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'weird' ELSE 'OK' END",
    "spanSchemaVersion": "CASE WHEN k % 7 = 0 THEN '1' ELSE '2' END",
    "startTimestampMs": "CASE WHEN k % 17 <> 0 THEN cast(occurrence_timestamp_ms AS string) END",
    "endTimestampMs": "cast(occurrence_timestamp_ms + v100 + CASE WHEN k % 5 = 0 THEN 3"
    " WHEN k % 19 = 0 THEN 10000 ELSE 0 END AS string)",
    "attr_a": "CASE WHEN k % 3 > 0 THEN 'x' END",
    "attr_b": "CASE WHEN k % 3 > 1 THEN 'y' END",
}


@lru_cache(maxsize=8)
def span_events(spark, sf):
    """Trace events mapped from the shared table."""
    entries = ", ".join(f"'{n}', {sql}" for n, sql in SPAN_FIELDS.items())
    return (
        T.telemetry(spark, sf)
        .withColumn("module", F.lit("trace"))
        .withColumn("name", F.expr("'op-' || cast(k % 5 AS string)"))
        .withColumn("kind", F.expr("CASE WHEN k = 98 THEN 'ALERT' ELSE 'METRIC' END"))
        .withColumn("fields", F.expr(f"map_filter(map({entries}), (k, v) -> v IS NOT NULL)"))
    )


def spans(spark, sf):
    rows = window(span_events(spark, sf)).filter("raw_pruned_ms IS NULL")
    return TR.parse_spans(TR.load_spans(rows))


def classified(spark, sf):
    return TR.classify_span_relations(spans(spark, sf))


def _hex_sql(column: str, digits: int) -> str:
    return (
        f"CASE WHEN regexp_full_match({column}, '[0-9a-fA-F]{{{digits}}}') AND"
        f" regexp_matches({column}, '[^0]') THEN lower({column}) END"
    )


def _int_sql(column: str) -> str:
    return (
        f"CASE WHEN regexp_full_match({column}, '0|[1-9][0-9]*') THEN cast({column} AS bigint) END"
    )


SPAN_CTE = T.duck_cte(
    extra="raw AS (SELECT *, "
    + ", ".join(f"{sql} AS s_{name}" for name, sql in SPAN_FIELDS.items())
    + ", CASE WHEN k = 98 THEN 'ALERT' ELSE 'METRIC' END AS span_kind FROM t WHERE "
    + T.WINDOW_SQL
    + "), p AS (SELECT event_id, raw_pruned_ms, span_kind,"
    + f" {_hex_sql('s_traceId', 32)} AS trace_id, {_hex_sql('s_spanId', 16)} AS span_id,"
    + f" {_hex_sql('s_parentSpanId', 16)} AS parent_span_id, s_parentSpanId IS NOT NULL AS"
    " parent_sent, 'op-' || cast(k % 5 AS varchar) AS name, CASE WHEN s_status IN ('OK', 'ERROR')"
    " THEN s_status ELSE 'UNKNOWN' END AS status,"
    + f" {_int_sql('s_duration_ms')} AS duration_ms, {_int_sql('s_startTimestampMs')} AS st,"
    + f" {_int_sql('s_endTimestampMs')} AS en, s_spanSchemaVersion = '2' AS timed,"
    " cast((s_attr_a IS NOT NULL)::int + (s_attr_b IS NOT NULL)::int AS int) AS"
    " custom_attribute_count, occurrence_timestamp_ms,"
    + f" {LATE_SQL} AS late, app_version AS release_version, release_identity_quality FROM raw),"
    " s AS (SELECT event_id, trace_id, span_id, parent_span_id, name, status, duration_ms,"
    " CASE WHEN timed THEN st END AS start_ms, CASE WHEN timed THEN en END AS end_ms,"
    " CASE WHEN NOT timed THEN 'TIMING_UNAVAILABLE' WHEN st IS NULL OR en IS NULL OR duration_ms"
    " IS NULL OR st = 0 THEN 'INVALID_TIMING' WHEN en < st OR abs(en - st - duration_ms) > 5 THEN"
    " 'CLOCK_SKEW' ELSE 'AVAILABLE' END AS timing_state, parent_sent AND parent_span_id IS NULL AS"
    " parent_invalid, custom_attribute_count, occurrence_timestamp_ms, late, release_version,"
    " release_identity_quality FROM p WHERE raw_pruned_ms IS NULL AND span_kind = 'METRIC' AND"
    " trace_id IS NOT NULL AND span_id IS NOT NULL)"
)
CYCLE_CTE = SPAN_CTE.replace("WITH ", "WITH RECURSIVE ", 1) + (
    ", n AS (SELECT trace_id, span_id, count(*) AS copies, arg_max_null(parent_span_id, event_id)"
    " AS parent FROM s GROUP BY 1, 2),"
    " g AS (SELECT n.trace_id, n.span_id, n.parent FROM n JOIN n m ON m.trace_id = n.trace_id AND"
    " m.span_id = n.parent), r AS (SELECT trace_id, span_id, parent AS anc FROM g UNION SELECT"
    " r.trace_id, r.span_id, g.parent FROM r JOIN g ON g.trace_id = r.trace_id AND g.span_id ="
    " r.anc), loops AS (SELECT DISTINCT trace_id, span_id FROM r WHERE anc = span_id),"
    " cyc AS (SELECT DISTINCT trace_id, span_id FROM (SELECT trace_id, span_id FROM loops UNION"
    " SELECT r.trace_id, r.span_id FROM r JOIN loops l ON l.trace_id = r.trace_id AND l.span_id ="
    " r.anc)), c AS (SELECT s.*, CASE WHEN parent_invalid THEN 'INVALID_PARENT' WHEN n.copies > 1"
    " THEN 'DUPLICATE_ID' WHEN s.parent_span_id IS NULL THEN 'ROOT' WHEN m.span_id IS NULL THEN"
    " 'ORPHAN' WHEN m.copies > 1 THEN 'AMBIGUOUS_PARENT' WHEN cyc.span_id IS NOT NULL THEN 'CYCLE'"
    " ELSE 'CHILD' END AS relation_state FROM s JOIN n ON n.trace_id = s.trace_id AND n.span_id ="
    " s.span_id LEFT JOIN n m ON m.trace_id = s.trace_id AND m.span_id = s.parent_span_id LEFT"
    " JOIN cyc ON cyc.trace_id = s.trace_id AND cyc.span_id = s.span_id)"
)
SUMMARY_CTE = CYCLE_CTE + (
    ", y AS (SELECT trace_id, count(*) AS span_count, count(*) FILTER (status = 'ERROR') AS"
    " error_span_count, CASE WHEN bool_and(timing_state = 'AVAILABLE') THEN max(end_ms) -"
    " min(start_ms) END AS duration_ms, min(occurrence_timestamp_ms) AS first_seen_ms,"
    " max(occurrence_timestamp_ms) AS last_seen_ms, count(*) FILTER (timing_state = 'AVAILABLE')"
    " AS timing_available_count, count(*) FILTER (relation_state = 'ORPHAN') AS orphan_count,"
    " count(*) FILTER (relation_state IN ('INVALID_PARENT', 'CYCLE', 'DUPLICATE_ID',"
    " 'AMBIGUOUS_PARENT')) AS invalid_relation_count, count(*) FILTER (late) AS late_count,"
    " CASE WHEN count(*) FILTER (relation_state = 'ORPHAN') > 0 THEN 'PARTIAL' ELSE"
    " 'UNKNOWN_COMPLETENESS' END AS coverage_state, CASE WHEN bool_or(relation_state IN"
    " ('INVALID_PARENT', 'CYCLE', 'DUPLICATE_ID', 'AMBIGUOUS_PARENT', 'ORPHAN') OR timing_state <>"
    " 'AVAILABLE' OR status = 'UNKNOWN' OR duration_ms IS NULL) THEN 'DEGRADED' ELSE 'PRESENT' END"
    " AS state FROM c GROUP BY trace_id)"
)


@query("parse_spans", f"{SPAN_CTE} SELECT * FROM s")
def _(spark, sf):
    return spans(spark, sf)


@query(
    "load_spans",
    f"{SPAN_CTE} SELECT count(*) FILTER (raw_pruned_ms IS NULL AND span_kind = 'METRIC' AND"
    " trace_id IS NOT NULL AND span_id IS NOT NULL) AS sample_count, count(*) FILTER (raw_pruned_ms"
    " IS NULL AND NOT (span_kind = 'METRIC' AND trace_id IS NOT NULL AND span_id IS NOT NULL)) AS"
    " invalid_span_count, count(raw_pruned_ms) AS expired_span_count FROM p",
)
def _(spark, sf):
    return TR.span_row_counts(window(span_events(spark, sf)))


@query(
    "classify_span_relations",
    f"{CYCLE_CTE} SELECT event_id, trace_id, span_id, relation_state FROM c",
)
def _(spark, sf):
    return classified(spark, sf).select("event_id", "trace_id", "span_id", "relation_state")


@query("detect_span_cycles", f"{CYCLE_CTE} SELECT trace_id, span_id FROM cyc")
def _(spark, sf):
    return TR.detect_span_cycles(TR.span_nodes(spans(spark, sf)))


@query("summarize_traces", f"{SUMMARY_CTE} SELECT * FROM y")
def _(spark, sf):
    return TR.summarize_traces(classified(spark, sf))


@query(
    "trace_list",
    f"{SUMMARY_CTE} SELECT * FROM y ORDER BY last_seen_ms DESC, trace_id LIMIT 100",
)
def _(spark, sf):
    return TR.trace_list(TR.summarize_traces(classified(spark, sf)), 100)


@query(
    "trace_totals",
    f"{SUMMARY_CTE}, x AS (SELECT count(*) FILTER (raw_pruned_ms IS NULL AND span_kind = 'METRIC'"
    " AND trace_id IS NOT NULL AND span_id IS NOT NULL) AS sample_count, count(*) FILTER"
    " (raw_pruned_ms IS NULL AND NOT (span_kind = 'METRIC' AND trace_id IS NOT NULL AND span_id IS"
    " NOT NULL)) AS invalid_span_count, count(raw_pruned_ms) AS expired_span_count FROM p)"
    " SELECT x.*, (SELECT count(*) FROM y) AS trace_count, (SELECT count(duration_ms) FROM s) AS"
    " duration_sample_count, (SELECT round(avg(duration_ms), 6) FROM s) AS mean_span_duration_ms,"
    " (SELECT round(quantile_cont(cast(duration_ms AS double), 0.95), 6) FROM s) AS"
    " p95_span_duration_ms, 'DEGRADED' AS state, (SELECT count(*) FROM y) > 100 AS truncated"
    " FROM x",
)
def _(spark, sf):
    rows = window(span_events(spark, sf))
    mine = spans(spark, sf)
    summaries = TR.summarize_traces(classified(spark, sf))
    return rounded(TR.trace_totals(mine, summaries, TR.span_row_counts(rows), 100))


HOT_TRACE = "ABC".lower().rjust(32, "0")


@query(
    "trace_detail",
    f"{CYCLE_CTE} SELECT event_id, span_id, parent_span_id, relation_state, timing_state,"
    f" start_ms, end_ms, status FROM c WHERE trace_id = '{HOT_TRACE}'",
)
def _(spark, sf):
    return TR.trace_detail(classified(spark, sf), HOT_TRACE).select(
        "event_id", "span_id", "parent_span_id", "relation_state", "timing_state", "start_ms",
        "end_ms", "status",
    )


@query(
    "trace_waterfall",
    CYCLE_CTE.replace(", c AS (", ", hop AS (SELECT g.trace_id, g.span_id, g.parent, 1 AS lvl FROM"
                      " g JOIN n a ON a.trace_id = g.trace_id AND a.span_id = g.span_id AND"
                      " a.copies = 1 JOIN n b ON b.trace_id = g.trace_id AND b.span_id = g.parent"
                      " AND b.copies = 1), walk AS (SELECT * FROM hop UNION ALL SELECT w.trace_id,"
                      " w.span_id, h.parent, w.lvl + 1 FROM walk w JOIN hop h ON h.trace_id ="
                      " w.trace_id AND h.span_id = w.parent WHERE w.lvl < 8), deep AS (SELECT"
                      " trace_id, span_id, max(lvl) AS steps FROM walk GROUP BY 1, 2), c AS (", 1)
    + ", b AS (SELECT trace_id, min(start_ms) FILTER (timing_state = 'AVAILABLE') AS t0,"
    " max(end_ms) FILTER (timing_state = 'AVAILABLE') AS t1 FROM c GROUP BY 1)"
    " SELECT c.trace_id, c.span_id, event_id, relation_state, CASE WHEN relation_state = 'CHILD'"
    " THEN coalesce(steps, 0) ELSE 0 END AS depth, round(CASE WHEN timing_state = 'AVAILABLE' THEN"
    " (start_ms - t0) / greatest(1, t1 - t0) * 100 END, 6) AS offset_percent, round(CASE WHEN"
    " timing_state = 'AVAILABLE' THEN (end_ms - start_ms) / greatest(1, t1 - t0) * 100 END, 6) AS"
    " width_percent FROM c JOIN b ON b.trace_id = c.trace_id LEFT JOIN deep ON deep.trace_id ="
    " c.trace_id AND deep.span_id = c.span_id",
)
def _(spark, sf):
    return rounded(TR.trace_waterfall(spans(spark, sf)))


# rule_id, tenant, metric, comparison, threshold, min_samples, window_s, release, channel, silence
RULES = [
    (1, "tenant-a", "crash.count", "gt", 0.0, 1, 86400, None, "ops", None),
    (2, "tenant-a", "anr.count", "gt", 50.0, 1, 86400, "2.0.0", "ops", None),
    (3, "tenant-b", "native_crash.count", "lt", 1.0, 1, 43200, None, None, None),
    (4, "tenant-a", "network.error_count", "gt", 0.0, 100_000, 86400, None, "ops", None),
    (5, "tenant-c", "crash.count", "gt", 0.0, 1, 86400, None, "ops", None),
    (6, "tenant-a", "core.sdk_health.emitCount.p95", "gt", 500.0, 1, 86400, None, "ops", None),
    (7, "tenant-a", "network.network_request.durationMs.p95", "gt", 1.0, 1, 86400, None, "ops",
     None),
    (8, "tenant-b", "fps.fps_stats.fps.p95", "lt", 30.0, 1, 43200, "2.0.0", "ops",
     T.TO_MS + 1),
    (9, "tenant-b", "native_tombstone.count", "gt", 3.0, 1, 80000, "1.0.0", "pager", T.TO_MS + 1),
]
_RULE_SCHEMA = (
    "rule_id bigint, tenant_id string, app_id string, environment string, metric string,"
    " comparison string, threshold double, min_samples bigint, window_seconds bigint,"
    " release_version string, channel string, silence_until_ms bigint, enabled boolean"
)


def rules(spark):
    rows = [
        (i, tenant, "com.example", "production", *rest, True) for i, tenant, *rest in RULES
    ]
    return small_table(spark, rows, _RULE_SCHEMA)


def _value(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


RULES_SQL = (
    "rules AS (SELECT * FROM (VALUES "
    + ", ".join("(" + ", ".join(_value(v) for v in r) + ")" for r in RULES)
    + ") r(rule_id, tenant_id, metric, comparison, threshold, min_samples, window_seconds,"
    " release_version, channel, silence_until_ms))"
)
RULE_JOIN_SQL = (
    "t.tenant_id = rules.tenant_id AND t.occurrence_timestamp_ms >="
    f" {T.TO_MS} - window_seconds * 1000 AND t.occurrence_timestamp_ms < {T.TO_MS} AND"
    " (release_version IS NULL OR (app_version = release_version AND release_identity_quality ="
    " 'OCCURRENCE_BOUND'))"
)
COUNT_SQL = (
    "cnt AS (SELECT rule_id, count(t.id) AS sample_count, CASE WHEN count(t.id) > 0 THEN"
    " cast(count(t.id) FILTER ((metric = 'crash.count' AND name = 'java_crash') OR (metric ="
    " 'native_crash.count' AND name = 'native_crash') OR (metric = 'native_tombstone.count' AND"
    " name = 'tombstone_crash') OR (metric = 'anr.count' AND name = 'anr_detected')) AS double) END"
    f" AS value FROM rules LEFT JOIN t ON {RULE_JOIN_SQL} WHERE metric LIKE '%count' GROUP BY"
    " rule_id)"
)
P95_SQL = (
    "obs AS (SELECT rule_id, CASE metric WHEN 'core.sdk_health.emitCount.p95' THEN"
    " cast(f_emitCount AS double) WHEN 'network.network_request.durationMs.p95' THEN CASE WHEN"
    " f_durationMs <> '-1' THEN cast(f_durationMs AS double) END ELSE cast(f_fps AS double) END AS"
    f" v FROM rules JOIN t ON {RULE_JOIN_SQL} AND ((metric LIKE 'core%' AND name = 'sdk_health') OR"
    " (metric LIKE 'network.network_request%' AND name = 'network_request') OR (metric LIKE 'fps%'"
    " AND name = 'fps_stats')) WHERE metric LIKE '%p95'), p95 AS (SELECT rule_id, count(v) AS"
    " sample_count, CASE WHEN count(v) = count(*) THEN round(quantile_cont(v, 0.95), 6) END AS"
    " value FROM obs GROUP BY rule_id)"
)
P95_FIELDS = ("emitCount", "durationMs", "fps")


@query(
    "evaluate_count_rules",
    T.duck_cte(extra=f"{RULES_SQL}, {COUNT_SQL}") + " SELECT rule_id, value, sample_count FROM cnt",
)
def _(spark, sf):
    out = A.evaluate_count_rules(T.telemetry(spark, sf), A.active_rules(rules(spark)), T.TO_MS)
    return out.select("rule_id", "value", "sample_count")


@query(
    "evaluate_p95_rules",
    T.duck_cte(*P95_FIELDS, extra=f"{RULES_SQL}, {P95_SQL}")
    + " SELECT rule_id, value, coalesce(sample_count, 0) AS sample_count FROM rules LEFT JOIN p95"
    " USING (rule_id) WHERE metric LIKE '%p95'",
)
def _(spark, sf):
    out = A.evaluate_p95_rules(T.inbox(spark, sf), A.active_rules(rules(spark)), T.TO_MS)
    return rounded(out.select("rule_id", "value", "sample_count"))


@query(
    "alert_rule_state",
    T.duck_cte(*P95_FIELDS, extra=f"{RULES_SQL}, {COUNT_SQL}, {P95_SQL}")
    + ", e AS (SELECT rule_id, value, sample_count FROM cnt UNION ALL SELECT rule_id, value,"
    " coalesce(sample_count, 0) FROM rules LEFT JOIN p95 USING (rule_id) WHERE metric LIKE '%p95')"
    " SELECT rule_id, value, sample_count, CASE WHEN value IS NULL OR sample_count < min_samples"
    " THEN 'INSUFFICIENT_DATA' WHEN (comparison = 'gt' AND value > threshold) OR (comparison = 'lt'"
    " AND value < threshold) THEN 'FIRING' ELSE 'OK' END AS state FROM e JOIN rules USING"
    " (rule_id)",
)
def _(spark, sf):
    mine = A.active_rules(rules(spark))
    counted = A.evaluate_count_rules(T.telemetry(spark, sf), mine, T.TO_MS)
    measured = A.evaluate_p95_rules(T.inbox(spark, sf), mine, T.TO_MS)
    out = A.alert_rule_state(counted.unionByName(measured))
    return rounded(out.select("rule_id", "value", "sample_count", "state"))


# Evaluation ticks: one per tenant (the rule), event type and six hours.
TICK_MS = 21_600_000
TICK_SQL = (
    "ticks AS (SELECT (user_id % 2) * 10 + ascii(event_type) % 10 AS rule_id,"
    f" (cast(floor(occurrence_timestamp_ms / {TICK_MS}e0) AS bigint) + 1) * {TICK_MS} AS"
    " evaluated_ms, cast(count(*) FILTER (k > 50) AS double) AS value, count(*) AS sample_count"
    " FROM base GROUP BY 1, 2)"
)
TICK_STATE = (
    "CASE WHEN value IS NULL OR sample_count < 8 THEN 'INSUFFICIENT_DATA' WHEN value / sample_count"
    " > 0.55 THEN 'FIRING' ELSE 'OK' END"
)


def ticks(spark, sf):
    base = T.raw_events(spark, sf).selectExpr(*T.SPARK_BASE)
    grouped = base.groupBy(
        F.expr("user_id % 2 * 10 + ascii(event_type) % 10 AS rule_id"),
        F.expr(
            f"(cast(floor(occurrence_timestamp_ms / {TICK_MS}e0) AS bigint) + 1) * {TICK_MS}"
            " AS evaluated_ms"
        ),
    ).agg(
        F.expr("cast(count_if(k > 50) AS double) AS value"), F.count("*").alias("sample_count")
    )
    return grouped.withColumn("state", F.expr(TICK_STATE))


EPISODE_SQL = T.duck_cte(extra=TICK_SQL) + (
    f", d AS (SELECT *, {TICK_STATE} AS state FROM ticks), q AS (SELECT *, lag(state) OVER"
    " (PARTITION BY rule_id ORDER BY evaluated_ms) AS prev FROM d WHERE state <>"
    " 'INSUFFICIENT_DATA'), f AS (SELECT * FROM q WHERE state = 'FIRING' AND coalesce(prev, 'OK') ="
    " 'OK'), r AS (SELECT * FROM q WHERE state = 'OK' AND prev = 'FIRING'), ep AS (SELECT"
    " f.rule_id, f.evaluated_ms AS triggered_ms, (SELECT min(r.evaluated_ms) FROM r WHERE"
    " r.rule_id = f.rule_id AND r.evaluated_ms > f.evaluated_ms) AS resolved_ms, f.value AS"
    " trigger_value, f.sample_count FROM f)"
)


@query("alert_episodes", f"{EPISODE_SQL} SELECT * FROM ep")
def _(spark, sf):
    return A.alert_episodes(ticks(spark, sf))


def tick_rules(spark, sf):
    return ticks(spark, sf).select("rule_id").distinct().selectExpr(
        "rule_id",
        "'tenant-a' AS tenant_id",
        "'com.example' AS app_id",
        "'production' AS environment",
        "if(rule_id % 3 = 0, NULL, concat('ch-', rule_id % 2)) AS channel",
        f"if(rule_id % 2 = 1, {T.FROM_MS}, NULL) AS silence_until_ms",
        "'ratio' AS metric",
        "0.55D AS threshold",
    )


OUTBOX_SQL = (
    ", tr AS (SELECT rule_id, evaluated_ms, 'FIRING' AS transition, value, sample_count FROM f"
    " UNION ALL SELECT rule_id, evaluated_ms, 'RESOLVED', value, sample_count FROM r), ob AS"
    " (SELECT rule_id, transition, 'ch-' || cast(rule_id % 2 AS varchar) AS channel, CASE WHEN"
    f" rule_id % 2 = 1 AND {T.FROM_MS} > evaluated_ms THEN 'SUPPRESSED' ELSE 'PENDING' END AS"
    " status, evaluated_ms AS next_attempt_ms, 'ratio' AS metric, value, 0.55 AS threshold,"
    " sample_count FROM tr WHERE rule_id % 3 <> 0)"
)


@query("alert_outbox", f"{EPISODE_SQL}{OUTBOX_SQL} SELECT * FROM ob")
def _(spark, sf):
    return A.alert_outbox(A.alert_transitions(ticks(spark, sf)), tick_rules(spark, sf))


@query("alert_metric_catalog")
def _(spark, sf):
    """Metrics a rule may name, with the number of rows of the counted event."""
    from vitalgauge import catalog
    from vitalgauge import constants as C

    seen = T.telemetry(spark, sf).groupBy("module", "name").agg(F.count("*").alias("event_count"))
    names = small_table(
        spark,
        [(m, module, name) for m, (module, name) in C.ALERT_COUNT_EVENTS.items()],
        "metric string, module string, name string",
    )
    counted = names.join(seen, ["module", "name"], "left").select("metric", "event_count")
    return catalog.alert_metric_catalog(spark).join(counted, "metric", "left")


ATTEMPT_SQL = (
    "id, CASE k % 8 WHEN 0 THEN 200 WHEN 1 THEN 204 WHEN 2 THEN 302 WHEN 3 THEN 408 WHEN 4 THEN"
    " 429 WHEN 5 THEN 503 WHEN 6 THEN 404 END AS http_status, cast(k % 6 + 1 AS int) AS"
    " attempt_count, k % 13 <> 0 AS configured, k % 17 <> 0 AS claimed,"
    " occurrence_timestamp_ms AS finished_ms"
)


@query(
    "delivery_outcome",
    T.duck_cte() + f", a AS (SELECT {ATTEMPT_SQL} FROM t) SELECT *, CASE WHEN NOT claimed OR NOT"
    " configured THEN 'FAILED' WHEN http_status IN (200, 204) THEN 'DELIVERED' WHEN attempt_count <"
    " 5 AND coalesce(http_status, 500) IN (408, 429, 500, 503) THEN 'RETRY' ELSE 'FAILED' END AS"
    " status, CASE WHEN NOT claimed THEN 'RETRY_EXHAUSTED' WHEN NOT configured THEN"
    " 'CHANNEL_UNCONFIGURED' WHEN http_status IN (200, 204) THEN NULL WHEN http_status IS NULL THEN"
    " 'TRANSPORT_ERROR' ELSE 'HTTP_' || cast(http_status AS varchar) END AS last_error, CASE WHEN"
    " claimed THEN finished_ms + least(3600, cast(pow(2, attempt_count) AS bigint) * 10) * 1000 END"
    " AS next_attempt_ms FROM a",
)
def _(spark, sf):
    return A.delivery_outcome(T.telemetry(spark, sf).selectExpr(*_split(ATTEMPT_SQL)))


def _split(columns: str) -> list[str]:
    """Split a flat select list at its top-level commas."""
    out, depth, part = [], 0, ""
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(part.strip())
            part = ""
        else:
            part += ch
    return [*out, part.strip()]


EPISODES = "id AS episode_id, id % 7 AS rule_id, occurrence_timestamp_ms AS triggered_ms"


@query(
    "acknowledge_episodes",
    T.duck_cte() + ", ack AS (SELECT id - id % 4 AS episode_id, received_ms AS acknowledged_ms,"
    " event_id AS actor FROM t WHERE id % 4 < 3 AND k % 3 = 0), o AS (SELECT *, row_number() OVER"
    " (PARTITION BY episode_id ORDER BY acknowledged_ms, actor) AS rn FROM ack) SELECT t.id AS"
    " episode_id, t.id % 7 AS rule_id, occurrence_timestamp_ms AS triggered_ms, acknowledged_ms,"
    " actor AS acknowledged_by FROM t LEFT JOIN o ON o.episode_id = t.id AND rn = 1"
    " WHERE t.name = 'java_crash'",
)
def _(spark, sf):
    rows = T.telemetry(spark, sf)
    acks = rows.filter("id % 4 < 3 AND k % 3 = 0").selectExpr(
        "id - id % 4 AS episode_id", "received_ms AS acknowledged_ms", "event_id AS actor"
    )
    episodes = rows.filter("name = 'java_crash'").selectExpr(*_split(EPISODES))
    return A.acknowledge_episodes(episodes, acks)


@query(
    "alert_history",
    T.duck_cte() + ", ep AS (SELECT id AS episode_id, id % 7 AS rule_id FROM t WHERE name ="
    " 'java_crash'), dl AS (SELECT id AS delivery_id, id - 1 AS episode_id FROM t), ru AS (SELECT"
    " unnest(range(7)) AS rule_id), sc AS (SELECT rule_id, CASE WHEN rule_id < 4 THEN 'tenant-a'"
    " ELSE 'tenant-b' END AS tenant_id FROM ru), it AS (SELECT tenant_id, 'episode' AS kind,"
    " episode_id AS item_id, rule_id FROM ep JOIN sc USING (rule_id) UNION ALL SELECT tenant_id,"
    " 'delivery', delivery_id, rule_id FROM dl JOIN ep USING (episode_id) JOIN sc USING (rule_id)),"
    " n AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, kind ORDER BY item_id DESC) AS"
    " position FROM it) SELECT tenant_id, 'com.example' AS app_id, 'production' AS environment,"
    " kind, item_id, rule_id, position FROM n WHERE position <= 100",
)
def _(spark, sf):
    rows = T.telemetry(spark, sf)
    owners = spark.range(7).selectExpr(
        "id AS rule_id",
        "if(id < 4, 'tenant-a', 'tenant-b') AS tenant_id",
        "'com.example' AS app_id",
        "'production' AS environment",
    )
    episodes = rows.filter("name = 'java_crash'").selectExpr(*_split(EPISODES))
    deliveries = rows.selectExpr("id AS delivery_id", "id - 1 AS episode_id")
    return A.alert_history(owners, episodes, deliveries)


SLIDE_SQL = (
    "(cast(floor(occurrence_timestamp_ms / 60000e0) AS bigint) - i) * 60000 AS window_start_ms"
)


@query(
    "rolling_incident_alert",
    T.duck_cte() + f", h AS (SELECT app_id, environment, {FAMILY_SQL} AS family, {SLIDE_SQL} FROM t,"
    " range(5) r(i) WHERE release_identity_quality = 'OCCURRENCE_BOUND' AND name IN ('java_crash',"
    " 'anr_detected')) SELECT *, count(*) AS incident_count FROM h GROUP BY ALL",
)
def _(spark, sf):
    return A.rolling_incident_alert(T.telemetry(spark, sf))


@query(
    "rolling_drop_rate_alert",
    T.duck_cte("dropRate") + f", h AS (SELECT app_id, app_version AS release_version, {SLIDE_SQL},"
    " cast(f_dropRate AS double) AS rate FROM t, range(15) r(i) WHERE name = 'sdk_health' AND"
    " release_identity_quality = 'OCCURRENCE_BOUND'), g AS (SELECT app_id, release_version,"
    " window_start_ms, count(*) AS sample_count, round(quantile_cont(rate, 0.95), 6) AS p95 FROM h"
    " GROUP BY ALL) SELECT * FROM g WHERE p95 > 0.01",
)
def _(spark, sf):
    return rounded(A.rolling_drop_rate_alert(T.inbox(spark, sf)))
