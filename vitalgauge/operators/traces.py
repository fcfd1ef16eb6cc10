"""Trace reports: span parsing, parent relations, cycles, summaries and waterfall geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgauge import constants as C
from vitalgauge.functions import events as E
from vitalgauge.functions.metrics import ladder, lit
from vitalgauge.operators.percentiles import percentile_aggregates
from vitalgauge.session import ensure_checkpoint_dir

BROKEN = ("INVALID_PARENT", "CYCLE", "DUPLICATE_ID", "AMBIGUOUS_PARENT")
_NODE = ["trace_id", "span_id"]


# Raw field -> column holding its text; looked up once per row.
_SENT = {
    "traceId": "raw_trace",
    "spanId": "raw_span",
    "parentSpanId": "raw_parent",
    "duration_ms": "raw_duration",
    "startTimestampMs": "raw_start",
    "endTimestampMs": "raw_end",
    "spanSchemaVersion": "raw_version",
    "status": "raw_status",
}


def _with_text(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(
        "*", *[f"try_element_at(fields, '{f}') AS {name}" for f, name in _SENT.items()]
    )


def _hex_id(text: str, digits: int) -> str:
    return (
        f"if({text} rlike '^[0-9a-fA-F]{{{digits}}}$' AND {text} rlike '[^0]', lower({text}), NULL)"
    )


def _integer(text: str) -> str:
    # Canonical non-negative text of at most 20 digits, bounded by the nanosecond range.
    number = f"try_cast({text} AS bigint)"
    return (
        f"if({text} rlike '^(0|[1-9][0-9]{{0,19}})$' AND {number} <= {C.MAX_SPAN_MILLIS},"
        f" {number}, NULL)"
    )


def parse_spans(
    rows: DataFrame,
    late_after_ms: int = C.LATE_AFTER_MS,
    keep: tuple[str, ...] = (),
    keep_rows: bool = False,
) -> DataFrame:
    """Spans of valid trace events; bad timing is a state, a bad identity drops the row.

    ``keep`` carries further columns along. With ``keep_rows`` a row without a span stays, with
    null span columns.
    """
    spans_only = "module = 'trace' AND kind = 'METRIC'"
    if not keep_rows:
        rows = rows.filter(spans_only)
    read = _with_text(rows).selectExpr(
        *keep,
        f"coalesce({spans_only}, false) AS is_span",
        "event_id",
        f"{_hex_id('raw_trace', 32)} AS trace_id",
        f"{_hex_id('raw_span', 16)} AS span_id",
        f"{_hex_id('raw_parent', 16)} AS parent_span_id",
        "raw_parent IS NOT NULL AS parent_sent",
        "coalesce(name, '') AS name",
        "if(raw_status IN ('OK', 'ERROR'), raw_status, 'UNKNOWN') AS status",
        f"{_integer('raw_duration')} AS duration_ms",
        f"{_integer('raw_start')} AS sent_start",
        f"{_integer('raw_end')} AS sent_end",
        f"coalesce({_integer('raw_version')} = 2, false) AS timed",
        "cast(size(filter(map_keys(fields), f -> startswith(f, 'attr_'))) AS int)"
        " AS custom_attribute_count",
        "occurrence_timestamp_ms",
        f"{E.late(late_after_ms)} AS late",
        "app_version AS release_version",
        "release_identity_quality",
    )
    timing = ladder(
        ("NOT timed", lit("TIMING_UNAVAILABLE")),
        (
            "sent_start IS NULL OR sent_end IS NULL OR duration_ms IS NULL OR sent_start = 0",
            lit("INVALID_TIMING"),
        ),
        (
            "sent_end < sent_start"
            f" OR abs(sent_end - sent_start - duration_ms) > {C.CLOCK_TOLERANCE_MS}",
            lit("CLOCK_SKEW"),
        ),
        otherwise=lit(C.AVAILABLE),
    )
    columns = {
        "event_id": "event_id",
        "trace_id": "trace_id",
        "span_id": "span_id",
        "parent_span_id": "parent_span_id",
        "name": "name",
        "status": "status",
        "duration_ms": "duration_ms",
        "start_ms": "if(timed, sent_start, NULL)",
        "end_ms": "if(timed, sent_end, NULL)",
        "timing_state": timing,
        "parent_invalid": "parent_sent AND parent_span_id IS NULL",
        "custom_attribute_count": "custom_attribute_count",
        "occurrence_timestamp_ms": "occurrence_timestamp_ms",
        "late": "late",
        "release_version": "release_version",
        "release_identity_quality": "release_identity_quality",
    }
    row = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
    # A plain filter on the parsed ids would be pushed down and repeat the parsing per condition.
    generate = "inline_outer" if keep_rows else "inline"
    return read.selectExpr(
        *keep,
        f"{generate}(filter(array(struct({row})), s -> is_span AND s.trace_id IS NOT NULL"
        " AND s.span_id IS NOT NULL))",
    )


def load_spans(
    rows: DataFrame, release: str | None = None, trace_id: str | None = None
) -> DataFrame:
    """Trace rows of the scoped window, optionally of one release or one trace."""
    rows = rows.filter("module = 'trace'")
    if release is not None:
        rows = rows.filter(F.col("app_version") == release)
    if trace_id is not None:
        rows = rows.filter(
            F.lower(F.try_element_at(F.col("fields"), F.lit("traceId"))) == trace_id
        )
    return rows


def span_row_counts(rows: DataFrame) -> DataFrame:
    """Usable, invalid and expired trace rows; expired rows are not judged."""
    ok = (
        f"kind = 'METRIC' AND {_hex_id('raw_trace', 32)} IS NOT NULL"
        f" AND {_hex_id('raw_span', 16)} IS NOT NULL"
    )
    return _with_text(load_spans(rows)).agg(
        F.expr(f"count_if(raw_pruned_ms IS NULL AND {ok}) AS sample_count"),
        F.expr(f"count_if(raw_pruned_ms IS NULL AND NOT ({ok})) AS invalid_span_count"),
        F.expr("count_if(raw_pruned_ms IS NOT NULL) AS expired_span_count"),
    )


def span_nodes(spans: DataFrame) -> DataFrame:
    """One row per span id of a trace: its copies, and the parent of its latest event id."""
    return spans.groupBy(*_NODE).agg(
        F.count("*").alias("copies"),
        F.max_by("parent_span_id", "event_id").alias("parent_span_id"),
    )


def detect_span_cycles(nodes: DataFrame) -> DataFrame:
    """Spans whose ancestor chain reaches a cycle.

    Every round doubles the distance of all ancestor pointers, and a span whose chain ends drops
    out. Once a round drops nothing, exactly the spans leading into cycles remain, so the number of
    rounds is the logarithm of the longest chain. Rounds are cut by reliable checkpoints, which
    survive lost executors.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    parents = nodes.select("trace_id", F.col("span_id").alias("ancestor"))
    active = (
        nodes.filter("parent_span_id IS NOT NULL")
        .select(*_NODE, F.col("parent_span_id").alias("ancestor"))
        .join(parents, ["trace_id", "ancestor"], "left_semi")
        .select(*_NODE, "ancestor")
        .checkpoint()
    )
    remaining = active.count()
    while remaining:
        step = active.select(
            "trace_id", F.col("span_id").alias("ancestor"), F.col("ancestor").alias("next")
        )
        active = (
            active.join(step, ["trace_id", "ancestor"])
            .select(*_NODE, F.col("next").alias("ancestor"))
            .checkpoint()
        )
        before, remaining = remaining, active.count()
        if remaining == before:
            break
    return active.select(*_NODE)


def classify_span_relations(spans: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Add ``relation_state``; ``nodes`` are the ``span_nodes`` when the caller has them already.

    Relations are decided on unique span ids and joined back, so copies of one span or many
    children of one parent never meet as pairs.
    """
    ensure_checkpoint_dir(spans.sparkSession)
    nodes = span_nodes(spans).checkpoint() if nodes is None else nodes
    cyclic = detect_span_cycles(nodes).withColumn("cyclic", F.lit(True))
    parents = nodes.select(
        "trace_id",
        F.col("span_id").alias("parent_span_id"),
        F.col("copies").alias("parent_copies"),
    )
    relation = ladder(
        ("copies > 1", lit("DUPLICATE_ID")),
        ("parent_span_id IS NULL", lit("ROOT")),
        ("parent_copies IS NULL", lit("ORPHAN")),
        ("parent_copies > 1", lit("AMBIGUOUS_PARENT")),
        ("cyclic", lit("CYCLE")),
        otherwise=lit("CHILD"),
    )
    decided = (
        nodes.join(parents, ["trace_id", "parent_span_id"], "left")
        .join(cyclic, _NODE, "left")
        .selectExpr(*_NODE, f"{relation} AS node_relation")
    )
    return (
        spans.join(decided, _NODE)
        .withColumn(
            "relation_state", F.expr("if(parent_invalid, 'INVALID_PARENT', node_relation)")
        )
        .drop("node_relation")
    )


def summarize_traces(classified: DataFrame) -> DataFrame:
    """One row per trace; the duration is known only when every span is timed."""
    timed = f"timing_state = '{C.AVAILABLE}'"
    totals = classified.groupBy("trace_id").agg(
        F.expr("count(*) AS span_count"),
        F.expr("count_if(status = 'ERROR') AS error_span_count"),
        F.expr(f"count_if({timed}) AS timing_available_count"),
        F.expr(f"max(if({timed}, end_ms, NULL)) AS last_end"),
        F.expr(f"min(if({timed}, start_ms, NULL)) AS first_start"),
        F.expr("min(occurrence_timestamp_ms) AS first_seen_ms"),
        F.expr("max(occurrence_timestamp_ms) AS last_seen_ms"),
        F.expr("count_if(relation_state = 'ORPHAN') AS orphan_count"),
        F.expr(f"count_if(relation_state IN {E.quoted(BROKEN)}) AS invalid_relation_count"),
        F.expr("count_if(late) AS late_count"),
        F.expr("count_if(status = 'UNKNOWN' OR duration_ms IS NULL) AS unclear_count"),
    )
    whole = "timing_available_count = span_count"
    return totals.selectExpr(
        "trace_id",
        "span_count",
        "error_span_count",
        f"if({whole}, last_end - first_start, NULL) AS duration_ms",
        "first_seen_ms",
        "last_seen_ms",
        "timing_available_count",
        "orphan_count",
        "invalid_relation_count",
        "late_count",
        "if(orphan_count > 0, 'PARTIAL', 'UNKNOWN_COMPLETENESS') AS coverage_state",
        f"if(invalid_relation_count > 0 OR orphan_count > 0 OR NOT {whole} OR unclear_count > 0,"
        f" '{C.DEGRADED}', '{C.PRESENT}') AS state",
    )


def trace_list(summaries: DataFrame, limit: int) -> DataFrame:
    """Most recently seen traces first."""
    return summaries.orderBy(F.desc("last_seen_ms"), "trace_id").limit(limit)


def trace_totals(
    spans: DataFrame, summaries: DataFrame, row_counts: DataFrame, limit: int
) -> DataFrame:
    """Overall state, counts and reported span durations of the list."""
    durations = spans.filter("duration_ms IS NOT NULL").select(
        F.col("duration_ms").cast("double").alias("duration")
    )
    traces = summaries.agg(
        F.count("*").alias("trace_count"),
        F.count_if(F.col("state") == C.DEGRADED).alias("degraded"),
    )
    # Each side is one row; scalar subqueries keep them apart without a join.
    p95 = percentile_aggregates(durations, [], "duration", {"p95": 0.95})
    state = ladder(
        (
            "invalid_span_count > 0 OR (expired_span_count > 0 AND sample_count > 0)"
            " OR degraded > 0",
            lit(C.DEGRADED),
        ),
        ("sample_count > 0", lit(C.PRESENT)),
        ("expired_span_count > 0", lit(C.UNAVAILABLE)),
        otherwise=lit(C.NO_DATA),
    )
    return (
        row_counts.select(
            "*",
            traces.select("trace_count").scalar().alias("trace_count"),
            traces.select("degraded").scalar().alias("degraded"),
            durations.agg(F.count("*")).scalar().alias("duration_sample_count"),
            durations.agg(F.avg("duration")).scalar().alias("mean_span_duration_ms"),
            p95.select("p95").scalar().alias("p95_span_duration_ms"),
        )
        .selectExpr("*", f"{state} AS state", f"trace_count > {limit} AS truncated")
        .drop("degraded")
    )


def trace_detail(classified: DataFrame, trace_id: str) -> DataFrame:
    """Spans of one trace by start (or occurrence) and event id."""
    return (
        classified.filter(F.col("trace_id") == trace_id)
        .withColumn(
            "sort_ms", F.coalesce(F.expr("nullif(start_ms, 0)"), "occurrence_timestamp_ms")
        )
        .orderBy("sort_ms", "event_id")
    )


MAX_DEPTH = 8


def trace_waterfall(spans: DataFrame) -> DataFrame:
    """Offset and width of every timed span in per cent of its trace, and its depth (at most 8).

    Depth walks unique parents only. Three pointer doublings cover eight levels; each starts from a
    reliable checkpoint, so the plan does not double with the pointers.
    """
    ensure_checkpoint_dir(spans.sparkSession)
    nodes = span_nodes(spans).checkpoint()
    classified = classify_span_relations(spans, nodes)
    timed = f"timing_state = '{C.AVAILABLE}'"
    bounds = spans.groupBy("trace_id").agg(
        F.expr(f"min(if({timed}, start_ms, NULL)) AS trace_start"),
        F.expr(f"max(if({timed}, end_ms, NULL)) AS trace_end"),
    )
    unique = nodes.filter("copies = 1").select(*_NODE, "parent_span_id")
    known = unique.select("trace_id", F.col("span_id").alias("parent_span_id"))
    hops = (
        unique.join(known, ["trace_id", "parent_span_id"], "left_semi")
        .select(*_NODE, F.col("parent_span_id").alias("ancestor"), F.lit(1).alias("steps"))
    )
    for _ in range(3):
        onward = hops.select(
            "trace_id",
            F.col("span_id").alias("ancestor"),
            F.col("ancestor").alias("next"),
            F.col("steps").alias("more"),
        )
        hops = hops.join(onward, ["trace_id", "ancestor"], "left").select(
            *_NODE,
            F.col("next").alias("ancestor"),
            (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
        ).checkpoint()
    width = "greatest(1, trace_end - trace_start)"
    return (
        classified.join(bounds, "trace_id")
        .join(hops.select(*_NODE, "steps"), _NODE, "left")
        .selectExpr(
            "trace_id",
            "span_id",
            "event_id",
            "relation_state",
            f"if(relation_state = 'CHILD', least({MAX_DEPTH}, coalesce(steps, 0)), 0) AS depth",
            f"if({timed}, (start_ms - trace_start) / {width} * 100, NULL) AS offset_percent",
            f"if({timed}, (end_ms - start_ms) / {width} * 100, NULL) AS width_percent",
        )
    )
