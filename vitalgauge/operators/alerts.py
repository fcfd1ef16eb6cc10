"""Alerts: rule evaluation, episodes, outbox, delivery outcomes and rolling incident windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalgauge import catalog
from vitalgauge import constants as C
from vitalgauge.functions import events as E
from vitalgauge.functions.metrics import ladder, lit
from vitalgauge.operators.percentiles import percentile_aggregates
from vitalgauge.operators.performance import observe_value
from vitalgauge.session import broadcast_checked

_SCOPE = ["tenant_id", "app_id", "environment"]


def active_rules(rules: DataFrame, per_scope: int | None = None) -> DataFrame:
    """Enabled rules; with ``per_scope`` only the first ones of every scope by id."""
    enabled = rules.filter("enabled")
    if per_scope is None:
        return enabled
    rank = F.row_number().over(Window.partitionBy(*_SCOPE).orderBy("rule_id"))
    return enabled.withColumn("_rank", rank).filter(F.col("_rank") <= per_scope).drop("_rank")


def _windows(rules: DataFrame) -> list[int]:
    """The distinct window lengths of the rules in seconds, ascending: a handful of settings, at most one a rule."""
    return sorted(r[0] for r in rules.select("window_seconds").distinct().collect())


def _panes(events: DataFrame, windows: list[int], now_ms: int) -> DataFrame:
    """Events inside the longest window with ``pane``, the shortest window that holds them, and ``release``.

    Whatever the number of rules, an event falls into one pane; a rule adds up the panes within its window. The release is
    null where the event isn't bound to one.
    """
    age = f"({now_ms}L - occurrence_timestamp_ms)"
    ladder_sql = " ".join(f"WHEN {age} <= {w} * 1000L THEN {w}" for w in windows)
    return events.filter(
        (F.col("occurrence_timestamp_ms") >= now_ms - max(windows, default=0) * 1000) & (F.col("occurrence_timestamp_ms") < now_ms)
    ).selectExpr("*", f"CASE {ladder_sql} END AS pane" if windows else "0 AS pane", f"if({E.BOUND}, app_version, NULL) AS release")


# A release rule only sees occurrence-bound events of its release.
_IN_RULE = "pane <= window_seconds AND (release_version IS NULL OR release <=> release_version)"


def evaluate_count_rules(events: DataFrame, rules: DataFrame, now_ms: int) -> DataFrame:
    """Counted events per rule; null when the window holds no telemetry at all.

    Events are counted once by (scope, release, pane); only these counts meet the rules of their scope.
    """
    mine = rules.filter(f"metric IN {E.quoted(C.ALERT_COUNT_EVENTS)}")
    counted = {metric: f"_hits_{i}" for i, metric in enumerate(C.ALERT_COUNT_EVENTS)}
    panes = (
        _panes(events, _windows(mine), now_ms)
        .groupBy(*_SCOPE, "release", "pane")
        .agg(
            F.count("*").alias("n"),
            *[
                F.expr(f"count_if(module = '{module}' AND name = '{name}') AS {counted[metric]}")
                for metric, (module, name) in C.ALERT_COUNT_EVENTS.items()
            ],
        )
    )
    hits = " ".join(f"WHEN '{metric}' THEN {column}" for metric, column in counted.items())
    totals = (
        panes.join(broadcast_checked(mine.select(*_SCOPE, "rule_id", "metric", "window_seconds", "release_version")), _SCOPE)
        .filter(_IN_RULE)
        .groupBy("rule_id")
        .agg(F.sum("n").alias("n"), F.expr(f"sum(CASE metric {hits} END) AS hits"))
    )
    return mine.join(totals, "rule_id", "left").selectExpr(
        *mine.columns, "cast(hits AS double) AS value", "coalesce(n, 0) AS sample_count"
    )


def evaluate_p95_rules(events: DataFrame, rules: DataFrame, now_ms: int) -> DataFrame:
    """p95 of a registered observation; only a fully covered window has a value.

    Observations are counted once by (scope, release, pane, metric, value); the counts meet the rules on scope and metric,
    and a percentile over counted values does the rest.
    """
    mine = rules.filter("metric LIKE '%.p95'").withColumn("metric_id", F.expr("left(metric, length(metric) - 4)"))
    # Not more metrics than the registry has.
    registered = {f.id for f in catalog.performance_fields()}
    named = {r[0] for r in mine.select("metric_id").distinct().filter(F.col("metric_id").isin(*registered)).collect()}
    keys = [*_SCOPE, "release", "pane"]
    observed = observe_value(_panes(events, _windows(mine), now_ms), *keys, metrics=named)
    cells = observed.groupBy(*keys, "metric_id", "value").agg(F.count("*").alias("c"))
    wanted = mine.select(*_SCOPE, "metric_id", "rule_id", "window_seconds", "release_version")
    in_rules = cells.join(broadcast_checked(wanted), [*_SCOPE, "metric_id"]).filter(_IN_RULE)
    counts = {"samples": "value IS NOT NULL", "n": "true"}
    measured = percentile_aggregates(in_rules, ["rule_id"], "value", {"p95": 0.95}, counts, weight="c")
    return mine.join(measured, "rule_id", "left").selectExpr(
        *rules.columns,
        "if(samples = n, p95, NULL) AS value",
        "coalesce(samples, 0) AS sample_count",
    )


STATE = ladder(
    ("value IS NULL OR sample_count < min_samples", lit("INSUFFICIENT_DATA")),
    ("if(comparison = 'gt', value > threshold, value < threshold)", lit("FIRING")),
    otherwise=lit("OK"),
)


def alert_rule_state(evaluated: DataFrame) -> DataFrame:
    """Add ``state``."""
    return evaluated.withColumn("state", F.expr(STATE))


def alert_transitions(ticks: DataFrame, open_rules: DataFrame | None = None) -> DataFrame:
    """Ticks that open or close an episode.

    Insufficient ticks change nothing, so only decisive ones are compared with their predecessor.
    A rule has one tick per evaluation instant; the window never depends on event volume.
    ``open_rules`` names rules with an open episode before the first tick.
    """
    decisive = ticks.filter("state IN ('FIRING', 'OK')")
    order = Window.partitionBy("rule_id").orderBy("evaluated_ms")
    start = F.lit("OK")
    if open_rules is not None:
        marked = open_rules.select("rule_id", F.lit("FIRING").alias("_initial"))
        decisive = decisive.join(marked, "rule_id", "left")
        start = F.coalesce("_initial", F.lit("OK"))
    return (
        decisive.withColumn("_before", F.coalesce(F.lag("state").over(order), start))
        .filter("state <> _before")
        .withColumn("transition", F.expr("if(state = 'FIRING', 'FIRING', 'RESOLVED')"))
        .drop("_before", "_initial")
    )


def alert_episodes(ticks: DataFrame) -> DataFrame:
    """Episodes open on the first breach and close on the first recovery."""
    order = Window.partitionBy("rule_id").orderBy("evaluated_ms")
    return (
        alert_transitions(ticks)
        .withColumn("resolved_ms", F.lead("evaluated_ms").over(order))
        .filter("transition = 'FIRING'")
        .selectExpr(
            "rule_id",
            "evaluated_ms AS triggered_ms",
            "resolved_ms",
            "value AS trigger_value",
            "sample_count",
        )
    )


def alert_outbox(transitions: DataFrame, rules: DataFrame) -> DataFrame:
    """One delivery per transition of a rule with a channel; silenced ones are SUPPRESSED."""
    wanted = rules.filter("channel IS NOT NULL").select(
        "rule_id", "channel", "silence_until_ms", "metric", "threshold"
    )
    return transitions.select(
        "rule_id", "evaluated_ms", "transition", "value", "sample_count"
    ).join(wanted, "rule_id").selectExpr(
        "rule_id",
        "transition",
        "channel",
        "if(coalesce(silence_until_ms > evaluated_ms, false), 'SUPPRESSED', 'PENDING') AS status",
        "evaluated_ms AS next_attempt_ms",
        "metric",
        "value",
        "threshold",
        "sample_count",
    )


def delivery_outcome(attempts: DataFrame, max_attempts: int = 5) -> DataFrame:
    """Status after an attempt: ``http_status`` is null on a transport error.

    ``attempt_count`` counts the attempt itself; ``configured`` tells if the channel is known, and
    ``claimed`` is false for a row whose attempts were already used up.
    """
    budget = f"attempt_count < {max_attempts}"
    status = ladder(
        ("NOT claimed OR NOT configured", lit("FAILED")),
        ("http_status BETWEEN 200 AND 299", lit("DELIVERED")),
        (
            f"{budget} AND (http_status IS NULL OR http_status IN (408, 429)"
            " OR http_status >= 500)",
            lit("RETRY"),
        ),
        otherwise=lit("FAILED"),
    )
    error = ladder(
        ("NOT claimed", lit("RETRY_EXHAUSTED")),
        ("NOT configured", lit("CHANNEL_UNCONFIGURED")),
        ("http_status BETWEEN 200 AND 299", "NULL"),
        ("http_status IS NULL", lit("TRANSPORT_ERROR")),
        otherwise="concat('HTTP_', http_status)",
    )
    delay = "cast(least(3600, pow(2, attempt_count) * 10) AS bigint)"
    return attempts.selectExpr(
        "*",
        f"{status} AS status",
        f"{error} AS last_error",
        f"if(claimed, finished_ms + {delay} * 1000, NULL) AS next_attempt_ms",
    )


def acknowledge_episodes(episodes: DataFrame, acknowledgements: DataFrame) -> DataFrame:
    """The first acknowledgement of an episode wins."""
    first = acknowledgements.groupBy("episode_id").agg(
        F.min(F.struct("acknowledged_ms", "actor")).alias("first")
    )
    return episodes.join(first, "episode_id", "left").selectExpr(
        *episodes.columns,
        "first.acknowledged_ms AS acknowledged_ms",
        "first.actor AS acknowledged_by",
    )


def alert_history(
    rules: DataFrame, episodes: DataFrame, deliveries: DataFrame, limit: int = 100
) -> DataFrame:
    """Latest episodes and deliveries of the scopes of ``rules``, newest first per scope."""
    scoped = rules.select(*_SCOPE, "rule_id")
    items = [
        episodes.join(scoped, "rule_id").selectExpr(
            *_SCOPE, "'episode' AS kind", "episode_id AS item_id", "rule_id"
        ),
        deliveries.join(
            episodes.select("episode_id", "rule_id"), "episode_id"
        ).join(scoped, "rule_id").selectExpr(
            *_SCOPE, "'delivery' AS kind", "delivery_id AS item_id", "rule_id"
        ),
    ]
    newest = Window.partitionBy(*_SCOPE, "kind").orderBy(F.desc("item_id"))
    return (
        items[0]
        .unionByName(items[1])
        .withColumn("position", F.row_number().over(newest))
        .filter(F.col("position") <= limit)
    )


def _event_time(rows: DataFrame) -> DataFrame:
    return rows.withColumn("event_time", F.timestamp_millis("occurrence_timestamp_ms"))


def rolling_incident_alert(rows: DataFrame, threshold: int = 0) -> DataFrame:
    """Crash and ANR counts of 5-minute windows sliding by one minute, per app and environment.

    Works on batch rows and, after a watermark on ``event_time``, on streams.
    """
    hits = rows.filter(
        F.expr(f"{E.BOUND} AND {E.FAMILY} IN ('JAVA_CRASH', 'ANR')")
    ).withColumn("family", F.expr(E.FAMILY))
    if "event_time" not in hits.columns:
        hits = _event_time(hits)
    return (
        hits.groupBy(
            "app_id", "environment", "family", F.window("event_time", "5 minutes", "1 minute")
        )
        .agg(F.count("*").alias("incident_count"))
        .filter(F.col("incident_count") > threshold)
        .select(
            "app_id",
            "environment",
            "family",
            F.unix_millis("window.start").alias("window_start_ms"),
            "incident_count",
        )
    )


DROP_RATE_KEYS = ("app_id", "release_version")


def drop_rate_windows(rows: DataFrame, *window_args: str) -> DataFrame:
    """Reported drop rates with their time windows; the release only when bound."""
    return _in_windows(_drop_rates(rows), *window_args)


def _drop_rates(rows: DataFrame) -> DataFrame:
    return rows.filter(E.is_event("core", "sdk_health")).selectExpr(
        "app_id", f"if({E.BOUND}, app_version, NULL) AS release_version",
        f"{E.BOUND} AS bound", f"{E.RATE} AS rate", "occurrence_timestamp_ms",
    ).filter("rate IS NOT NULL")


def _in_windows(rates: DataFrame, *window_args: str) -> DataFrame:
    return (
        _event_time(rates)
        .withColumn("window", F.window("event_time", *window_args))
        .withColumn("window_start_ms", F.unix_millis("window.start"))
        .drop("window", "event_time", "occurrence_timestamp_ms")
    )


def rolling_drop_rate_alert(rows: DataFrame, threshold: float = 0.01) -> DataFrame:
    """p95 drop rate of 15-minute windows sliding by one minute, above the threshold.

    Rates are counted by (key, minute, rate) first; the slide is a minute, so a minute's rates are in the same windows and
    only the counted rows are expanded.
    """
    minutes = (
        _drop_rates(rows)
        .filter("bound")
        .withColumn("occurrence_timestamp_ms", F.expr("occurrence_timestamp_ms - pmod(occurrence_timestamp_ms, 60000L)"))
        .groupBy(*DROP_RATE_KEYS, "occurrence_timestamp_ms", "rate")
        .agg(F.count("*").alias("c"))
    )
    windows = _in_windows(minutes, "15 minutes", "1 minute")
    keys = [*DROP_RATE_KEYS, "window_start_ms"]
    alerts = percentile_aggregates(windows, keys, "rate", {"p95": 0.95}, {"sample_count": "true"}, weight="c")
    return alerts.filter(F.col("p95") > threshold)
