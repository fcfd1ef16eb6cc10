"""Release health: identity-gated counts, installations, sessions and SDK quality per release.

One filtered scan feeds every metric. Each row is reduced to a flag word and expands to its event
class and the entities it names (installation, session, fingerprint). Entities fold to one flag word
per key before they are counted, and that fold combines on the map side, so one dominating release
or installation never gathers in a task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgauge import constants as C
from vitalgauge.functions import events as E
from vitalgauge.functions import metrics as M
from vitalgauge.functions.metrics import ladder, lit, ratio
from vitalgauge.operators.scope import Scope, bucket_index, bucket_spine, scope_window_filter
from vitalgauge.session import small_table


@dataclass(frozen=True)
class Window:
    """Half-open report window with the lateness threshold and gates of release reports."""

    from_ms: int
    to_ms: int
    late_after_ms: int = C.LATE_AFTER_MS
    min_installations: int = C.MIN_INSTALLATIONS
    min_sdk_coverage: float = C.MIN_SDK_COVERAGE


# Facts about one row, each a bit of its flag word.
FLAGS = {
    "eligible": "eligible",
    "incident": f"eligible AND family IN {E.LIVE}",
    "identified": "eligible AND installation_hmac IS NOT NULL",
    "fingerprint": "incident_fingerprint IS NOT NULL",
    "java": "family = 'JAVA_CRASH'",
    "native": "family = 'NATIVE_CRASH'",
    "tombstone": "family = 'NATIVE_TOMBSTONE'",
    "anr": "family = 'ANR'",
    "late": "is_late",
    "sdk": "eligible AND family = 'SDK_HEALTH'",
    "sdk_valid": "sdk_valid",
    "sdk_dropped": "sdk_dropped",
    "sdk_healthy": "eligible AND family = 'SDK_HEALTH' AND sdk_valid",
    "runtime": f"eligible AND family NOT IN {E.HISTORICAL}",
    "known_session": f"eligible AND family NOT IN {E.HISTORICAL} AND session_hmac IS NOT NULL"
    f" AND session_identity_quality <=> '{C.OCCURRENCE_BOUND}'",
    "session_start": "session_start",
}
_BIT = {name: 1 << i for i, name in enumerate(FLAGS)}


def flagged(*names: str, without: str | None = None) -> str:
    """SQL test that the flag word carries all the names, and not ``without``."""
    wanted = sum(_BIT[name] for name in names)
    tested = wanted + (_BIT[without] if without else 0)
    return f"(flags & {tested} = {wanted})"


# Event counts of a release; ``declared`` is every row.
EVENT_COUNTS = {
    "eligible": flagged("eligible"),
    "java": flagged("eligible", "java"),
    "native": flagged("eligible", "native"),
    "tombstone": flagged("eligible", "tombstone"),
    "anr": flagged("eligible", "anr"),
    "incidents": flagged("incident"),
    "incidents_identified": flagged("incident", "identified"),
    "fingerprinted": flagged("incident", "fingerprint"),
    "identified": flagged("identified"),
    "late": flagged("eligible", "late"),
    "sdk_rows": flagged("sdk"),
    "sdk_invalid": flagged("sdk", without="sdk_valid"),
    "sdk_drops": flagged("sdk", "sdk_dropped"),
    "runtime": flagged("runtime"),
    "known_sessions": flagged("known_session"),
}


def release_rows(
    inbox: DataFrame, scope: Scope, window: Window, releases: tuple[str, ...]
) -> DataFrame:
    """Scoped rows of the named releases, reduced to a flag word and the identity columns."""
    rows = scope_window_filter(inbox, scope, window.from_ms, window.to_ms).filter(
        F.col("app_version").isin(*releases)
    )
    return rows.selectExpr(
        "app_version",
        "installation_hmac",
        "installation_hmac_key_version",
        "session_hmac",
        "session_hmac_key_version",
        "session_identity_quality",
        "incident_fingerprint",
        f"{E.FAMILY} AS family",
        f"{E.BOUND} AS eligible",
        f"{E.SESSION_START} AS session_start",
        f"{E.SDK_VALID} AS sdk_valid",
        f"{E.SDK_DROPPED} AS sdk_dropped",
        f"{E.RATE} AS rate",
        f"{E.late(window.late_after_ms)} AS is_late",
    ).selectExpr(
        "app_version",
        "installation_hmac",
        "installation_hmac_key_version",
        "session_hmac",
        "session_hmac_key_version",
        "incident_fingerprint",
        "if(eligible AND family = 'SDK_HEALTH', rate, NULL) AS sdk_rate",
        " + ".join(f"if({FLAGS[name]}, {bit}, 0)" for name, bit in _BIT.items()) + " AS flags",
    )


def _with_releases(df: DataFrame, releases: tuple[str, ...]) -> DataFrame:
    """Keep a row for every requested release, also for one without data."""
    spine = small_table(df.sparkSession, [(r,) for r in releases], "app_version string")
    joined = spine.join(df, "app_version", "left")
    return joined.na.fill(0, [c for c, kind in df.dtypes if kind == "bigint"])


def _counts(conditions: dict[str, str]) -> list[str]:
    return [f"count_if({condition}) AS {name}" for name, condition in conditions.items()]


def _aggregate(df: DataFrame, keys: tuple[str, ...], aggregates: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(a) for a in aggregates])


def release_counts(rows: DataFrame, releases: tuple[str, ...]) -> DataFrame:
    """Event counts per release: declared, eligible, incidents, identity and SDK evidence."""
    aggregates = [
        "count(*) AS declared",
        "max(sdk_rate) AS sdk_worst_rate",
        *_counts(EVENT_COUNTS),
    ]
    return _with_releases(_aggregate(rows, ("app_version",), aggregates), releases)


def _entity(kind: str, condition: str, key: str) -> str:
    return f"if({condition}, named_struct('kind', '{kind}', 'key', {key}), NULL)"


# What one row contributes to: its event class, and the entities it names. Event classes are flag
# words, so there are few of them and they collapse on the map side.
_ENTITIES = ", ".join(
    (
        _entity("event", "true", "cast(flags AS string)"),
        _entity("installation", flagged("identified"), "installation_hmac"),
        _entity("epoch", flagged("identified"), "coalesce(installation_hmac_key_version, '')"),
        _entity(
            "session",
            flagged("known_session"),
            "concat(coalesce(session_hmac_key_version, ''), '/', session_hmac)",
        ),
        _entity(
            "session_epoch", flagged("known_session"), "coalesce(session_hmac_key_version, '')"
        ),
        _entity(
            "fingerprint",
            f"{flagged('incident', 'fingerprint')} AND incident_fingerprint <> ''",
            "incident_fingerprint",
        ),
    )
)


def release_measures(rows: DataFrame, releases: tuple[str, ...]) -> DataFrame:
    """All counts and distinct counts per release from one scan.

    Every row expands to its event class and entities; the first aggregate folds them by key (with
    a partial aggregate before the shuffle), the second counts keys per release.
    """
    entities = rows.selectExpr(
        "app_version", "flags", "sdk_rate", f"inline(array_compact(array({_ENTITIES})))"
    )
    folded = _aggregate(
        entities,
        ("app_version", "kind", "key"),
        ["count(*) AS n", "bit_or(flags) AS flags", "max(sdk_rate) AS sdk_rate"],
    )
    started = f"kind = 'session' AND {flagged('session_start')}"
    crashed = f"({flagged('java')} OR {flagged('native')})"
    distinct = {
        "active": "kind = 'installation'",
        "affected": f"kind = 'installation' AND {flagged('incident')}",
        "sdk_installations": f"kind = 'installation' AND {flagged('sdk_healthy')}",
        "fingerprints": "kind = 'fingerprint'",
        "sessions_started": started,
        "sessions_unstarted": f"kind = 'session' AND NOT {flagged('session_start')}",
        "sessions_crashed": f"{started} AND {crashed}",
        "sessions_anr": f"{started} AND {flagged('anr')}",
        "session_epochs": "kind = 'session_epoch'",
    }
    events = [
        f"sum(if(kind = 'event' AND {condition}, n, 0)) AS {name}"
        for name, condition in {"declared": "true", **EVENT_COUNTS}.items()
    ]
    return _with_releases(
        _aggregate(
            folded,
            ("app_version",),
            [
                *events,
                *_counts(distinct),
                "max(if(kind = 'event', sdk_rate, NULL)) AS sdk_worst_rate",
                # A key ring holds at most 16 versions, so the set stays small.
                "collect_set(if(kind = 'epoch', key, NULL)) AS epochs",
            ],
        ),
        releases,
    )


QUALITY = ladder(
    ("declared = 0", lit(C.NO_DATA)),
    ("eligible = 0", lit(C.UNAVAILABLE)),
    ("eligible < declared OR identified < eligible OR sdk_drops > 0", lit(C.DEGRADED)),
    ("late > 0", lit(C.LATE)),
    otherwise=lit(C.PRESENT),
)
QUALITY_REASON = ladder(
    ("declared = 0", "NULL"),
    ("eligible = 0", lit(C.OCCURRENCE_REASON)),
    ("eligible < declared", lit("RELEASE_IDENTITY_COVERAGE_INCOMPLETE")),
    ("identified < eligible", lit("INSTALLATION_IDENTITY_COVERAGE_INCOMPLETE")),
    ("sdk_drops > 0", lit("SDK_REPORTED_DROPS")),
    ("late > 0", lit("LATE_DATA_PRESENT")),
)


def with_quality(counts: DataFrame) -> DataFrame:
    """Add ``quality`` and ``quality_reason``; missing identity takes precedence."""
    return counts.selectExpr(
        "*", f"{QUALITY} AS quality", f"{QUALITY_REASON} AS quality_reason"
    )


def identity_coverage(counts: DataFrame) -> DataFrame:
    """Add release and installation identity coverage; null without a denominator."""
    return counts.selectExpr(
        "*",
        "try_divide(eligible, declared) AS release_identity_coverage",
        "try_divide(identified, eligible) AS installation_identity_coverage",
    )


def late_ratio_metric(to_ms: int) -> str:
    """Share of late eligible rows."""
    return M.metric(
        ladder(
            ("declared = 0", lit(C.NO_DATA)),
            ("eligible = 0", lit(C.UNAVAILABLE)),
            ("late > 0", lit(C.LATE)),
            otherwise=lit(C.ZERO),
        ),
        "if(eligible > 0, eligible, declared)",
        to_ms,
        value=ratio("late", "eligible"),
        numerator="if(eligible > 0, late, NULL)",
        denominator="nullif(eligible, 0)",
        reason=ladder(("declared > 0 AND eligible = 0", lit(C.OCCURRENCE_REASON))),
    )


def fingerprint_metric(to_ms: int) -> str:
    """Distinct incident fingerprints with their coverage."""
    return M.metric(
        ladder(
            ("incidents > 0 AND fingerprints = 0", lit(C.UNAVAILABLE)),
            ("incidents > 0 AND fingerprinted <> incidents", lit(C.DEGRADED)),
            ("incidents > 0", lit(C.PRESENT)),
            ("eligible > 0", lit(C.ZERO)),
            otherwise="quality",
        ),
        ladder(
            ("incidents > 0", "incidents"), ("eligible > 0", "eligible"), otherwise="declared"
        ),
        to_ms,
        value=ladder(
            ("incidents > 0", "nullif(fingerprints, 0)"), ("eligible > 0", "0")
        ),
        coverage=ladder(("fingerprints > 0", ratio("fingerprinted", "incidents"))),
        reason=ladder(
            ("incidents > 0 AND fingerprints = 0", lit("INCIDENT_FINGERPRINT_NOT_PROVIDED")),
            ("eligible = 0", "quality_reason"),
        ),
    )


def sdk_drop_metric(to_ms: int) -> str:
    """Worst reported drop rate; coverage is the share of active installations reporting."""
    return M.metric(
        f"if(declared = 0, '{C.NO_DATA}', {M.SDK_STATE})",
        "sdk_rows",
        to_ms,
        value=M.SDK_VALUE,
        coverage=ratio("sdk_installations", "active"),
        reason=f"if(declared = 0, NULL, {M.SDK_REASON})",
    )


# No installation can be counted: (condition, state, reason, samples).
_BLOCKED = (
    ("declared = 0", lit(C.NO_DATA), "NULL", "0"),
    ("eligible = 0", lit(C.UNAVAILABLE), lit(C.OCCURRENCE_REASON), "declared"),
    ("identified = 0", lit(C.UNAVAILABLE), lit(C.INSTALLATION_REASON), "eligible"),
)
_PARTIAL = "identified < eligible"


def _installation_metric(state, samples, to_ms: int, **open_parts: str) -> str:
    """Metric that is withheld while ``_BLOCKED`` holds."""
    reason = open_parts.pop("reason", "NULL")
    return M.metric(
        ladder(*[(c, s) for c, s, _, _ in _BLOCKED], *state[:-1], otherwise=state[-1][1]),
        ladder(*[(c, n) for c, _, _, n in _BLOCKED], otherwise=samples),
        to_ms,
        reason=ladder(*[(c, r) for c, _, r, _ in _BLOCKED], otherwise=reason),
        **{name: f"if(identified > 0, {sql}, NULL)" for name, sql in open_parts.items()},
    )


def active_metric(to_ms: int) -> str:
    """Distinct installations over eligible rows."""
    return _installation_metric(
        ((_PARTIAL, lit(C.DEGRADED)), ("true", lit(C.PRESENT))),
        "eligible",
        to_ms,
        value="active",
        coverage=ratio("identified", "eligible"),
    )


def affected_metric(to_ms: int) -> str:
    """Distinct installations over live incidents."""
    return _installation_metric(
        (
            (_PARTIAL, lit(C.DEGRADED)),
            ("affected = 0", lit(C.ZERO)),
            ("true", lit(C.PRESENT)),
        ),
        "incidents",
        to_ms,
        value="affected",
        coverage=f"coalesce({ratio('incidents_identified', 'incidents')}, 1.0)",
    )


def ratio_metric(to_ms: int) -> str:
    """Affected over active installations; a closed gate withholds the value."""
    closed = f"gate <> '{C.PRESENT}' AND eligible > 0"
    gated = M.metric(
        "gate",
        "eligible",
        to_ms,
        numerator="affected",
        denominator="active",
        coverage="installation_identity_coverage",
        reason="gate_reason",
    )
    open_gate = _installation_metric(
        (
            (_PARTIAL, lit(C.DEGRADED)),
            ("affected = 0", lit(C.ZERO)),
            ("true", lit(C.PRESENT)),
        ),
        "eligible",
        to_ms,
        value=f"if({_PARTIAL}, NULL, {ratio('affected', 'active')})",
        numerator="affected",
        denominator="active",
        coverage=ratio("identified", "eligible"),
        reason=ladder((_PARTIAL, lit("INSTALLATION_IDENTITY_COVERAGE_INCOMPLETE"))),
    )
    return f"if({closed}, {gated}, {open_gate})"


def session_metric(failed: str, to_ms: int) -> str:
    """Share of explicitly started sessions without the failure; gates never infer a session."""
    rules = (
        ("declared = 0", lit(C.NO_DATA), "NULL"),
        ("known_sessions = 0", lit(C.UNAVAILABLE), lit(C.SESSION_REASON)),
        (
            "session_epochs > 1",
            lit(C.UNAVAILABLE),
            lit("SESSION_KEY_ROTATION_BREAKS_CONTINUITY"),
        ),
        (
            "known_sessions <> runtime OR eligible <> declared",
            lit(C.UNKNOWN_COVERAGE),
            lit("SESSION_IDENTITY_COVERAGE_INCOMPLETE"),
        ),
        (
            "sessions_started = 0 OR sessions_unstarted > 0",
            lit(C.UNKNOWN_COVERAGE),
            lit("SESSION_START_NOT_IN_WINDOW"),
        ),
    )
    intact = f"(sessions_started - {failed})"
    blocked = " OR ".join(f"({condition})" for condition, _, _ in rules)
    return M.metric(
        ladder(*[(c, s) for c, s, _ in rules], otherwise="gate"),
        "runtime",
        to_ms,
        value=f"if(({blocked}) OR gate <> '{C.PRESENT}', NULL,"
        f" {ratio(intact, 'sessions_started')})",
        numerator=f"if(sessions_started > 0, {intact}, NULL)",
        denominator="nullif(sessions_started, 0)",
        coverage=ratio("known_sessions", "runtime"),
        reason=ladder(*[(c, r) for c, _, r in rules], otherwise="gate_reason"),
    )


METRICS = (
    "java_crash_events",
    "native_crash_events",
    "native_tombstone_events",
    "anr_events",
    "affected_installations",
    "active_installations",
    "affected_installation_ratio",
    "incident_fingerprint_count",
    "late_ratio",
    "sdk_drop_rate",
    "crash_free_sessions",
    "anr_free_sessions",
)


def release_slices(rows: DataFrame, window: Window, releases: tuple[str, ...]) -> DataFrame:
    """One row per release with its state, coverages and all metric structs.

    A failed gate replaces the slice state. Java and ANR counts keep the state from before the
    gates, native and tombstone counts take the replaced one, and all four keep the old reason.
    """
    to_ms = window.to_ms
    base = identity_coverage(with_quality(release_measures(rows, releases))).selectExpr(
        "*", f"{sdk_drop_metric(to_ms)} AS sdk_drop_rate"
    )
    gates = (
        (f"quality <> '{C.PRESENT}'", "quality", "quality_reason"),
        (
            f"sdk_drop_rate.state NOT IN ('{C.PRESENT}', '{C.ZERO}')",
            "sdk_drop_rate.state",
            "sdk_drop_rate.reason",
        ),
        (
            f"coalesce(sdk_drop_rate.coverage < {window.min_sdk_coverage}, true)",
            lit(C.UNKNOWN_COVERAGE),
            lit("SDK_HEALTH_INSTALLATION_COVERAGE_INCOMPLETE"),
        ),
        (
            f"active < {window.min_installations}",
            lit(C.UNAVAILABLE),
            lit("INSUFFICIENT_INSTALLATION_SAMPLE"),
        ),
    )
    gated = base.selectExpr(
        "*",
        ladder(*[(c, s) for c, s, _ in gates], otherwise=lit(C.PRESENT)) + " AS gate",
        ladder(*[(c, r) for c, _, r in gates]) + " AS gate_reason",
    ).selectExpr("*", f"if(gate <> '{C.PRESENT}' AND eligible > 0, gate, quality) AS state")

    def count(column: str, state: str) -> str:
        return M.count_metric(column, "eligible", to_ms, state, "quality_reason")

    sql = {
        "java_crash_events": count("java", "quality"),
        "native_crash_events": count("native", "state"),
        "native_tombstone_events": count("tombstone", "state"),
        "anr_events": count("anr", "quality"),
        "affected_installations": affected_metric(to_ms),
        "active_installations": active_metric(to_ms),
        "affected_installation_ratio": ratio_metric(to_ms),
        "incident_fingerprint_count": fingerprint_metric(to_ms),
        "late_ratio": late_ratio_metric(to_ms),
        "sdk_drop_rate": "sdk_drop_rate",
        "crash_free_sessions": session_metric("sessions_crashed", to_ms),
        "anr_free_sessions": session_metric("sessions_anr", to_ms),
    }
    return gated.selectExpr(
        "app_version",
        "state",
        "declared AS declared_sample_count",
        "eligible AS eligible_sample_count",
        "declared - eligible AS excluded_non_occurrence_count",
        "release_identity_coverage",
        "installation_identity_coverage",
        "epochs",
        *[f"{sql[name]} AS {name}" for name in METRICS],
    )


_EPOCHS = "array_distinct(flatten(collect_list(epochs)))"
_CONTINUITY = ladder(
    (f"array_contains({_EPOCHS}, '')", lit("INSTALLATION_HMAC_VERSION_MISSING")),
    (f"size({_EPOCHS}) > 1", lit("INSTALLATION_HMAC_CONTINUITY_BREAK")),
)


def hmac_continuity(measures: DataFrame) -> DataFrame:
    """One row: why installation counts of the compared releases cannot be joined, or null."""
    return measures.agg(F.expr(_CONTINUITY).alias("reason"))


def release_health(
    inbox: DataFrame, scope: Scope, window: Window, new_release: str, baseline_release: str
) -> DataFrame:
    """Both releases with every metric; a key epoch break withholds installation metrics."""
    releases = (new_release, baseline_release)
    rows = release_rows(inbox, scope, window, releases)
    return with_continuity(release_slices(rows, window, releases), window, new_release)


def with_continuity(slices: DataFrame, window: Window, new_release: str) -> DataFrame:
    """Apply the continuity override across the compared releases and name their roles."""
    # The two release rows meet in one array, so the override needs no second pass.
    fields = ", ".join(slices.columns)
    flat = (
        slices.agg(
            F.expr(f"collect_list(struct({fields})) AS releases"),
            F.expr(f"{_CONTINUITY} AS continuity"),
        )
        .selectExpr("continuity", "inline(releases)")
        .withColumn("broken", F.expr("continuity IS NOT NULL AND eligible_sample_count > 0"))
    )
    withheld = M.metric(
        lit(C.UNAVAILABLE), "eligible_sample_count", window.to_ms, reason="continuity"
    )
    overridden = ("active_installations", "affected_installations", "affected_installation_ratio")
    role = F.when(F.col("app_version") == F.lit(new_release), "new").otherwise("baseline")
    return flat.withColumn("role", role).selectExpr(
        "role",
        "app_version",
        f"if(broken, '{C.UNAVAILABLE}', state) AS state",
        "declared_sample_count",
        "eligible_sample_count",
        "excluded_non_occurrence_count",
        "release_identity_coverage",
        "installation_identity_coverage",
        *[f"if(broken, {withheld}, {m}) AS {m}" if m in overridden else m for m in METRICS],
    )


def release_metrics(health: DataFrame) -> DataFrame:
    """Long form of a health report: one row per role and metric."""
    return health.selectExpr(*M.long_form(METRICS, "role", "app_version")).select(
        "role", "app_version", "metric", *M.flat("m")
    )


def release_comparison(health: DataFrame) -> DataFrame:
    """New minus baseline; null unless both sides carry a concrete value."""

    def delta(metric: str) -> str:
        return (
            f"(max({metric}.value) FILTER (WHERE role = 'new')"
            f" - max({metric}.value) FILTER (WHERE role = 'baseline'))"
        )

    counts = {
        "java_crash_event_delta": "java_crash_events",
        "native_crash_event_delta": "native_crash_events",
        "native_tombstone_event_delta": "native_tombstone_events",
        "anr_event_delta": "anr_events",
        "affected_installation_delta": "affected_installations",
    }
    gated = "affected_installation_ratio"
    concrete = f"bool_and({gated}.state IN ('{C.PRESENT}', '{C.ZERO}'))"
    return health.agg(
        *[F.expr(f"cast({delta(m)} AS bigint) AS {name}") for name, m in counts.items()],
        F.expr(f"if({concrete}, {delta(gated)}, NULL) AS affected_installation_ratio_delta"),
    )


_TREND_FAMILIES = {
    "java_crash_events": "JAVA_CRASH",
    "anr_events": "ANR",
    "native_crash_events": "NATIVE_CRASH",
    "native_tombstone_events": "NATIVE_TOMBSTONE",
}


def release_incident_trend(
    inbox: DataFrame, scope: Scope, window: Window, new_release: str, baseline_release: str
) -> DataFrame:
    """Incident counts per bucket and role; an unobserved bucket stays null, never zero."""
    rows = scope_window_filter(inbox, scope, window.from_ms, window.to_ms).filter(
        F.col("app_version").isin(new_release, baseline_release)
    )
    flagged = rows.select(
        bucket_index(window.from_ms, window.to_ms).alias("bucket"),
        F.when(F.col("app_version") == F.lit(new_release), "new").otherwise("baseline").alias("role"),
        F.expr(f"{E.BOUND} AS eligible"),
        F.expr(f"{E.FAMILY} AS family"),
    )
    counts, out = [], ["bucket_start_ms", "bucket_end_ms"]
    for role in ("new", "baseline"):
        mine = f"role = '{role}'"
        counts += _counts(
            {
                f"{role}_declared": mine,
                f"{role}_eligible": f"{mine} AND eligible",
                f"{role}_seen": f"{mine} AND eligible AND family IN {E.INCIDENTS}",
            }
            | {
                f"{role}_{name}": f"{mine} AND eligible AND family = '{family}'"
                for name, family in _TREND_FAMILIES.items()
            }
        )
        out += [
            f"if({role}_eligible > 0, {role}_{name}, NULL) AS {role}_{name}"
            for name in _TREND_FAMILIES
        ]
        out.append(
            ladder(
                (f"coalesce({role}_declared, 0) = 0", lit(C.NO_DATA)),
                (f"{role}_eligible = 0", lit(C.UNAVAILABLE)),
                (f"{role}_eligible < {role}_declared", lit(C.DEGRADED)),
                (f"{role}_seen > 0", lit(C.PRESENT)),
                otherwise=lit(C.ZERO),
            )
            + f" AS {role}_state"
        )
    buckets = _aggregate(flagged, ("bucket",), counts)
    spine = bucket_spine(inbox.sparkSession, window.from_ms, window.to_ms)
    return spine.join(buckets, "bucket", "left").selectExpr(*out)
