"""Release health: counts, gates, sessions, key rotation and trends."""

from __future__ import annotations

import pytest
from builders import NOW, SDK_OK, event

from vitalgauge.operators import issues, quality
from vitalgauge.operators import release as R
from vitalgauge.operators.scope import Scope, bucket_width, window_facts

SCOPE = Scope("t", "a", "e")
WINDOW = R.Window(NOW - 3_600_000, NOW + 3_600_000, min_installations=2)


def health(df, window=WINDOW):
    rows = R.release_health(df, SCOPE, window, "2.0.0", "1.0.0").collect()
    return {row["role"]: row for row in rows}


def clean(n: int) -> list[dict]:
    """One healthy SDK report per installation."""
    return [
        event("core", "sdk_health", installation_hmac=f"i{i}", fields=SDK_OK) for i in range(n)
    ]


def test_counts_and_exclusions(inbox):
    df = inbox(
        event("crash", "java_crash", incident_fingerprint="f"),
        event("crash", "java_crash", installation_hmac="i2"),
        event("anr", "anr_detected"),
        event("core", "sdk_health", fields=SDK_OK),
        event("crash", "native_crash", release_identity_quality="BATCH_DECLARED"),
        event("crash", "java_crash", app_version="1.0.0"),
        event("crash", "java_crash", tenant_id="other"),
    )
    new = health(df)["new"]
    assert (new["declared_sample_count"], new["eligible_sample_count"]) == (5, 4)
    assert new["excluded_non_occurrence_count"] == 1
    assert new["state"] == "DEGRADED"
    assert new["java_crash_events"]["value"] == 2
    assert new["anr_events"]["value"] == 1
    assert new["active_installations"]["value"] == 2
    assert new["affected_installation_ratio"]["value"] is None
    assert new["affected_installation_ratio"]["reason"] == "RELEASE_IDENTITY_COVERAGE_INCOMPLETE"


def test_absent_release_is_no_data(inbox):
    baseline = health(inbox(*clean(2)))["baseline"]
    assert baseline["state"] == "NO_DATA"
    assert {baseline[m]["state"] for m in R.METRICS} == {"NO_DATA"}


def test_open_gate_gives_ratio_and_deltas(inbox):
    rows = clean(2) + [event("crash", "java_crash", installation_hmac="i0")]
    both = rows + [{**r, "app_version": "1.0.0"} for r in clean(2)]
    slices = health(inbox(*both))
    ratio = slices["new"]["affected_installation_ratio"]
    assert (ratio["state"], ratio["value"], ratio["coverage"]) == ("PRESENT", 0.5, 1.0)
    assert slices["baseline"]["affected_installation_ratio"]["state"] == "ZERO"
    report = R.release_health(inbox(*both), SCOPE, WINDOW, "2.0.0", "1.0.0")
    delta = R.release_comparison(report).first()
    assert delta["java_crash_event_delta"] == 1
    assert delta["affected_installation_ratio_delta"] == 0.5


@pytest.mark.parametrize(
    "rows, reason",
    [
        (clean(1), "INSUFFICIENT_INSTALLATION_SAMPLE"),
        (
            [event("core", "sdk_health", fields={**SDK_OK, "dropCount": "1"})],
            "SDK_REPORTED_DROPS",
        ),
        (
            [event("core", "sdk_health", fields=SDK_OK, received_ms=NOW + 900_001)],
            "LATE_DATA_PRESENT",
        ),
        (
            clean(1) + [event("core", "tick", installation_hmac="i9")],
            "SDK_HEALTH_INSTALLATION_COVERAGE_INCOMPLETE",
        ),
        ([event("core", "tick")], "SDK_HEALTH_NOT_PROVIDED"),
        (
            [event("core", "sdk_health", fields={**SDK_OK, "emitCount": "0"})],
            "SDK_HEALTH_FIELDS_OR_SAMPLE_INVALID",
        ),
    ],
)
def test_closed_gates_withhold_the_ratio(inbox, rows, reason):
    df = inbox(*rows, event("crash", "java_crash", installation_hmac="i0"))
    new = health(df)["new"]
    assert new["affected_installation_ratio"]["value"] is None
    assert new["affected_installation_ratio"]["reason"] == reason
    assert new["java_crash_events"]["value"] == 1


def test_failed_gate_hides_native_but_not_java_counts(inbox):
    df = inbox(*clean(1), event("crash", "java_crash", installation_hmac="i0"))
    new = health(df)["new"]
    assert new["state"] == "UNAVAILABLE"
    assert new["java_crash_events"]["state"] == "PRESENT"
    assert new["native_crash_events"]["value"] is None
    assert new["native_crash_events"]["state"] == "UNAVAILABLE"


def test_key_rotation_breaks_installation_counts(inbox):
    rows = clean(2) + [event("core", "tick", installation_hmac_key_version="v2")]
    new = health(inbox(*rows))["new"]
    assert new["state"] == "UNAVAILABLE"
    active = new["active_installations"]
    assert (active["value"], active["reason"]) == (None, "INSTALLATION_HMAC_CONTINUITY_BREAK")


START = {"session_schema_version": "1", "session_count": "1"}


def session(name: str, key: str | None, **overrides) -> dict:
    module, event_name = name.split("/")
    bound = {"session_identity_quality": "OCCURRENCE_BOUND", "session_hmac_key_version": "v1"}
    return event(module, event_name, session_hmac=key, **(bound if key else {}), **overrides)


SESSIONS = [
    session("core/sdk_health", "a", fields=SDK_OK),
    session("core/session_start", "a", fields=START),
    session("core/session_start", "b", fields=START),
    *[session("crash/native_crash", "a")] * 3,
    session("crash/java_crash", "a"),
    session("anr/anr_detected", "b"),
    *[session("crash/tombstone_crash", None)] * 8,
]
ONE = R.Window(WINDOW.from_ms, WINDOW.to_ms, min_installations=1)


def test_sessions_are_only_started_ones(inbox):
    new = health(inbox(*SESSIONS), ONE)["new"]
    free = new["crash_free_sessions"]
    assert (free["state"], free["value"], free["numerator"], free["denominator"]) == (
        "PRESENT", 0.5, 1, 2,
    )
    assert new["anr_free_sessions"]["value"] == 0.5
    assert new["native_crash_events"]["value"] == 3
    assert new["native_tombstone_events"]["value"] == 8


@pytest.mark.parametrize(
    "extra, reason",
    [
        (session("core/tick", None), "SESSION_IDENTITY_COVERAGE_INCOMPLETE"),
        (session("core/tick", "c"), "SESSION_START_NOT_IN_WINDOW"),
        (
            {**session("core/tick", "a"), "session_hmac_key_version": "v2"},
            "SESSION_KEY_ROTATION_BREAKS_CONTINUITY",
        ),
        (
            session("core/sdk_health", "a", fields={**SDK_OK, "dropCount": "2"}),
            "SDK_REPORTED_DROPS",
        ),
    ],
)
def test_session_gates(inbox, extra, reason):
    free = health(inbox(*SESSIONS, extra), ONE)["new"]["crash_free_sessions"]
    assert (free["value"], free["reason"]) == (None, reason)


def test_trend_distinguishes_absent_declared_and_zero(inbox):
    window = R.Window(NOW, NOW + 3 * 60_000)
    df = inbox(
        event("core", "tick", occurrence_timestamp_ms=NOW),
        event(
            "core", "tick", occurrence_timestamp_ms=NOW + 60_000,
            release_identity_quality="BATCH_DECLARED",
        ),
    )
    rows = R.release_incident_trend(df, SCOPE, window, "2.0.0", "1.0.0").orderBy(
        "bucket_start_ms"
    ).collect()
    assert [r["new_state"] for r in rows] == ["ZERO", "UNAVAILABLE", "NO_DATA"]
    assert [r["new_java_crash_events"] for r in rows] == [0, None, None]


def test_bucket_width_is_minute_aligned():
    assert bucket_width(0, 60_000) == 60_000
    assert bucket_width(0, 24 * 60_000 + 1) == 120_000


def test_facts_keep_weights(inbox):
    df = inbox(*[event("core", "tick")] * 500)
    facts = window_facts(df, WINDOW.from_ms, WINDOW.to_ms).collect()
    assert [f["weight"] for f in facts] == [500]


def test_resource_distribution_counts_missing(inbox):
    rows = [
        event("crash", "native_crash", incident_fingerprint="f", device_model="m",
              os_version="o")
    ] * 7 + [event("crash", "native_crash", incident_fingerprint="f")] * 3
    issue = issues.issue_rows(inbox(*rows), "f")
    top = issues.issue_distribution(issue).filter("dimension = 'device_model'").collect()
    assert [(r["label"], r["event_count"]) for r in top] == [("m", 7)]
    cover = issues.issue_coverage(issue).filter("dimension = 'device_model'").first()
    assert (cover["state"], cover["missing_event_count"]) == ("DEGRADED", 3)


def test_expired_scene_is_not_missing(inbox):
    df = inbox(
        event("crash", "java_crash", incident_fingerprint="f", scene="Home"),
        event("crash", "java_crash", incident_fingerprint="f", scene="Home",
              raw_pruned_ms=NOW, retained_scene_state="EXPIRED"),
    )
    cover = issues.issue_coverage(issues.issue_rows(df, "f")).filter("dimension = 'scene'").first()
    assert (cover["state"], cover["reason"]) == ("DEGRADED", "SCENE_EVIDENCE_EXPIRED")
    assert (cover["available_event_count"], cover["expired_event_count"]) == (1, 1)


def test_unknown_fingerprint_and_mixed_family(inbox):
    df = inbox(
        event("crash", "java_crash", incident_fingerprint="f"),
        event("anr", "anr_detected", incident_fingerprint="f"),
    )
    assert issues.issue_detail(df, "f").first()["event_family"] == "MIXED"
    absent = issues.issue_detail(df, "g").first()
    assert (absent["state"], absent["reason"]) == ("NO_DATA", "FINGERPRINT_NOT_FOUND")


def test_data_quality_states(inbox):
    def state(*rows):
        return quality.data_quality(inbox(*rows), NOW).first()["state"]

    assert state(event("core", "sdk_health", fields=SDK_OK)) == "PRESENT"
    assert state(event("core", "tick")) == "UNAVAILABLE"
    assert state(event("core", "sdk_health", fields=SDK_OK, installation_hmac=None)) == "DEGRADED"
    assert quality.data_quality(inbox(event("core", "tick")), NOW, "9").first()["state"] == "NO_DATA"
