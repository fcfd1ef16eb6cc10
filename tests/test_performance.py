"""Normalization, fingerprints, percentiles and performance statistics."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pytest
from builders import event
from pyspark.sql import functions as F

from vitalgauge import catalog
from vitalgauge.operators import fingerprints as FP
from vitalgauge.operators import performance as P
from vitalgauge.operators.normalize import normalize_fields, resolve_occurrence_time
from vitalgauge.operators.percentiles import percentile_aggregates, spread_percentiles

BOTH = ("2.0.0", "1.0.0")
COLD = "launch.cold_start.launchDurationMs"


def launch(value, **kw):
    fields = {} if value is None else {"launchDurationMs": value}
    return event("launch", "cold_start", fields=fields, **kw)


def test_registry_sizes():
    fields = catalog.performance_fields()
    assert (len(fields), len({f.id for f in fields})) == (246, 246)
    assert (len(catalog.known_events()), len(catalog.category_fields())) == (66, 29)


def test_every_registered_metric_is_observed(inbox):
    """One valid value per registered field gives exactly one sample per metric."""
    rows = {}
    for f in catalog.performance_fields():
        fields = rows.setdefault((f.module, f.name), {})
        fields[f.field] = "1"
        if f.availability_field:
            fields[f.availability_field] = "true"
    df = inbox(*[event(m, n, fields=fields) for (m, n), fields in rows.items()])
    got = P.metric_summaries(df, BOTH).filter("app_version = '2.0.0'").collect()
    assert len(got) == 246
    assert {(r["state"], r["sample_count"]) for r in got} == {("PRESENT", 1)}


def test_percentiles_and_delta(inbox):
    df = inbox(
        *[launch(v) for v in ("100", "200", "300", "400")], launch("100", app_version="1.0.0")
    )
    summaries = P.metric_summaries(df, BOTH)
    row = summaries.filter(f"metric_id = '{COLD}' AND app_version = '2.0.0'").first()
    assert (row["p50"], round(row["p95"], 9), row["mean"]) == (250.0, 385.0, 250.0)
    delta = P.compare_metrics(summaries, *BOTH).filter(f"metric_id = '{COLD}'").first()
    assert round(delta["p95_delta"], 9) == 285.0


def test_states_are_not_zero(inbox):
    df = inbox(*[launch(v) for v in ("100", "0", None, "-1")])
    row = P.metric_summaries(df, BOTH).filter(f"metric_id = '{COLD}'").orderBy(
        F.desc("app_version")
    ).first()
    assert row["state"] == "DEGRADED"
    assert (row["missing_count"], row["invalid_count"], row["minimum"]) == (1, 1, 0.0)
    zero = P.metric_summaries(inbox(launch("0")), BOTH).filter(
        f"metric_id = '{COLD}' AND app_version = '2.0.0'"
    ).first()
    assert zero["state"] == "ZERO"


def test_gates_make_values_unavailable(inbox):
    df = inbox(
        event("gc_monitor", "memory_churn", fields={"gcTimeRatio": "0.5"}),
        event(
            "core", "sdk_health",
            fields={"dispatcherStage.resolve.count": "0", "dispatcherStage.resolve.avgMicros": "0"},
        ),
    )
    states = {
        r["metric_id"]: r["state"] for r in P.observe_value(df, "id").collect()
    }
    assert states["gc_monitor.memory_churn.gcTimeRatio"] == "UNAVAILABLE"
    assert states["core.sdk_health.dispatcherStage.resolve.avgMicros"] == "UNAVAILABLE"


def fps(value, span):
    sent = {"fps": value, "windowDurationMs": span}
    return event("fps", "fps_stats", fields={k: v for k, v in sent.items() if v is not None})


def test_weighted_fps(inbox):
    df = inbox(fps("30", "1000"), fps("60", "3000"), fps("0", "0"), fps("90", None),
               fps("bad", "5000"))
    row = P.weighted_fps(P.fps_pairs(df, "app_version"), "app_version").first()
    assert row["value"] == pytest.approx(52.5) and row["total_window_ms"] == 4000.0
    assert (row["sample_count"], row["event_count"], row["coverage"]) == (2, 5, 0.4)
    assert (row["missing_count"], row["invalid_count"]) == (1, 2)


def test_weighted_fps_does_not_overflow(inbox):
    df = inbox(fps("30", "1e308"), fps("60", "1e308"))
    row = P.weighted_fps(P.fps_pairs(df, "app_version"), "app_version").first()
    assert row["value"] == pytest.approx(45.0) and row["total_window_ms"] is None


@pytest.mark.parametrize(
    "field, value, state",
    [
        ("dropRate", "NaN", "INVALID"), ("dropRate", "Infinity", "INVALID"),
        ("dropRate", "1e9999", "INVALID"), ("dropRate", "1.01", "INVALID"),
        ("dropRate", "-0.1", "INVALID"), ("dropRate", "1d", "INVALID"),
        ("dropRate", "0x1p3", "INVALID"), ("dropRate", " 0.5 ", "AVAILABLE"),
        ("dropRate", "1_0e-2", "AVAILABLE"), ("emitCount", "9223372036854775808", "INVALID"),
        ("emitCount", "-1", "INVALID"), ("emitCount", "007", "INVALID"),
        ("emitCount", "9223372036854775807", "AVAILABLE"), ("emitCount", "1.0", "INVALID"),
    ],
)
def test_number_text(inbox, field, value, state):
    row = inbox(event("core", "sdk_health", fields={field: value})).first()
    assert row["field_states"][field] == state
    assert (field in row["ints"] or field in row["nums"]) == (state == "AVAILABLE")


@pytest.mark.parametrize(
    "kind, value, state",
    [("DOUBLE", "3.0", "AVAILABLE"), ("DOUBLE", "3.5", "INVALID"), ("BOOLEAN", "true", "INVALID"),
     ("LONG", "3", "AVAILABLE"), ("NULL", None, "INVALID"), ("DOUBLE", "NaN", "INVALID")],
)
def test_typed_integers(inbox, kind, value, state):
    row = inbox(
        event("core", "sdk_health", fields={"emitCount": value}, field_types={"emitCount": kind})
    ).first()
    assert row["field_states"]["emitCount"] == state


def test_http_sentinels_and_unknown_category(inbox):
    row = inbox(event("network", "network_request", fields={"statusCode": "-1", "x": "y"})).first()
    assert (row["ints"]["statusCode"], row["unknown_field_count"]) == (-1, 1)
    row = inbox(event("fps", "fps_stats", fields={"dropSeverity": "4"})).first()
    assert row["field_states"]["dropSeverity"] == "UNKNOWN" and row["ints"] == {}


def test_exit_time(inbox):
    rows = inbox(
        event("crash", "app_exit", fields={"exitTimestamp": "123"}),
        event("crash", "app_exit", fields={"exitTimestamp": "0"}),
    )
    got = resolve_occurrence_time(rows, "occurrence_timestamp_ms").orderBy("id").collect()
    assert [r["timestamp_source"] for r in got] == ["fields.exitTimestamp", "event.timestamp"]


def test_stack_fingerprint_is_the_hash_of_scrubbed_lines(inbox):
    stack = "java.lang.Error: \"q\" é  at A.m(A.java:12)\x0b\r\n\n\tat 0x7f00abcdef 　"
    lines = ['java.lang.Error: "q" é', "at A.m(A.java:<line>)", "at <addr>"]
    wanted = hashlib.sha256(
        json.dumps(lines, ensure_ascii=False, separators=(",", ":")).encode()
    ).hexdigest()
    df = inbox(event("crash", "java_crash", fields={"stackTrace": stack}), normalized=False)
    assert FP.fingerprint_java_anr(df).first()["stack_fingerprint"] == wanted


def test_control_characters_hash_like_lower_case_json(inbox):
    stack = "a\x0e\\u001F\x7fb"
    wanted = hashlib.sha256(
        json.dumps([stack], ensure_ascii=False, separators=(",", ":")).encode()
    ).hexdigest()
    df = inbox(event("anr", "anr_detected", fields={"mainThreadStack": stack}), normalized=False)
    assert FP.fingerprint_java_anr(df).first()["stack_fingerprint"] == wanted


def test_native_fingerprint(inbox):
    def prints(*rows):
        df = inbox(*rows, normalized=False)
        return [r["native_fingerprint"]
                for r in FP.fingerprint_native(df).orderBy("id").collect()]

    def native(name, pc):
        text = f"#00 pc {pc} /lib/libc.so (abort)"
        return event("crash", name, fields={"backtrace": text, "signal": "6"})

    a, padded, other, tomb, text = prints(
        native("native_crash", "0abc"), native("native_crash", "000ABC"),
        native("native_crash", "abd"), native("tombstone_crash", "abc"),
        event("crash", "native_crash", fields={"backtrace": "no frames"}),
    )
    wanted = json.dumps(
        {"family": "NATIVE_CRASH", "signal": "6", "frames": [["abc", "libc.so", "(abort)"]]},
        sort_keys=True, separators=(",", ":"),
    )
    assert a == padded == hashlib.sha256(wanted.encode()).hexdigest()
    assert len({a, other, tomb}) == 3 and text is None


def test_spread_percentiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    hot = [("hot", float(v)) for v in rng.normal(size=30_000)]
    copies = [("copies", 5.0)] * 5_000 + [("copies", 9.0)] * 3
    small = [("small", 1.0), ("small", 2.0), (None, 4.0), (None, 8.0)]
    df = spark.createDataFrame(hot + copies + small, "k string, v double")
    wanted = {"p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0}
    for got in (
        spread_percentiles(df, ["k"], "v", wanted),
        percentile_aggregates(df, ["k"], "v", wanted),
    ):
        rows = {r["k"]: r for r in got.collect()}
        for key in ("hot", "copies", "small", None):
            values = [v for k, v in hot + copies + small if k == key]
            for name, p in wanted.items():
                assert rows[key][name] == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_percentiles_of_weighted_odd_values(spark):
    values = [0.0, -0.0, -3.5, -1e-320, 1e-320, 1e300, -1e300, 2.0, 2.0000001, 7.0, float("inf")]
    rows = [("a", v, i + 1, i % 2) for i, v in enumerate(values)] + [("a", None, 4, 1), ("empty", None, 2, 0)]
    df = spark.createDataFrame(rows, "k string, v double, times bigint, odd int")
    got = percentile_aggregates(
        df, ["k"], "v", {"p30": 0.3, "p50": 0.5, "p75": 0.75}, {"n": "true", "odd_rows": "odd = 1"}, moments=True, weight="times"
    )
    by_key = {r["k"]: r for r in got.collect()}
    full = [v for v, n in zip(values, range(1, 12)) for _ in range(n)]
    for name, p in (("p30", 0.3), ("p50", 0.5), ("p75", 0.75)):
        assert by_key["a"][name] == pytest.approx(np.quantile(full, p), rel=1e-12)
    assert (by_key["a"]["n"], by_key["a"]["odd_rows"]) == (70, 34)
    assert by_key["a"]["minimum"] == -1e300 and by_key["a"]["maximum"] == float("inf")
    assert by_key["empty"]["p50"] is None and by_key["empty"]["n"] == 2 and by_key["empty"]["mean"] is None


def test_weighted_sums_of_any_magnitude(spark):
    rows = (
        [("big", 1.5e308, 1.7e308), ("big", 1.7e308, 1.2e308), ("small", 5e-324, 5e-324), ("small", 1e-323, 5e-324)]
        + [("mixed", 60.0, 1e300), ("mixed", 1e-300, 1e-300), ("zero", 0.0, 3.0), (None, 30.0, 2.0), (None, 60.0, 1.0)]
    )
    pairs = spark.createDataFrame(rows, "k string, fps double, span double").selectExpr("*", "'AVAILABLE' AS state")
    pairs = pairs.unionByName(spark.createDataFrame([("none", None, None, "MISSING")], "k string, fps double, span double, state string"))
    got = {r["k"]: r for r in P.weighted_fps(pairs, "k").collect()}
    assert got["big"]["value"] == pytest.approx(1.5e308 + (1.7e308 - 1.5e308) * (1.2 / 2.9), rel=1e-12)
    assert got["big"]["total_window_ms"] is None
    assert got["small"]["value"] in (5e-324, 1e-323) and got["mixed"]["value"] == pytest.approx(60.0)
    assert (got["zero"]["value"], got["zero"]["state"]) == (0.0, "ZERO")
    assert got[None]["value"] == pytest.approx(40.0) and got[None]["total_window_ms"] == pytest.approx(3.0)
    assert (got["none"]["value"], got["none"]["state"], got["none"]["missing_count"]) == (None, "UNAVAILABLE", 1)
    plan = P.weighted_fps(pairs, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_percentiles_read_their_input_once(spark, tmp_path):
    spark.range(100).selectExpr("id % 3 AS k", "if(id % 7 = 0, NULL, cast(id AS double)) AS v").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for counts, moments in ({}, False), ({"n": "true"}, True):
        out = percentile_aggregates(df, ["k"], "v", {"p95": 0.95}, counts, moments)
        assert out.count() == 3
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("FileScan parquet") == 1 and "ReusedExchange" in plan


def test_normalize_ignores_unknown_events(inbox):
    row = inbox(event("custom", "thing", fields={"a": "1"})).first()
    assert row["field_states"] == {} and row["unknown_field_count"] == 1


def test_normalization_needs_no_shuffle(inbox):
    df = normalize_fields(inbox(event("core", "tick"), normalized=False), "occurrence_timestamp_ms")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
