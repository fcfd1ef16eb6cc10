"""Streaming jobs over a commit log: late rows count, and what a micro-batch reads doesn't grow with its number."""

from __future__ import annotations

from builders import NOW, event

from vitalgauge.operators.ingest import admit_quota
from vitalgauge.streaming import jobs as J

DAY = 86_400_000


def drained(spark, tmp_path, slices, launch):
    """Write one slice after another and drain the stream each time."""
    for part in slices:
        part.write.mode("append").parquet(str(tmp_path / "source"))
        launch(spark.readStream.schema(part.schema).parquet(str(tmp_path / "source"))).awaitTermination()


def test_rows_that_come_very_late_count(spark, inbox, tmp_path):
    crash = [event("crash", "java_crash", occurrence_timestamp_ms=NOW - d * DAY) for d in (0, 0, 20, 5, 20, 40)]
    slices = [inbox(*crash[:2], normalized=False), inbox(*crash[2:4], normalized=False), inbox(*crash[4:], normalized=False)]
    log = J.release_count_log(str(tmp_path / "counts"))
    drained(spark, tmp_path / "a", slices, lambda s: J.stream_release_counts(s, log, str(tmp_path / "c1"), True, compact_every=2))
    counts = {r.window_start_ms // DAY: r.event_count for r in J.summed(log.read(spark, "counts")).collect()}
    assert counts == {NOW // DAY: 2, NOW // DAY - 20: 2, NOW // DAY - 5: 1, NOW // DAY - 40: 1}
    alerts = J.rolling_alert_log(str(tmp_path / "alerts"))
    drained(spark, tmp_path / "b", slices, lambda s: J.stream_rolling_alerts(s, alerts, str(tmp_path / "c2"), True))
    late = J.rolling_alerts(alerts.read(spark, "counts"), threshold=1).collect()
    assert len(late) == 10 and {r.incident_count for r in late} == {2}


def test_quota_reads_the_touched_hours_only(spark, tmp_path):
    log = J.quota_log(str(tmp_path / "set"))
    limits = spark.createDataFrame([("k", 2, 100)], "key_id string, requests_per_minute bigint, events_per_minute bigint")
    slices = [
        spark.createDataFrame(
            [("k", h * 3_600_000 + i, f"b{h}-{n}-{i}", 1) for i in range(2)],
            "key_id string, received_ms bigint, batch_id string, event_count bigint",
        )
        for n, h in enumerate((0, 1, 2, 1, 0))
    ]
    drained(spark, tmp_path, slices, lambda s: J.stream_quota(s, limits, log, str(tmp_path / "c"), True, compact_every=2))
    got = {(r.batch_id, r.admitted) for r in log.read(spark, "admissions").collect()}
    whole = slices[0]
    for part in slices[1:]:
        whole = whole.unionByName(part)
    assert sum(admitted for _, admitted in got) == 6  # two a minute in three hours; the later ones find them used
    assert {b for b, admitted in got if admitted} == {"b0-0-0", "b0-0-1", "b1-1-0", "b1-1-1", "b2-2-0", "b2-2-1"}
    assert admit_quota(whole, limits).filter("admitted").count() == 6
    plan = log.read(spark, "used").filter("hour IN (1)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(hour" in plan


def test_an_epoch_of_episodes_reads_one_row_a_rule(spark, tmp_path):
    log = J.episode_log(str(tmp_path / "set"))
    schema = "rule_id bigint, evaluated_ms bigint, value double, sample_count bigint, state string"
    states = ["FIRING", "INSUFFICIENT_DATA", "OK", "OK", "FIRING", "FIRING", "OK"]
    slices = [spark.createDataFrame([(rule, t * 1000, 1.0, 1, s) for rule in (1, 2)], schema) for t, s in enumerate(states)]
    drained(spark, tmp_path, slices, lambda s: J.stream_alert_episodes(s, log, str(tmp_path / "c"), True, compact_every=3))
    got = sorted((r.rule_id, r.evaluated_ms, r.transition) for r in log.read(spark, "transitions").collect())
    want = [(0, "FIRING"), (2000, "RESOLVED"), (4000, "FIRING"), (6000, "RESOLVED")]
    assert got == [(rule, t, k) for rule in (1, 2) for t, k in want]
    assert log.read(spark, "last").count() == 2
