"""Traces, alerts, retention, quota, ingest and symbols."""

from __future__ import annotations

import base64
import hashlib
import hmac
import random

import pytest
from builders import NOW, event
from pyspark.sql import functions as F

from vitalgauge.operators import alerts as A
from vitalgauge.operators import identity as ID
from vitalgauge.operators import ingest as IN
from vitalgauge.operators import retention as RT
from vitalgauge.operators import traces as TR
from vitalgauge.plans import ingest_queries as IQ
from vitalgauge.sources import line_batches as LB
from vitalgauge.sources import protobuf_batches as PB

TRACE = "a" * 32


def span(number, parent=None, trace=TRACE, **fields):
    sent = {
        "traceId": trace, "spanId": f"{number:016x}", "duration_ms": "10", "status": "OK",
        "spanSchemaVersion": "2", "startTimestampMs": "1000", "endTimestampMs": "1010", **fields,
    }
    if parent is not None:
        sent["parentSpanId"] = parent if isinstance(parent, str) else f"{parent:016x}"
    return event("trace", "op", fields={k: v for k, v in sent.items() if v is not None})


def relations(inbox, *rows):
    spans = TR.parse_spans(inbox(*rows, normalized=False))
    got = TR.classify_span_relations(spans).collect()
    return {r["event_id"]: r["relation_state"] for r in got}


def test_span_relations(inbox):
    got = relations(
        inbox,
        span(1), span(2, 1), span(3, 99), span(4, 5), span(5, 4), span(6, 4),
        span(7, 1), span(7, 1), span(8, 7), span(9, "nothex"),
        span(4, trace="B" * 32),
    )
    assert list(got[f"e{i}"] for i in range(11)) == [
        "ROOT", "CHILD", "ORPHAN", "CYCLE", "CYCLE", "CYCLE", "DUPLICATE_ID", "DUPLICATE_ID",
        "AMBIGUOUS_PARENT", "INVALID_PARENT", "ROOT",
    ]


def test_long_chain_and_self_parent(inbox):
    chain = [span(1)] + [span(i, i - 1) for i in range(2, 80)] + [span(100, 100)]
    got = relations(inbox, *chain)
    assert got.pop("e79") == "CYCLE"
    assert set(got.values()) == {"ROOT", "CHILD"}


@pytest.mark.parametrize(
    "fields, state",
    [
        ({}, "AVAILABLE"),
        ({"spanSchemaVersion": "1"}, "TIMING_UNAVAILABLE"),
        ({"startTimestampMs": None}, "INVALID_TIMING"),
        ({"duration_ms": "-1"}, "INVALID_TIMING"),
        ({"endTimestampMs": "900"}, "CLOCK_SKEW"),
        ({"endTimestampMs": "11010"}, "CLOCK_SKEW"),
        ({"endTimestampMs": "1015"}, "AVAILABLE"),
    ],
)
def test_span_timing(inbox, fields, state):
    row = TR.parse_spans(inbox(span(1, **fields), normalized=False)).first()
    assert row["timing_state"] == state


def test_invalid_trace_ids_are_not_spans(inbox):
    df = inbox(span(0), span(1, trace="0" * 32), span(1, trace="xyz"), normalized=False)
    assert TR.parse_spans(df).count() == 0
    counts = TR.span_row_counts(df).first()
    assert (counts["sample_count"], counts["invalid_span_count"]) == (0, 3)


def test_waterfall_depth_stops_at_eight(inbox):
    spans = TR.parse_spans(
        inbox(*[span(i, i - 1 if i > 1 else None) for i in range(1, 13)], normalized=False)
    )
    depth = {r["span_id"]: r["depth"] for r in TR.trace_waterfall(spans).collect()}
    assert [depth[f"{i:016x}"] for i in (1, 2, 5, 12)] == [0, 1, 4, 8]


RULE = ("bigint", "string", "string", "string", "string", "string", "double", "bigint", "bigint",
        "string", "string", "bigint", "boolean")
RULE_COLUMNS = ("rule_id tenant_id app_id environment metric comparison threshold min_samples"
                " window_seconds release_version channel silence_until_ms enabled").split()


def rules(spark, *rows):
    schema = ", ".join(f"{c} {t}" for c, t in zip(RULE_COLUMNS, RULE))
    return spark.createDataFrame(
        [(i, "t", "a", "e", metric, "gt", threshold, 1, 300, None, "ops", None, True)
         for i, (metric, threshold) in enumerate(rows)], schema)


def test_alert_sequence(spark, inbox):
    """Exit only, two crash evaluations, silence, recovery: one episode, closed once."""
    minute = 60_000
    df = inbox(
        event("crash", "app_exit", occurrence_timestamp_ms=NOW),
        event("crash", "java_crash", occurrence_timestamp_ms=NOW + minute),
        event("launch", "cold_start", occurrence_timestamp_ms=NOW + 20 * minute),
    )
    rule = rules(spark, ("crash.count", 0.0))
    ticks = None
    for at in (NOW + 1, NOW + 2 * minute, NOW + 3 * minute, NOW + 10 * minute, NOW + 21 * minute):
        tick = A.alert_rule_state(A.evaluate_count_rules(df, rule, at)).selectExpr(
            "rule_id", f"{at}L AS evaluated_ms", "value", "sample_count", "state")
        ticks = tick if ticks is None else ticks.unionByName(tick)
    states = [r["state"] for r in ticks.orderBy("evaluated_ms").collect()]
    assert states == ["OK", "FIRING", "FIRING", "INSUFFICIENT_DATA", "OK"]
    episode = A.alert_episodes(ticks).collect()
    assert [(e["triggered_ms"], e["resolved_ms"]) for e in episode] == [
        (NOW + 2 * minute, NOW + 21 * minute)
    ]
    outbox = A.alert_outbox(A.alert_transitions(ticks), rule).collect()
    assert sorted(d["transition"] for d in outbox) == ["FIRING", "RESOLVED"]


def test_busy_rule_and_partial_p95(spark, inbox):
    df = inbox(
        *[event("crash", "java_crash")] * 2,
        *[event("launch", "cold_start", fields={"launchDurationMs": "5"})] * 3,
        event("launch", "warm_start", fields={"launchDurationMs": "-1"}),
    )
    rule = rules(
        spark, ("crash.count", 1.0), ("launch.cold_start.launchDurationMs.p95", 4.0),
        ("launch.warm_start.launchDurationMs.p95", 0.0),
    )
    count = A.alert_rule_state(A.evaluate_count_rules(df, rule, NOW + 1)).first()
    assert (count["state"], count["value"], count["sample_count"]) == ("FIRING", 2.0, 6)
    p95 = {r["rule_id"]: r for r in A.evaluate_p95_rules(df, rule, NOW + 1).collect()}
    assert (p95[1]["value"], p95[2]["value"]) == (5.0, None)


def test_alert_history_retention(spark):
    day = 86_400_000
    episodes = spark.createDataFrame(
        [(1, NOW - 100 * day), (2, NOW - 5 * day), (3, None)],
        "episode_id bigint, resolved_ms bigint")
    deliveries = spark.createDataFrame(
        [(10, 1), (20, 2), (30, 3)], "delivery_id bigint, episode_id bigint")
    kept, sent = RT.prune_alert_history(episodes, deliveries, NOW)
    assert {r["episode_id"] for r in kept.collect()} == {2, 3}
    assert {r["delivery_id"] for r in sent.collect()} == {20, 30}


def quota(spark, batches, requests=2, events=3, used=None):
    df = spark.createDataFrame(
        batches, "key_id string, received_ms bigint, batch_id string, event_count bigint")
    limits = df.select("key_id").distinct().selectExpr(
        "key_id", f"{requests}L AS requests_per_minute", f"{events}L AS events_per_minute")
    rows = IN.admit_quota(df, limits, used).collect()
    return {r["batch_id"]: (r["admitted"], r["retry_after"]) for r in rows}


def test_rejected_batches_consume_nothing(spark):
    at = 1_704_700_020_000 // 60_000 * 60_000 + 30_000
    got = quota(spark, [("k", at, "a", 1), ("k", at + 1, "b", 3), ("k", at + 2, "c", 2),
                        ("k", at + 3, "d", 1), ("k", at + 60_000, "e", 1), ("k", at, "f", 9)])
    assert got["a"] == (True, None) and got["c"] == (True, None)
    assert got["b"] == (False, 30) and got["d"] == (False, 30) and got["f"] == (False, 60)
    assert got["e"] == (True, None)


def test_quota_matches_a_plain_fold(spark):
    rng = random.Random(3)
    batches = [(rng.choice("xy"), NOW // 60_000 * 60_000 + rng.randrange(180_000), f"b{i:04d}",
                rng.randrange(1, 40)) for i in range(600)]
    state, want = {}, {}
    for key, at, name, n in sorted(batches, key=lambda b: (b[0], b[1], b[2])):
        used = state.setdefault((key, at // 60_000), [0, 0])
        ok = n <= 100 and used[0] + 1 <= 9 and used[1] + n <= 100
        if ok:
            used[0] += 1
            used[1] += n
        want[name] = ok
    got = quota(spark, batches, requests=9, events=100)
    assert {k: v[0] for k, v in got.items()} == want


def test_native_hmac_equals_python(spark):
    secret = bytes(range(40))
    keys = ID.key_ring(spark, {"v1": base64.b64encode(secret).decode()})
    rows = spark.createDataFrame([("t", "plain", None)],
                                 "tenant_id string, installation_plaintext string,"
                                 " session_plaintext string")
    got = ID.pseudonymize_ids(rows, keys, "v1").first()
    message = b"\0".join((ID.INSTALLATION_DOMAIN.encode(), b"t", b"plain"))
    assert got["installation_hmac"] == hmac.new(secret, message, hashlib.sha256).hexdigest()
    assert got["session_hmac"] is None


def line(**over):
    base = {"ts": "5", "eventId": "e", "module": "m", "name": "n", "kind": "METRIC",
            "severity": "INFO", "priority": "LOW", "process": "p", "thread": "t", **over}
    return "|".join(f"{k}={v}" for k, v in base.items())


def decode(spark, body: bytes, **kw):
    df = spark.createDataFrame([("b", body)], "batch_id string, body binary")
    return LB.decode_line_batches(df, **kw).orderBy("event_index").collect()


@pytest.mark.parametrize("mark", ["\r", "\x0b", "\x0c", "\x1c", "\x85", " "])
def test_only_newline_separates_events(spark, mark):
    rows = decode(spark, (line(fields=f"a=x{mark}y") + "\r\n").encode())
    assert [(r["decode_error"], r["fields"]) for r in rows] == [(None, {"a": f"x{mark}y"})]


@pytest.mark.parametrize(
    "body, error",
    [
        (b"", "EMPTY_BATCH"), (b"\xff", "INVALID_ENCODING"),
        ((line() + "\n\n" + line()).encode(), "BLANK_LINE"),
        (line(extra="1").replace("extra", "ts").encode(), "INVALID_SEGMENTS"),
        (b"ts=1|eventId=e", "MISSING_FIELDS"),
        (line(foreground="1").encode(), "INVALID_FOREGROUND"),
        (line(fields="a=1,a=2").encode(), "INVALID_MAP"),
        (line(ts="x").encode(), "INVALID_TIMESTAMP_TEXT"),
        ("\n".join([line()] * 3).encode(), "TOO_MANY_EVENTS"),
    ],
)
def test_line_errors(spark, body, error):
    rows = decode(spark, body, max_events=2 if error == "TOO_MANY_EVENTS" else 10)
    assert error in {r["decode_error"] for r in rows}


def test_length_prefixed_frames(spark):
    message = PB.message_classes()["Event"](timestamp=7, event_id="e", module="m")
    message.fields["k"] = "v"
    frame = message.SerializeToString()
    good = len(frame).to_bytes(4, "big") + frame
    df = spark.createDataFrame(
        [("good", good * 2), ("cut", good + b"\0\0"), ("zero", b"\0\0\0\0")],
        "source string, body binary")
    rows = PB.decode_protobuf_batches(df, enveloped=False).collect()
    got = sorted((r["source"], r["event_index"], r["decode_error"]) for r in rows)
    assert got == [("cut", 0, None), ("cut", 1, "INVALID_FRAME"), ("good", 0, None),
                   ("good", 1, None), ("zero", 0, "INVALID_FRAME")]


def python_inputs(df):
    """What the Python steps of a plan read, outermost first."""
    found, nodes = [], [df._jdf.queryExecution().analyzed()]
    while nodes:
        node = nodes.pop()
        below = node.children()
        nodes += [below.apply(i) for i in range(below.size())]
        if node.nodeName().startswith("MapIn"):
            rows = df.sparkSession._jvm.org.apache.spark.sql.classic.Dataset.ofRows(
                df.sparkSession._jsparkSession, node.child())
            found.append(type(df)(rows, df.sparkSession))
    return found


def test_python_reads_small_rows_of_large_protobuf_batches(spark):
    """An Arrow batch has 10,000 rows: neither a body nor the events of a batch may stand in one."""
    events = spark.range(20_000).selectExpr(
        "if(id < 19000, 'long', 'short-' || id) AS source", "if(id < 19000, 'b1', 'b' || id) AS batch_id",
        "named_struct('id', id, 'event_id', 'e' || id, 'timestamp', id, 'module', 'm', 'name', 'n',"
        " 'kind', 'METRIC', 'severity', 'INFO', 'priority', 'NORMAL', 'process_name', 'p',"
        " 'thread_name', 't', 'app_version', '1', 'k', '7') AS e")
    batches = events.groupBy("source", "batch_id").agg(F.array_sort(F.collect_list("e")).alias("events"))
    batches = batches.unionByName(batches.limit(1).selectExpr(
        "'empty' AS source", "'b0' AS batch_id", "slice(events, 1, 0) AS events"))
    decoded = PB.decode_protobuf_batches(IQ.encode_envelopes(batches), enveloped=True)
    inputs = python_inputs(decoded)
    assert len(inputs) == 2
    for rows in inputs:
        size = rows.selectExpr(f"max(length(to_json(struct({', '.join(rows.columns)}))))").first()[0]
        assert size < 2_000
    got = decoded.selectExpr(
        "source", "batch_id", "event_index", "event_id", "timestamp", "typed_fields['k'].value AS k",
        "occurrence.service_version AS app_version", "decode_error").collect()
    want = [("empty", "b0", 0, None, None, None, None, "EMPTY_BATCH")]
    want += [("long", "b1", i, f"e{i}", i, "7", "1", None) for i in range(19_000)]
    want += [(f"short-{i}", f"b{i}", 0, f"e{i}", i, "7", "1", None) for i in range(19_000, 20_000)]
    assert sorted(map(tuple, got)) == want


def test_protobuf_values_and_broken_bodies(spark):
    classes = PB.message_classes()

    def sent(size):
        e = classes["Event"](timestamp=-7, event_id="e", module="\u00fc" * size, foreground=True)
        e.fields["a"], e.fields["b"], e.extras["x"] = "1", "", "\u20ac"
        e.typed_fields["t"].type = "INT"
        e.occurrence.installation_id, e.occurrence.session_id = "i", ""
        e.occurrence.native_frames.add(abi="arm", module_relative_pc=2**64 - 1)
        e.occurrence.native_frames.add(abi="x86", load_bias=0)
        return e

    plain = classes["Event"](event_id="p", scene="s")
    envelope = classes["Envelope"](schema_version=3, batch_id="b", events=[sent(1), plain, sent(300_000)])
    bodies = [("all", envelope.SerializeToString()), ("exact", plain.SerializeToString() + b"\0"), ("none", b""), ("null", None)]
    df = spark.createDataFrame(bodies, "source string, body binary").coalesce(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        rows = {(r["source"], r["event_index"]): r for r in PB.decode_protobuf_batches(df, enveloped=True).collect()}
        frames = PB.decode_protobuf_batches(
            spark.createDataFrame([("empty", b""), ("null", None)], df.schema), enveloped=False).collect()
    finally:
        spark.conf.set(key, before)
    assert {k: r["decode_error"] for k, r in rows.items()} == {
        ("all", 0): None, ("all", 1): None, ("all", 2): None, ("exact", 0): "INVALID_ENVELOPE",
        ("none", 0): "EMPTY_BATCH", ("null", 0): "INVALID_ENVELOPE"}
    for index, size in ((0, 1), (2, 300_000)):
        r = rows["all", index].asDict(recursive=True)
        assert (r["timestamp"], r["module"], r["foreground"], r["scene"]) == (-7, "\u00fc" * size, True, None)
        assert (r["schema_version"], r["batch_id"], r["sent_at_ms"], r["service_name"]) == ("3", "b", 0, "")
        assert (r["fields"], r["extras"], r["global_context"]) == ({"a": "1", "b": ""}, {"x": "\u20ac"}, {})
        assert r["typed_fields"] == {"t": {"type": "INT", "value": ""}}
        o = r["occurrence"]
        assert (o["installation_id"], o["session_id"], o["device_model"], o["variant"]) == ("i", "", None, "")
        assert [(f["abi"], f["module_relative_pc"], f["load_bias"]) for f in o["native_frames"]] == [
            ("arm", 2**64 - 1, None), ("x86", 0, 0)]
    assert (rows["all", 1]["scene"], rows["all", 1]["occurrence"], rows["all", 1]["fields"]) == ("s", None, {})
    assert (rows["none", 0]["schema_version"], rows["null", 0]["schema_version"]) == ("0", None)
    assert rows["none", 0]["fields"] is None and rows["exact", 0]["event_id"] is None
    assert [r["decode_error"] for r in frames] == ["EMPTY_BATCH"] * 2


def test_expired_fields_after_pruning(inbox):
    df = inbox(event("crash", "java_crash", scene="Home",
                     fields={"stackTrace": "x", "threadName": "main"}),
               event("core", "sdk_health", fields={"emitCount": "5"}))
    rows = {r["id"]: r for r in RT.prune_raw_evidence(df, NOW).collect()}
    assert rows[0]["field_states"]["threadName"] == "EXPIRED"
    assert rows[0]["field_states"]["exceptionClass"] == "MISSING"
    assert (rows[0]["retained_scene_state"], rows[0]["scene"]) == ("EXPIRED", None)
    assert rows[1]["ints"] == {"emitCount": 5}
    assert rows[1]["field_states"]["emitCount"] == "AVAILABLE"


def test_rules_meet_counted_events_only(spark, inbox):
    rows = [event("crash", "java_crash", occurrence_timestamp_ms=NOW - i * 1000, app_version="1.0" if i % 3 else "2.0",
                  release_identity_quality="OCCURRENCE_BOUND" if i % 4 else "ABSENT") for i in range(1, 61)]
    events = inbox(*rows).persist()
    lengths = (1, 10, 30, 60, 3600)
    rules = spark.createDataFrame(
        [(i * 10 + j, "t", "a", "e", "crash.count", w, release) for i, w in enumerate(lengths) for j, release in enumerate((None, "2.0", "9.9"))],
        "rule_id bigint, tenant_id string, app_id string, environment string, metric string, window_seconds bigint,"
        " release_version string",
    )
    got = {r.rule_id: (r.value, r.sample_count) for r in A.evaluate_count_rules(events, rules, NOW).collect()}
    for i, w in enumerate(lengths):
        inside = [k for k in range(1, 61) if k <= w]
        bound = [k for k in inside if k % 3 == 0 and k % 4]
        assert got[i * 10] == (float(len(inside)), len(inside))
        assert got[i * 10 + 1] == ((float(len(bound)), len(bound)) if bound else (None, 0))
        assert got[i * 10 + 2] == (None, 0)
    out = A.evaluate_count_rules(events, rules, NOW)
    out.collect()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("InMemoryRelation")]
    # the join with the rules stands above an aggregate of the events
    assert above.count("Join ") == 2 and "Aggregate" in above[above.rindex("Join ") :]
