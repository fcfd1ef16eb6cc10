"""Canonical payload, scrubbing, admission and null keys against values worked out by hand."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from vitalgauge.functions.text import python_double
from vitalgauge.operators import identity, ingest, performance

FRAME = "struct<abi:string,module_build_id:string,module_name:string,module_relative_pc:bigint,load_bias:bigint>"
MAPS = ", ".join(f"{m} map<string,string>" for m in ingest.MAPS)
SCHEMA = (
    "event_id string, module string, name string, kind string, severity string, priority string,"
    f" process_name string, thread_name string, scene string, foreground boolean, timestamp bigint, {MAPS},"
    " installation_plaintext string, session_plaintext string, occurrence struct<service_version:string,"
    "version_code:string,app_build:string,variant:string,installation_id:string,session_id:string,"
    f"device_model:string,os_version:string,native_frames:array<{FRAME}>>"
)


def event(**changes) -> tuple:
    row = dict(
        event_id="e1", module="m", name="n", kind="METRIC", severity="INFO", priority="LOW", process_name="p",
        thread_name="main", scene=None, foreground=None, timestamp=5,
        fields={"a": "1e16", "b": "0.0001", "c": "x\u0007", "d": "12345678.25", "user": "secret-1"},
        field_types={"a": "DOUBLE", "b": "FLOAT", "d": "DOUBLE"}, global_context={}, extras={}, unknown={},
        installation_plaintext="secret-1", session_plaintext="s-9",
        occurrence=("1.0", "7", "b", "release", "secret-1", "s-9", "phone of secret-1", None,
                    [("arm64", "id1", "lib.so", 5, None), ("arm64", "id2", "secret-1.so", 6, 7)]),
    )
    return tuple({**row, **changes}.values())


def test_scrubbed_payload_hash(spark):
    rows = spark.createDataFrame([event()], SCHEMA)
    clean = identity.scrub_identifiers(rows)
    assert "secret-1" not in json.dumps(clean.drop("installation_plaintext").first().asDict(True))
    expected = {
        "event_id": "e1", "extras": {}, "field_types": {"a": "DOUBLE", "b": "FLOAT", "d": "DOUBLE"},
        "fields": {"a": 1e16, "b": 0.0001, "c": "x\u0007", "d": 12345678.25}, "foreground": None,
        "global_context": {}, "kind": "METRIC", "module": "m", "name": "n", "priority": "LOW", "process_name": "p",
        "occurrence": {
            "app_build": "b", "service_version": "1.0", "variant": "release", "version_code": "7",
            "native_frames": [{"abi": "arm64", "module_build_id": "id1", "module_name": "lib.so",
                               "module_relative_pc": 5, "load_bias": None}],
        },
        "scene": None, "severity": "INFO", "thread_name": "main", "timestamp": 5, "unknown": {},
    }
    text = json.dumps(expected, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    row = ingest.canonical_payload_hash(clean).first()
    assert row["payload_size_bytes"] == len(text.encode())
    assert row["payload_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("occurrence", [None, ("1.0", "7", "b", "r", None, None, "d", "14", [])])
def test_absent_parts_of_the_payload(spark, occurrence):
    rows = spark.createDataFrame([event(occurrence=occurrence, fields={}, field_types={})], SCHEMA)
    text = rows.select(F.expr(ingest.canonical_json(True))).first()[0]
    found = json.loads(text)["occurrence"]
    assert found == (occurrence and {"app_build": "b", "device_model": "d", "native_frames": [], "os_version": "14",
                                     "service_version": "1.0", "variant": "r", "version_code": "7"})


def test_doubles_are_printed_as_python_prints_them(spark):
    values = [0.0, -0.0, 1.0, -1.5, 1e-3, 9.99e-4, 1e-4, -1.25e-4, 9.9e-5, 1e-100, 1e6, 1e7, -1.5e7, 123456789.125,
              1e15, 1.5e15, 9007199254740993.0, 1e16, 1.25e17, 1e100, 1.7976931348623157e308]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", F.expr(python_double("v")).alias("t"))
    assert [(r["v"], r["t"]) for r in rows.collect()] == [(v, repr(v)) for v in values]


def test_batch_without_limits_is_rejected(spark):
    batches = spark.createDataFrame([("k", 60_000, "b1", 1), ("other", 60_000, "b2", 1)],
                                    "key_id string, received_ms bigint, batch_id string, event_count bigint")
    limits = spark.createDataFrame([("k", 5, 50)], "key_id string, requests_per_minute int, events_per_minute int")
    found = {r["batch_id"]: r["admitted"] for r in ingest.admit_quota(batches, limits).collect()}
    assert found == {"b1": True, "b2": False}


def test_null_release_keeps_its_weighted_fps(spark):
    pairs = spark.createDataFrame([("r", 60.0, 1.0, "AVAILABLE"), (None, 30.0, 2.0, "AVAILABLE")],
                                  "release string, fps double, span double, state string")
    found = {r["release"]: r["value"] for r in performance.weighted_fps(pairs, "release").collect()}
    assert found == {"r": 60.0, None: 30.0}


def test_stored_copy_hides_a_hot_id_and_conflicts_name_their_batch(spark):
    signature = ", ".join(f"'{c}' AS {c}" for c in ingest.SIGNATURE if c != "payload_sha256")
    new = spark.range(60).selectExpr(
        "'t' AS tenant_id", "if(id % 2 = 0, 'hot', concat('e', id)) AS event_id", "concat('b', id % 5) AS batch_id",
        "cast(id AS int) AS event_index", "if(id = 8, 'x', 'same') AS payload_sha256", signature.split(", ")[0],
        *signature.split(", ")[1:], "'a' AS app_id", "'e' AS environment",
    )
    stored = new.filter("event_index = 0")
    fresh = ingest.dedup_events(new, stored)
    assert fresh.count() == 30 and fresh.filter("event_id = 'hot'").count() == 0
    found = {tuple(r) for r in ingest.detect_event_conflicts(new, stored).collect()}
    assert found == {("t", "b3", "hot", "BATCH"), ("t", "b3", "hot", "STORED")}
