"""The ingest chain: conflicts in order of arrival against a plain replay, rotation, replays of epochs, pruning, privacy."""

from __future__ import annotations

import base64
import random
import re

import pytest

from vitalgauge.operators import admission as A
from vitalgauge.operators.identity import key_ring
from vitalgauge.sources.inbox import backfill_inbox, prune_inbox
from vitalgauge.streaming import jobs as J

NOW = 1_704_700_000_000
LAYOUT = A.IdentityLayout(buckets=4, parts=2)


@pytest.fixture(scope="module")
def ring(spark):
    return key_ring(spark, {v: base64.b64encode(bytes(range(i, i + 32))).decode() for i, v in enumerate(("v1", "v2"))})


def line(event_id, scene="s", day=0, **more):
    parts = {
        "ts": NOW - day * 86_400_000, "eventId": event_id, "module": "core", "name": "tick", "kind": "METRIC",
        "severity": "INFO", "priority": "NORMAL", "process": "p", "thread": "t", "scene": scene, **more,
    }
    return "|".join(f"{k}={v}" for k, v in parts.items())


def requests(spark, *batches, tenant="t1", installation=None):
    """Batches of (request id, arrival, lines)."""
    rows = [
        (r, tenant, "app", "prod", "1", "1.0", "line", "1.0", None, "7", None, installation, NOW + at, "\n".join(lines).encode())
        for r, at, lines in batches
    ]
    return spark.createDataFrame(rows, A.BATCH_SCHEMA)


def stored(log, spark, *columns):
    return sorted(tuple(r) for r in log.read(spark, "inbox").select(*columns).collect())


def outcomes(log, spark):
    return {r.request_id: (r.outcome, r.received, r.inserted, r.duplicates) for r in log.read(spark, "requests").collect()}


def replayed(batches, known):
    """The rules one batch after another: batches of (id, arrival, [(event, scene)])."""
    told = {}
    for request, _, events in sorted(batches, key=lambda b: (b[1], b[0])):
        scenes = {}
        clash = any(scenes.setdefault(e, s) != s for e, s in events) or any(known.get(e, s) != s for e, s in events)
        if clash:
            told[request] = ("CONFLICT", len(events), 0, 0)
            continue
        new = {e for e, _ in events if e not in known}
        known.update(events)
        told[request] = ("ACCEPTED", len(events), len(new), len(events) - len(new))
    return told


def test_conflicts_equal_a_replay_in_order(spark, ring, tmp_path):
    rng = random.Random(4)
    log, known = J.ingest_log(str(tmp_path / "set")), {}
    for epoch in range(2):
        batches = [
            (f"r{epoch}-{i:03}", rng.randint(0, 9), [(f"e{rng.randint(0, 60)}", rng.choice("aaaaaab")) for _ in range(rng.randint(1, 4))])
            for i in range(60)
        ] + [(f"r{epoch}-twice", 5, [("x", "a"), (f"y{epoch}", "a"), ("x", "b")])]
        rows = requests(spark, *[(r, at, [line(e, s) for e, s in events]) for r, at, events in batches])
        assert J.ingest_batch(rows, epoch, log, ring, "v1", LAYOUT)
        told = replayed(batches, known)
        got = outcomes(log, spark)
        assert {r: got[r] for r in told} == told
        assert stored(log, spark, "event_id", "scene") == sorted(known.items())
    assert {r.conflict for r in log.read(spark, "conflicts").collect()} == {"BATCH", "STORED", "EARLIER"}


def test_rotated_key_and_changed_installation(spark, ring, tmp_path):
    log = J.ingest_log(str(tmp_path / "set"))
    J.ingest_batch(requests(spark, ("a", 0, [line("e1")]), installation="phone-one"), 0, log, ring, "v1", LAYOUT)
    J.ingest_batch(requests(spark, ("b", 1, [line("e1")]), installation="phone-one"), 1, log, ring, "v2", LAYOUT)
    J.ingest_batch(requests(spark, ("c", 2, [line("e1")]), installation="phone-two"), 2, log, ring, "v2", LAYOUT)
    J.ingest_batch(requests(spark, ("d", 3, [line("e1")])), 3, log, ring, "v2", LAYOUT)
    J.ingest_batch(requests(spark, ("e", 4, [line("e1")]), tenant="t2", installation="phone-one"), 4, log, ring, "v2", LAYOUT)
    assert {r: o[0] for r, o in outcomes(log, spark).items()} == {
        "a": "ACCEPTED", "b": "ACCEPTED", "c": "CONFLICT", "d": "CONFLICT", "e": "ACCEPTED"
    }
    rows = log.read(spark, "inbox").collect()
    assert [(r.tenant_id, r.installation_hmac_key_version) for r in sorted(rows, key=lambda r: r.tenant_id)] == [("t1", "v1"), ("t2", "v2")]
    assert len({r.installation_hmac for r in rows}) == 2


def test_broken_batches_and_plaintext(spark, ring, tmp_path):
    log = J.ingest_log(str(tmp_path / "set"))
    batches = requests(
        spark,
        ("good", 0, [line("e1", context="who=phone-one,x=y", scene="on phone-one")]),
        ("late", 1, [line("e2"), line("e3", ts=NOW + 10**9)]),
        ("leak", 2, [line("phone-one-event")]),
        ("torn", 3, [line("e4"), "ts=1|ts=2"]),
        ("large", 4, [line("e5", fields=",".join(f"k{i}={'v' * 8000}" for i in range(40)))]),
        ("empty", 5, []),
        installation="phone-one",
    )
    J.ingest_batch(batches, 0, log, ring, "v1", LAYOUT)
    codes = {r.request_id: (r.first_bad_index, r.batch_error) for r in log.read(spark, "quarantine").collect()}
    assert codes == {
        "late": (1, "TIMESTAMP_IN_FUTURE"), "leak": (0, "PRIVACY_IDENTITY_CONFLICT"), "torn": (1, "INVALID_SEGMENTS"),
        "large": (0, "PAYLOAD_TOO_LARGE"), "empty": (0, "EMPTY_BATCH"),
    }
    row = log.read(spark, "inbox").first()
    assert row.scene is None and row.global_context == {"x": "y"}
    for name in log.tables:
        for found in log.read(spark, name).collect():
            assert "phone-one" not in str(found)


def test_epochs_that_run_again(spark, ring, tmp_path, monkeypatch):
    log = J.ingest_log(str(tmp_path / "set"))
    first = requests(spark, ("a", 0, [line("e1"), line("e2")]))
    # The job dies between writing and committing.
    with monkeypatch.context() as broken:
        broken.setattr(type(log), "publish", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            J.ingest_batch(first, 0, log, ring, "v1", LAYOUT)
    assert stored(log, spark, "event_id") == [] and outcomes(log, spark) == {}
    assert J.ingest_batch(first, 0, log, ring, "v1", LAYOUT)
    assert not J.ingest_batch(first, 0, log, ring, "v1", LAYOUT)
    assert stored(log, spark, "event_id") == [("e1",), ("e2",)]
    assert outcomes(log, spark) == {"a": ("ACCEPTED", 2, 2, 0)}


def test_only_partitions_that_may_hold_the_ids_are_read(spark, ring, tmp_path):
    log = J.ingest_log(str(tmp_path / "set"))
    for epoch in range(2):
        lines = [line(f"e{epoch}-{i}", day=i % 10) for i in range(40)]
        J.ingest_batch(requests(spark, (f"r{epoch}", epoch, lines)), epoch, log, ring, "v1", LAYOUT)
    for compacted in (False, True):
        if compacted:
            for name in ("identities", "identity_filters"):
                log.compact(spark, name, rewrite=A.merged_filters if name == "identity_filters" else None)
        identities, filters = log.read(spark, "identities"), log.read(spark, "identity_filters")
        ids = spark.createDataFrame([("t1", "e1-7"), ("t1", "unseen"), (None, None)], "tenant_id string, event_id string")
        partitions = A.partitions_to_open(ids, filters, LAYOUT)
        assert sum(map(len, partitions.values())) < identities.select("id_date", "id_bucket").distinct().count() / 4
        found = A.opened(identities, partitions)
        assert found.where("event_id = 'e1-7'").count() == 1
        spark.conf.set("spark.sql.maxMetadataStringLength", 100_000)
        plan = found._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.maxMetadataStringLength")
        pruned = re.search(r"PartitionFilters: \[([^\n]*?)\], PushedFilters", plan).group(1)
        assert "id_date" in pruned and "id_bucket" in pruned
        assert A.opened(identities, {}).count() == 0
    every = {tuple(r) for r in identities.select("tenant_id", "event_id").collect()}
    assert len(every) == 80
    opened = A.opened(identities, A.partitions_to_open(identities, filters, LAYOUT))
    assert {tuple(r) for r in opened.select("tenant_id", "event_id").collect()} == every


def test_hot_event_id(spark, ring, tmp_path):
    log = J.ingest_log(str(tmp_path / "set"))
    batches = [(f"r{i:04}", i, [line("hot"), line(f"e{i}")]) for i in range(300)]
    J.ingest_batch(requests(spark, *batches), 0, log, ring, "v1", LAYOUT)
    assert log.read(spark, "inbox").count() == 301
    assert sum(o[3] for o in outcomes(log, spark).values()) == 299


def test_backfill_and_pruning_rewrite_their_partitions(spark, ring, tmp_path):
    log = J.ingest_log(str(tmp_path / "set"))
    lines = [line(f"e{d}", day=d, module="network", name="network_request", fields="statusCode=200", context="a=b") for d in range(3)]
    J.ingest_batch(requests(spark, ("r", 0, lines)), 0, log, ring, "v1", LAYOUT)
    aged = log.read(spark, "inbox").selectExpr(
        "* EXCEPT (normalization_version, ints)",
        "if(event_id = 'e1', 3, normalization_version) AS normalization_version",
        "if(event_id = 'e1', cast(map() AS map<string,bigint>), ints) AS ints",
    )
    log.append(spark, {"inbox": aged}, 1, replaced=("inbox",))
    assert backfill_inbox(spark, log) == 1 and backfill_inbox(spark, log) == 0
    rows = {r.event_id: r for r in log.read(spark, "inbox").collect()}
    assert len(rows) == 3 and all(r.normalization_version == 4 and r.ints["statusCode"] == 200 for r in rows.values())
    assert prune_inbox(spark, log, "event_id IN ('e0', 'e2')", NOW) == 2
    rows = {r.event_id: r for r in log.read(spark, "inbox").collect()}
    assert rows["e0"].raw_pruned_ms == NOW and rows["e0"].fields == {} and rows["e0"].global_context == {}
    assert rows["e0"].retained_scene_state == "EXPIRED" and rows["e0"].payload_sha256 is not None
    assert rows["e1"].raw_pruned_ms is None and rows["e1"].fields == {"statusCode": "200"}
