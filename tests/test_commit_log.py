"""The commit log: whole commits, replays, snapshots, compaction, races and bounded folders."""

from __future__ import annotations

import re

import pytest

from vitalgauge.sources.commit_log import CommitLog, LostCommit, Table
from vitalgauge.sources.files import Files


@pytest.fixture()
def log(tmp_path):
    return CommitLog(
        str(tmp_path / "set"),
        {"a": Table("k bigint, day date, v string", ("day",), ("k",)), "b": Table("k bigint")},
    )


def rows(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "k bigint").selectExpr(
        "k", "date_add(DATE'2024-01-01', cast(k % 3 AS int)) AS day", "concat('v', k) AS v"
    )


def keys(df):
    return sorted(r.k for r in df.collect())


def test_commits_are_whole_and_replays_write_nothing(spark, log):
    assert keys(log.read(spark, "a")) == []
    assert log.append(spark, {"a": rows(spark, 1, 2), "b": rows(spark, 1)}, epoch=0)
    before = log.snapshot(spark)
    # A writer that dies after staging leaves nothing visible.
    log.stage(spark, "a", rows(spark, 8, 9), before)
    assert keys(log.read(spark, "a")) == [1, 2]
    assert log.append(spark, {"a": rows(spark, 3), "b": rows(spark)}, epoch=1)
    assert not log.append(spark, {"a": rows(spark, 3), "b": rows(spark, 7)}, epoch=1)
    assert keys(log.read(spark, "a")) == [1, 2, 3] and keys(log.read(spark, "b")) == [1]
    assert keys(log.read(spark, "a", before)) == [1, 2]
    assert log.read(spark, "a").columns == ["k", "day", "v"]


def test_partition_filters_reach_the_folders(spark, log):
    log.append(spark, {"a": rows(spark, *range(9))})
    plan = log.read(spark, "a").filter("day = DATE'2024-01-02'")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*day#\d+ = ", plan)
    assert keys(log.read(spark, "a").filter("day = DATE'2024-01-02'")) == [1, 4, 7]


def test_compaction_swaps_folders_at_once(spark, log):
    for epoch in range(4):
        log.append(spark, {"a": rows(spark, epoch, epoch + 10)}, epoch)
    old = log.snapshot(spark)
    assert log.compact(spark, "a") and not log.compact(spark, "a")
    new = log.snapshot(spark)
    assert len(old.folders["a"]) == 4 and len(new.folders["a"]) == 1 and new.epoch == 3
    assert keys(log.read(spark, "a")) == keys(log.read(spark, "a", old)) == sorted([*range(4), *range(10, 14)])
    assert not log.append(spark, {"a": rows(spark, 99)}, epoch=3)  # a replay after compaction


def test_race_for_a_version(spark, log):
    log.append(spark, {"a": rows(spark, 1)}, epoch=0)
    log.append(spark, {"a": rows(spark, 2)}, epoch=1)
    base = log.snapshot(spark)
    folder = log.stage(spark, "a", log.read(spark, "a", base), base)
    log.append(spark, {"a": rows(spark, 3)}, epoch=2)  # the stream goes on while compaction writes
    log.publish(spark, {"a": folder}, drops={"a": base.folders["a"]})
    assert keys(log.read(spark, "a")) == [1, 2, 3]
    with pytest.raises(LostCommit):
        log.publish(spark, {"a": folder}, drops={"a": base.folders["a"]})
    files = Files(spark, log.path)
    taken = log._manifest(log.snapshot(spark).version)
    assert not files.publish_text(taken, f"{log.path}/scratch/x", "{}")
    assert keys(log.read(spark, "a")) == [1, 2, 3]


def test_folders_and_manifests_stay_bounded(spark, log):
    files = Files(spark, log.path)
    for epoch in range(12):
        log.append(spark, {"a": rows(spark, epoch)}, epoch)
        if epoch % 3 == 2:
            log.compact(spark, "a")
            log.vacuum(spark, keep=2)
    assert len(files.names(f"{log.path}/data/a")) <= 5  # one compacted, three behind it in an older manifest, one now
    assert len([n for n in files.names(f"{log.path}/log") if n.endswith(".json")]) <= 2
    assert keys(log.read(spark, "a")) == list(range(12))


def test_rewriting_some_partitions(spark, log):
    for epoch in range(2):
        log.append(spark, {"a": rows(spark, *range(epoch * 9, epoch * 9 + 9))}, epoch)
    files = Files(spark, log.path)

    def listed():
        found = {}
        for entry in log.snapshot(spark).folders["a"]:
            for leaf in log._leaves(files, "a", entry, 1):
                found[leaf] = [n for n in files.names(f"{log.path}/data/a/{leaf}") if n.endswith(".parquet")]
        return found

    before, old = listed(), log.snapshot(spark)
    changed = log.rewrite_partitions(spark, "a", "k = 10", lambda df: df.selectExpr("k", "day", "concat(v, '!') AS v"))
    after = listed()
    assert changed == 1
    untouched = {leaf for leaf in before if "day=2024-01-02" not in leaf}
    assert {leaf: before[leaf] for leaf in untouched} == {leaf: after[leaf] for leaf in after if leaf in before}
    assert {r.k: r.v for r in log.read(spark, "a").collect()} == {k: f"v{k}" + ("!" if k % 3 == 1 else "") for k in range(18)}
    assert {r.v for r in log.read(spark, "a", old).collect()} == {f"v{k}" for k in range(18)}
    assert log.rewrite_partitions(spark, "a", "k = 99", lambda df: df) == 0
    with pytest.raises(ValueError, match="counts"):
        log.rewrite_partitions(spark, "a", "k = 1", lambda df: df.where("k <> 1"))
    assert log.read(spark, "a").count() == 18
    # again, on entries that are partition folders by now
    assert log.rewrite_partitions(spark, "a", "k IN (0, 1)", lambda df: df.selectExpr("k", "day", "upper(v) AS v")) == 2
    log.compact(spark, "a")
    log.vacuum(spark, keep=1)
    assert keys(log.read(spark, "a")) == list(range(18)) and len(files.names(f"{log.path}/data/a")) == 1


def test_odd_partition_values(spark, tmp_path):
    log = CommitLog(str(tmp_path / "odd"), {"t": Table("k bigint, who string", ("who",))})
    names = ["a/b", "c=d", "e f", None, "it's", "100%", "x:y", "é", "back\\slash", "[q]"]
    log.append(spark, {"t": spark.createDataFrame(list(enumerate(names)), "k bigint, who string")})
    for k, _ in enumerate(names):
        assert log.rewrite_partitions(spark, "t", f"k = {k}", lambda df: df.selectExpr("k + 100 AS k", "who")) == 1
    assert {(r.k, r.who) for r in log.read(spark, "t").collect()} == {(k + 100, n) for k, n in enumerate(names)}
