"""The five streaming jobs. Each returns a started query; pass ``available_now`` to drain and stop.

Event time is the occurrence. No job drops late rows, because lateness is a reported fact: counts of micro-batches are
added up over commits instead of waiting in state for a watermark. Every micro-batch is one commit of a log, so the cost of
one doesn't depend on how many came before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitalgauge.functions import events as E
from vitalgauge.operators import admission as A
from vitalgauge.operators.alerts import alert_transitions, rolling_incident_alert
from vitalgauge.operators.ingest import admit_quota
from vitalgauge.sources.commit_log import CommitLog, Snapshot, Table
from vitalgauge.sources.files import Files
from vitalgauge.sources.inbox import INBOX, with_partition_date

def _start(df: DataFrame, each_batch, checkpoint: str, available_now: bool, mode: str = "append"):
    writer = (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(each_batch)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def ingest_log(folder: str) -> CommitLog:
    """The tables that ingest commits together: stored rows, the identity index with its bitmaps, and side tables."""
    return CommitLog(
        folder,
        {
            "inbox": INBOX,
            "identities": Table(A.IDENTITY_SCHEMA, ("id_date", "id_bucket"), ("tenant_id", "event_id")),
            "identity_filters": Table(A.FILTER_SCHEMA),
            "quarantine": Table(
                "tenant_id string, request_id string, batch_id string, received_ms bigint, event_count bigint,"
                " first_bad_index int, batch_error string"
            ),
            "conflicts": Table("tenant_id string, request_id string, batch_id string, event_id string, conflict string"),
            "requests": Table(
                "tenant_id string, request_id string, received_ms bigint, outcome string, received bigint,"
                " inserted bigint, duplicates bigint"
            ),
        },
    )


def ingest_batch(
    batches: DataFrame, epoch: int, log: CommitLog, keys: DataFrame, active_version: str,
    layout: A.IdentityLayout = A.IdentityLayout(),
) -> bool:
    """Take one set of wire batches in; False if this epoch is committed already.

    Two passes over the bytes: the first finds the dates and buckets of the identity index whose bitmaps may hold one of
    the ids, the second runs the whole chain against the identities of just those partitions. What must be read several
    times in between is kept in a staging folder (pseudonymized, without plaintext ids), which goes after the commit.
    """
    spark = batches.sparkSession
    base = log.snapshot(spark)
    if epoch <= base.epoch:
        return False
    staging = f"{log.path}/staging/{uuid.uuid4().hex}"

    def keep(df: DataFrame, label: str) -> DataFrame:
        path = f"{staging}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    ids = A.decode_batches(batches).select("tenant_id", "event_id")
    partitions = A.partitions_to_open(ids, log.read(spark, "identity_filters", base), layout)
    known = A.opened(log.read(spark, "identities", base), partitions)
    prepared = keep(A.prepare(batches, keys, active_version, known), "prepared")
    taken, conflicts = A.settle(prepared, keep)
    fresh = keep(A.fresh_events(taken), "fresh")
    conflicts = keep(conflicts, "conflicts")
    identities = A.identities_of(fresh, layout)
    log.append(
        spark,
        {
            "inbox": with_partition_date(fresh),
            "identities": identities,
            "identity_filters": A.filters_of(identities, layout),
            "quarantine": A.quarantined(prepared),
            "conflicts": conflicts,
            "requests": A.acknowledgements(prepared, fresh, conflicts),
        },
        epoch,
    )
    Files(spark, log.path).delete(staging)
    return True


def stream_ingest(
    batches: DataFrame, folder: str, checkpoint: str, keys: DataFrame, active_version: str,
    available_now: bool = False, compact_every: int = 20, layout: A.IdentityLayout = A.IdentityLayout(),
) -> StreamingQuery:
    """Wire batches (``admission.BATCH_SCHEMA``) into the inbox: the whole ingest chain, from bytes to stored rows.

    Every micro-batch is one commit of all tables (``ingest_log``): readers see it whole or not at all, and one that
    runs again after a failure finds its epoch committed or starts over. Broken batches go to ``quarantine``, batches
    that reuse an event id for other content to ``conflicts``, and ``requests`` tells what came of each. Every
    ``compact_every`` epochs the folders of each table become one, and files that no kept snapshot names are removed.
    """
    log = ingest_log(folder)

    def each_batch(rows: DataFrame, epoch: int) -> None:
        ingest_batch(rows, epoch, log, keys, active_version, layout)
        if (epoch + 1) % compact_every == 0:
            spark = rows.sparkSession
            for name in log.tables:
                log.compact(spark, name, rewrite=A.merged_filters if name == "identity_filters" else None)
            log.vacuum(spark, keep=compact_every)

    return _start(batches, each_batch, checkpoint, available_now)


def _counting(events: DataFrame, count, log: CommitLog, checkpoint: str, available_now: bool, compact_every: int):
    """Each micro-batch commits its own counts; a group's count is the sum over commits.

    Nothing waits for a watermark, so a row counts however late it comes, and no state grows. Compaction adds the counts of
    a group up, which bounds folders and rows.
    """

    def each_batch(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        log.append(spark, {"counts": count(rows)}, epoch)
        if (epoch + 1) % compact_every == 0:
            log.compact(spark, "counts", rewrite=summed)
            log.vacuum(spark, keep=compact_every)

    return _start(events, each_batch, checkpoint, available_now)


def summed(parts: DataFrame) -> DataFrame:
    """Counts of all commits by group: the last column is the count."""
    *keys, value = parts.columns
    return parts.groupBy(*keys).agg(F.sum(value).alias(value))


RELEASE_COUNTS = (
    "app_id string, environment string, app_version string, family string,"
    " window_start_ms bigint, event_count bigint"
)


def release_count_log(folder: str) -> CommitLog:
    return CommitLog(folder, {"counts": Table(RELEASE_COUNTS)})


def stream_release_counts(
    events: DataFrame, log: CommitLog, checkpoint: str, available_now: bool = False, width: str = "1 hour",
    compact_every: int = 20,
) -> StreamingQuery:
    """Tumbling counts by release and family; read them with ``summed(log.read(spark, "counts"))``."""

    def count(rows: DataFrame) -> DataFrame:
        return (
            rows.filter(F.expr(E.BOUND))
            .select(
                "app_id", "environment", "app_version", F.expr(E.FAMILY).alias("family"),
                F.timestamp_millis("occurrence_timestamp_ms").alias("event_time"),
            )
            .groupBy("app_id", "environment", "app_version", "family", F.window("event_time", width))
            .agg(F.count("*").alias("event_count"))
            .select(
                "app_id", "environment", "app_version", "family",
                F.unix_millis("window.start").alias("window_start_ms"), "event_count",
            )
        )

    return _counting(events, count, log, checkpoint, available_now, compact_every)


ROLLING_ALERTS = (
    "app_id string, environment string, family string, window_start_ms bigint,"
    " incident_count bigint"
)


def rolling_alert_log(folder: str) -> CommitLog:
    return CommitLog(folder, {"counts": Table(ROLLING_ALERTS)})


def stream_rolling_alerts(
    events: DataFrame, log: CommitLog, checkpoint: str, available_now: bool = False, compact_every: int = 20
) -> StreamingQuery:
    """Crash and ANR counts of sliding windows; ``rolling_alerts`` tells which are above a threshold."""
    return _counting(events, rolling_incident_alert, log, checkpoint, available_now, compact_every)


def rolling_alerts(counts: DataFrame, threshold: int = 0) -> DataFrame:
    return summed(counts).filter(F.col("incident_count") > threshold)


TRANSITIONS = (
    "rule_id bigint, evaluated_ms bigint, value double, sample_count bigint, state string,"
    " transition string"
)


def episode_log(folder: str) -> CommitLog:
    """Transitions, and the last one of each rule."""
    return CommitLog(
        folder, {"transitions": Table(TRANSITIONS), "last": Table("rule_id bigint, evaluated_ms bigint, transition string")}
    )


def stream_alert_episodes(
    ticks: DataFrame, log: CommitLog, checkpoint: str, available_now: bool = False, compact_every: int = 20
) -> StreamingQuery:
    """Open and close episodes as evaluation ticks arrive.

    A micro-batch reads and replaces the last transition of each rule (one row a rule); earlier transitions aren't read.
    """

    def each_batch(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        last = log.read(spark, "last")
        still_open = last.filter("transition = 'FIRING'").select("rule_id", F.col("transition").alias("last"))
        found = alert_transitions(rows, still_open).select(*_names(TRANSITIONS))
        newest = (
            last.unionByName(found.select("rule_id", "evaluated_ms", "transition"))
            .groupBy("rule_id")
            .agg(F.max_by("transition", "evaluated_ms").alias("transition"), F.max("evaluated_ms").alias("evaluated_ms"))
        )
        log.append(spark, {"transitions": found, "last": newest}, epoch, replaced=("last",))
        if (epoch + 1) % compact_every == 0:
            log.compact(spark, "transitions")
            log.vacuum(spark, keep=compact_every)

    return _start(ticks, each_batch, checkpoint, available_now)


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


ADMISSIONS = (
    "key_id string, window_ms bigint, received_ms bigint, batch_id string, event_count bigint,"
    " admitted boolean, retry_after bigint"
)


def quota_log(folder: str) -> CommitLog:
    """Admissions, and what each micro-batch used of a key's minute, by hour."""
    return CommitLog(
        folder,
        {
            "admissions": Table(ADMISSIONS),
            "used": Table("key_id string, window_ms bigint, used_requests bigint, used_events bigint, hour bigint", ("hour",)),
        },
    )


def _hours(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("hour", F.expr(f"{column} div 3600000L"))


def stream_quota(
    batches: DataFrame, limits: DataFrame, log: CommitLog, checkpoint: str, available_now: bool = False,
    compact_every: int = 20,
) -> StreamingQuery:
    """Admit batches per key and minute; counters of earlier micro-batches carry over.

    A micro-batch reads the counters of the hours it touches, by partition; admissions aren't read again.
    """

    def add_up(used: DataFrame) -> DataFrame:
        return used.groupBy("key_id", "window_ms", "hour").agg(
            F.sum("used_requests").alias("used_requests"), F.sum("used_events").alias("used_events")
        )

    def each_batch(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        base = log.snapshot(spark)
        if epoch <= base.epoch:
            return
        touched = [r[0] for r in _hours(rows, "received_ms").select("hour").distinct().collect()]
        used = add_up(log.read(spark, "used", base).filter(F.col("hour").isin(touched))).drop("hour")
        folder = log.stage(spark, "admissions", admit_quota(rows, limits, used), base)
        # The fold ran once; its stored result gives the counters.
        admitted = log.read(spark, "admissions", Snapshot(folders={"admissions": (folder,)})).filter("admitted")
        spent = admitted.groupBy("key_id", "window_ms").agg(
            F.count("*").alias("used_requests"), F.sum("event_count").alias("used_events")
        )
        counters = log.stage(spark, "used", _hours(spent, "window_ms"), base)
        log.publish(spark, {"admissions": folder, "used": counters}, epoch=epoch)
        if (epoch + 1) % compact_every == 0:
            log.compact(spark, "admissions")
            log.compact(spark, "used", rewrite=add_up)
            log.vacuum(spark, keep=compact_every)

    return _start(batches, each_batch, checkpoint, available_now)
