"""Inbox table on Parquet, partitioned so that scope and window filters prune directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgauge import constants as C
from vitalgauge.operators.admission import STORED_SCHEMA
from vitalgauge.operators.normalize import renormalize_backfill
from vitalgauge.operators.retention import prune_raw_evidence
from vitalgauge.sources.commit_log import CommitLog, Table

PARTITIONS = ("tenant_id", "app_id", "environment", "occurrence_date")
# The inbox behind a commit log: the whole stored row, laid out as ``write_inbox`` lays it out.
INBOX = Table(f"{STORED_SCHEMA}, occurrence_date date", PARTITIONS, ("app_version", "occurrence_timestamp_ms"))


def with_partition_date(rows: DataFrame) -> DataFrame:
    """Add the UTC occurrence date used as the last partition column."""
    return rows.withColumn(
        "occurrence_date", F.to_date(F.timestamp_millis("occurrence_timestamp_ms"))
    )


def write_inbox(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write rows clustered by partition.

    Rebalancing lets AQE split a dominating tenant or day over several writers and merge small
    ones. Rows are sorted by release and time inside a file so that row-group statistics prune too.
    """
    (
        with_partition_date(rows)
        .hint("rebalance", *[F.col(c) for c in PARTITIONS])
        .sortWithinPartitions(*PARTITIONS, "app_version", "occurrence_timestamp_ms")
        .write.mode(mode)
        .partitionBy(*PARTITIONS)
        .parquet(path)
    )


def read_inbox(spark: SparkSession, path: str) -> DataFrame:
    """The stored inbox."""
    return spark.read.parquet(path)


def _changed_rows(which: str, change):
    """Apply ``change`` to the rows for which ``which`` is true; the rest of a partition stays as it is."""

    def whole(rows: DataFrame) -> DataFrame:
        with_frames = rows.withColumn("native_frames", F.col("occurrence.native_frames"))
        rest = rows.where(f"NOT coalesce({which}, false)")
        return rest.unionByName(change(with_frames.where(which)).select(rows.columns))

    return whole


def backfill_inbox(spark: SparkSession, log: CommitLog, version: int = C.NORMALIZATION_VERSION) -> int:
    """Normalize stored rows of an older version again, where their raw evidence is kept; gives how many partitions changed.

    Partitions with such rows are staged whole, their counts verified, and swapped in one commit; others keep their files.
    """
    stale = f"normalization_version < {version} AND raw_pruned_ms IS NULL"
    return log.rewrite_partitions(spark, "inbox", stale, _changed_rows(stale, lambda rows: renormalize_backfill(rows, version)))


def prune_inbox(spark: SparkSession, log: CommitLog, due: str, now_ms: int) -> int:
    """Delete the raw evidence of stored rows for which ``due`` (SQL) is true; gives how many partitions changed."""
    empty = F.expr("cast(map() AS map<string,string>)")

    def change(rows: DataFrame) -> DataFrame:
        pruned = prune_raw_evidence(rows, now_ms)
        return pruned.withColumns({"global_context": empty, "extras": empty, "unknown": empty, "occurrence": F.lit(None)})

    due = f"({due}) AND raw_pruned_ms IS NULL"
    return log.rewrite_partitions(spark, "inbox", due, _changed_rows(due, change))
