"""Tables behind a commit log: rows become visible by one renamed file, all tables of a commit at once.

``<path>/data/<table>/commit=<version>-<random>/`` holds Parquet files; nobody reads a folder because it is there.
``<path>/log/<version>.json`` names, for every table, the folders that are live at this version, and the last epoch in them.
The newest version is the table; each manifest is whole, so a reader opens one. A writer stages its folders, then renames a
manifest into place under the next number. If another writer took the number, it looks again and retries.

- A reader never sees half a commit: it reads the folders of one manifest.
- A micro-batch that is replayed finds its epoch committed and writes nothing; one that died before its commit left
  folders that no manifest names.
- ``compact`` swaps the many folders of a table for one in a single commit; ``vacuum`` removes old manifests and
  folders that none of the kept ones names. So folders and manifests stay bounded while a stream runs.

One stream writes epochs; compaction may run beside it.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitalgauge.sources.files import Files

RETRIES = 20
# Characters that Spark escapes in the names of partition folders (fixed values).
ESCAPED = set('"#%\'*/:=?\\{[]^')


@dataclass(frozen=True)
class Table:
    """Columns of a table (partition columns included), how its folders are laid out and sorted."""

    schema: str
    partitions: tuple[str, ...] = ()
    order: tuple[str, ...] = ()


@dataclass(frozen=True)
class Snapshot:
    """What one manifest says."""

    version: int = 0
    epoch: int = -1
    folders: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"version": self.version, "epoch": self.epoch, "folders": self.folders})


class LostCommit(RuntimeError):
    """A commit that can't be made any more: other writers changed what it builds on."""


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, datetime.date):
        return f"DATE'{value}'"
    return f"'{value}'" if isinstance(value, str) and "'" not in value and "\\" not in value else repr(value)


def _folder_of(pairs) -> str:
    """The folder name that Spark gives a partition."""
    parts = []
    for key, value in pairs:
        text = "__HIVE_DEFAULT_PARTITION__" if value is None or value == "" else str(value)
        parts.append(f"{key}=" + "".join(f"%{ord(c):02X}" if c in ESCAPED or ord(c) < 32 or ord(c) == 127 else c for c in text))
    return "/".join(parts)


def _same_counts(one: DataFrame, other: DataFrame, keys: list[str]) -> bool:
    counts = [df.groupBy(*keys).agg(F.count("*").alias("n")) for df in (one, other)]
    return counts[0].exceptAll(counts[1]).isEmpty() and counts[1].exceptAll(counts[0]).isEmpty()


@dataclass(frozen=True)
class CommitLog:
    path: str
    tables: dict[str, Table]

    def _manifest(self, version: int) -> str:
        return f"{self.path}/log/{version:020d}.json"

    def _versions(self, files: Files) -> list[int]:
        return [int(name[:-5]) for name in files.names(f"{self.path}/log") if name.endswith(".json")]

    def snapshot(self, spark: SparkSession, version: int | None = None) -> Snapshot:
        """The newest manifest, or the one of a version that is still kept."""
        files = Files(spark, self.path)
        found = self._versions(files) if version is None else [version]
        if not found or found[-1] == 0:
            return Snapshot()
        told = json.loads(files.read_text(self._manifest(found[-1])))
        return Snapshot(told["version"], told["epoch"], {name: tuple(f) for name, f in told["folders"].items()})

    def read(self, spark: SparkSession, name: str, at: Snapshot | None = None) -> DataFrame:
        """Rows of a table at a snapshot; later commits don't change what an open snapshot reads."""
        at = at or self.snapshot(spark)
        schema = StructType.fromDDL(self.tables[name].schema)
        folders = at.folders.get(name, ())
        if not folders:
            return spark.createDataFrame([], schema)
        base = f"{self.path}/data/{name}"
        rows = spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{folder}" for folder in folders])
        return rows.select(*schema.names)

    def stage(self, spark: SparkSession, name: str, rows: DataFrame, base: Snapshot) -> str:
        """Write rows to a new folder that no reader sees yet; gives its name."""
        table = self.tables[name]
        folder = f"commit={base.version:020d}-{uuid.uuid4().hex}"
        columns = StructType.fromDDL(table.schema)
        rows = rows.select(*[F.col(c.name).cast(c.dataType) for c in columns])
        if table.partitions:
            # AQE splits a dominating partition over several writers and joins small ones.
            rows = rows.hint("rebalance", *[F.col(c) for c in table.partitions])
        if table.partitions or table.order:
            rows = rows.sortWithinPartitions(*table.partitions, *table.order)
        rows.write.partitionBy(*table.partitions).parquet(f"{self.path}/data/{name}/{folder}")
        return folder

    def publish(
        self, spark: SparkSession, adds: dict[str, str], drops: dict[str, tuple[str, ...]] | None = None,
        epoch: int | None = None, kept: dict[str, tuple[str, ...]] | None = None,
    ) -> Snapshot:
        """Make staged folders visible and dropped ones invisible in one step; ``kept`` names parts of the dropped ones
        that stay."""
        files = Files(spark, self.path)
        for _ in range(RETRIES):
            now = self.snapshot(spark)
            if epoch is not None and epoch <= now.epoch:
                return now
            for name, folder in adds.items():
                if not files.exists(f"{self.path}/data/{name}/{folder}"):
                    raise LostCommit(f"{name}/{folder} was removed before its commit")
            folders = dict(now.folders)
            for name in {*adds, *(drops or {})}:
                live, gone = folders.get(name, ()), set((drops or {}).get(name, ()))
                if not gone <= set(live):
                    raise LostCommit(f"{name} was rewritten meanwhile")
                stays = tuple(f for f in live if f not in gone) + (kept or {}).get(name, ())
                folders[name] = stays + ((adds[name],) if name in adds else ())
            after = Snapshot(now.version + 1, now.epoch if epoch is None else epoch, folders)
            scratch = f"{self.path}/scratch/{uuid.uuid4().hex}"
            if files.publish_text(self._manifest(after.version), scratch, after.text()):
                return after
        raise LostCommit(f"no free version after {RETRIES} tries")

    def append(
        self, spark: SparkSession, rows: dict[str, DataFrame], epoch: int | None = None, replaced: tuple[str, ...] = ()
    ) -> bool:
        """Add rows to several tables in one commit; False if the epoch is in already. Tables in ``replaced`` then hold
        the new rows only."""
        base = self.snapshot(spark)
        if epoch is not None and epoch <= base.epoch:
            return False
        adds = {name: self.stage(spark, name, df, base) for name, df in rows.items()}
        self.publish(spark, adds, {name: base.folders.get(name, ()) for name in replaced}, epoch)
        return True

    def rewrite_partitions(
        self, spark: SparkSession, name: str, stale: str, change: Callable[[DataFrame], DataFrame]
    ) -> int:
        """Rewrite the partitions that hold a row for which ``stale`` (SQL) is true; gives how many there were.

        The rows of these partitions are staged whole behind ``change``, which must keep their number and partitions;
        counts are compared, then one commit swaps them. All other partitions keep their files.
        """
        base, files = self.snapshot(spark), Files(spark, self.path)
        keys = list(self.tables[name].partitions)
        rows = self.read(spark, name, base)
        hit = rows.where(stale).select(*keys).distinct()
        found = [tuple(r) for r in hit.collect()]  # as many as the table's partitions at most
        if not found:
            return 0
        inside = " OR ".join("(" + " AND ".join(f"{k} <=> {_literal(v)}" for k, v in zip(keys, values)) + ")" for values in found)
        part = rows.where(inside)
        folder = self.stage(spark, name, change(part), base)
        alone = Snapshot(base.version, base.epoch, {name: (folder,)})
        if not _same_counts(part, self.read(spark, name, alone), keys):
            raise ValueError(f"{name}: the rewritten partitions have other counts")
        gone = {_folder_of(zip(keys, values)) for values in found}
        live: list[str] = []
        for entry in base.folders[name]:
            for leaf in self._leaves(files, name, entry, len(keys)):
                if leaf.split("/", 1)[1] not in gone:
                    live.append(leaf)
        self.publish(spark, {name: folder}, {name: base.folders[name]}, kept={name: tuple(live)})
        return len(found)

    def _leaves(self, files: Files, name: str, entry: str, depth: int) -> list[str]:
        """Partition folders of an entry; an entry may be one itself."""
        found = [entry]
        while found and found[0].count("/") < depth:
            found = [f"{f}/{child}" for f in found for child in files.names(f"{self.path}/data/{name}/{f}") if "=" in child]
        return found

    def compact(
        self, spark: SparkSession, name: str, more_than: int = 1, rewrite: Callable[[DataFrame], DataFrame] | None = None
    ) -> bool:
        """Swap a table's folders for one, if there are more than so many.

        Readers see the same rows before and after, or what ``rewrite`` makes of them (as of partial aggregates).
        """
        base = self.snapshot(spark)
        old = base.folders.get(name, ())
        if len(old) <= more_than:
            return False
        rows = self.read(spark, name, base)
        folder = self.stage(spark, name, rewrite(rows) if rewrite else rows, base)
        self.publish(spark, {name: folder}, drops={name: old})
        return True

    def vacuum(self, spark: SparkSession, keep: int = 10) -> None:
        """Remove all manifests but the newest ``keep``, and folders that these don't name and that are older than them.

        A reader may go on with a snapshot for ``keep`` commits.
        """
        files = Files(spark, self.path)
        kept = self._versions(files)[-keep:]
        if not kept:
            return
        named = [self.snapshot(spark, version).folders for version in kept]
        for version in self._versions(files):
            if version < kept[0]:
                files.delete(self._manifest(version))
        for name in self.tables:
            live = {folder.split("/")[0] for folders in named for folder in folders.get(name, ())}
            for folder in files.names(f"{self.path}/data/{name}"):
                if folder.startswith("commit=") and folder not in live and int(folder[7:27]) < kept[0]:
                    files.delete(f"{self.path}/data/{name}/{folder}")
