"""Session settings and the small runtime helpers that need a live session."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

# Largest table the library will mark for broadcast; anything above joins by shuffle.
BROADCAST_ROW_LIMIT = 50_000


def build_session(app_name: str, master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the settings every operator assumes (UTC, AQE, redaction)."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.redaction.string.regex", "(?i)(ipad|opad|secret)[^,)]*")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared checkpoint folder; fall back to a scratch folder in local tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    folder = tempfile.mkdtemp(prefix="vitalgauge-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def broadcast_checked(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Mark a side for broadcast only after a bounded count; larger sides stay shuffle joins."""
    rows = df.limit(limit + 1).count()
    return F.broadcast(df) if rows <= limit else df


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A contract table of fixed size as a local relation inside the plan (no job to build it)."""
    kinds = StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [() for _ in kinds]
    arrays = [
        pa.array(list(values), type=to_arrow_type(field.dataType))
        for values, field in zip(columns, kinds)
    ]
    table = pa.Table.from_arrays(arrays, names=[field.name for field in kinds])
    return spark.createDataFrame(table, schema=kinds)
