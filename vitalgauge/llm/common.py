"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgauge.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder of ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage ends there, and every executor sees it."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs started inside read and pass to Python at most so many rows at a time: both sides hold little."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {key: spark.conf.get(key) for key in keys}
    try:
        for key in keys:
            spark.conf.set(key, str(rows))
        yield
    finally:
        for key in keys:
            spark.conf.set(key, before[key])


_WORKER_CACHES: dict[str, dict] = {}


def worker_cache(owner: str, cache: dict) -> dict:
    """Register what an operator keeps in a Python worker from one task to the next."""
    return _WORKER_CACHES.setdefault(owner, cache)


def only(owner: str) -> None:
    """Called where a task of an operator begins: what other operators keep in this worker goes."""
    for name, cache in _WORKER_CACHES.items():
        if name != owner:
            cache.clear()
    give_back()


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def give_back() -> None:
    """Memory that is free in this process goes back to the system: Arrow's pool and malloc would keep it."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def text_of(column: str) -> Column:
    """The column as text; null counts as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def slices(batches: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    """Arrow batches cut small, so that a task holds the results of few rows at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]
        give_back()


def named(df: DataFrame, **columns: str) -> DataFrame:
    """Only the given columns, under the operator's own names: other columns can't clash."""
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))
