"""Import every query module once and expose the registry."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import SparkSession

from vitalgauge.plans import registry

MODULES = (
    "scan_queries",
    "release_queries",
    "performance_queries",
    "signal_queries",
    "ingest_queries",
    "operation_queries",
    "streaming_queries",
)


def _utc(fn):
    """The mapping reads epoch milliseconds, so every query runs in a UTC session."""

    def run(spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    return run


def _load() -> None:
    for module in MODULES:
        import_module(f"vitalgauge.plans.{module}")


def queries() -> dict:
    _load()
    return {name: _utc(fn) for name, fn in registry.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.SQL)
