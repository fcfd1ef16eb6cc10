"""Shared session and row builders."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from builders import DEFAULTS, INBOX

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from vitalgauge.operators.normalize import normalize_fields  # noqa: E402
from vitalgauge.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def inbox(spark):
    """Build normalized inbox rows from dictionaries of overrides."""

    def build(*rows: dict, normalized: bool = True):
        full = []
        for i, row in enumerate(rows):
            merged = {**DEFAULTS, "id": i, "event_id": f"e{i}", **row}
            merged.setdefault("received_ms", merged["occurrence_timestamp_ms"])
            full.append(tuple(merged.get(c) for c in INBOX))
        df = spark.createDataFrame(full, ", ".join(f"{c} {t}" for c, t in INBOX.items()))
        return normalize_fields(df, "occurrence_timestamp_ms") if normalized else df

    return build
