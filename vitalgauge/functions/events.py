"""Row-level rules over inbox columns, written once as SQL text and usable as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalgauge import constants as C

FAMILY = (
    "CASE "
    + " ".join(
        f"WHEN module = '{module}' AND name = '{name}' THEN '{family}'"
        for (module, name), family in C.EVENT_FAMILIES.items()
    )
    + " ELSE 'UNREGISTERED' END"
)
BOUND = f"coalesce(release_identity_quality = '{C.OCCURRENCE_BOUND}', false)"
EMIT = "try_element_at(ints, 'emitCount')"
DROPS = "try_element_at(ints, 'dropCount')"
RATE = "try_element_at(nums, 'dropRate')"
SDK_VALID = f"coalesce({EMIT} > 0 AND {DROPS} >= 0 AND {RATE} BETWEEN 0 AND 1, false)"
SDK_DROPPED = f"(coalesce({DROPS} > 0, false) OR coalesce({RATE} > 0, false))"
SESSION_START = (
    "coalesce(module = 'core' AND name = 'session_start'"
    " AND try_element_at(ints, 'session_schema_version') = 1"
    " AND try_element_at(ints, 'session_count') = 1, false)"
)
VISIBLE_SCENE = "CASE WHEN raw_pruned_ms IS NULL THEN scene END"
SCENE_STATE = (
    f"CASE WHEN raw_pruned_ms IS NULL THEN if(coalesce(scene, '') <> '', '{C.AVAILABLE}',"
    f" '{C.MISSING}') WHEN retained_scene_state IN ('{C.EXPIRED}', '{C.MISSING}')"
    f" THEN retained_scene_state ELSE '{C.RETENTION_UNKNOWN}' END"
)


def late(late_after_ms: int = C.LATE_AFTER_MS) -> str:
    """SQL of: received more than the threshold after the occurrence."""
    return f"(received_ms - occurrence_timestamp_ms > {late_after_ms})"


def quoted(values) -> str:
    """SQL list of string literals."""
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


LIVE = quoted(C.LIVE_FAMILIES)
INCIDENTS = quoted(C.INCIDENT_FAMILIES)
HISTORICAL = quoted(C.HISTORICAL_FAMILIES)


def is_event(module: str, name: str) -> Column:
    """Match one exact event identity."""
    return F.expr(f"module = '{module}' AND name = '{name}'")


def event_family() -> Column:
    """Map the exact (module, name) pairs to product families, everything else UNREGISTERED."""
    return F.expr(FAMILY)


def occurrence_bound() -> Column:
    """Release identity was frozen when the event occurred."""
    return F.expr(BOUND)


def is_late(late_after_ms: int = C.LATE_AFTER_MS) -> Column:
    return F.expr(late(late_after_ms))


def valid_sdk_health() -> Column:
    """All three counters present and in range; a null anywhere is invalid."""
    return F.expr(SDK_VALID)


def sdk_dropped() -> Column:
    """The SDK reported at least one dropped event."""
    return F.expr(SDK_DROPPED)


def session_start_valid() -> Column:
    """Explicit session start with schema version 1 and exactly one session."""
    return F.expr(SESSION_START)


def visible_scene() -> Column:
    """The scene text while raw evidence is retained."""
    return F.expr(VISIBLE_SCENE)


def scene_state() -> Column:
    """AVAILABLE / MISSING while raw is kept; EXPIRED / MISSING / RETENTION_UNKNOWN afterwards."""
    return F.expr(SCENE_STATE)
