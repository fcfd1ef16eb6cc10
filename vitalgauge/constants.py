"""Fixed values of the telemetry contract: states, reasons, limits, event identities."""

from __future__ import annotations

# Metric and evidence states (fixed values).
PRESENT = "PRESENT"
ZERO = "ZERO"
NO_DATA = "NO_DATA"
UNAVAILABLE = "UNAVAILABLE"
UNKNOWN_COVERAGE = "UNKNOWN_COVERAGE"
DEGRADED = "DEGRADED"
LATE = "LATE"
AVAILABLE = "AVAILABLE"
MISSING = "MISSING"
INVALID = "INVALID"
UNKNOWN = "UNKNOWN"
EXPIRED = "EXPIRED"
RETENTION_UNKNOWN = "RETENTION_UNKNOWN"
NOT_APPLICABLE = "NOT_APPLICABLE"

# Identity provenance (fixed values).
OCCURRENCE_BOUND = "OCCURRENCE_BOUND"
BATCH_DECLARED = "BATCH_DECLARED"
REQUEST_DECLARED = "REQUEST_DECLARED"
ABSENT = "ABSENT"

# Reasons (fixed values).
OCCURRENCE_REASON = "OCCURRENCE_IDENTITY_NOT_PROVIDED"
INSTALLATION_REASON = "INSTALLATION_IDENTITY_NOT_PROVIDED"
SESSION_REASON = "SESSION_ID_NOT_PROVIDED"
SDK_HEALTH_REASON = "SDK_HEALTH_NOT_PROVIDED"
DEVICE_REASON = "STANDARD_DEVICE_RESOURCE_NOT_PROVIDED"
OS_REASON = "STANDARD_OS_RESOURCE_NOT_PROVIDED"

SOURCE = "durable_inbox"
NORMALIZATION_VERSION = 4

# Limits (fixed values).
MAX_EVENT_ID_BYTES = 128
MAX_IDENTIFIER_BYTES = 256
MAX_MAP_ENTRIES = 256
MAX_MAP_KEY_BYTES = 128
MAX_MAP_VALUE_BYTES = 8_192
MAX_EVENT_JSON_BYTES = 262_144
MAX_FUTURE_SKEW_MS = 600_000
MAX_NATIVE_FRAMES = 256
MAX_SPAN_MILLIS = 18_446_744_073_709
CLOCK_TOLERANCE_MS = 5

# Defaults of the reports; every operator takes them as arguments.
LATE_AFTER_MS = 900_000
MIN_INSTALLATIONS = 100
MIN_SDK_COVERAGE = 1.0
MAX_BUCKETS = 24

# Exact event identity -> product family (fixed values).
EVENT_FAMILIES = {
    ("crash", "java_crash"): "JAVA_CRASH",
    ("crash", "native_crash"): "NATIVE_CRASH",
    ("crash", "tombstone_crash"): "NATIVE_TOMBSTONE",
    ("anr", "anr_detected"): "ANR",
    ("crash", "app_exit"): "APP_EXIT",
    ("core", "sdk_health"): "SDK_HEALTH",
    ("core", "session_start"): "SESSION_START",
}
LIVE_FAMILIES = ("JAVA_CRASH", "NATIVE_CRASH", "ANR")
INCIDENT_FAMILIES = (*LIVE_FAMILIES, "NATIVE_TOMBSTONE")
HISTORICAL_FAMILIES = ("APP_EXIT", "NATIVE_TOMBSTONE")

# Count metrics an alert rule may name -> counted event (fixed values).
ALERT_COUNT_EVENTS = {
    "crash.count": ("crash", "java_crash"),
    "native_crash.count": ("crash", "native_crash"),
    "native_tombstone.count": ("crash", "tombstone_crash"),
    "anr.count": ("anr", "anr_detected"),
    "network.error_count": ("network", "network_error"),
}

INBOX_STATES = ("pending", "processing", "awaiting_symbols", "delivered", "dead_letter")
LIVE_STATUSES = ("pending", "processing", "awaiting_symbols")
UNFINISHED_SYMBOL_STATUSES = ("pending", "processing", "symbols_missing")
