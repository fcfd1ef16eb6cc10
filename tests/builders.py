"""Rows that several test modules build: column types, defaults and the fields of a sound health report."""

from __future__ import annotations

NOW = 1_704_700_000_000
INBOX = {
    "id": "bigint", "event_id": "string", "tenant_id": "string", "app_id": "string",
    "environment": "string", "app_version": "string", "app_build": "string",
    "version_code": "string", "variant": "string", "release_identity_quality": "string",
    "installation_hmac": "string", "installation_hmac_key_version": "string",
    "installation_identity_quality": "string", "session_hmac": "string",
    "session_hmac_key_version": "string", "session_identity_quality": "string",
    "occurrence_timestamp_ms": "bigint", "received_ms": "bigint", "module": "string",
    "name": "string", "kind": "string", "severity": "string", "incident_fingerprint": "string",
    "scene": "string", "device_model": "string", "os_version": "string",
    "schema_version": "string", "protocol": "string", "inbox_status": "string",
    "raw_pruned_ms": "bigint", "retained_scene_state": "string",
    "fields": "map<string,string>", "field_types": "map<string,string>",
}
DEFAULTS = {
    "tenant_id": "t", "app_id": "a", "environment": "e", "app_version": "2.0.0",
    "release_identity_quality": "OCCURRENCE_BOUND", "installation_hmac": "i1",
    "installation_hmac_key_version": "v1", "installation_identity_quality": "OCCURRENCE_BOUND",
    "session_identity_quality": "ABSENT", "occurrence_timestamp_ms": NOW, "module": "core",
    "name": "tick", "kind": "METRIC", "severity": "INFO", "schema_version": "3",
    "protocol": "p", "inbox_status": "pending", "fields": {}, "field_types": {},
}
SDK_OK = {"emitCount": "10", "dropCount": "0", "dropRate": "0.0"}


def event(module: str, name: str, **overrides) -> dict:
    return {"module": module, "name": name, **overrides}
