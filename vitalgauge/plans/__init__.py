"""Telemetry mapping of the shared tables, registered queries and their SQL counterparts."""
