"""Incident fingerprints from stack evidence, hashed over a canonical JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgauge.functions.events import FAMILY
from vitalgauge.functions.text import basename, json_string, lines, lower_escapes, raw, strip

MAX_LINES = 256
# Patterns that define the fingerprint (fixed values).
_FRAME = raw(r"#\d+\s+pc\s+([0-9a-fA-F]+)\s+(\S+)(.*)")
_ADDRESS = raw(r"(?:0x)?[0-9a-fA-F]{6,}")
_LINE_NUMBER = raw(r":\d+\)")


def _field(name: str) -> str:
    return f"try_element_at(fields, '{name}')"


def fingerprint_java_anr(events: DataFrame) -> DataFrame:
    """Add the fingerprint of Java crashes and ANRs from their first non-empty stack field.

    The scrubbed, non-blank lines are hashed; without any line there is no fingerprint.
    """
    evidence = (
        f"CASE {FAMILY} WHEN 'JAVA_CRASH' THEN nullif({_field('stackTrace')}, '')"
        f" WHEN 'ANR' THEN coalesce(nullif({_field('mainThreadStack')}, ''),"
        f" nullif({_field('stackSamples')}, '')) END"
    )
    scrubbed = (
        f"regexp_replace(regexp_replace({strip('line')}, {_ADDRESS}, '<addr>'),"
        f" {_LINE_NUMBER}, ':<line>)')"
    )
    kept = (
        f"filter(transform(slice({lines('evidence')}, 1, {MAX_LINES}), line -> {scrubbed}),"
        " line -> line <> '')"
    )
    return (
        events.withColumn("evidence", F.expr(evidence))
        .withColumn("kept_lines", F.expr(kept))
        .withColumn("canonical", F.expr("if(size(kept_lines) > 0, to_json(kept_lines), NULL)"))
        .withColumn("stack_fingerprint", F.expr(f"sha2({lower_escapes('canonical')}, 256)"))
        .drop("evidence", "kept_lines", "canonical")
    )


def fingerprint_native(events: DataFrame) -> DataFrame:
    """Add the fingerprint of native crashes and tombstones: family, signal and frames.

    Typed frames win over the parsed backtrace. Load bias differs per process start and is left
    out of the identity.
    """
    pc = f"regexp_replace(lower(regexp_extract(line, {_FRAME}, 1)), '^0+(?=.)', '')"
    parsed = (
        f"transform(filter(slice({lines('backtrace')}, 1, {MAX_LINES}), line -> line rlike"
        f" {_FRAME}), line -> array({pc}, {basename(f'regexp_extract(line, {_FRAME}, 2)')},"
        f" {strip(f'regexp_extract(line, {_FRAME}, 3)')}))"
    )
    frames = "if(size(parsed_frames) > 0, to_json(parsed_frames), NULL)"
    if "native_frames" in events.columns:
        typed = (
            "transform(native_frames, f -> named_struct('abi', f.abi, 'module_build_id',"
            " f.module_build_id, 'module_name', f.module_name, 'module_relative_pc',"
            " f.module_relative_pc))"
        )
        frames = f"if(size(native_frames) > 0, to_json({typed}), {frames})"
    signal = _field("signal")
    signal_json = (
        f"CASE WHEN {signal} IS NULL THEN 'null' WHEN coalesce(try_element_at(field_types,"
        f" 'signal'), 'STRING') IN ('BYTE', 'SHORT', 'INT', 'LONG') THEN {signal}"
        f" ELSE {json_string(signal)} END"
    )
    canonical = (
        f"""concat('{{"family":"', family, '","frames":', {frames}, ',"signal":',"""
        f" {signal_json}, '}}')"
    )
    return (
        events.withColumn("family", F.expr(FAMILY))
        .withColumn(
            "backtrace",
            F.expr(f"if(family IN ('NATIVE_CRASH', 'NATIVE_TOMBSTONE'), {_field('backtrace')}, NULL)"),
        )
        .withColumn("parsed_frames", F.expr(parsed))
        .withColumn(
            "canonical",
            F.expr(f"if(family IN ('NATIVE_CRASH', 'NATIVE_TOMBSTONE'), {canonical}, NULL)"),
        )
        .withColumn("native_fingerprint", F.expr(f"sha2({lower_escapes('canonical')}, 256)"))
        .drop("family", "backtrace", "parsed_frames", "canonical")
    )


def incident_fingerprint(events: DataFrame) -> DataFrame:
    """Add ``computed_fingerprint`` for every incident family."""
    return (
        fingerprint_native(fingerprint_java_anr(events))
        .withColumn("computed_fingerprint", F.coalesce("stack_fingerprint", "native_fingerprint"))
        .drop("stack_fingerprint", "native_fingerprint")
    )
