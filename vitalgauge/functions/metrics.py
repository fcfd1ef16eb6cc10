"""State-bearing metric structs as SQL text: a value never appears without state and reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalgauge import constants as C

FIELDS = (
    ("state", "string"),
    ("value", "double"),
    ("numerator", "bigint"),
    ("denominator", "bigint"),
    ("sample_count", "bigint"),
    ("coverage", "double"),
    ("as_of_ms", "bigint"),
    ("source", "string"),
    ("reason", "string"),
)


def ladder(*rules: tuple[str, str], otherwise: str = "NULL") -> str:
    """First matching rule wins."""
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {otherwise} END"


def lit(text: str) -> str:
    """SQL string literal."""
    return f"'{text}'"


def ratio(part: str, whole: str) -> str:
    """Quotient, null for an empty denominator."""
    return f"try_divide({part}, {whole})"


def metric(
    state: str,
    samples: str,
    as_of_ms: int,
    *,
    value: str = "NULL",
    numerator: str = "NULL",
    denominator: str = "NULL",
    coverage: str = "NULL",
    reason: str = "NULL",
) -> str:
    """One metric struct with fixed field types."""
    parts = dict(
        state=state,
        value=value,
        numerator=numerator,
        denominator=denominator,
        sample_count=samples,
        coverage=coverage,
        as_of_ms=as_of_ms,
        source=lit(C.SOURCE),
        reason=reason,
    )
    body = ", ".join(f"'{name}', cast({parts[name]} AS {kind})" for name, kind in FIELDS)
    return f"named_struct({body})"


def count_metric(count: str, samples: str, as_of_ms: int, quality: str, reason: str) -> str:
    """A count stays visible when degraded and is withheld when there is no usable evidence."""
    withheld = f"{quality} IN ('{C.NO_DATA}', '{C.UNAVAILABLE}')"
    state = ladder(
        (f"{quality} <> '{C.PRESENT}'", quality),
        (f"{count} = 0", lit(C.ZERO)),
        otherwise=lit(C.PRESENT),
    )
    return metric(
        state, samples, as_of_ms, value=f"if({withheld}, NULL, {count})", reason=reason
    )


def coverage_metric(part: str, whole: str, as_of_ms: int, missing_reason: str) -> str:
    """Share of rows carrying an identity; an empty whole is NO_DATA, an empty part UNAVAILABLE."""
    share = ratio(part, whole)
    return metric(
        ladder(
            (f"{whole} = 0", lit(C.NO_DATA)),
            (f"{part} = 0", lit(C.UNAVAILABLE)),
            (f"{part} = {whole}", lit(C.PRESENT)),
            otherwise=lit(C.DEGRADED),
        ),
        whole,
        as_of_ms,
        value=f"if({part} > 0, {share}, NULL)",
        numerator=f"if({whole} > 0, {part}, NULL)",
        denominator=f"if({whole} > 0, {whole}, NULL)",
        coverage=share,
        reason=ladder(
            (f"{whole} = 0 OR {part} = {whole}", "NULL"),
            (f"{part} = 0", lit(missing_reason)),
            otherwise=lit("IDENTITY_COVERAGE_INCOMPLETE"),
        ),
    )


# Parts of the SDK health metric over the counts sdk_rows, sdk_invalid and sdk_drops.
SDK_STATE = ladder(
    ("sdk_rows = 0 OR sdk_invalid > 0", lit(C.UNAVAILABLE)),
    ("sdk_drops > 0", lit(C.DEGRADED)),
    otherwise=lit(C.ZERO),
)
SDK_VALUE = "if(sdk_rows > 0 AND sdk_invalid = 0, sdk_worst_rate, NULL)"
SDK_REASON = ladder(
    ("sdk_rows = 0", lit(C.SDK_HEALTH_REASON)),
    ("sdk_invalid > 0", lit("SDK_HEALTH_FIELDS_OR_SAMPLE_INVALID")),
    ("sdk_drops > 0", lit("SDK_REPORTED_DROPS")),
)


def sdk_health_metric(as_of_ms: int) -> str:
    """No rows or any invalid row means UNAVAILABLE; otherwise the worst reported drop rate."""
    return metric(SDK_STATE, "sdk_rows", as_of_ms, value=SDK_VALUE, reason=SDK_REASON)


def continuity(rows: str = "true") -> str:
    """Aggregate: why the distinct installations of these rows cannot be counted, or null.

    Pseudonyms of two key epochs cannot be joined, and one without an epoch cannot be placed.
    """
    known = f"{rows} AND installation_hmac IS NOT NULL"
    version = "installation_hmac_key_version"
    return (
        f"CASE WHEN count_if({known} AND {version} IS NULL) > 0"
        " THEN 'INSTALLATION_HMAC_VERSION_MISSING'"
        f" WHEN min({version}) FILTER (WHERE {known}) <> max({version}) FILTER (WHERE {known})"
        " THEN 'INSTALLATION_HMAC_CONTINUITY_BREAK' END"
    )


def flat(struct: str) -> list[Column]:
    """Select one metric struct as plain columns, doubles rounded for comparison."""
    return [
        F.expr(f"round({struct}.{name}, 6) AS {name}" if kind == "double" else f"{struct}.{name}")
        for name, kind in FIELDS
    ]


def long_form(names, *keep: str) -> tuple[str, ...]:
    """Select list turning the named metric columns into rows ``(metric, m)``."""
    pairs = ", ".join(f"named_struct('metric', '{n}', 'm', {n})" for n in names)
    return (*keep, f"inline(array({pairs}))")
