"""Normalization: registered fields to typed values with one state per field.

The registry is a contract of fixed size (one row per known event), so each event joins it by
broadcast and every field is evaluated inside the row. Nothing is shuffled.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgauge import catalog
from vitalgauge import constants as C
from vitalgauge.functions.events import FAMILY, quoted
from vitalgauge.functions.text import parse_double, parse_integer
from vitalgauge.session import small_table

_WHOLE = quoted(("BYTE", "SHORT", "INT", "LONG"))
_REAL = quoted(("FLOAT", "DOUBLE"))
_NON_FINITE = quoted(("NaN", "Infinity", "-Infinity"))
_DEFS = "map<string,struct<type:string,unit:string,indexed:boolean,allowed:array<string>>>"


def definitions_by_event(df: DataFrame) -> DataFrame:
    """Registry folded to one row per event; at most as many rows as there are known events."""
    grouped = defaultdict(dict)
    for f in catalog.registry():
        grouped[(f.module, f.name)][f.field] = {
            "type": f.type,
            "unit": f.unit,
            "indexed": f.indexed,
            "allowed": list(f.allowed) if f.type != "boolean" else [],
        }
    rows = [(module, name, list(defs.items())) for (module, name), defs in grouped.items()]
    return small_table(df.sparkSession, rows, f"module string, name string, defs {_DEFS}")


def out_of_bounds(value: str, unit: str, event_ms: str) -> str:
    """SQL of the physical bounds; a unit outside the list (HTTP status, none) has no bound."""
    return (
        f"coalesce(CASE WHEN {unit} IN {quoted(catalog.NON_NEGATIVE_UNITS)} AND {value} < 0"
        f" THEN true WHEN {unit} = 'ratio' THEN {value} > 1 WHEN {unit} = '%' THEN {value} > 100"
        f" WHEN {unit} = 'ratio_delta' THEN {value} NOT BETWEEN -1 AND 1"
        f" WHEN {unit} = 'ms_epoch' THEN {value} <= 0"
        f" OR {value} > {event_ms} + {C.MAX_FUTURE_SKEW_MS} END, false)"
    )


# Wire classes: whole numbers, finite reals, booleans, null; everything else is text.
_IS_REAL = f"(x.wire IN {_REAL} AND x.raw NOT IN {_NON_FINITE})"
_IS_TEXT = (
    f"(x.wire NOT IN ('BOOLEAN', 'NULL') AND x.wire NOT IN {_WHOLE} AND NOT {_IS_REAL})"
)
_DOUBLE = parse_double("x.raw")
# First pass over the sent fields that are registered: definition, raw value and wire type.
_FETCH = (
    "transform(filter(map_entries(fields), e -> map_contains_key(defs, e.key)), e ->"
    " named_struct('field', e.key, 'd', try_element_at(defs, e.key), 'raw', e.value, 'wire',"
    " coalesce(try_element_at(field_types, e.key), 'STRING')))"
)
# Second pass: the typed reading; at most the one of the registered type is not null.
_TYPE = (
    "transform(fetched, x -> named_struct('field', x.field, 'd', x.d,"
    f" 'i', CASE WHEN x.d.type <> 'integer' OR x.wire = 'BOOLEAN' OR x.raw IS NULL THEN NULL"
    f" WHEN {_IS_REAL} THEN if({_DOUBLE} = floor({_DOUBLE}) AND abs({_DOUBLE}) <"
    f" 9.223372036854775e18D, cast({_DOUBLE} AS bigint), NULL) ELSE {parse_integer('x.raw')} END,"
    f" 'n', if(x.d.type = 'number' AND x.wire <> 'BOOLEAN' AND x.raw IS NOT NULL, {_DOUBLE}, NULL),"
    f" 'b', if(x.d.type = 'boolean' AND ({_IS_TEXT} OR x.wire = 'BOOLEAN')"
    " AND x.raw IN ('true', 'false'), x.raw = 'true', NULL),"
    f" 's', if(x.d.type = 'string' AND {_IS_TEXT}, x.raw, NULL)))"
)


def _state(event_ms: str) -> str:
    # Third pass: one state per field, from the typed reading.
    number = "coalesce(cast(y.i AS double), y.n)"
    return (
        "transform(typed, y -> named_struct('field', y.field, 'indexed', y.d.indexed,"
        f" 'state', CASE WHEN coalesce(cast(y.i AS string), cast(y.n AS string), cast(y.b AS string), y.s)"
        f" IS NULL THEN '{C.INVALID}'"
        " WHEN size(y.d.allowed) > 0 AND NOT array_contains(y.d.allowed,"
        f" coalesce(cast(y.i AS string), y.s)) THEN '{C.UNKNOWN}'"
        f" WHEN {out_of_bounds(number, 'y.d.unit', event_ms)} THEN '{C.INVALID}'"
        f" ELSE '{C.AVAILABLE}' END, 'i', y.i, 'n', y.n, 'b', y.b, 's', y.s))"
    )


def _pick(key: str, name: str) -> str:
    return (
        f"map_from_entries(transform(filter(observed, o -> o.state = '{C.AVAILABLE}'"
        f" AND o.{key} IS NOT NULL), o -> struct(o.field, o.{key}))) AS {name}"
    )


def normalize_fields(events: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """Add typed maps, field states, the indexed field list and the unknown field count.

    ``events`` needs ``module``, ``name``, ``fields`` (text by name) and ``field_types`` (wire type
    by name, null for untyped protocols).
    """
    defs = F.broadcast(definitions_by_event(events))
    return (
        events.join(defs, ["module", "name"], "left")
        .withColumn("defs", F.expr(f"coalesce(defs, cast(map() AS {_DEFS}))"))
        .withColumn("fetched", F.expr(_FETCH))
        .withColumn("typed", F.expr(_TYPE))
        .withColumn("observed", F.expr(_state(timestamp)))
        .selectExpr(
            *events.columns,
            _pick("i", "ints"),
            _pick("n", "nums"),
            _pick("b", "bools"),
            _pick("s", "strs"),
            "map_from_entries(concat(transform(observed, o -> struct(o.field AS f, o.state AS s)),"
            " transform(filter(map_keys(defs), d -> NOT map_contains_key(fields, d)),"
            f" d -> struct(d AS f, '{C.MISSING}' AS s)))) AS field_states",
            f"transform(filter(observed, o -> o.indexed AND o.state = '{C.AVAILABLE}'),"
            " o -> o.field) AS indexed_fields",
            "cast(size(fields) - size(observed) AS int) AS unknown_field_count",
        )
    )


# Value of the field named by the column ``field``, from whichever typed map holds it.
TEXT_VALUE = (
    "coalesce(cast(try_element_at(ints, field) AS string), cast(try_element_at(bools, field) AS"
    " string), try_element_at(strs, field))"
)
NUMBER_VALUE = "coalesce(try_element_at(nums, field), cast(try_element_at(ints, field) AS double))"


def field_values(normalized: DataFrame, *keys: str) -> DataFrame:
    """Long form: one row per event and registered field with state and value."""
    return normalized.select(
        *keys, "ints", "nums", "bools", "strs", F.explode("field_states").alias("field", "state")
    ).selectExpr(
        *keys, "field", "state", f"{TEXT_VALUE} AS text_value",
        "try_element_at(nums, field) AS number_value",
    )


def normalize_categories(normalized: DataFrame, key: str) -> DataFrame:
    """State of every fixed category; a value outside the allowed set is UNKNOWN and dropped."""
    categories = F.broadcast(catalog.category_registry(normalized.sparkSession))
    return normalized.join(
        categories.select("module", "name", "field"), ["module", "name"]
    ).selectExpr(
        key, "field", "try_element_at(field_states, field) AS state", f"{TEXT_VALUE} AS label"
    )


def check_unit_bounds(
    observations: DataFrame, value: str, unit: str, event_ms: str
) -> DataFrame:
    """Flag values that violate the physical bounds of their unit."""
    return observations.withColumn(
        "in_bounds", F.expr(f"NOT {out_of_bounds(value, unit, event_ms)}")
    )


def indexed_attributes(normalized: DataFrame, key: str) -> DataFrame:
    """Registered fields flagged for indexing, with their values."""
    return normalized.select(
        key, "ints", "nums", "bools", "strs", F.explode("indexed_fields").alias("field")
    ).selectExpr(
        key,
        "field",
        f"{NUMBER_VALUE} AS number_value",
        "coalesce(cast(try_element_at(bools, field) AS string), try_element_at(strs, field))"
        " AS text_value",
    )


def classify_event_family(events: DataFrame) -> DataFrame:
    """Add the product family of the exact event identity."""
    return events.withColumn("event_family", F.expr(FAMILY))


def resolve_occurrence_time(normalized: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """A process exit carries its own valid exit time; every other event uses its timestamp."""
    usable = (
        "module = 'crash' AND name = 'app_exit'"
        " AND coalesce(try_element_at(ints, 'exitTimestamp') > 0, false)"
    )
    return normalized.selectExpr(
        "*",
        f"if({usable}, try_element_at(ints, 'exitTimestamp'), {timestamp})"
        " AS resolved_occurrence_ms",
        f"{timestamp} AS resolved_collection_ms",
        f"if({usable}, 'fields.exitTimestamp', 'event.timestamp') AS timestamp_source",
    )


def field_availability(states: Column, raw_pruned: Column, *retained: Column) -> Column:
    """AVAILABLE fields that retention no longer keeps become EXPIRED; other states stay."""

    def state_of(key: Column, state: Column) -> Column:
        kept = F.lit(False)
        for values in retained:
            kept = kept | F.coalesce(F.map_contains_key(values, key), F.lit(False))
        return F.when(raw_pruned & (state == C.AVAILABLE) & ~kept, C.EXPIRED).otherwise(state)

    return F.transform_values(states, state_of)


def renormalize_backfill(
    inbox: DataFrame, version: int = C.NORMALIZATION_VERSION, timestamp: str = "event_timestamp_ms"
) -> DataFrame:
    """Recompute rows of an older normalization whose raw evidence is kept.

    Identity columns are untouched and a fingerprint is only filled in where it was null. The
    result holds the changed rows; write it over their partitions.
    """
    from vitalgauge.operators.fingerprints import incident_fingerprint

    derived = ["ints", "nums", "bools", "strs", "field_states", "indexed_fields",
               "unknown_field_count", "normalization_version"]
    stale = inbox.filter(
        (F.col("normalization_version") < version) & F.col("raw_pruned_ms").isNull()
    )
    fresh = normalize_fields(stale.drop(*derived), timestamp=timestamp)
    computed = incident_fingerprint(fresh)
    return (
        computed.withColumn("normalization_version", F.lit(version))
        .withColumn("_filled", F.col("incident_fingerprint").isNull())
        .withColumn(
            "raw_incident_fingerprint",
            F.when(
                F.col("_filled") & F.col("computed_fingerprint").isNotNull(),
                F.col("computed_fingerprint"),
            ).otherwise(F.col("raw_incident_fingerprint")),
        )
        .withColumn(
            "incident_fingerprint",
            F.coalesce("incident_fingerprint", "computed_fingerprint"),
        )
        .drop("_filled", "computed_fingerprint")
    )


def canonicalize_issues(inbox: DataFrame, jobs: DataFrame) -> DataFrame:
    """Keep the raw fingerprint and publish the symbolized Java fingerprint where a job is done."""
    done = jobs.filter(
        (F.col("job_type") == "java")
        & (F.col("job_status") == "symbolized")
        & F.col("fingerprint_sha256").isNotNull()
    ).select(F.col("inbox_event_id").alias("id"), "fingerprint_sha256")
    return (
        inbox.withColumn("raw_incident_fingerprint", F.col("incident_fingerprint"))
        .join(done, "id", "left")
        .withColumn(
            "incident_fingerprint",
            F.when(
                F.col("incident_fingerprint").isNotNull(),
                F.coalesce("fingerprint_sha256", "incident_fingerprint"),
            ),
        )
        .drop("fingerprint_sha256")
    )
