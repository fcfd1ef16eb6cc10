"""From wire batches to stored rows: every ingest rule in order, and the identity index that replays are found by.

``prepare`` is one lazy plan without a shuffle but the small join with stored identities: decode, validate, resolve and
pseudonymize identities, find leaks, scrub, hash, bound the size, normalize, resolve the time, fingerprint. Plaintext ids
never leave it. ``settle`` decides which batches are taken.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalgauge import constants as C
from vitalgauge.operators import identity as ID
from vitalgauge.operators import ingest as IN
from vitalgauge.operators.fingerprints import incident_fingerprint
from vitalgauge.operators.normalize import normalize_fields, resolve_occurrence_time
from vitalgauge.sources.line_batches import decode_line_batches
from vitalgauge.sources.protobuf_batches import OCCURRENCE

# A wire batch: who sent it (authenticated scope), what the request declared, when it came, and its bytes.
BATCH_SCHEMA = (
    "request_id string, tenant_id string, app_id string, environment string, schema_version string, sdk_version string,"
    " protocol string, declared_app_version string, declared_app_build string, declared_version_code string,"
    " declared_variant string, declared_installation_id string, received_ms bigint, body binary"
)
AUTHENTICATED, EVENT_DECLARED = "AUTHENTICATED", "EVENT_DECLARED"

# The stored row (fixed names): scope, provenance, pseudonyms, times, payload, normalized values, fingerprints.
STORED_SCHEMA = (
    "tenant_id string, event_id string, app_id string, environment string, schema_version string, sdk_version string,"
    " app_version string, app_build string, version_code string, variant string, protocol string,"
    " scope_identity_quality string, release_identity_quality string, installation_identity_quality string,"
    " installation_hmac string, installation_hmac_key_version string, session_identity_quality string, session_hmac string,"
    " session_hmac_key_version string, device_model string, os_version string, event_timestamp_ms bigint,"
    " occurrence_timestamp_ms bigint, collection_timestamp_ms bigint, timestamp_quality string, module string, name string,"
    " kind string, severity string, priority string, process_name string, thread_name string, scene string,"
    " foreground boolean, fields map<string,string>, field_types map<string,string>, global_context map<string,string>,"
    f" extras map<string,string>, unknown map<string,string>, occurrence {OCCURRENCE}, payload_sha256 string,"
    " payload_size_bytes bigint, normalization_version int, ints map<string,bigint>, nums map<string,double>,"
    " bools map<string,boolean>, strs map<string,string>, field_states map<string,string>, indexed_fields array<string>,"
    " unknown_field_count int, incident_fingerprint string, raw_incident_fingerprint string, request_id string,"
    " batch_id string, event_index int, received_ms bigint, inbox_status string, raw_pruned_ms bigint, retained_scene_state string, attempt_count int"
)
STORED = tuple(part.split()[0] for part in STORED_SCHEMA.split(", "))
# What stored rows must agree in, apart from the pseudonyms, which are compared under the stored key version.
FACTS = tuple(c for c in IN.SIGNATURE if c not in ("installation_hmac", "session_hmac")) + ("app_id", "environment")
PSEUDONYMS = (
    "installation_hmac", "installation_hmac_key_version", "session_hmac", "session_hmac_key_version",
)

FILTER_BITS = 4096 * 8  # of one bitmap


@dataclass(frozen=True)
class IdentityLayout:
    """Buckets of a date in the identity index, and bitmaps of a bucket; fixed when the index is made.

    A bitmap tells ids apart while it has seen some thousands: choose buckets * parts as a day's ids divided by 4,000.
    With more ids the bitmaps only open more partitions than needed; nothing is missed.
    """

    buckets: int = 16
    parts: int = 16


def decode_batches(batches: DataFrame, max_events: int = 1_000) -> DataFrame:
    """Events of line batches with the request's columns; ``decode_error`` as in ``decode_line_batches``."""
    named = batches.withColumn("batch_id", F.col("request_id"))
    return decode_line_batches(named, max_events).withColumn("occurrence", F.expr(f"cast(NULL AS {OCCURRENCE})"))


def hashed_ids(layout: IdentityLayout) -> list:
    """Columns id_bucket, id_part and id_bit of an event id: its bucket, the bitmap inside, and the bit in that."""
    seeds = [F.xxhash64("tenant_id", "event_id", F.lit(i)) for i in range(3)]
    return [
        F.pmod(seeds[0], F.lit(layout.buckets)).cast("int").alias("id_bucket"),
        F.pmod(seeds[1], F.lit(layout.parts)).cast("int").alias("id_part"),
        F.pmod(seeds[2], F.lit(FILTER_BITS)).cast("bigint").alias("id_bit"),
    ]


IDENTITY_SCHEMA = (
    "tenant_id string, event_id string, "
    + ", ".join(f"{c} string" for c in (*FACTS, *PSEUDONYMS))
    + ", id_date date, id_bucket int"
)
FILTER_SCHEMA = "id_date date, id_bucket int, id_part int, bits binary"


def identities_of(stored: DataFrame, layout: IdentityLayout) -> DataFrame:
    """Rows of the identity index for newly stored events, by the date of the event."""
    date = F.to_date(F.timestamp_millis("event_timestamp_ms")).alias("id_date")
    return stored.select("tenant_id", "event_id", *FACTS, *PSEUDONYMS, date, hashed_ids(layout)[0])


def filters_of(identities: DataFrame, layout: IdentityLayout) -> DataFrame:
    """One bitmap of a fixed size for each (date, bucket, part) of new identities."""
    _, part, bit = hashed_ids(layout)
    return (
        identities.select("id_date", "id_bucket", part, bit)
        .groupBy("id_date", "id_bucket", "id_part")
        .agg(F.bitmap_construct_agg("id_bit").alias("bits"))
    )


def merged_filters(filters: DataFrame) -> DataFrame:
    """One bitmap for each (date, bucket, part) again, after several commits."""
    return filters.groupBy("id_date", "id_bucket", "id_part").agg(F.bitmap_or_agg("bits").alias("bits"))


def partitions_to_open(ids: DataFrame, filters: DataFrame, layout: IdentityLayout) -> dict[str, list[int]]:
    """Dates and their buckets whose bitmaps have the bit of at least one id: never too few, rarely too many.

    The result is at most as large as the list of the index's partitions, which the driver holds anyway.
    """
    wanted = ids.select(*hashed_ids(layout)).distinct()
    byte = "cast(conv(hex(substring(bits, cast(id_bit div 8 + 1 AS int), 1)), 16, 10) AS int)"
    hit = filters.join(wanted, ["id_bucket", "id_part"]).where(f"({byte} & shiftleft(1, cast(id_bit % 8 AS int))) <> 0")
    found: dict[str, list[int]] = {}
    for row in hit.select(F.col("id_date").cast("string").alias("day"), "id_bucket").distinct().collect():
        found.setdefault(row.day, []).append(row.id_bucket)
    return found


def opened(identities: DataFrame, partitions: dict[str, list[int]]) -> DataFrame:
    """The identities of these partitions only; the filter is on partition columns, so other files aren't listed or read."""
    if not partitions:
        return identities.where(F.lit(False))
    either = " OR ".join(
        f"(id_date = DATE'{day}' AND id_bucket IN ({', '.join(map(str, sorted(buckets)))}))" for day, buckets in sorted(partitions.items())
    )
    days = ", ".join(f"DATE'{day}'" for day in sorted(partitions))
    return identities.where(f"id_date IN ({days}) AND ({either})")


def prepare(
    batches: DataFrame,
    keys: DataFrame,
    active_version: str,
    stored: DataFrame,
    decode: Callable[[DataFrame], DataFrame] = decode_batches,
    max_event_bytes: int = C.MAX_EVENT_JSON_BYTES,
) -> DataFrame:
    """Stored rows of all events, with ``error_code`` and ``stored_state`` (NEW, SAME or CLASH).

    ``stored`` has the identities that may be met again. A replay is compared under the key version of the stored row, so
    a rotated key makes no conflict. Rows with an error keep nothing of the event but batch, place and code.
    """
    events = decode(batches)
    valid = IN.validate_events(events, "received_ms").withColumn("error_code", F.coalesce("decode_error", "error_code"))
    known = ID.resolve_identity(valid)
    leaks = ID.reject_identity_leak(known).withColumn(
        "error_code", F.expr("coalesce(error_code, if(identity_leak, 'PRIVACY_IDENTITY_CONFLICT', NULL))")
    )
    hashed = IN.event_size_limit(IN.canonical_payload_hash(ID.scrub_identifiers(leaks)), max_event_bytes).withColumn(
        "error_code", F.expr("coalesce(error_code, if(too_large, 'PAYLOAD_TOO_LARGE', NULL))")
    )
    met = _compared(hashed, stored, keys)
    pseudonymous = ID.pseudonymize_ids(met, keys, active_version)
    timed = resolve_occurrence_time(normalize_fields(pseudonymous, "timestamp"), "timestamp")
    timed = timed.withColumn("native_frames", F.col("occurrence.native_frames"))
    rows = incident_fingerprint(timed).selectExpr(
        "* EXCEPT (computed_fingerprint, occurrence)",
        "occurrence.device_model AS device_model",
        "occurrence.os_version AS os_version",
        # installation and session id of the snapshot aren't stored
        "if(occurrence IS NULL, NULL, named_struct("
        + ", ".join(
            f"'{f}', {'cast(NULL AS string)' if f in ('installation_id', 'session_id') else 'occurrence.' + f}"
            for f in _occurrence_fields(timed)
        )
        + ")) AS occurrence",
        "timestamp AS event_timestamp_ms",
        "resolved_occurrence_ms AS occurrence_timestamp_ms",
        "resolved_collection_ms AS collection_timestamp_ms",
        f"'{AUTHENTICATED}' AS scope_identity_quality",
        f"'{EVENT_DECLARED}' AS timestamp_quality",
        f"{C.NORMALIZATION_VERSION} AS normalization_version",
        "computed_fingerprint AS incident_fingerprint",
        "computed_fingerprint AS raw_incident_fingerprint",
        "'pending' AS inbox_status",
        "cast(NULL AS bigint) AS raw_pruned_ms",
        "cast(NULL AS string) AS retained_scene_state",
        "0 AS attempt_count",
    )
    always = ("request_id", "batch_id", "event_index", "tenant_id", "received_ms")
    return rows.selectExpr(
        "error_code",
        "if(error_code IS NULL, stored_state, NULL) AS stored_state",
        *[c if c in always else f"if(error_code IS NULL, {c}, NULL) AS {c}" for c in STORED],
    )


def _occurrence_fields(df: DataFrame) -> list[str]:
    return df.schema["occurrence"].dataType.names


def _compared(events: DataFrame, stored: DataFrame, keys: DataFrame) -> DataFrame:
    """Add ``stored_state`` of each event."""
    kept = stored.select(
        "tenant_id", "event_id", F.struct(*FACTS).alias("_facts"), *[F.col(c).alias(f"_{c}") for c in PSEUDONYMS]
    )
    joined = events.join(kept, ["tenant_id", "event_id"], "left")

    def same(kind: str, domain: str) -> str:
        digest = ID.hmac_sql(domain, "tenant_id", f"{kind}_plaintext", f"_{kind}_ipad", f"_{kind}_opad")
        return (
            f"if({kind}_plaintext IS NULL, _{kind}_hmac IS NULL AND _{kind}_hmac_key_version IS NULL,"
            f" coalesce({digest} = _{kind}_hmac, false))"
        )

    domains = {"installation": ID.INSTALLATION_DOMAIN, "session": ID.SESSION_DOMAIN}
    for kind in domains:
        ring = keys.toDF(f"_{kind}_hmac_key_version", f"_{kind}_ipad", f"_{kind}_opad")
        joined = joined.join(F.broadcast(ring), f"_{kind}_hmac_key_version", "left")
    agree = " AND ".join([f"{c} <=> _facts.{c}" for c in FACTS] + [same(*pair) for pair in domains.items()])
    return joined.selectExpr(*events.columns, f"CASE WHEN _facts IS NULL THEN 'NEW' WHEN {agree} THEN 'SAME' ELSE 'CLASH' END AS stored_state")


def quarantined(prepared: DataFrame) -> DataFrame:
    """One row for each batch with a bad event: the first one's place and code."""
    broken = "error_code IS NOT NULL"
    return (
        prepared.groupBy("tenant_id", "request_id", "batch_id", "received_ms")
        .agg(
            F.count("*").alias("event_count"),
            F.expr(f"min(event_index) FILTER (WHERE {broken}) AS first_bad_index"),
            F.expr(f"min_by(error_code, event_index) FILTER (WHERE {broken}) AS batch_error"),
        )
        .filter("first_bad_index IS NOT NULL")
    )


def settle(prepared: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Events of the batches that are taken, and (tenant, batch, event, conflict) of those that aren't.

    Batches count in order of arrival (received_ms, request_id). One conflict rejects a batch: an id with two contents
    inside it (BATCH), one stored with another content (STORED), or one that an earlier batch, itself taken, has with
    another content (EARLIER). Only ids with several contents enter the rounds that decide the last kind; each round
    decides at least the earliest open batch of every id. ``keep`` stores a table between rounds.
    """
    bad = quarantined(prepared).select("request_id")
    signature = F.sha2(F.to_json(F.struct(*IN.SIGNATURE, "app_id", "environment")), 256)
    sound = prepared.join(bad, "request_id", "left_anti").withColumn("content", signature)
    place = F.struct("received_ms", "request_id").alias("place")
    contents = keep(
        sound.groupBy("tenant_id", "request_id", "batch_id", "event_id", place).agg(
            F.min("content").alias("content"), F.max("content").alias("other"), F.bool_or(F.col("stored_state") == "CLASH").alias("clash")
        ),
        "contents",
    )
    columns = ["tenant_id", "request_id", "batch_id", "event_id", "conflict"]
    outright = contents.select(
        "tenant_id", "request_id", "batch_id", "event_id",
        F.expr("if(content <> other, 'BATCH', if(clash, 'STORED', NULL)) AS conflict"),
    ).where("conflict IS NOT NULL")
    several = (
        contents.groupBy("tenant_id", "event_id")
        .agg(F.min("content").alias("low"), F.max("content").alias("high"))
        .where("low <> high")
        .select("tenant_id", "event_id")
    )
    # all rows, also of batches without such ids, can be rejected outright; only these ids can reject each other
    open_rows = contents.join(several, ["tenant_id", "event_id"]).join(outright.select("request_id").distinct(), "request_id", "left_anti")
    open_rows = keep(open_rows.select("tenant_id", "request_id", "batch_id", "event_id", "place", "content", F.lit(False).alias("taken")), "open")
    earlier_conflicts = []
    before = Window.partitionBy("tenant_id", "event_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)

    def differs(column: str, only: str = "true"):
        chosen = F.when(F.expr(only), F.col(column))
        return F.coalesce((F.min(chosen).over(before) != F.col(column)) | (F.max(chosen).over(before) != F.col(column)), F.lit(False))

    while not open_rows.where("NOT taken").isEmpty():
        judged = open_rows.withColumn("refused", differs("content", "taken")).withColumn("waits", differs("content"))
        requests = judged.groupBy("request_id").agg(F.bool_or("refused").alias("refused_batch"), F.bool_or("waits").alias("waits_batch"))
        round_rows = keep(judged.join(requests, "request_id"), "round")
        earlier_conflicts.append(round_rows.where("NOT taken AND refused").select("tenant_id", "request_id", "batch_id", "event_id", F.lit("EARLIER").alias("conflict")))
        open_rows = round_rows.where("taken OR NOT refused_batch").select(
            "tenant_id", "request_id", "batch_id", "event_id", "place", "content", F.expr("taken OR NOT waits_batch AS taken")
        )
    conflicts = outright.select(*columns)
    for found in earlier_conflicts:
        conflicts = conflicts.unionByName(found.select(*columns))
    taken = sound.drop("content").join(conflicts.select("request_id").distinct(), "request_id", "left_anti")
    return taken, conflicts


def fresh_events(taken: DataFrame) -> DataFrame:
    """First copy, in order of arrival, of each event that isn't stored yet."""
    first = Window.partitionBy("tenant_id", "event_id").orderBy("received_ms", "request_id", "event_index")
    return (
        taken.where("stored_state = 'NEW'").withColumn("_copy", F.row_number().over(first)).where("_copy = 1").drop("_copy", "error_code", "stored_state")
    )


def acknowledgements(prepared: DataFrame, fresh: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One row for each request: what came of it, and received, inserted and duplicate events."""
    refused = conflicts.groupBy("request_id").agg(F.min("conflict").alias("conflict"))
    stored = fresh.groupBy("request_id").agg(F.count("*").alias("inserted"))
    received = prepared.groupBy("tenant_id", "request_id", "received_ms").agg(
        F.count("*").alias("received"), F.bool_or(F.col("error_code").isNotNull()).alias("broken")
    )
    outcome = "CASE WHEN broken THEN 'QUARANTINED' WHEN conflict IS NOT NULL THEN 'CONFLICT' ELSE 'ACCEPTED' END"
    return received.join(refused, "request_id", "left").join(stored, "request_id", "left").selectExpr(
        "tenant_id", "request_id", "received_ms", f"{outcome} AS outcome", "received", "coalesce(inserted, 0L) AS inserted",
        f"if({outcome} = 'ACCEPTED', received - coalesce(inserted, 0L), 0L) AS duplicates",
    )
