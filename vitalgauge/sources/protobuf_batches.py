"""Protobuf batches: length-prefixed V1 frames and V2/V3 envelopes.

Spark has no built-in decoder without its protobuf package, so bytes become rows in Arrow batches;
everything after that (typed values, validation, batch identity) is native. The message layout
below is the wire contract.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from operator import attrgetter
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# message: (number, name, type, label); types are scalars, "map" or a message name.
MESSAGES = {
    "TypedValue": ((1, "type", "string", ""), (2, "value", "string", "")),
    "Frame": (
        (1, "abi", "string", ""), (2, "module_build_id", "string", ""),
        (3, "module_name", "string", ""), (4, "module_relative_pc", "uint64", ""),
        (5, "load_bias", "uint64", "optional"),
    ),
    "Occurrence": (
        (1, "service_version", "string", ""), (2, "version_code", "string", ""),
        (3, "app_build", "string", ""), (4, "variant", "string", ""),
        (5, "installation_id", "string", ""), (6, "native_frames", "Frame", "repeated"),
        (7, "session_id", "string", "optional"), (8, "device_model", "string", "optional"),
        (9, "os_version", "string", "optional"),
    ),
    "Resource": (
        (1, "service_name", "string", ""), (2, "service_version", "string", ""),
        (3, "deployment_environment", "string", ""), (4, "installation_id", "string", ""),
    ),
    "Event": (
        (1, "timestamp", "int64", ""), (2, "module", "string", ""), (3, "name", "string", ""),
        (4, "kind", "string", ""), (5, "severity", "string", ""),
        (6, "process_name", "string", ""), (7, "thread_name", "string", ""),
        (8, "scene", "string", ""), (9, "foreground", "bool", ""),
        (10, "fields", "map", "string"), (11, "global_context", "map", "string"),
        (12, "extras", "map", "string"), (13, "priority", "string", ""),
        (14, "event_id", "string", ""), (15, "typed_fields", "map", "TypedValue"),
        (16, "occurrence", "Occurrence", ""),
    ),
    "Envelope": (
        (1, "schema_version", "uint32", ""), (2, "sdk_name", "string", ""),
        (3, "sdk_version", "string", ""), (4, "batch_id", "string", ""),
        (5, "sent_at_ms", "int64", ""), (6, "resource", "Resource", ""),
        (7, "events", "Event", "repeated"),
    ),
}
LENGTH_BYTES = 4
_FRAME = (
    "struct<abi:string,module_build_id:string,module_name:string,module_relative_pc:decimal(20,0),"
    "load_bias:decimal(20,0)>"
)
OCCURRENCE = (
    "struct<service_version:string,version_code:string,app_build:string,variant:string,"
    "installation_id:string,session_id:string,device_model:string,os_version:string,"
    f"native_frames:array<{_FRAME}>>"
)
EVENT_SCHEMA = (
    "source string, schema_version string, sdk_name string, sdk_version string, batch_id string,"
    " sent_at_ms bigint, service_name string, service_version string,"
    " deployment_environment string, resource_installation_id string, event_index int,"
    " timestamp bigint, event_id string, module string, name string, kind string, severity string,"
    " priority string, process_name string, thread_name string, scene string, foreground boolean,"
    " fields map<string,string>, typed_fields map<string,struct<type:string,value:string>>,"
    f" global_context map<string,string>, extras map<string,string>, occurrence {OCCURRENCE},"
    " decode_error string"
)
_HEAD = (
    "source", "schema_version", "sdk_name", "sdk_version", "batch_id", "sent_at_ms", "service_name",
    "service_version", "deployment_environment", "resource_installation_id",
)
# Results leave when there are so many rows or bytes; bodies come in pieces, 10,000 to an Arrow batch.
_ROWS_PER_FRAME = 2_000
_BYTES_PER_FRAME = 1 << 20
_PIECE_BYTES = 1_024


@lru_cache(maxsize=1)
def message_classes() -> dict:
    """Message classes built from ``MESSAGES``; needs the protobuf runtime on the executors."""
    try:
        from google.protobuf import descriptor_pb2, descriptor_pool, message_factory
    except ImportError as error:  # pragma: no cover - depends on the cluster image
        raise RuntimeError("reading protobuf batches needs the protobuf Python package") from error
    kinds = descriptor_pb2.FieldDescriptorProto
    scalars = {
        "string": kinds.TYPE_STRING, "int64": kinds.TYPE_INT64, "uint64": kinds.TYPE_UINT64,
        "uint32": kinds.TYPE_UINT32, "bool": kinds.TYPE_BOOL,
    }
    file = descriptor_pb2.FileDescriptorProto(
        name="batches.proto", package="batches", syntax="proto3"
    )

    def add(message, number, name, kind, repeated=False):
        field = message.field.add(name=name, number=number)
        field.label = kinds.LABEL_REPEATED if repeated else kinds.LABEL_OPTIONAL
        if kind in scalars:
            field.type = scalars[kind]
        else:
            field.type, field.type_name = kinds.TYPE_MESSAGE, f".batches.{kind}"
        return field

    for message_name, fields in MESSAGES.items():
        message = file.message_type.add(name=message_name)
        for number, name, kind, label in fields:
            if kind == "map":
                entry_name = "".join(p.capitalize() for p in name.split("_")) + "Entry"
                entry = message.nested_type.add(name=entry_name)
                entry.options.map_entry = True
                add(entry, 1, "key", "string")
                add(entry, 2, "value", label)
                add(message, number, name, f"{message_name}.{entry_name}", repeated=True)
                continue
            field = add(message, number, name, kind, repeated=label == "repeated")
            if label == "optional":
                field.proto3_optional = True
                field.oneof_index = len(message.oneof_decl)
                message.oneof_decl.add(name=f"_{name}")
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    return {
        name: message_factory.GetMessageClass(pool.FindMessageTypeByName(f"batches.{name}"))
        for name in MESSAGES
    }


def _array(messages: list, name: str, kind: str, label: str, to: pa.DataType) -> pa.Array:
    """One field of many messages as an Arrow array of type ``to``."""
    get = attrgetter(name)
    if kind == "map" or label == "repeated":
        found, ends = [], [0]
        for entries in map(get, messages):
            if entries:
                found.extend(entries.items() if kind == "map" else entries)
            ends.append(len(found))
        offsets = pa.array(ends, pa.int32())
        if kind != "map":
            return pa.ListArray.from_arrays(offsets, _struct(found, kind, to.value_type), type=to)
        values = [value for _, value in found]
        values = _struct(values, label, to.item_type) if label in MESSAGES else pa.array(values, to.item_type)
        return pa.MapArray.from_arrays(offsets, pa.array([key for key, _ in found], to.key_type), values, type=to)
    if kind in MESSAGES:
        has = [m.HasField(name) for m in messages]
        return _spread(_struct([get(m) for m, h in zip(messages, has) if h], kind, to), has)
    if label == "optional":
        values = [get(m) if m.HasField(name) else None for m in messages]
    else:
        values = list(map(get, messages))
    # decimals hold unsigned numbers
    return pa.array(values, pa.uint64()).cast(to) if kind == "uint64" else pa.array(values, to)


def _struct(messages: list, kind: str, to: pa.StructType) -> pa.StructArray:
    layout = {name: field for _, name, *field in MESSAGES[kind]}
    return pa.StructArray.from_arrays(
        [_array(messages, f.name, *layout[f.name], f.type) for f in to], fields=list(to)
    )


def _spread(values: pa.Array, has: list[bool]) -> pa.Array:
    """The values in order where ``has`` is true, nulls elsewhere."""
    if all(has):
        return values
    if not len(values):
        return pa.nulls(len(has), values.type)
    return values.take(pa.array([at - 1 if h else None for at, h in zip(accumulate(has), has)], pa.int32()))


class _Row(NamedTuple):
    """An event of a batch, or the error that ends it; ``size`` is about its bytes."""

    head: tuple
    index: int
    event: object
    error: str | None
    size: int


def _frames(source: str, body: bytes | None) -> Iterator[_Row]:
    """Events of big-endian length-prefixed frames; the first broken frame ends the batch."""
    decode = message_classes()["Event"].FromString
    head = (source, *[None] * (len(_HEAD) - 1))
    at, index = 0, 0
    if not body:
        yield _Row(head, 0, None, "EMPTY_BATCH", 0)
        return
    while at < len(body):
        end = at + LENGTH_BYTES + int.from_bytes(body[at : at + LENGTH_BYTES], "big")
        start, at = at + LENGTH_BYTES, end
        if start > len(body) or end <= start or end > len(body):
            yield _Row(head, index, None, "INVALID_FRAME", 0)
            return
        try:
            event = decode(body[start:end])
        except Exception:  # noqa: BLE001 - any parse failure rejects the frame
            yield _Row(head, index, None, "INVALID_MESSAGE", 0)
            return
        yield _Row(head, index, event, None, end - start)
        index += 1


def _envelope(source: str, body: bytes | None) -> Iterator[_Row]:
    """Events of an envelope; every row repeats the head."""
    try:
        envelope = message_classes()["Envelope"].FromString(body)
    except Exception:  # noqa: BLE001 - any parse failure rejects the envelope
        yield _Row((source, *[None] * (len(_HEAD) - 1)), 0, None, "INVALID_ENVELOPE", 0)
        return
    resource = envelope.resource
    head = (
        source, str(envelope.schema_version), envelope.sdk_name, envelope.sdk_version,
        envelope.batch_id, envelope.sent_at_ms, resource.service_name, resource.service_version,
        resource.deployment_environment, resource.installation_id,
    )
    size = sum(len(value) for value in head if isinstance(value, str))
    if not envelope.events:
        yield _Row(head, 0, None, "EMPTY_BATCH", size)
        return
    size += len(body) // len(envelope.events)
    for index, event in enumerate(envelope.events):
        yield _Row(head, index, event, None, size)


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes | None]]:
    """``(source, body)`` put together from the pieces, which follow each other."""
    held = bytearray()
    for batch in batches:
        for source, size, piece in zip(*batch.columns):
            if not size.is_valid:
                yield source.as_py(), None
                continue
            held += piece.as_buffer()
            if len(held) == size.as_py():
                yield source.as_py(), bytes(held)
                held = bytearray()


def decode_protobuf_batches(batches: DataFrame, enveloped: bool) -> DataFrame:
    """Events of ``(source, body)`` rows; a broken body yields one row with ``decode_error``.

    Python gets a body in rows of a kilobyte, so that Arrow batches stay small however large bodies
    are; a task holds one body and the rows of a megabyte at a time.
    """
    schema = to_arrow_schema(StructType.fromDDL(EVENT_SCHEMA))
    pieces = batches.selectExpr(
        "source",
        "octet_length(body) AS size",
        f"explode_outer(transform(sequence(0, greatest(octet_length(body) - 1, 0) div {_PIECE_BYTES}),"
        f" i -> substring(body, cast(i * {_PIECE_BYTES} + 1 AS int), {_PIECE_BYTES}))) AS piece",
    )

    def decode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[_Row] = []
        held = 0
        for source, body in _bodies(frames):
            for row in _envelope(source, body) if enveloped else _frames(source, body):
                rows.append(row)
                held += row.size
                if len(rows) >= _ROWS_PER_FRAME or held >= _BYTES_PER_FRAME:
                    yield _to_batch(rows, schema)
                    rows, held = [], 0
        if rows:
            yield _to_batch(rows, schema)

    return pieces.mapInArrow(decode, EVENT_SCHEMA)


def _to_batch(rows: list[_Row], schema: pa.Schema) -> pa.RecordBatch:
    heads, at = [], []
    for row in rows:
        if not heads or row.head is not heads[-1]:
            heads.append(row.head)
        at.append(len(heads) - 1)
    at = pa.array(at, pa.int32())
    columns = {
        name: pa.array(values, schema.field(name).type).take(at) for name, values in zip(_HEAD, zip(*heads))
    }
    events = [row.event for row in rows if row.event is not None]
    has = [row.event is not None for row in rows]
    for _, name, kind, label in MESSAGES["Event"]:
        columns[name] = _spread(_array(events, name, kind, label, schema.field(name).type), has)
    scene = columns["scene"]
    columns["scene"] = pc.if_else(pc.equal(scene, ""), pa.scalar(None, scene.type), scene)
    columns["event_index"] = pa.array([row.index for row in rows], pa.int32())
    columns["decode_error"] = pa.array([row.error for row in rows], pa.string())
    return pa.RecordBatch.from_arrays([columns[name] for name in schema.names], schema=schema)


def check_envelopes(
    decoded: DataFrame, version: str, max_events: int = 1_000, sdk_name: str | None = None
) -> DataFrame:
    """Add ``error_code`` for envelope-level violations of schema 2 or 3.

    Each event carries its envelope head, so no regrouping is needed.
    """
    from vitalgauge.functions.metrics import ladder, lit

    def bounded(column: str, limit: int = 256) -> str:
        return f"coalesce(octet_length({column}) BETWEEN 1 AND {limit}, false)"

    occurrence = (
        ("occurrence IS NOT NULL", "UNEXPECTED_OCCURRENCE")
        if version == "2"
        else ("occurrence IS NULL", "MISSING_OCCURRENCE")
    )
    rules = [
        ("decode_error IS NOT NULL", "decode_error"),
        (f"schema_version <> '{version}'", lit("SCHEMA_VERSION_MISMATCH")),
        *([(f"sdk_name <> '{sdk_name}'", lit("UNKNOWN_SDK"))] if sdk_name else []),
        (f"NOT {bounded('sdk_version', 64)}", lit("INVALID_SDK_VERSION")),
        ("sent_at_ms <= 0", lit("INVALID_SENT_AT")),
        (f"NOT batch_id rlike '^b{version}-[0-9a-f]{{32}}$'", lit("INVALID_BATCH_ID")),
        (
            " OR ".join(
                f"NOT {bounded(c)}"
                for c in ("service_name", "service_version", "deployment_environment")
            ),
            lit("INVALID_RESOURCE"),
        ),
        (f"event_index >= {max_events}", lit("TOO_MANY_EVENTS")),
        ("size(fields) > 0", lit("UNTYPED_FIELDS")),
        (occurrence[0], lit(occurrence[1])),
    ]
    if version == "2":
        rules.append(
            (f"NOT {bounded('resource_installation_id')}", lit("INVALID_RESOURCE"))
        )
    return decoded.selectExpr("*", f"{ladder(*rules)} AS error_code")
