"""Line protocol: one event per newline, ``k=v`` segments split by ``|``, maps split by ``,``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgauge.functions.metrics import ladder, lit
from vitalgauge.functions.text import raw, strip

REQUIRED = (
    "ts", "eventId", "module", "name", "kind", "severity", "priority", "process", "thread",
)
OPTIONAL = ("scene", "foreground", "fields", "context", "extras")
_KNOWN = ", ".join(f"'{k}'" for k in (*REQUIRED, *OPTIONAL))


def read_batch_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per batch file: ``batch_id`` (the path) and ``body``."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .load(path)
        .select(F.col("path").alias("batch_id"), F.col("content").alias("body"))
    )


def _pairs(text: str, separator: str) -> str:
    """Entries of a ``k=v`` list; an entry without a key or separator has a null key."""
    return (
        f"transform(split({text}, {raw(separator)}, -1), s -> named_struct('key',"
        " if(locate('=', s) > 1, substring(s, 1, locate('=', s) - 1), NULL), 'value',"
        " substring(s, locate('=', s) + 1)))"
    )


def _bad_pairs(pairs: str) -> str:
    keys = f"transform({pairs}, p -> p.key)"
    return f"(exists({pairs}, p -> p.key IS NULL) OR size(array_distinct({keys})) < size({pairs}))"


def _get(key: str) -> str:
    return f"try_element_at(segments, '{key}')"


def decode_line_batches(batches: DataFrame, max_events: int = 1_000) -> DataFrame:
    """Events of ``(batch_id, body)`` rows, one row per line with ``error_code``.

    Only ``\\n`` separates events: other line breaks occur inside exception texts. A batch that
    cannot be split yields one row with the error at index 0.
    """
    text = "cast(body AS string)"
    split_lines = f"split({text}, '\\n', -1)"
    prepared = (
        batches.withColumn("_valid", F.expr(f"is_valid_utf8({text})"))
        .withColumn("_lines", F.expr(f"if(_valid, {split_lines}, array(''))"))
        .withColumn(
            "_lines",
            F.expr("if(element_at(_lines, -1) = '', slice(_lines, 1, size(_lines) - 1), _lines)"),
        )
        .withColumn("_lines", F.expr("transform(_lines, x -> if(endswith(x, char(13)), left(x, length(x) - 1), x))"))
    )
    batch_error = ladder(
        ("NOT _valid", lit("INVALID_ENCODING")),
        ("NOT exists(_lines, x -> x <> '')", lit("EMPTY_BATCH")),
        (f"size(_lines) > {max_events}", lit("TOO_MANY_EVENTS")),
    )
    exploded = (
        prepared.withColumn("_batch_error", F.expr(batch_error))
        .select(
            *[c for c in batches.columns if c != "body"],
            "_batch_error",
            F.expr(
                "posexplode(if(_batch_error IS NULL, _lines, array(''))) AS (event_index, _line)"
            ),
        )
        .withColumn("_pairs", F.expr(_pairs("_line", r"\|")))
        .withColumn("_bad", F.expr(_bad_pairs("_pairs")))
        .withColumn("segments", F.expr("if(_bad, NULL, map_from_entries(_pairs))"))
    )
    for name, key in (("_fields", "fields"), ("_context", "context"), ("_extras", "extras")):
        exploded = exploded.withColumn(
            name, F.expr(f"if(coalesce({_get(key)}, '') = '', NULL, {_pairs(_get(key), ',')})")
        )
    stamp = strip(_get("ts"))
    missing = " OR ".join(f"{_get(key)} IS NULL" for key in REQUIRED)
    line_error = ladder(
        ("_batch_error IS NOT NULL", "_batch_error"),
        ("_line = ''", lit("BLANK_LINE")),
        ("_bad", lit("INVALID_SEGMENTS")),
        (missing, lit("MISSING_FIELDS")),
        (f"coalesce({_get('foreground')} NOT IN ('true', 'false'), false)",
         lit("INVALID_FOREGROUND")),
        (f"NOT {stamp} rlike '^[+-]?[0-9]+(_[0-9]+)*$'", lit("INVALID_TIMESTAMP_TEXT")),
        (
            " OR ".join(
                f"coalesce({_bad_pairs(m)}, false)" for m in ("_fields", "_context", "_extras")
            ),
            lit("INVALID_MAP"),
        ),
    )

    def as_map(name: str) -> str:
        empty = "cast(map() AS map<string,string>)"
        return (
            f"if({name} IS NULL OR {_bad_pairs(name)}, {empty}, map_from_entries({name}))"
        )

    return exploded.selectExpr(
        *[c for c in batches.columns if c != "body"],
        "event_index",
        f"try_cast(replace({stamp}, '_', '') AS bigint) AS timestamp",
        f"{_get('eventId')} AS event_id",
        f"{_get('module')} AS module",
        f"{_get('name')} AS name",
        f"{_get('kind')} AS kind",
        f"{_get('severity')} AS severity",
        f"{_get('priority')} AS priority",
        f"{_get('process')} AS process_name",
        f"{_get('thread')} AS thread_name",
        f"{_get('scene')} AS scene",
        f"cast({_get('foreground')} AS boolean) AS foreground",
        f"{as_map('_fields')} AS fields",
        "cast(map() AS map<string,string>) AS field_types",
        f"{as_map('_context')} AS global_context",
        f"{as_map('_extras')} AS extras",
        f"map_filter(segments, (k, v) -> k NOT IN ({_KNOWN})) AS unknown",
        f"{line_error} AS decode_error",
    )


def read_line_batches(
    spark: SparkSession, path: str, max_events: int = 1_000
) -> tuple[DataFrame, DataFrame]:
    """Decoded events of sound batches, and the rows of batches with a decoding error."""
    from vitalgauge.operators.ingest import reject_invalid_batches

    decoded = decode_line_batches(read_batch_files(spark, path), max_events)
    return reject_invalid_batches(decoded.withColumnRenamed("decode_error", "error_code"))
