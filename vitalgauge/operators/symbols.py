"""Crash symbol matching: jobs, artifact registry, exact matching, frame alignment, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalgauge import constants as C
from vitalgauge.functions.events import quoted
from vitalgauge.functions.metrics import ladder, lit
from vitalgauge.functions.text import basename, lines, raw, strip

# ABIs symbols can be registered for (fixed values).
ABIS = ("arm64-v8a", "armeabi-v7a", "x86", "x86_64")
BUILD_ID = raw(r"^[0-9a-f]{8,128}$")
ARTIFACT_KEY = (
    "tenant_id", "artifact_type", "app_id", "version_code", "app_build", "variant", "abi",
    "build_id",
)
BUILD_KEY = ("tenant_id", "app_id", "version_code", "app_build", "variant")
_HAS_BUILD = (
    f"release_identity_quality = '{C.OCCURRENCE_BOUND}' AND coalesce(version_code, '') <> ''"
    " AND coalesce(app_build, '') <> '' AND coalesce(variant, '') <> ''"
)


def _frame_ok(frame: str) -> str:
    return (
        f"({frame}.abi IN {quoted(ABIS)} AND lower({frame}.module_build_id) rlike {BUILD_ID})"
    )


def derive_symbol_jobs(
    events: DataFrame, existing: DataFrame | None = None, enabled: bool = True
) -> DataFrame:
    """One job per Java or native crash; a complete identity parks the event for symbols."""
    stack = (
        "if(name = 'java_crash', coalesce(try_element_at(fields, 'stackTrace'),"
        " try_element_at(fields, 'stack_trace')), try_element_at(fields, 'backtrace'))"
    )
    crashes = events.filter("module = 'crash' AND name IN ('java_crash', 'native_crash')")
    if existing is not None:
        done = existing.select(F.col("inbox_event_id").alias("id"))
        crashes = crashes.join(done, "id", "left_anti")
    complete = (
        f"stack <> '' AND coalesce({_HAS_BUILD}, false) AND (name = 'java_crash' OR"
        f" coalesce({_frame_ok('get(native_frames, 0)')}, false))"
    )
    status = ladder(
        *([] if enabled else [("true", lit("disabled"))]),
        (complete, lit("pending")),
        otherwise=lit("metadata_missing"),
    )
    return (
        crashes.withColumn("stack", F.expr(f"coalesce({stack}, '')"))
        .selectExpr(
            "id AS inbox_event_id",
            "tenant_id",
            "event_id",
            "if(name = 'java_crash', 'java', 'native') AS job_type",
            f"{status} AS job_status",
            "sha2(stack, 256) AS input_sha256",
            "inbox_status",
        )
        .withColumn(
            "new_inbox_status",
            F.expr(
                "if(job_status = 'pending' AND inbox_status = 'pending', 'awaiting_symbols',"
                " inbox_status)"
            ),
        )
    )


def register_artifacts(uploads: DataFrame, existing: DataFrame) -> DataFrame:
    """Outcome of each upload: inserted, replayed, or conflict with the registered content."""
    key = list(ARTIFACT_KEY)
    first = Window.partitionBy(*key).orderBy("upload_id")
    # The first upload of an identity is what later ones are compared with.
    winners = (
        uploads.withColumn("_rank", F.row_number().over(first))
        .filter("_rank = 1")
        .select(
            *key,
            F.col("upload_id").alias("winner"),
            F.col("sha256").alias("first_sha"),
            F.col("size").alias("first_size"),
        )
    )
    stored = existing.select(
        *key, F.col("sha256").alias("stored_sha"), F.col("size").alias("stored_size")
    )
    joined = uploads.join(winners, key).join(stored, key, "left")
    new = "stored_sha IS NULL AND upload_id = winner"
    clash = (
        "sha256 <> coalesce(stored_sha, first_sha) OR size <> coalesce(stored_size, first_size)"
    )
    return joined.selectExpr(
        "upload_id",
        f"{new} AS inserted",
        f"NOT ({new}) AND ({clash}) AS conflict",
    )


def match_java_artifacts(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Mapping file of the exact build; a version alone never matches."""
    mine = jobs.filter(f"job_type = 'java' AND {_HAS_BUILD}")
    mappings = artifacts.filter(
        "artifact_type = 'java_mapping' AND coalesce(abi, '') = ''"
        " AND coalesce(build_id, '') = ''"
    ).select(*BUILD_KEY, "artifact_id")
    return mine.join(mappings, list(BUILD_KEY)).select("inbox_event_id", "artifact_id")


def required_modules(jobs: DataFrame) -> DataFrame:
    """Distinct (job, abi, build id) a native stack needs; at most 256 per job."""
    return (
        jobs.filter(f"job_type = 'native' AND {_HAS_BUILD}")
        .filter(F.expr(_frame_ok("get(native_frames, 0)")))
        .select(
            "inbox_event_id",
            *BUILD_KEY,
            F.expr(
                "inline(array_distinct(transform(native_frames, f -> named_struct('abi', f.abi,"
                " 'build_id', lower(f.module_build_id)))))"
            ),
        )
    )


def match_native_artifacts(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Artifacts of a native stack, only when every module of the stack is registered."""
    needed = required_modules(jobs)
    elves = artifacts.filter(
        "artifact_type = 'native_elf' AND artifact_status = 'active'"
    ).select(*BUILD_KEY, "abi", "build_id", "artifact_id")
    joined = needed.join(elves, [*BUILD_KEY, "abi", "build_id"], "left")
    return (
        joined.groupBy("inbox_event_id")
        .agg(
            F.count("*").alias("required_count"),
            F.count("artifact_id").alias("matched_count"),
            # At most 256 modules per job.
            F.array_sort(F.collect_list("artifact_id")).alias("artifact_ids"),
        )
        .filter("matched_count = required_count")
        .select("inbox_event_id", "artifact_ids")
    )


def _all_hex(text: str) -> str:
    return f"({text} <> '' AND translate(lower({text}), '0123456789abcdef', '') = '')"


def _backtrace_frames(backtrace: str) -> str:
    """SQL: frames of a tombstone backtrace, from the words of lines like ``#00 pc <hex> <module> ...``."""
    number = "substring(get(p.w, 0), 2)"
    is_frame = (
        f"size(p.w) >= 4 AND startswith(get(p.w, 0), '#') AND {number} <> ''"
        f" AND translate({number}, '0123456789', '') = '' AND get(p.w, 1) = 'pc' AND {_all_hex('get(p.w, 2)')}"
    )
    mark = "(BuildId:"
    tail = f"substring(line, instr(line, '{mark}') + {len(mark)})"
    id_text = f"trim(BOTH ' \t' FROM substring_index({tail}, ')', 1))"
    inline_id = (
        f"if(contains(line, '{mark}') AND contains({tail}, ')') AND {_all_hex(id_text)},"
        f" lower({id_text}), '')"
    )
    words = r"filter(split(line, r'\s+'), x -> x <> '')"
    return (
        f"transform(filter(transform(split({backtrace}, '\n'), line -> named_struct('w', {words},"
        f" 'inline_id', {inline_id})), p -> {is_frame}),"
        " p -> named_struct('pc', cast(conv(get(p.w, 2), 16, 10) AS decimal(20,0)), 'module',"
        f" {basename('get(p.w, 3)')}, 'inline_id', p.inline_id))"
    )


def align_native_frames(jobs: DataFrame) -> DataFrame:
    """Check that typed frames and backtrace lines correspond one to one.

    Adds ``alignment``: ALIGNED, or why the stack cannot be symbolized.
    """
    parsed = _backtrace_frames("backtrace")
    marked = f"size(filter({lines('backtrace')}, line -> ltrim(line) LIKE '#%'))"
    same = (
        "forall(zip_with(parsed, native_frames, (p, f) -> coalesce("
        f"{_frame_ok('f')} AND p.pc = f.module_relative_pc AND p.module = f.module_name"
        " AND (p.inline_id = '' OR p.inline_id = lower(f.module_build_id)), false)), ok -> ok)"
    )
    alignment = ladder(
        ("size(parsed) = 0", lit("INVALID_NATIVE_STACK")),
        (
            f"coalesce(size(native_frames), 0) NOT BETWEEN 1 AND {C.MAX_NATIVE_FRAMES}"
            f" OR size(native_frames) <> size(parsed) OR size(parsed) <> {marked}",
            lit("FRAME_COUNT_MISMATCH"),
        ),
        (same, lit("ALIGNED")),
        otherwise=lit("FRAME_IDENTITY_MISMATCH"),
    )
    return (
        jobs.withColumn(
            "backtrace", F.expr("coalesce(try_element_at(fields, 'backtrace'), '')")
        )
        .withColumn("parsed", F.expr(parsed))
        .withColumn("alignment", F.expr(alignment))
        .drop("backtrace", "parsed")
    )


def frame_resolution(frames: DataFrame) -> DataFrame:
    """State of each symbolized frame from the tool's ``function`` and ``location`` text."""
    source = raw(r"^(.+):(\d+):(\d+)$")
    state = ladder(
        ("coalesce(function, '') IN ('', '??')", lit("UNRESOLVED")),
        (
            f"NOT coalesce(location rlike {source}, false)"
            f" OR regexp_extract(location, {source}, 1) = '??'"
            f" OR regexp_extract(location, {source}, 2) rlike '^0+$'",
            lit("FUNCTION_ONLY"),
        ),
        otherwise=lit("RESOLVED"),
    )
    return frames.withColumn("frame_state", F.expr(state))


def resolution_status(resolved: DataFrame) -> DataFrame:
    """Job outcome from its frame states."""
    counts = resolved.groupBy("inbox_event_id").agg(
        F.count("*").alias("total_frames"),
        F.expr("count_if(frame_state <> 'UNRESOLVED') AS resolved_frames"),
        F.expr("count_if(frame_state = 'RESOLVED') AS full_frames"),
    )
    status = ladder(
        ("resolved_frames = 0", lit("failed")),
        ("full_frames = total_frames", lit("symbolized")),
        otherwise=lit("partially_symbolized"),
    )
    return counts.selectExpr(
        "inbox_event_id", f"{status} AS job_status", "resolved_frames", "total_frames"
    )


MAX_FINGERPRINT_LINES = 32


def symbol_fingerprint(outputs: DataFrame, output: str = "output") -> DataFrame:
    """Hash of the first 32 stripped, non-blank lines of the symbolized stack."""
    kept = f"filter(transform({lines(output)}, x -> {strip('x')}), x -> x <> '')"
    return outputs.withColumn(
        "fingerprint_sha256",
        F.expr(f"sha2(array_join(slice({kept}, 1, {MAX_FINGERPRINT_LINES}), '\\n'), 256)"),
    )


def requeue_missing_jobs(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Parked jobs a newly registered artifact can serve; one native module is enough to retry."""
    parked = jobs.filter("job_status = 'symbols_missing'")
    java = match_java_artifacts(parked, artifacts).select("inbox_event_id")
    modules = parked.filter("job_type = 'native'").select(
        "inbox_event_id",
        *BUILD_KEY,
        F.expr(
            "inline(array_distinct(transform(native_frames, f -> named_struct('abi', f.abi,"
            " 'build_id', lower(f.module_build_id)))))"
        ),
    )
    elves = artifacts.filter("artifact_type = 'native_elf'").select(
        *BUILD_KEY, "abi", "build_id"
    )
    native = (
        modules.join(elves, [*BUILD_KEY, "abi", "build_id"], "left_semi")
        .select("inbox_event_id")
        .distinct()
    )
    return java.unionByName(native)
