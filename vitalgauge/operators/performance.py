"""Performance statistics: every registered observation in one long-form aggregate.

Each row expands to the observations of its own event, so a report is one aggregate over
(release, metric) however many metrics are registered.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgauge import catalog
from vitalgauge import constants as C
from vitalgauge.functions import events as E
from vitalgauge.functions.metrics import ladder, lit
from vitalgauge.operators.percentiles import percentile_aggregates
from vitalgauge.operators.scope import Scope, bucket_index, bucket_spine, scope_window_filter
from vitalgauge.session import small_table

PERCENTILES = {"p50": 0.5, "p75": 0.75, "p95": 0.95}


def load_observations(
    inbox: DataFrame,
    scope: Scope,
    from_ms: int,
    to_ms: int,
    releases: tuple[str, ...] = (),
    cataloged_only: bool = True,
) -> DataFrame:
    """Scoped rows of the window, restricted to cataloged events and the named releases."""
    rows = scope_window_filter(inbox, scope, from_ms, to_ms)
    if releases:
        rows = rows.filter(F.col("app_version").isin(*releases))
    if cataloged_only:
        known = F.broadcast(catalog.event_catalog(inbox.sparkSession))
        rows = rows.join(known, ["module", "name"], "left_semi")
    return rows


def _number(field: str) -> str:
    return (
        f"coalesce(try_element_at(nums, {field}), cast(try_element_at(ints, {field}) AS double))"
    )


# A closed availability flag or an empty sample count hides the value of the definition ``f``.
_GATED = (
    "((f.available IS NOT NULL AND NOT coalesce(try_element_at(bools, f.available), false))"
    f" OR (f.counted IS NOT NULL AND NOT coalesce({_number('f.counted')} > 0, false)))"
)


def _observations(spark, metrics: set[str] | None = None) -> DataFrame:
    grouped = defaultdict(list)
    for f in catalog.performance_fields():
        if metrics is not None and f.id not in metrics:
            continue
        grouped[(f.module, f.name)].append(
            {
                "metric_id": f.id,
                "field": f.field,
                "unit": f.unit,
                "available": f.availability_field,
                "counted": f.sample_count_field,
            }
        )
    rows = [(module, name, fields) for (module, name), fields in grouped.items()]
    return small_table(
        spark,
        rows,
        "module string, name string, observed array<struct<metric_id:string,field:string,"
        "unit:string,available:string,counted:string>>",
    )


def observe_value(rows: DataFrame, *keep: str, metrics: set[str] | None = None) -> DataFrame:
    """Long form ``(keep..., metric_id, unit, state, value)`` of every registered observation, or of ``metrics`` alone.

    A closed availability flag or an empty sample count makes the value UNAVAILABLE whatever was
    sent; otherwise the normalized value or its stored state applies.
    """
    value = f"if({_GATED}, NULL, {_number('f.field')})"
    state = ladder(
        (_GATED, lit(C.UNAVAILABLE)),
        (f"{_number('f.field')} IS NOT NULL", lit(C.AVAILABLE)),
        otherwise=f"coalesce(try_element_at(field_states, f.field), '{C.UNAVAILABLE}')",
    )
    defs = F.broadcast(_observations(rows.sparkSession, metrics))
    return rows.join(defs, ["module", "name"]).selectExpr(
        *keep,
        "inline(transform(observed, f -> named_struct('metric_id', f.metric_id, 'unit', f.unit,"
        f" 'state', {state}, 'value', {value})))",
    )


def reported_values(rows: DataFrame) -> DataFrame:
    """Add ``has_value``: the row reports at least one observation."""
    defs = F.broadcast(_observations(rows.sparkSession))
    reported = f"exists(observed, f -> NOT ({_GATED}) AND {_number('f.field')} IS NOT NULL)"
    return (
        rows.join(defs, ["module", "name"], "left")
        .withColumn("has_value", F.expr(f"coalesce({reported}, false)"))
        .drop("observed")
    )


def summary_state(values: str, total: str, nonzero: str) -> str:
    """SQL state of a distribution from value count, event count and non-zero value count."""
    return ladder(
        (f"{total} = 0", lit(C.NO_DATA)),
        (f"{values} = 0", lit(C.UNAVAILABLE)),
        (f"{values} < {total}", lit(C.DEGRADED)),
        (f"{nonzero} = 0", lit(C.ZERO)),
        otherwise=lit(C.PRESENT),
    )


_SUMMARY = {
    "sample_count": "value IS NOT NULL",
    "event_count": "true",
    "missing_count": f"value IS NULL AND state = '{C.MISSING}'",
    "invalid_count": f"value IS NULL AND state = '{C.INVALID}'",
    "unavailable_count": f"value IS NULL AND state NOT IN ('{C.MISSING}', '{C.INVALID}')",
    "nonzero": "coalesce(value <> 0, false)",
}


def summarize_metric(observations: DataFrame, *keys: str) -> DataFrame:
    """State, counts, coverage, mean, exact percentiles and range per key and metric."""
    names = [*keys, "metric_id"]
    full = percentile_aggregates(observations, names, "value", PERCENTILES, _SUMMARY, moments=True)
    return full.selectExpr(
        *names,
        summary_state("sample_count", "event_count", "nonzero") + " AS state",
        "sample_count",
        "event_count",
        "missing_count",
        "invalid_count",
        "unavailable_count",
        "try_divide(sample_count, event_count) AS coverage",
        "mean",
        *PERCENTILES,
        "maximum",
        "minimum",
    )


SUMMARY_COLUMNS = (
    "state", "sample_count", "event_count", "missing_count", "invalid_count",
    "unavailable_count", "coverage", "mean", "p50", "p75", "p95", "maximum", "minimum",
)


def _fill_empty(df: DataFrame) -> DataFrame:
    """Absent groups are NO_DATA with zero counts, never zero values."""
    counts = [c for c in SUMMARY_COLUMNS if c.endswith("_count")]
    return df.na.fill(C.NO_DATA, ["state"]).na.fill(0, counts)


def bound_rows(rows: DataFrame, releases: tuple[str, ...]) -> DataFrame:
    """Occurrence-bound rows of the compared releases."""
    return rows.filter(E.occurrence_bound() & F.col("app_version").isin(*releases))


def metric_summaries(rows: DataFrame, releases: tuple[str, ...]) -> DataFrame:
    """Summary of every registered metric for every release, also where nothing was observed."""
    spark = rows.sparkSession
    spine = small_table(
        spark,
        [(r, f.id) for r in releases for f in catalog.performance_fields()],
        "app_version string, metric_id string",
    )
    observed = observe_value(bound_rows(rows, releases), "app_version")
    summary = summarize_metric(observed, "app_version")
    return _fill_empty(spine.join(summary, ["app_version", "metric_id"], "left"))


def compare_metrics(summaries: DataFrame, new_release: str, baseline_release: str) -> DataFrame:
    """p95 of the new release minus the baseline per metric, null unless both exist."""

    def p95(release: str) -> Column:
        return F.max(F.when(F.col("app_version") == F.lit(release), F.col("p95")))

    return summaries.groupBy("metric_id").agg(
        p95(new_release).alias("current_p95"),
        p95(baseline_release).alias("baseline_p95"),
        (p95(new_release) - p95(baseline_release)).alias("p95_delta"),
    )


def metric_trend(
    rows: DataFrame, releases: tuple[str, ...], metric_id: str, from_ms: int, to_ms: int
) -> DataFrame:
    """Summary per bucket and release for one metric; empty buckets stay NO_DATA."""
    spark = rows.sparkSession
    field = next(f for f in catalog.performance_fields() if f.id == metric_id)
    mine = bound_rows(rows, releases).filter(E.is_event(field.module, field.name))
    observed = observe_value(
        mine.withColumn("bucket", bucket_index(from_ms, to_ms)), "app_version", "bucket", metrics={metric_id}
    )
    summary = summarize_metric(observed, "app_version", "bucket").drop("metric_id")
    spine = bucket_spine(spark, from_ms, to_ms).withColumn(
        "app_version", F.explode(F.array(*[F.lit(r) for r in releases]))
    )
    return _fill_empty(spine.join(summary, ["app_version", "bucket"], "left")).drop("bucket")


def event_statistics(rows: DataFrame, new_release: str, baseline_release: str) -> DataFrame:
    """Reported counts of every cataloged event, zeros kept."""
    counts = rows.groupBy("module", "name").agg(
        F.count_if(F.expr(E.BOUND) & (F.col("app_version") == F.lit(new_release))).alias("current_count"),
        F.count_if(F.expr(E.BOUND) & (F.col("app_version") == F.lit(baseline_release))).alias("baseline_count"),
        F.expr("count(*) AS total_count"),
        F.expr(f"count_if(NOT {E.BOUND}) AS non_occurrence_count"),
    )
    known = catalog.event_catalog(rows.sparkSession).drop("position")
    return known.join(counts, ["module", "name"], "left").na.fill(0)


def late_count(rows: DataFrame, late_after_ms: int = C.LATE_AFTER_MS) -> DataFrame:
    """Late and unbound rows of the report."""
    return rows.agg(
        F.expr(f"count_if({E.late(late_after_ms)}) AS late_count"),
        F.expr(f"count_if(NOT {E.BOUND}) AS non_occurrence_count"),
        F.expr("count(*) AS row_count"),
    )


def category_observations(rows: DataFrame, *keep: str) -> DataFrame:
    """Long form ``(keep..., metric_id, state, label)`` of every fixed category."""
    grouped = defaultdict(list)
    for f in catalog.category_fields():
        grouped[(f.module, f.name)].append(
            {"metric_id": f.id, "field": f.field, "type": f.type, "labels": list(f.allowed)}
        )
    defs = small_table(
        rows.sparkSession,
        [(module, name, fields) for (module, name), fields in grouped.items()],
        "module string, name string, categories"
        " array<struct<metric_id:string,field:string,type:string,labels:array<string>>>",
    )
    original = f"coalesce(try_element_at(field_states, f.field), '{C.MISSING}')"
    value = (
        "CASE f.type WHEN 'boolean' THEN cast(try_element_at(bools, f.field) AS string)"
        " WHEN 'integer' THEN cast(try_element_at(ints, f.field) AS string)"
        " ELSE try_element_at(strs, f.field) END"
    )
    known = f"array_contains(f.labels, {value})"
    state = ladder(
        (f"{original} = '{C.EXPIRED}'", lit(C.EXPIRED)),
        (known, lit(C.AVAILABLE)),
        (f"{value} IS NULL AND {original} IN ('{C.MISSING}', '{C.INVALID}')", original),
        otherwise=lit(C.UNKNOWN),
    )
    return rows.join(F.broadcast(defs), ["module", "name"]).selectExpr(
        *keep,
        "inline(transform(categories, f -> named_struct('metric_id', f.metric_id,"
        f" 'state', {state}, 'label', if({known} AND {original} <> '{C.EXPIRED}', {value},"
        " NULL))))",
    )


def category_distribution(rows: DataFrame, releases: tuple[str, ...]) -> DataFrame:
    """Count of every fixed label per release, zero labels kept."""
    spine = small_table(
        rows.sparkSession,
        [
            (r, f.id, label)
            for r in releases
            for f in catalog.category_fields()
            for label in f.allowed
        ],
        "app_version string, metric_id string, label string",
    )
    counts = (
        category_observations(bound_rows(rows, releases), "app_version")
        .filter("label IS NOT NULL")
        .groupBy("app_version", "metric_id", "label")
        .agg(F.count("*").alias("event_count"))
    )
    return spine.join(counts, ["app_version", "metric_id", "label"], "left").na.fill(0)


def category_summary(rows: DataFrame, releases: tuple[str, ...]) -> DataFrame:
    """State and evidence counts of every fixed category per release."""
    spine = small_table(
        rows.sparkSession,
        [(r, f.id) for r in releases for f in catalog.category_fields()],
        "app_version string, metric_id string",
    )
    states = (
        ("available", C.AVAILABLE),
        ("missing", C.MISSING),
        ("invalid", C.INVALID),
        ("unknown", C.UNKNOWN),
        ("expired", C.EXPIRED),
    )
    counts = (
        category_observations(bound_rows(rows, releases), "app_version")
        .groupBy("app_version", "metric_id")
        .agg(
            F.expr("count(*) AS event_count"),
            *[F.expr(f"count_if(state = '{s}') AS {n}_count") for n, s in states],
        )
    )
    state = ladder(
        ("event_count = 0", lit(C.NO_DATA)),
        ("available_count = 0", lit(C.UNAVAILABLE)),
        ("available_count = event_count", lit(C.PRESENT)),
        otherwise=lit(C.DEGRADED),
    )
    joined = spine.join(counts, ["app_version", "metric_id"], "left").na.fill(0)
    return joined.selectExpr("*", f"{state} AS state")


def fps_pairs(rows: DataFrame, *keys: str) -> DataFrame:
    """FPS and window duration of every FPS row with the state of the pair."""
    fps, span = _number("'fps'"), _number("'windowDurationMs'")

    def stored(field: str) -> str:
        return f"coalesce(try_element_at(field_states, '{field}'), '{C.UNAVAILABLE}')"

    pair = rows.filter(E.is_event("fps", "fps_stats")).selectExpr(
        *keys,
        f"{fps} AS fps",
        f"{span} AS span",
        f"if({fps} IS NULL, {stored('fps')}, '{C.AVAILABLE}') AS fps_state",
        f"if({span} IS NULL, {stored('windowDurationMs')}, '{C.AVAILABLE}') AS span_state",
    )
    state = ladder(
        (
            f"fps_state = '{C.INVALID}' OR span_state = '{C.INVALID}'"
            " OR coalesce(fps < 0, false) OR coalesce(span <= 0, false)",
            lit(C.INVALID),
        ),
        (f"fps_state = '{C.MISSING}' OR span_state = '{C.MISSING}'", lit(C.MISSING)),
        ("fps IS NULL OR span IS NULL", lit(C.UNAVAILABLE)),
        otherwise=lit(C.AVAILABLE),
    )
    return pair.selectExpr(*keys, "fps", "span", f"{state} AS state")


# Sums are kept by chunks of this many binary exponents, scaled into the chunk, so none can overflow.
_CHUNK = 200


def _chunk(value: str) -> str:
    """SQL of the chunk of a number >= 0; the lowest chunk has everything below 2^-800, zero included."""
    return f"if({value} = 0, -5, greatest(-5, cast(floor(log2({value}) / {_CHUNK}) AS int)))"


def _scaled(value: str, chunk: str) -> str:
    return f"({value} * pow(2D, -{_CHUNK}D * {chunk}))"


def _combined(cells: str, part: str, shift: str) -> str:
    """SQL of the sum over chunks (at most a few dozen), scaled to the highest chunk."""
    return f"aggregate(array_sort({cells}), 0D, (acc, x) -> acc + x.{part} * pow(2D, {_CHUNK}D * ({shift})))"


def weighted_fps(pairs: DataFrame, *keys: str) -> DataFrame:
    """Duration-weighted FPS, whatever the size of the numbers: partial sums by exponent chunk, combined at the end."""
    usable = f"state = '{C.AVAILABLE}'"
    parts = (
        pairs.selectExpr(
            *keys, "state", "fps", "span",
            f"if({usable}, {_chunk('span')}, NULL) AS es", f"if({usable}, {_chunk('fps')}, NULL) AS ef",
        )
        .groupBy(*keys, "es", "ef")
        .agg(
            F.expr(f"count_if({usable}) AS sample_count"),
            F.expr("count(*) AS event_count"),
            F.expr(f"count_if(state = '{C.MISSING}') AS missing_count"),
            F.expr(f"count_if(state = '{C.INVALID}') AS invalid_count"),
            F.expr(f"count_if(state = '{C.UNAVAILABLE}') AS unavailable_count"),
            F.expr(f"sum({_scaled('span', 'es')}) AS s"),
            F.expr(f"sum({_scaled('fps', 'ef')} * {_scaled('span', 'es')}) AS p"),
        )
    )
    counts = ("sample_count", "event_count", "missing_count", "invalid_count", "unavailable_count")
    totals = parts.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in counts],
        F.max("es").alias("top_es"),
        F.max("ef").alias("top_ef"),
        F.expr("collect_list(struct(es, ef, s, p)) FILTER (WHERE es IS NOT NULL) AS cells"),
    ).withColumns(
        {
            "scaled_total": F.expr(_combined("cells", "s", "x.es - top_es")),
            "scaled_fps": F.expr(_combined("cells", "p", "x.es - top_es + x.ef - top_ef")),
        }
    )
    value = f"if(sample_count = 0, NULL, scaled_fps / scaled_total * pow(2D, {_CHUNK}D * top_ef))"
    total = f"(scaled_total * pow(2D, {_CHUNK}D * top_es))"
    state = ladder(
        ("sample_count = 0", lit(C.UNAVAILABLE)),
        ("sample_count < event_count", lit(C.DEGRADED)),
        ("value = 0", lit(C.ZERO)),
        otherwise=lit(C.PRESENT),
    )
    return totals.withColumn("value", F.expr(value)).selectExpr(
        *keys,
        f"{state} AS state",
        "value",
        "sample_count",
        "event_count",
        f"if({total} < double('Infinity'), {total}, NULL) AS total_window_ms",
        "missing_count",
        "invalid_count",
        "unavailable_count",
        "try_divide(sample_count, event_count) AS coverage",
    )


def paired_ratio(
    rows: DataFrame, module: str, name: str, numerator: str, denominator: str, *keys: str
) -> DataFrame:
    """Sum of numerators over sum of denominators for rows with 0 <= a <= b and b > 0."""
    parts = (
        rows.filter(E.is_event(module, name))
        .selectExpr(
            *keys, f"{_number(lit(numerator))} AS a", f"{_number(lit(denominator))} AS b"
        )
        .filter("a >= 0 AND a <= b AND b > 0")
        .withColumn("eb", F.expr(_chunk("b")))
        .groupBy(*keys, "eb")
        .agg(F.expr(f"sum({_scaled('a', 'eb')}) AS sa"), F.expr(f"sum({_scaled('b', 'eb')}) AS sb"), F.count("*").alias("n"))
    )
    totals = parts.groupBy(*keys).agg(
        F.sum("n").alias("pair_count"), F.max("eb").alias("top"), F.collect_list(F.struct("eb", "sa", "sb")).alias("cells")
    )
    ratio = f"{_combined('cells', 'sa', 'x.eb - top')} / {_combined('cells', 'sb', 'x.eb - top')}"
    return totals.selectExpr(*keys, f"{ratio} AS ratio", "pair_count")


def window_event_counts(
    rows: DataFrame, module: str, name: str, release: str | None = None
) -> DataFrame:
    """Samples and incidents of a window; a release filter also requires bound identity."""
    if release is not None:
        rows = rows.filter((F.col("app_version") == release) & E.occurrence_bound())
    return rows.agg(
        F.count("*").alias("samples"),
        F.count_if(E.is_event(module, name)).alias("incidents"),
    )


def performance_report(
    inbox: DataFrame,
    scope: Scope,
    from_ms: int,
    to_ms: int,
    new_release: str,
    baseline_release: str,
) -> DataFrame:
    """Every metric of both releases side by side with the p95 delta."""
    releases = (new_release, baseline_release)
    rows = load_observations(inbox, scope, from_ms, to_ms, releases)
    summaries = metric_summaries(rows, releases)
    # Two rows per metric meet in the window, so the summaries are computed once.
    both = Window.partitionBy("metric_id")

    def p95(release: str) -> Column:
        return F.max(F.when(F.col("app_version") == release, F.col("p95"))).over(both)

    return summaries.withColumn("p95_delta", p95(new_release) - p95(baseline_release))


