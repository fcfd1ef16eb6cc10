"""Issue reports: top fingerprints, one issue in detail, its distributions and trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgauge import constants as C
from vitalgauge.functions import events as E
from vitalgauge.functions import metrics as M
from vitalgauge.operators.scope import bucket_index, bucket_spine
from vitalgauge.session import small_table

DIMENSIONS = {
    "release": C.OCCURRENCE_REASON,
    "scene": "SCENE_NOT_PROVIDED",
    "device_model": C.DEVICE_REASON,
    "android_version": C.OS_REASON,
}
TOP_LABELS = 10


def incident_rows(rows: DataFrame) -> DataFrame:
    """Rows of the incident families with ``family`` and ``eligible``."""
    return rows.withColumns(
        {"family": E.event_family(), "eligible": E.occurrence_bound()}
    ).filter(F.col("family").isin(*C.INCIDENT_FAMILIES))


def continuity(rows: DataFrame) -> DataFrame:
    """One row with the key epoch problem of the given rows, null when there is none."""
    return rows.agg(F.expr(M.continuity()).alias("reason"))


def per_installation(rows: DataFrame, *keys: str) -> DataFrame:
    """First level of every distinct installation count; hot keys collapse before the shuffle."""
    return rows.groupBy(*keys, "installation_hmac").agg(
        F.count("*").alias("n"),
        F.min("occurrence_timestamp_ms").alias("first_ms"),
        F.max("occurrence_timestamp_ms").alias("last_ms"),
    )


def installation_count(blocked: Column) -> Column:
    """Aggregate over ``per_installation``: null when an id is missing or the epochs differ."""
    complete = ~F.bool_or(F.col("installation_hmac").isNull())
    return F.when(complete & blocked.isNull(), F.count("installation_hmac"))


def affected_installation_count(incidents: DataFrame, *keys: str) -> DataFrame:
    """Events and distinct affected installations per key, each key judged by its own epochs."""
    levelled = incidents.groupBy(*keys, "installation_hmac").agg(
        F.expr("count(*) AS n"),
        F.expr("bool_or(installation_hmac_key_version IS NULL) AS unversioned"),
        F.expr("min(installation_hmac_key_version) AS low"),
        F.expr("max(installation_hmac_key_version) AS high"),
    )
    blocked = (
        "coalesce(bool_or(unversioned), false) OR bool_or(installation_hmac IS NULL)"
        " OR min(low) <> max(high)"
    )
    return levelled.groupBy(*keys).agg(
        F.expr("sum(n) AS event_count"),
        F.expr(f"if({blocked}, NULL, count(installation_hmac)) AS affected_installation_count"),
    )


def top_fingerprints(rows: DataFrame, release: str, limit: int) -> DataFrame:
    """Most frequent incident fingerprints of one release.

    Order: count descending, last seen descending, fingerprint.
    """
    declared = rows.filter(F.col("app_version") == release)
    reason = continuity(declared.filter(E.occurrence_bound())).scalar()
    grouped = (
        per_installation(
            incident_rows(declared).filter("eligible AND incident_fingerprint IS NOT NULL"),
            "incident_fingerprint",
            "family",
        )
        .withColumn("blocked", reason)
        .groupBy("incident_fingerprint", "family")
        .agg(
            F.sum("n").alias("event_count"),
            installation_count(F.max("blocked")).alias("affected_installation_count"),
            F.min("first_ms").alias("first_seen_ms"),
            F.max("last_ms").alias("last_seen_ms"),
        )
    )
    return (
        grouped.orderBy(
            F.desc("event_count"), F.desc("last_seen_ms"), "incident_fingerprint", "family"
        )
        .limit(limit)
        .select(
            F.col("incident_fingerprint").alias("fingerprint"),
            F.col("family").alias("event_family"),
            "event_count",
            "affected_installation_count",
            "first_seen_ms",
            "last_seen_ms",
        )
    )


def fingerprint_summary(rows: DataFrame, release: str) -> DataFrame:
    """State, incident count and fingerprint coverage of the release the top list is about."""
    declared = rows.filter(F.col("app_version") == release)
    flagged = declared.selectExpr(
        "installation_hmac",
        "installation_hmac_key_version",
        "incident_fingerprint",
        f"{E.BOUND} AS is_bound",
        f"{E.FAMILY} IN {E.INCIDENTS} AS incident",
    )
    counts = flagged.agg(
        F.expr("count(*) AS declared"),
        F.expr("count_if(is_bound) AS eligible"),
        F.expr("count_if(is_bound AND incident) AS incidents"),
        F.expr("count_if(is_bound AND incident AND incident_fingerprint IS NOT NULL) AS printed"),
        F.expr(f"{M.continuity('is_bound')} AS installation_reason"),
    )
    c = F.col
    state = (
        F.when(c("declared") == 0, C.NO_DATA)
        .when(c("eligible") == 0, C.UNAVAILABLE)
        .when(c("incidents") == 0, C.ZERO)
        .when(c("installation_reason").isNotNull(), C.DEGRADED)
        .when(c("printed") == 0, C.UNAVAILABLE)
        .when(c("printed") < c("incidents"), C.DEGRADED)
        .otherwise(C.PRESENT)
    )
    return counts.select(
        F.lit(release).alias("release_version"),
        state.alias("state"),
        c("incidents").alias("sample_count"),
        F.try_divide("printed", "incidents").alias("fingerprint_coverage"),
        "installation_reason",
    )


def issue_rows(rows: DataFrame, fingerprint: str) -> DataFrame:
    """Incident rows of one fingerprint with family and eligibility."""
    return incident_rows(rows.filter(F.col("incident_fingerprint") == fingerprint))


def issue_detail(rows: DataFrame, fingerprint: str) -> DataFrame:
    """Totals of one fingerprint; family is MIXED when it spans several."""
    issue = issue_rows(rows, fingerprint)
    known = "eligible AND installation_hmac IS NOT NULL"
    entity = issue.groupBy("eligible", "family", "installation_hmac").agg(
        F.expr("count(*) AS n"),
        F.expr("min(occurrence_timestamp_ms) AS first_ms"),
        F.expr("max(occurrence_timestamp_ms) AS last_ms"),
        F.expr(f"bool_or({known} AND installation_hmac_key_version IS NULL) AS unversioned"),
        F.expr(f"min(if({known}, installation_hmac_key_version, NULL)) AS low"),
        F.expr(f"max(if({known}, installation_hmac_key_version, NULL)) AS high"),
    )
    totals = entity.agg(
        F.expr("coalesce(sum(n), 0) AS declared"),
        F.expr("coalesce(sum(if(eligible, n, NULL)), 0) AS event_count"),
        F.expr("count(DISTINCT if(eligible, installation_hmac, NULL)) AS installations"),
        F.expr("bool_or(eligible AND installation_hmac IS NULL) AS anonymous"),
        F.expr("min(if(eligible, family, NULL)) AS family_low"),
        F.expr("max(if(eligible, family, NULL)) AS family_high"),
        F.expr("min(if(eligible, first_ms, NULL)) AS first_seen_ms"),
        F.expr("max(if(eligible, last_ms, NULL)) AS last_seen_ms"),
        F.expr(
            "CASE WHEN bool_or(unversioned) THEN 'INSTALLATION_HMAC_VERSION_MISSING'"
            " WHEN min(low) <> max(high) THEN 'INSTALLATION_HMAC_CONTINUITY_BREAK' END"
            " AS continuity"
        ),
    )
    c = F.col
    none = c("event_count") == 0
    broken = c("continuity").isNotNull()
    return totals.select(
        F.lit(fingerprint).alias("fingerprint"),
        F.when(c("declared") == 0, C.NO_DATA)
        .when(none | broken, C.UNAVAILABLE)
        .otherwise(C.PRESENT)
        .alias("state"),
        F.when(c("declared") == 0, "FINGERPRINT_NOT_FOUND")
        .when(none, C.OCCURRENCE_REASON)
        .otherwise(c("continuity"))
        .alias("reason"),
        F.when(c("family_low") != c("family_high"), "MIXED")
        .otherwise(c("family_low"))
        .alias("event_family"),
        "event_count",
        F.when(~broken & ~F.coalesce(c("anonymous"), F.lit(False)), c("installations")).alias(
            "affected_installation_count"
        ),
        "first_seen_ms",
        "last_seen_ms",
    )


def _dimension(name: str, label: Column, state: Column) -> Column:
    return F.struct(F.lit(name).alias("dimension"), label.alias("label"), state.alias("state"))


def _by_dimension(eligible: DataFrame) -> DataFrame:
    def present(label: str) -> Column:
        return F.when(F.coalesce(F.col(label), F.lit("")) != "", C.AVAILABLE).otherwise(C.MISSING)

    return eligible.select(
        "installation_hmac",
        "occurrence_timestamp_ms",
        F.explode(
            F.array(
                _dimension("release", F.col("app_version"), present("app_version")),
                _dimension("scene", E.visible_scene(), E.scene_state()),
                _dimension("device_model", F.col("device_model"), present("device_model")),
                _dimension("android_version", F.col("os_version"), present("os_version")),
            )
        ).alias("d"),
    ).select("d.*", "installation_hmac", "occurrence_timestamp_ms")


def issue_distribution(issue: DataFrame) -> DataFrame:
    """Ten largest labels per dimension, for ``issue_rows``.

    All four dimensions share one exploded pass; the window sees one row per label.
    """
    eligible = issue.filter("eligible")
    reason = continuity(eligible).scalar()
    labels = (
        per_installation(
            _by_dimension(eligible).filter(
                (F.col("state") == C.AVAILABLE) & F.col("label").isNotNull()
                & (F.col("label") != "")
            ),
            "dimension",
            "label",
        )
        .withColumn("blocked", reason)
        .groupBy("dimension", "label")
        .agg(
            F.sum("n").alias("event_count"),
            installation_count(F.max("blocked")).alias("affected_installation_count"),
        )
    )
    rank = F.row_number().over(
        Window.partitionBy("dimension").orderBy(F.desc("event_count"), "label")
    )
    return labels.withColumn("rank", rank).filter(F.col("rank") <= TOP_LABELS)


def issue_coverage(issue: DataFrame) -> DataFrame:
    """Evidence coverage and state of every dimension."""
    dims = small_table(
        issue.sparkSession, list(DIMENSIONS.items()), "dimension string, missing_reason string"
    )
    counted = (
        _by_dimension(issue.filter("eligible"))
        .groupBy("dimension")
        .agg(
            F.count("*").alias("total"),
            *[
                F.count_if(F.col("state") == state).alias(alias)
                for alias, state in (
                    ("available", C.AVAILABLE),
                    ("missing", C.MISSING),
                    ("expired", C.EXPIRED),
                    ("retention_unknown", C.RETENTION_UNKNOWN),
                )
            ],
            F.count_if(
                (F.col("state") == C.AVAILABLE) & (F.coalesce(F.col("label"), F.lit("")) != "")
            ).alias("labelled"),
        )
    )
    joined = dims.join(counted, "dimension", "left").na.fill(0)
    c = F.col
    gap = c("missing") + c("expired") + c("retention_unknown")
    why = (
        F.when(c("retention_unknown") > 0, "SCENE_RETENTION_UNKNOWN")
        .when(c("expired") > 0, "SCENE_EVIDENCE_EXPIRED")
        .otherwise(c("missing_reason"))
    )
    return joined.select(
        "dimension",
        F.when(c("total") == 0, C.NO_DATA)
        .when(c("labelled") == 0, C.UNAVAILABLE)
        .when(gap > 0, C.DEGRADED)
        .otherwise(C.PRESENT)
        .alias("state"),
        F.when((c("total") > 0) & ((c("labelled") == 0) | (gap > 0)), why).alias("reason"),
        c("total").alias("total_event_count"),
        c("available").alias("available_event_count"),
        c("missing").alias("missing_event_count"),
        c("expired").alias("expired_event_count"),
        c("retention_unknown").alias("retention_unknown_event_count"),
    )


def issue_trend(issue: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Counts per bucket of ``issue_rows``; an empty bucket is null."""
    eligible = issue.filter("eligible").withColumn("bucket", bucket_index(from_ms, to_ms))
    reason = continuity(eligible).scalar()
    counts = (
        per_installation(eligible, "bucket")
        .withColumn("blocked", reason)
        .groupBy("bucket")
        .agg(
            F.sum("n").alias("event_count"),
            installation_count(F.max("blocked")).alias("affected_installation_count"),
        )
    )
    return bucket_spine(issue.sparkSession, from_ms, to_ms).join(counts, "bucket", "left").select(
        "bucket_start_ms", "bucket_end_ms", "event_count", "affected_installation_count"
    )
