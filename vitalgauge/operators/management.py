"""Release-management tables: decisions, remote configuration, audit and credentials."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalgauge.operators.identity import key_pads
from vitalgauge.operators.scope import Scope
from vitalgauge.session import small_table

_SCOPE = ("tenant_id", "app_id", "environment")
ROLLOUT_DENOMINATOR = 10_000


def release_decisions(
    decisions: DataFrame, scope: Scope, limit: int, release: str | None = None
) -> DataFrame:
    """Human decisions of the scope, newest first."""
    rows = decisions.filter(scope.predicate())
    if release is not None:
        rows = rows.filter(F.col("release_version") == release)
    return rows.orderBy(F.desc("created_ms"), F.desc("decision_id")).limit(limit)


def active_config(configs: DataFrame, now_ms: int) -> DataFrame:
    """Latest active, unexpired configuration revision per scope."""
    live = configs.filter(F.col("active") & (F.col("expires_ms") > now_ms))
    return live.groupBy(*_SCOPE).agg(
        F.max_by(
            F.struct("revision", "rollout_basis_points", "expires_ms"), "revision"
        ).alias("c")
    ).select(*_SCOPE, "c.*")


def rollout_keys(spark, salts: dict[str, str]) -> DataFrame:
    """Key pads of the tenants' hexadecimal rollout salts."""
    rows = [(tenant, *key_pads(bytes.fromhex(salt))) for tenant, salt in salts.items()]
    return small_table(spark, rows, "tenant_id string, ipad binary, opad binary")


def rollout_bucket(installations: DataFrame, keys: DataFrame) -> DataFrame:
    """Add the stable bucket 0-9999 and whether ``rollout_basis_points`` includes it."""
    digest = (
        "sha2(concat(opad, unhex(sha2(concat(ipad, encode(installation_id, 'UTF-8')), 256))), 256)"
    )
    bucket = (
        f"cast(cast(conv(substring({digest}, 1, 16), 16, 10) AS decimal(20,0))"
        f" % {ROLLOUT_DENOMINATOR} AS int)"
    )
    return (
        installations.join(keys, "tenant_id")
        .selectExpr(*installations.columns, f"{bucket} AS bucket")
        .selectExpr(
            "*",
            f"rollout_basis_points >= {ROLLOUT_DENOMINATOR} OR (rollout_basis_points > 0"
            " AND bucket < rollout_basis_points) AS included",
        )
    )


def next_revision(configs: DataFrame) -> DataFrame:
    """Next free configuration revision per scope."""
    return configs.groupBy(*_SCOPE).agg(
        (F.coalesce(F.max("revision"), F.lit(0)) + 1).alias("next_revision")
    )


def audit_trail(audit: DataFrame, scope: Scope, limit: int = 100) -> DataFrame:
    """Newest audit rows of the scope; app-wide actions carry no environment."""
    app = F.get_json_object("details", "$.app_id")
    environment = F.get_json_object("details", "$.environment")
    return (
        audit.filter(
            (F.col("tenant_id") == scope.tenant_id)
            & (app == scope.app_id)
            & (environment.isNull() | (environment == scope.environment))
        )
        .orderBy(F.desc("audit_id"))
        .limit(limit)
        .drop("details")
    )


CREDENTIAL_COLUMNS = (
    "kind", "key_id", "description", "role", "active", "expires_ms", "created_ms"
)


def credential_inventory(
    query_keys: DataFrame, ingest_keys: DataFrame, ci_keys: DataFrame, scope: Scope,
    limit: int = 200,
) -> DataFrame:
    """Metadata of the newest keys of each kind; secrets and hashes are never selected."""
    app_wide = (F.col("tenant_id") == scope.tenant_id) & (F.col("app_id") == scope.app_id)
    parts = []
    for kind, keys, mine in (
        ("query", query_keys, scope.predicate()),
        ("ingest", ingest_keys, scope.predicate()),
        ("ci", ci_keys, app_wide),
    ):
        role = "role" if kind == "query" else "cast(NULL AS string) AS role"
        parts.append(
            keys.filter(mine).selectExpr(
                f"'{kind}' AS kind", "key_id", "description", role, "active", "expires_ms",
                "created_ms",
            )
        )
    newest = Window.partitionBy("kind").orderBy(F.desc("created_ms"), "key_id")
    everything = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return (
        everything.withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") <= limit)
        .drop("_rank")
    )
