"""Identity: provenance, keyed pseudonyms, and removal of plaintext identifiers.

Pseudonyms are HMAC-SHA256 built from two native hashes. The key pads travel in a small table that
is joined by key version, so neither keys nor plaintext ids appear as literals in a plan.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgauge import constants as C
from vitalgauge.session import small_table

MAX_KEY_VERSIONS = 16
MIN_KEY_BYTES = 32
_BLOCK = 64
# Default message domains; a deployment that continues existing pseudonyms passes its own.
INSTALLATION_DOMAIN = "installation.v1"
SESSION_DOMAIN = "session.v1"


def key_pads(secret: bytes) -> tuple[bytes, bytes]:
    """Inner and outer pad of an HMAC-SHA256 key of at most one block."""
    if not MIN_KEY_BYTES <= len(secret) <= _BLOCK:
        raise ValueError("a pseudonym key has 32 to 64 bytes")
    padded = secret.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in padded), bytes(b ^ 0x5C for b in padded)


def key_ring(spark: SparkSession, keys: dict[str, str]) -> DataFrame:
    """Versioned key table from Base64 secrets; at most 16 versions, so always broadcastable."""
    if not 1 <= len(keys) <= MAX_KEY_VERSIONS:
        raise ValueError("a key ring holds 1 to 16 versions")
    rows = [
        (version, *key_pads(base64.b64decode(secret, validate=True)))
        for version, secret in keys.items()
    ]
    return small_table(spark, rows, "key_version string, ipad binary, opad binary")


def hmac_sql(domain: str, tenant: str, identity: str, ipad: str = "ipad", opad: str = "opad") -> str:
    """SQL of the keyed digest; ``ipad`` and ``opad`` name the key's pads."""
    message = (
        f"concat(encode('{domain}', 'UTF-8'), unhex('00'), encode({tenant}, 'UTF-8'),"
        f" unhex('00'), encode({identity}, 'UTF-8'))"
    )
    return f"sha2(concat({opad}, unhex(sha2(concat({ipad}, {message}), 256))), 256)"


def resolve_identity(events: DataFrame) -> DataFrame:
    """Release, installation and session identity with their provenance.

    An occurrence snapshot wins; a schema-2 batch declares for its events; older requests declare
    by header, or not at all.
    """
    declared = (
        "CASE WHEN schema_version = '2' THEN '{batch}' WHEN {value} IS NOT NULL THEN '{request}'"
        " ELSE '{absent}' END"
    )

    def quality(value: str) -> str:
        text = declared.format(
            batch=C.BATCH_DECLARED, request=C.REQUEST_DECLARED, absent=C.ABSENT, value=value
        )
        return f"if(occurrence IS NOT NULL, '{C.OCCURRENCE_BOUND}', {text})"

    def pick(snapshot: str, header: str) -> str:
        return f"if(occurrence IS NOT NULL, occurrence.{snapshot}, {header})"

    return events.selectExpr(
        *events.columns,
        f"{pick('service_version', 'declared_app_version')} AS app_version",
        f"{pick('app_build', 'declared_app_build')} AS app_build",
        f"{pick('version_code', 'declared_version_code')} AS version_code",
        f"{pick('variant', 'declared_variant')} AS variant",
        f"{pick('installation_id', 'declared_installation_id')} AS installation_plaintext",
        "occurrence.session_id AS session_plaintext",
        f"{quality('declared_app_version')} AS release_identity_quality",
        f"{quality('declared_installation_id')} AS installation_identity_quality",
        f"if(occurrence.session_id IS NOT NULL, '{C.OCCURRENCE_BOUND}', '{C.ABSENT}')"
        " AS session_identity_quality",
    )


def pseudonymize_ids(
    events: DataFrame,
    keys: DataFrame,
    active_version: str,
    installation_domain: str = INSTALLATION_DOMAIN,
    session_domain: str = SESSION_DOMAIN,
) -> DataFrame:
    """Replace plaintext ids by tenant-isolated digests under the active key version."""
    keyed = events.withColumn("key_version", F.lit(active_version)).join(
        F.broadcast(keys), "key_version"
    )

    def digest(domain: str, column: str) -> str:
        return f"if({column} IS NULL, NULL, {hmac_sql(domain, 'tenant_id', column)})"

    kept = [c for c in events.columns if c not in ("installation_plaintext", "session_plaintext")]
    return keyed.selectExpr(
        *kept,
        f"{digest(installation_domain, 'installation_plaintext')} AS installation_hmac",
        "if(installation_plaintext IS NULL, NULL, key_version) AS installation_hmac_key_version",
        f"{digest(session_domain, 'session_plaintext')} AS session_hmac",
        "if(session_plaintext IS NULL, NULL, key_version) AS session_hmac_key_version",
    )


def match_rotated_identity(
    replays: DataFrame, stored: DataFrame, keys: DataFrame, domain: str = INSTALLATION_DOMAIN
) -> DataFrame:
    """Compare a replay's plaintext with the stored digest under the stored key version.

    An unknown version never matches; an absent plaintext matches only an absent digest.
    """
    joined = replays.join(
        stored.select(
            "tenant_id",
            "event_id",
            F.col("installation_hmac").alias("stored_hmac"),
            F.col("installation_hmac_key_version").alias("key_version"),
        ),
        ["tenant_id", "event_id"],
    ).join(F.broadcast(keys), "key_version", "left")
    same = (
        "if(installation_plaintext IS NULL, stored_hmac IS NULL AND key_version IS NULL,"
        " coalesce("
        + hmac_sql(domain, "tenant_id", "installation_plaintext")
        + " = stored_hmac, false))"
    )
    return joined.selectExpr("tenant_id", "event_id", "key_version", f"{same} AS matches")


_SECRETS = ("installation_plaintext", "session_plaintext")


def _holds(text: str) -> str:
    return " OR ".join(
        f"coalesce({s} <> '' AND contains({text}, {s}), false)" for s in _SECRETS
    )


def scrub_identifiers(events: DataFrame) -> DataFrame:
    """Delete map entries, scenes, occurrence texts and native frames that carry a plaintext id.

    Keys are searched only inside sender-controlled maps. A partly scrubbed frame is no longer an
    exact identity and is dropped whole, at the top level as inside an occurrence.
    """
    frame = " OR ".join(_holds(f"f.{c}") for c in ("abi", "module_build_id", "module_name"))
    out = []
    for column in events.columns:
        if column in ("fields", "field_types", "global_context", "extras", "unknown"):
            out.append(
                f"map_filter({column}, (k, v) -> NOT ({_holds('k')} OR {_holds('v')})) AS {column}"
            )
        elif column == "scene":
            out.append(f"if({_holds('scene')}, NULL, scene) AS scene")
        elif column == "native_frames":
            out.append(f"filter(native_frames, f -> NOT ({frame})) AS native_frames")
        elif column == "occurrence":
            parts = []
            for field in events.schema["occurrence"].dataType:
                value = f"occurrence.{field.name}"
                if field.name == "native_frames":
                    value = f"filter({value}, f -> NOT ({frame}))"
                elif field.dataType.typeName() == "string":
                    value = f"if({_holds(value)}, NULL, {value})"
                parts.append(f"'{field.name}', {value}")
            scrubbed = f"named_struct({', '.join(parts)})"
            out.append(f"if(occurrence IS NULL, NULL, {scrubbed}) AS occurrence")
        else:
            out.append(column)
    return events.selectExpr(*out)


# Identifiers that can't be rewritten (fixed values).
REQUIRED_IDENTIFIERS = (
    "event_id", "module", "name", "process_name", "thread_name", "tenant_id", "app_id",
    "environment", "sdk_version", "app_version", "app_build", "version_code", "variant",
)


def reject_identity_leak(events: DataFrame) -> DataFrame:
    """Add ``identity_leak``: a required identifier embeds a plaintext id and cannot be rewritten."""
    leak = " OR ".join(_holds(c) for c in REQUIRED_IDENTIFIERS)
    return events.withColumn("identity_leak", F.expr(leak))
