"""Deliveries from the source host: signature, validity, routing, projected fields.

A delivery row has `body` (bytes), `signature` and `event` (both may be null).
"""

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlake import fixed

_BLOCK = 64  # block size of SHA-256 in bytes


def hmac_sha256(body: Column, secret: str) -> Column:
    """HMAC-SHA256 in hex. The two padded keys are literals, so the rest is two native hashes per row.

    Literals are shown by explain() and in event logs, and the secret can be worked out from them. Keep both private, or set
    spark.redaction.string.regex to a pattern that covers them."""
    key = secret.encode("utf-8")
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in key))
    outer = F.lit(bytes(b ^ 0x5C for b in key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body), 256))), 256)


def signature_ok(body: Column, signature: Column, secret: str) -> Column:
    """False without a signature or a secret."""
    if not secret:
        return F.lit(False)
    expected = F.concat(F.lit("sha256="), hmac_sha256(body, secret))
    return F.coalesce(signature, F.lit("")) == expected


def _json_type(value: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def with_payload(deliveries: DataFrame) -> DataFrame:
    """Add `payload` (the body as a variant, null when it is no JSON) and `payload_ok`. Of a key that is there twice the last
    value counts, which is a setting of the session."""
    deliveries.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    parsed = deliveries.withColumn("payload", F.try_parse_json(F.col("body").cast("string")))
    payload = F.col("payload")
    number = F.try_variant_get(payload, "$.number", "double")
    ok = (
        (_json_type(payload, "$.action") == "STRING")
        & (number == F.floor(number))
        & _json_type(payload, "$.pull_request").startswith("OBJECT")
        & _json_type(payload, "$.repository").startswith("OBJECT")
        & _json_type(payload, "$.sender").startswith("OBJECT")
    )
    return parsed.withColumn("payload_ok", F.coalesce(ok, F.lit(False)))


def _field(path: str) -> Column:
    return F.coalesce(F.try_variant_get("payload", path, "string"), F.lit(""))


def project(with_payloads: DataFrame, keys: list[str]) -> DataFrame:
    """Fields of valid deliveries; those that are missing are empty."""
    return with_payloads.where("payload_ok").select(
        *keys,
        _field("$.action").alias("action"),
        F.try_variant_get("payload", "$.number", "bigint").alias("pr_number"),
        _field("$.repository.owner.login").alias("owner"),
        _field("$.repository.name").alias("repo_name"),
        _field("$.repository.full_name").alias("full_repo"),
        _field("$.pull_request.head.sha").alias("head_sha"),
        _field("$.pull_request.head.ref").alias("head_ref"),
        _field("$.pull_request.base.ref").alias("base_ref"),
    )


def route(deliveries: DataFrame, secret: str = "") -> DataFrame:
    """Add `status`, `code`, `message` and `pr_number`. The first rule that applies decides.

    Without a secret no signature is asked for.
    """
    rows = with_payload(deliveries)
    action = F.try_variant_get("payload", "$.action", "string")
    number = F.try_variant_get("payload", "$.number", "bigint")
    event = F.coalesce("event", F.lit("None"))
    unsigned = ~signature_ok(F.col("body"), F.col("signature"), secret) if secret else F.lit(False)

    def outcome(status: str, code: int, message: Column, pr: Column = F.lit(None)) -> Column:
        return F.struct(
            F.lit(status).alias("status"), F.lit(code).alias("code"), message.alias("message"),
            pr.cast("bigint").alias("pr_number"),
        )

    decided = (
        F.when(F.coalesce(F.length("body"), F.lit(0)) == 0, outcome("ok", 200, F.lit("Empty body received")))
        .when(unsigned, outcome("rejected", 401, F.lit("Invalid signature")))
        .when(event == "ping", outcome("ok", 200, F.lit("Pong! Webhook configured successfully")))
        .when(event != "pull_request", outcome("skipped", 200, F.concat(F.lit("Event type '"), event, F.lit("' not handled"))))
        .when(~F.col("payload_ok"), outcome("rejected", 400, F.lit("Invalid payload")))
        .when(
            ~action.isin(fixed.REVIEWED_ACTIONS),
            outcome("skipped", 200, F.concat(F.lit("Action '"), action, F.lit("' not handled")), number),
        )
        .otherwise(outcome("processing", 200, F.lit("PR review started"), number))
    )
    return rows.withColumn("_outcome", decided).select("*", "_outcome.*").drop("_outcome")
