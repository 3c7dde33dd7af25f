"""Identities: checksums, chunk and operation ids, fingerprints, storage keys and their checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_SHA256 = "^[0-9a-f]{64}$"
SAFE_ID = "^[A-Za-z0-9-]{1,128}$"
ENVIRONMENT = "^[A-Za-z0-9-]{1,64}$"


def sha256(c: Column) -> Column:
    """Hex SHA-256 of a string (as UTF-8) or of bytes."""
    return F.sha2(c, 256)


def chunk_id(artifact: Column, version: Column, index: Column, content_sha256: Column) -> Column:
    return sha256(F.concat_ws(":", artifact, version.cast("string"), index.cast("string"), content_sha256))


def operation_id(tenant: Column, artifact: Column, version: Column, kind: Column | str) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return sha256(F.concat_ws(":", tenant, artifact, version.cast("string"), kind))


def map_text(m: Column) -> Column:
    """A map in key order, written {k=v, k=v}."""
    entries = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))


def fingerprint(tenant: Column, content_sha256: Column, metadata: Column, original_name: Column, media_type: Column) -> Column:
    """What an idempotency key stands for: tenant, content, and metadata with name and detected type (these two win)."""
    own = F.create_map(F.lit("originalName"), original_name, F.lit("mediaType"), media_type)
    rest = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("originalName", "mediaType"))
    return sha256(F.concat_ws("\n", tenant, F.lit("INGEST"), content_sha256, map_text(F.map_concat(rest, own))))


def storage_key(environment: str, tenant: Column, media_type: Column, created_at: Column, artifact: Column, version: Column) -> Column:
    """environment/hash of the tenant/image or document/year/month/id/version/content."""
    kind = F.when(media_type.startswith("image/"), F.lit("image")).otherwise(F.lit("document"))
    return F.concat_ws("/", F.lit(environment), sha256(tenant), kind, F.date_format(created_at, "yyyy"), F.date_format(created_at, "MM"), artifact, version.cast("string"), F.lit("content"))


def valid_storage_key(key: Column, environment: str, tenant: Column) -> Column:
    """A key under its tenant's prefix without empty or parent segments."""
    prefix = F.concat(F.lit(f"{environment}/"), sha256(tenant), F.lit("/"))
    return F.coalesce(key.startswith(prefix) & ~key.contains("//") & ~F.array_contains(F.split(key, "/"), ".."), F.lit(False))


def valid_sha256(c: Column) -> Column:
    return F.coalesce(c.rlike(HEX_SHA256), F.lit(False))


def safe_id(c: Column) -> Column:
    return F.coalesce(c.rlike(SAFE_ID), F.lit(False))


def hex_to_base64(c: Column) -> Column:
    return F.base64(F.unhex(c))


def normal_path(c: Column) -> Column:
    """A path without empty and `.` segments, and with `x/..` resolved, innermost first."""
    def step(stack: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(stack) > 0) & (F.element_at(stack, -1) != "..")
        return F.when(part.isin("", "."), stack).when(up, F.slice(stack, 1, F.size(stack) - 1)).otherwise(F.concat(stack, F.array(part)))

    parts = F.aggregate(F.split(c, "/"), F.array().cast("array<string>"), lambda s, p: F.when(F.size(s) > 0, step(s, p)).otherwise(F.when(p.isin("", "."), s).otherwise(F.array(p))))
    return F.concat(F.when(c.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))
