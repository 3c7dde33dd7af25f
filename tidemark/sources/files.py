"""Files: spool listings, content reads, object checks and bounded ranges, all through Spark's readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import keys

SPOOL_NAME = "content.pending"
#: Fixed limits of a read: default and hard bytes of content, default and hard characters of text.
CONTENT_BYTES, CONTENT_HARD, TEXT_CHARS, TEXT_HARD = 262_144, 4 << 20, 32_768, 1_000_000


def binary_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def spool_files(spark: SparkSession, root: str) -> DataFrame:
    """spool_path, bytes, modified of each pending file at most three folders deep; contents are not read."""
    listed = binary_files(spark, root, SPOOL_NAME).select(F.regexp_replace("path", "^[a-z]+:/+", "/").alias("path"), "length", "modificationTime")
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    depth = F.size(F.split(F.substring(F.col("path"), len(base) + 2, 1 << 20), "/"))
    return listed.where((depth >= 1) & (depth <= 3)).select(keys.normal_path(F.col("path")).alias("spool_path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def inside(path: Column, root: str) -> Column:
    """Whether a path, once normalised, lies below the root."""
    return keys.normal_path(path).startswith(root.rstrip("/") + "/")


def contents(spark: SparkSession, root: str) -> DataFrame:
    """path, content, sha256 of every file below a folder."""
    return binary_files(spark, root).select(F.regexp_replace("path", "^[a-z]+:/+", "/").alias("path"), "content", keys.sha256(F.col("content")).alias("sha256"))


def content_source(status: Column, storage_key: Column, spool_path: Column) -> Column:
    """Where an artifact's bytes are: the object if stored under a key, else the spool."""
    return F.when((status == "STORED") & storage_key.isNotNull(), storage_key).otherwise(spool_path)


def verified_objects(objects: DataFrame, expected: DataFrame, environment: str, *, kms_key: str | None = None) -> DataFrame:
    """Expected artifacts (tenant_id, storage_key, sha256, size_bytes) with `verified`: the object has that length and content, under the tenant's prefix.

    Where objects tell the hash of their tenant (tenant_sha256) or the key that encrypts them (kms_key), these must agree too.
    """
    more = [c for c in ("tenant_sha256", "kms_key") if c in objects.columns]
    have = objects.select(F.col("path").alias("storage_key"), F.length("content").cast("long").alias("_length"), F.col("sha256").alias("_sha256"), *[F.col(c).alias(f"_{c}") for c in more])
    joined = expected.join(have, "storage_key", "left")
    ok = keys.valid_storage_key(F.col("storage_key"), environment, F.col("tenant_id")) & keys.valid_sha256(F.col("sha256"))
    ok = ok & (F.col("_length") == F.col("size_bytes")) & (F.col("_sha256") == F.col("sha256"))
    if "tenant_sha256" in more:
        ok = ok & (F.col("_tenant_sha256") == keys.sha256(F.col("tenant_id")))
    if "kms_key" in more:
        ok = ok & F.col("_kms_key").eqNullSafe(F.lit(kms_key))
    return joined.withColumn("verified", F.coalesce(ok, F.lit(False))).drop("_length", "_sha256", *[f"_{c}" for c in more])


def stored_status(checked: DataFrame) -> DataFrame:
    """What becomes of an upload: STORED if verified, else RETRY_PENDING with a code."""
    ok = F.col("verified")
    return checked.withColumn("storage_status", F.when(ok, "STORED").otherwise("RETRY_PENDING")).withColumn("failure_code", F.when(~ok, "STORAGE_FAILED"))


def byte_range(content: Column, offset: int, requested: int, most: int = CONTENT_BYTES) -> Column:
    """payload (base64), next_offset, eof of at most min(requested, most) bytes from an offset."""
    if offset < 0 or requested < 1:
        raise ValueError("a range begins at 0 or later and has a byte at least")
    n = min(requested, most, CONTENT_HARD)
    part = F.substring(content, offset + 1, n)
    return F.struct(
        F.regexp_replace(F.base64(part), r"\s", "").alias("payload"),
        (F.lit(offset).cast("long") + F.length(part)).alias("next_offset"),
        (F.length(content) - offset <= n).alias("eof"),
    )


def inline_or_uri(content: Column, uri: Column, most: int = CONTENT_BYTES) -> Column:
    """The whole content as base64 if it is small, else where to read it."""
    small = F.length(content) <= most
    return F.struct(F.when(small, F.regexp_replace(F.base64(content), r"\s", "")).alias("payload"), F.when(~small, uri).alias("uri"))
