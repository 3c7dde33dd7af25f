"""Indexing: artifacts to chunks, upsert by identity, replacement, and text put together again."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import keys, text, vectors

IDENTITY = ("tenant_id", "artifact_id", "chunk_index", "embedding_model", "embedding_version")


def chunk_rows(artifacts: DataFrame, *, size: int = 100, overlap: int = 20) -> DataFrame:
    """A row for each chunk of (tenant_id, artifact_id, version, text): index, text, tokens, content hash and id."""
    each = artifacts.select("tenant_id", "artifact_id", "version", F.posexplode(text.chunks(F.col("text"), size, overlap)).alias("chunk_index", "chunk_text"))
    hashed = each.withColumn("content_sha256", keys.sha256(F.col("chunk_text")))
    return hashed.select(
        keys.chunk_id(F.col("artifact_id"), F.col("version"), F.col("chunk_index"), F.col("content_sha256")).alias("chunk_id"),
        "tenant_id",
        "artifact_id",
        "version",
        "chunk_index",
        F.col("chunk_text").alias("text"),
        text.token_estimate(F.col("chunk_text")).alias("token_count"),
        "content_sha256",
    )


def invalid_chunk(dimensions: int | None = None) -> Column:
    """True where a chunk must be kept out of the store: blank identities or text, negative numbers, a bad vector."""

    def blank(c: str) -> Column:
        return F.coalesce(F.trim(F.col(c)) == "", F.lit(True))

    out = F.lit(False)
    for c in ("chunk_id", "tenant_id", "artifact_id", "text", "content_sha256", "embedding_model", "embedding_version"):
        out = out | blank(c)
    numbers = F.coalesce((F.col("chunk_index") < 0) | (F.col("token_count") < 0), F.lit(True))
    return out | numbers | ~vectors.valid(F.col("embedding"), dimensions)


def upserted(stored: DataFrame, new: DataFrame, *, identity: tuple[str, ...] = IDENTITY, order_col: str = "seq") -> DataFrame:
    """The last row of each identity, new ones after stored ones; one shuffle by identity."""
    every = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*identity).orderBy(F.desc("_new"), F.desc(order_col))
    return every.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_new")


def inserted_if_absent(stored: DataFrame, new: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """Adds rows whose key is not stored; stored ones are never changed."""
    return stored.unionByName(new.dropDuplicates(list(on)).join(stored.select(*on), list(on), "left_anti").select(*stored.columns))


def replaced(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New chunks of artifacts in place of all that were stored for them, so that a shorter version leaves nothing behind."""
    return without_artifacts(stored, new.select("tenant_id", "artifact_id").distinct()).unionByName(new.select(*stored.columns))


def without_artifacts(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """Chunks but those of the (tenant_id, artifact_id) that are gone."""
    return chunks.join(gone, ["tenant_id", "artifact_id"], "left_anti")


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """What became of the chunks of each artifact from one version to the next, by their content.

    tenant_id, artifact_id, content_sha256, occurrence, old_index, new_index, change. The k-th chunk of a
    content is paired with the k-th of the same content: `kept`; what is left over is `removed` or
    `added`. One shuffle by artifact and content.
    """
    on = ["tenant_id", "artifact_id", "content_sha256", "occurrence"]

    def numbered(chunks: DataFrame, name: str) -> DataFrame:
        same = Window.partitionBy(*on[:3]).orderBy("chunk_index")
        return chunks.select(*on[:3], F.col("chunk_index").alias(name), F.row_number().over(same).alias("occurrence"))

    both = numbered(old, "old_index").join(numbered(new, "new_index"), on, "full")
    change = F.when(F.col("old_index").isNull(), "added").when(F.col("new_index").isNull(), "removed").otherwise("kept")
    return both.select(*on, "old_index", "new_index", change.alias("change"))


def in_order(pairs: list[tuple[int, int]]) -> list[int]:
    """The old indexes of a longest common subsequence: of pairs (old, new), each index once, a longest run in which both grow."""
    ends: list[int] = []
    at: list[int] = []
    back: list[int] = []
    pairs = sorted(pairs)
    for i, (_, new) in enumerate(pairs):
        k = bisect_left(ends, new)
        if k == len(ends):
            ends.append(new)
            at.append(i)
        else:
            ends[k], at[k] = new, i
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i][0])
        i = back[i]
    return out[::-1]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _in_order(pairs: pd.Series) -> pd.Series:
    return pairs.map(lambda each: in_order([(p["old"], p["new"]) for p in each]))


def with_moves(changes: DataFrame) -> DataFrame:
    """Of the chunks that were kept, those outside of a longest common subsequence of both versions become `moved`.

    Pairs of an artifact meet in one row, of which there are no more than it has chunks.
    """
    kept = F.when(F.col("change") == "kept", F.struct(F.col("old_index").alias("old"), F.col("new_index").alias("new")))
    orders = changes.groupBy("tenant_id", "artifact_id").agg(F.collect_list(kept).alias("pairs")).select("tenant_id", "artifact_id", _in_order("pairs").alias("stay"))
    moved = (F.col("change") == "kept") & ~F.array_contains("stay", F.col("old_index"))
    return changes.join(orders, ["tenant_id", "artifact_id"]).withColumn("change", F.when(moved, "moved").otherwise(F.col("change"))).drop("stay")


def chunks_of(chunks: DataFrame, tenant: str, artifact: str, model: str | None = None) -> DataFrame:
    """Chunks of an artifact in order, of one embedding model if given."""
    mine = chunks.where((F.col("tenant_id") == tenant) & (F.col("artifact_id") == artifact))
    return (mine.where(F.col("embedding_model") == model) if model else mine).orderBy("chunk_index")


def extracted_text(chunks: DataFrame, by: list[str], *, index_col: str, text_col: str, limit: int) -> DataFrame:
    """Texts of each artifact in order, joined by newlines (none after leading empty ones), cut to `limit` characters."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(index_col).alias("i"), F.col(text_col).alias("t")))), lambda x: x["t"])
    joined = F.regexp_replace(F.array_join(parts, "\n"), r"^\n+", "")
    leading = F.element_at(parts, 1) == ""
    whole = F.when(leading, joined).otherwise(F.array_join(parts, "\n"))
    return chunks.groupBy(*by).agg(F.left(whole, F.lit(max(0, limit))).alias("extracted"))
