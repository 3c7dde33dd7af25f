"""Embeddings: a provider called in batches on the executors, and a cache table in front of it."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Texts to vectors, in order. A provider is built once for each partition.
Provider = Callable[[list[str]], list[list[float]]]


def hashing_provider(dimensions: int) -> Provider:
    """Deterministic unit vectors from hashes of words, for tests and dry runs."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dimensions
            for w in t.lower().split():
                h = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big")
                v[h % dimensions] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out

    return embed


def ordered_response(data: list[dict], count: int, dimensions: int) -> list[list[float]]:
    """Vectors of a response in the order of their indexes; every index once, right dimensions, finite numbers."""
    found: dict[int, list[float]] = {}
    for item in data:
        i, v = item["index"], item["embedding"]
        if i in found or not 0 <= i < count:
            raise ValueError("an index is repeated or out of range")
        if len(v) != dimensions or not all(map(math.isfinite, v)):
            raise ValueError("a vector has other dimensions or is not finite")
        found[i] = [float(x) for x in v]
    if len(found) != count:
        raise ValueError("vectors are missing")
    return [found[i] for i in range(count)]


def embedded(rows: DataFrame, make: Callable[[], Provider], dimensions: int, *, key_col: str = "content_sha256", text_col: str = "text", batch: int = 32) -> DataFrame:
    """key, embedding of each row, asked for in batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                vectors = provider(part[text_col].tolist())
                checked = ordered_response([{"index": i, "embedding": v} for i, v in enumerate(vectors)], len(part), dimensions)
                yield pd.DataFrame({key_col: part[key_col].to_numpy(), "embedding": checked})

    return rows.select(key_col, text_col).mapInPandas(run, f"{key_col} string, embedding array<float>")


#: A vector by model, version and content, and when it was last used.
CACHE = "embedding_model string, embedding_version string, content_sha256 string, embedding array<float>, last_use timestamp"


def used(cache: DataFrame, hits: DataFrame, new: DataFrame, model: str, version: str, now: datetime) -> DataFrame:
    """The cache after a run: new vectors (content_sha256, embedding) are added, and what was hit (content_sha256) is used `now`."""
    mine = (F.col("embedding_model") == model) & (F.col("embedding_version") == version)
    at = F.lit(now).cast("timestamp")
    marks = hits.select(F.col("content_sha256").alias("_hit")).union(new.select("content_sha256")).distinct()
    old = cache.join(marks, mine & (F.col("content_sha256") == F.col("_hit")), "left").withColumn("last_use", F.when(F.col("_hit").isNotNull(), at).otherwise(F.col("last_use"))).drop("_hit")
    here = cache.where(mine).select("content_sha256")
    added = new.dropDuplicates(["content_sha256"]).join(here, "content_sha256", "left_anti")
    return old.unionByName(added.select(F.lit(model).alias("embedding_model"), F.lit(version).alias("embedding_version"), "content_sha256", "embedding", at.alias("last_use")))


def last_used(cache: DataFrame, most: int) -> DataFrame:
    """The `most` vectors used last, ties by hash, model and version; one never used goes first.

    A running sum over times of use, which are as many as runs, finds the time at which the bound is
    reached; of the vectors of that time, a running sum over 4,096 ranges of hashes finds the range;
    only that range is ordered row by row. So no task orders the cache.
    """
    at = F.coalesce("last_use", F.lit("0001-01-01").cast("timestamp"))
    rows = cache.withColumn("_at", at)
    newest = Window.orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1)
    times = rows.groupBy("_at").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(newest), F.lit(0)))
    edge = times.where(F.col("before") < most).orderBy("_at").first()
    if edge is None:
        return cache.limit(0)
    newer, then = rows.where(F.col("_at") > F.lit(edge["_at"])), rows.where(F.col("_at") == F.lit(edge["_at"]))
    room = most - edge["before"]
    if edge["n"] > room:
        then = then.withColumn("_range", F.substring("content_sha256", 1, 3))
        counts = sorted((r["_range"], r["n"]) for r in then.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())  # 4,096 hexadecimal ranges
        last, taken = counts[0][0], 0
        for last, n in counts:
            if taken + n >= room:
                break
            taken += n
        first = Window.orderBy("content_sha256", "embedding_model", "embedding_version")
        some = then.where(F.col("_range") == last).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= room - taken)
        then = then.where(F.col("_range") < last).unionByName(some.drop("_n")).drop("_range")
    return newer.unionByName(then).drop("_at")


def with_cache(rows: DataFrame, cache: DataFrame, model: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their cached vectors, distinct texts that the cache lacks) for rows with content_sha256 and text."""
    mine = cache.where((F.col("embedding_model") == model) & (F.col("embedding_version") == version)).select("content_sha256", "embedding")
    hits = rows.join(mine, "content_sha256")
    misses = rows.select("content_sha256", "text").dropDuplicates(["content_sha256"]).join(mine, "content_sha256", "left_anti")
    return hits, misses
