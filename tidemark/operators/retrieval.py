"""Retrieval: vector and keyword top-k, reciprocal-rank fusion, filters and the joined hits.

Both branches project only what they rank by and end in a top-k, so that what is fused, joined and
filtered afterwards has at most two lists of candidates, however many chunks there are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text, vectors

#: The constant of reciprocal-rank fusion.
RANK_CONSTANT = 60
#: Candidates of each branch for each hit that is asked for.
MULTIPLIER = 4
MOST_HITS, MOST_STORED = 100, 1000


@dataclass(frozen=True)
class Filter:
    """Media types and tags that candidates must have; empty lists are no condition."""

    media_types: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)

    def column(self) -> Column:
        kind = F.col("media_type").isin(*self.media_types) if self.media_types else F.lit(True)
        return kind & text.has_all_tags(F.col("tags"), self.tags)


def hits_limit(limit: int) -> int:
    return max(1, min(limit, MOST_HITS))


def searchable(chunks: DataFrame, artifacts: DataFrame, tenant: str | None, where: Filter | None = None) -> DataFrame:
    """Chunks of a tenant whose artifact is indexed and passes the filter; Spark chooses the join."""
    ready = artifacts.where(F.col("index_status") == "READY")
    if where is not None:
        ready = ready.where(where.column())
    if tenant is not None:
        ready, chunks = ready.where(F.col("tenant_id") == tenant), chunks.where(F.col("tenant_id") == tenant)
    return chunks.join(ready.select(F.col("tenant_id").alias("of_tenant"), F.col("id").alias("of_artifact")), (F.col("tenant_id") == F.col("of_tenant")) & (F.col("artifact_id") == F.col("of_artifact")), "left_semi")


def vector_topk(chunks: DataFrame, query: list[float], k: int, *, id_col: str = "chunk_id", vector_col: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """The k chunks nearest to a query by cosine, ties by id; chunks without a vector are left out."""
    score = vectors.cosine(F.col(vector_col), vectors.literal(query))
    rows = chunks.where(F.col(vector_col).isNotNull()).select(id_col, *keep, score.alias("score"))
    return rows.orderBy(F.desc("score"), id_col).limit(min(k, MOST_STORED))


def keyword_topk(chunks: DataFrame, query: str, k: int, *, id_col: str = "chunk_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The k chunks with the greatest part of the query's terms, ties by id; chunks without any are left out."""
    score = text.keyword_score(F.col(text_col), text.query_terms(query))
    return chunks.select(id_col, *keep, score.alias("score")).where("score > 0").orderBy(F.desc("score"), id_col).limit(min(k, MOST_STORED))


def ranked(branch: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Adds rank, from 1, to the few rows of a branch."""
    return branch.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


def fused(branches: list[DataFrame], id_col: str = "chunk_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Sum over branches of 1 / (60 + rank) for each id; each branch has at most the candidates asked for."""
    rows = [ranked(b, id_col).select(id_col, *keep, (F.lit(1.0) / (F.col("rank") + RANK_CONSTANT)).alias("part")) for b in branches]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return every.groupBy(id_col, *keep).agg(F.sum("part").alias("score"))


def one_of(artifacts: DataFrame, tenant: str, artifact: str) -> DataFrame:
    """The artifact of a tenant by its id, tombstones included."""
    return artifacts.where((F.col("tenant_id") == tenant) & (F.col("id") == artifact))


def newest(artifacts: DataFrame, limit: int) -> DataFrame:
    """The artifacts created last, ties by id; tombstones count."""
    return artifacts.orderBy(F.desc("created_at"), "id").limit(limit)


def readable() -> Column:
    return (F.col("storage_status") != "DELETED") & (F.col("index_status") != "DELETED")


def resource_uri(artifact: Column, chunk: Column) -> Column:
    return F.concat(F.lit("artifact://"), artifact, F.lit("/chunks/"), chunk)


def hybrid_search(
    chunks: DataFrame,
    artifacts: DataFrame,
    query: str,
    vector: list[float],
    *,
    tenant: str | None,
    limit: int,
    multiplier: int = MULTIPLIER,
    media_types: list[str] | None = None,
    tags: list[str] | None = None,
    created_after: datetime | None = None,
    prefilter: bool = False,
    words: Callable[[DataFrame, int], DataFrame] | None = None,
) -> DataFrame:
    """chunk_id, artifact_id, score, uri of the best hits, greatest score first, ties by chunk id.

    Filters on media types and tags apply to the candidates; the time filter (inclusive) only to the
    fused list, so that it may leave fewer hits, unless `prefilter` asks for it beforehand. `words` gives
    the best (chunk_id, artifact_id, score) of the chunks by another measure than parts of words.
    """
    if not query.strip():
        raise ValueError("a query must not be blank")
    n = hits_limit(limit)
    k = n * max(1, min(multiplier, 100))
    where = Filter(media_types or [], tags or [])
    after = F.col("created_at") >= F.lit(created_after) if created_after else F.lit(True)
    found = searchable(chunks, artifacts.where(after) if prefilter else artifacts, tenant, where)
    branches = [vector_topk(found, vector, k, keep=("artifact_id",)), words(found, k) if words else keyword_topk(found, query, k, keep=("artifact_id",))]
    best = fused(branches, keep=("artifact_id",))
    of = artifacts.where(readable() & after & where.column())
    if tenant is not None:
        of = of.where(F.col("tenant_id") == tenant)
    return (
        of.select(F.col("id").alias("artifact_id"))
        .join(F.broadcast(best), "artifact_id")  # two lists of k candidates
        .select("chunk_id", "artifact_id", "score", resource_uri(F.col("artifact_id"), F.col("chunk_id")).alias("resource_uri"))
        .orderBy(F.desc("score"), "chunk_id")
        .limit(n)
    )
