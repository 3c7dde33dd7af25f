"""Registered queries that go through an index: full text by posting lists, vectors by lists of clusters.

An index is built over the whole table when it is first asked for, is kept in the shared folder, and
serves the later queries of the session for as long as the table's files are the same.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import nearest, postings
from tidemark.plans.queries import FTS_AND, FTS_RANK, SQL, first_vector, query, t
from tidemark.sources import shared

_built: dict[tuple, tuple] = {}


def _once(spark: SparkSession, sf: str, name: str, kind: str, build: Callable[[DataFrame], tuple]) -> tuple:
    """What `build` makes of a table, the kept rows first; made anew if the session or the table's files are other ones, or the kept rows are gone."""
    rows = t(spark, sf, name)
    files = rows.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect()  # a row for each file
    key = (spark.sparkContext.applicationId, kind, tuple(sorted((r[0], r[1], str(r[2])) for r in files)))
    if key not in _built or not shared.there(_built[key][0]):
        _built[key] = build(rows)
    return _built[key]


def _postings(spark: SparkSession, sf: str) -> DataFrame:
    def build(docs: DataFrame) -> tuple[DataFrame]:
        return (shared.kept(postings.dealt(postings.postings(docs, id_col="doc_id")), "postings", "bucket"),)

    return _once(spark, sf, "documents", "postings", build)[0]


def _lists(spark: SparkSession, sf: str, rounds: int = nearest.ROUNDS) -> tuple[DataFrame, np.ndarray, dict[int, tuple[int, float]]]:
    def build(rows: DataFrame) -> tuple:
        centres = nearest.centroids(rows, nearest.default_lists(rows.where("embedding is not null").count()), id_col="vec_id", vector_col="embedding", rounds=rounds)
        lists = nearest.dealt(nearest.assigned(rows, centres, id_col="vec_id", vector_col="embedding"))
        index = shared.kept(lists, "lists", "list")
        return index, centres, nearest.widths(index)

    return _once(spark, sf, "embeddings", f"lists-{rounds}", build)


@query("fts_indexed", SQL["fts_rank"])
def fts_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of `fts_rank`, from posting lists."""
    return postings.search(_postings(spark, sf), FTS_RANK, 50).withColumnRenamed("id", "doc_id")


@query("fts_match_indexed", SQL["fts_match"])
def fts_match_indexed(spark: SparkSession, sf: str) -> DataFrame:
    return postings.matching(_postings(spark, sf), FTS_AND).withColumnRenamed("id", "doc_id")




@query(
    "fts_document_frequency",
    r"SELECT term, count(*) AS n_docs, sum(n)::BIGINT AS n_places, max(n)::INT AS most FROM (SELECT term, doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY ALL) GROUP BY term HAVING count(*) >= 2",
)
def fts_document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of at least two documents, read from the index: documents, places, and the most places in one document."""
    docs = F.when(F.col("block") < 0, 1).otherwise(F.size(F.array_distinct(F.transform("places", lambda x: F.shiftright(x, postings.POSITION)))))
    lists = _postings(spark, sf).where(F.col("bucket") < postings.BUCKETS).select("term", "most", docs.alias("n"), F.size("places").alias("places"))
    return lists.groupBy("term").agg(F.sum("n").alias("n_docs"), F.sum("places").alias("n_places"), F.max("most").alias("most")).where("n_docs >= 2")


@query("vector_topk_indexed", SQL["vector_topk"])
def vector_topk_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of `vector_topk`: lists are read until no other one can hold a better vector."""
    index, centres, width = _lists(spark, sf)
    return nearest.exact_search(index, centres, width, first_vector(spark, sf), 50).select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


NEIGHBOURS, RECALL = 10, 0.95


@query("vector_neighbours")
def vector_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one, from as many lists as a sample of them says are needed to find 95 % of all."""
    index, centres, _ = _lists(spark, sf)
    asked = t(spark, sf, "embeddings").where("vec_id % 100 = 0")
    probes = nearest.probes_for(index, centres, asked, NEIGHBOURS, RECALL, id_col="vec_id", vector_col="embedding")
    found = nearest.neighbours(index, centres, asked, NEIGHBOURS, id_col="vec_id", vector_col="embedding", probes=probes)
    return found.select("query_id", F.col("id").alias("vec_id"), "score", "rank")


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


@query(
    "vector_probed",
    f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt({_dot('embedding', 'embedding')})) AS v, md5(vec_id::VARCHAR) AS h FROM embeddings),
c AS (SELECT v, row_number() OVER (ORDER BY h) - 1 AS list FROM (SELECT DISTINCT ON (v) v, h FROM e ORDER BY v, h) QUALIFY list < (SELECT floor(sqrt(count(*))) FROM e)),
m AS (SELECT vec_id, any_value(e.v) AS v, min({{'d': -{_dot('e.v', 'c.v')}, 'list': list}}).list AS list FROM e, c GROUP BY vec_id),
q AS (SELECT vec_id AS query_id, v AS asked FROM e WHERE vec_id % 100 = 0),
p AS (SELECT query_id, asked, list FROM q, c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {_dot('asked', 'v')} DESC, list) <= {nearest.PROBES}),
s AS (SELECT query_id, vec_id, round({_dot('asked', 'v')}, 9) AS score FROM p JOIN m USING (list))
SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= {NEIGHBOURS}""",
)
def vector_probed(spark: SparkSession, sf: str) -> DataFrame:
    """The same search over lists around sampled vectors as they are, with a fixed number of probes."""
    index, centres, _ = _lists(spark, sf, rounds=0)
    asked = t(spark, sf, "embeddings").where("vec_id % 100 = 0")
    found = nearest.neighbours(index, centres, asked, NEIGHBOURS, id_col="vec_id", vector_col="embedding")
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")
