"""Registered queries over the benchmark tables, each beside the SQL that must give the same rows.

The tables stand for the engine's own: documents are text artifacts (source as tenant, lang as tag),
embeddings are chunk vectors (vec_id as doc_id), labels tell what is indexed (quality 1: READY),
conversations are chunks in order, events are audit and job events, orders are artifacts with times.
Constants such as limits are parameters of the feature that a query shows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import keys, media, redaction, text, times
from tidemark.operators import access, audit, fulltext, indexing, intake, jobs, retrieval
from tidemark.sources import embed, extract, files
from tidemark.streaming import leases, relay

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

QUERY_TEXT = "license version and the personal thing"
#: RE2 has no vertical tab in its white space.
WS = r"[ \t\n\x0B\f\r]+"
NOW = datetime(2024, 6, 1)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def artifacts_of(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as artifacts, indexed where a label says so."""
    labels = t(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = t(spark, sf, "documents").select("doc_id", "source", "lang")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("tenant_id"), F.lit("text/plain").alias("media_type"), F.array("lang").alias("tags"), F.lit("STORED").alias("storage_status"),
        F.when(F.col("quality") == 1, "READY").otherwise("PENDING").alias("index_status"), F.lit(None).cast("timestamp").alias("created_at"),
    )


def first_vector(spark: SparkSession, sf: str) -> list[float]:
    return list(t(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"])


def chunks_with_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """A chunk for each document, with a vector if there is one of its number."""
    docs = t(spark, sf, "documents").select("doc_id", F.col("source").alias("tenant_id"), "text")
    vectors = t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return docs.join(vectors, "doc_id", "left").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").cast("string").alias("artifact_id"), "tenant_id", "text", "embedding")


_WORDS = f"string_split(trim(regexp_replace(text, '{WS}', ' ', 'g')), ' ')"
_CHUNKS = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents WHERE trim(regexp_replace(text, '{WS}', ' ', 'g')) <> ''),
c AS (SELECT doc_id, unnest(range(0, 1 + greatest(0, ceil((len(words) - 100) / 80.0))::BIGINT)) AS k, words FROM w),
x AS (SELECT doc_id, k::INT AS chunk_index, array_to_string(words[k * 80 + 1 : k * 80 + 100], ' ') AS chunk_text FROM c)
"""


@query("chunk_documents", _CHUNKS + "SELECT doc_id, chunk_index, chunk_text FROM x")
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", F.posexplode(text.chunks(F.col("text"))).alias("chunk_index", "chunk_text"))


@query("chunk_ids", _CHUNKS + "SELECT sha256(doc_id || ':1:' || chunk_index || ':' || sha256(chunk_text)) AS chunk_id, doc_id::VARCHAR AS artifact_id, chunk_index, sha256(chunk_text) AS content_sha256, greatest(1, ceil(length(chunk_text) / 4.0))::INT AS token_count FROM x")
def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    docs = t(spark, sf, "documents").select(F.col("source").alias("tenant_id"), F.col("doc_id").cast("string").alias("artifact_id"), F.lit(1).alias("version"), "text")
    return indexing.chunk_rows(docs).select("chunk_id", "artifact_id", "chunk_index", "content_sha256", "token_count")


@query("token_estimate", "SELECT doc_id, greatest(1, ceil(length(text) / 4.0))::INT AS token_count FROM documents")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("token_count"))


_TERMS = "[" + ", ".join(f"'{x}'" for x in text.query_terms(QUERY_TEXT)) + "]"
_KEYWORD = f"len(list_filter({_TERMS}, lambda x: contains(lower(text), x)))::DOUBLE / len({_TERMS})"


@query("keyword_topk", f"SELECT doc_id, {_KEYWORD} AS score FROM documents WHERE {_KEYWORD} > 0 ORDER BY score DESC, doc_id LIMIT 50")
def keyword_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.keyword_topk(t(spark, sf, "documents"), QUERY_TEXT, 50, id_col="doc_id")


def _cosine(a: str, b: str) -> str:
    def products(x: str, y: str) -> str:
        return f"list_sum(list_transform(list_zip({x}, {y}), lambda p: (p[1] * p[2])::DOUBLE))"

    return f"({products(a, b)} / (sqrt({products(a, a)}) * sqrt({products(b, b)})))"


_VECTOR = f"SELECT e.*, {_cosine('e.embedding', 'q.embedding')} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


@query("vector_topk", f"SELECT vec_id, round(score, 6) AS score FROM ({_VECTOR}) ORDER BY round(score, 6) DESC, vec_id LIMIT 50")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "embeddings")
    found = retrieval.vector_topk(rows, first_vector(spark, sf), 50, id_col="vec_id")
    return found.select("vec_id", F.round("score", 6).alias("score"))


_READY = "SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1"


@query("vector_topk_filtered", f"SELECT v.vec_id AS chunk_id, round(score, 6) AS score FROM ({_VECTOR}) v JOIN documents d ON d.doc_id = v.vec_id JOIN ({_READY}) r ON r.doc_id = d.doc_id WHERE d.lang = 'en' ORDER BY v.score DESC, v.vec_id LIMIT 20")
def vector_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    found = retrieval.searchable(chunks_with_vectors(spark, sf), artifacts_of(spark, sf), None, retrieval.Filter(["text/plain"], ["en"]))
    return retrieval.vector_topk(found, first_vector(spark, sf), 20).select("chunk_id", F.round("score", 6).alias("score"))


_RRF = "sum(1.0::DOUBLE / (60 + r))"


@query(
    "rrf_fuse",
    f"""
WITH a AS (SELECT o_orderkey AS chunk_id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders QUALIFY r <= 200),
b AS (SELECT o_orderkey AS chunk_id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders QUALIFY r <= 200)
SELECT chunk_id, {_RRF} AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY chunk_id ORDER BY score DESC, chunk_id LIMIT 100""",
)
def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "orders")
    lists = [rows.select(F.col("o_orderkey").alias("chunk_id"), F.col(c).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(200) for c in ("o_totalprice", "o_orderdate")]
    return retrieval.fused(lists).orderBy(F.desc("score"), "chunk_id").limit(100)


@query(
    "hybrid_search",
    f"""
WITH d AS (SELECT d.doc_id AS chunk_id, d.text FROM documents d JOIN ({_READY}) r USING (doc_id) WHERE d.lang = 'en'),
v AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM ({_VECTOR}) x JOIN d ON d.chunk_id = x.vec_id QUALIFY r <= 40),
k AS (SELECT chunk_id, row_number() OVER (ORDER BY {_KEYWORD} DESC, chunk_id) AS r FROM d WHERE {_KEYWORD} > 0 QUALIFY r <= 40)
SELECT chunk_id, chunk_id::VARCHAR AS artifact_id, score, 'artifact://' || chunk_id || '/chunks/' || chunk_id AS resource_uri
FROM (SELECT chunk_id, {_RRF} AS score FROM (SELECT * FROM v UNION ALL SELECT * FROM k) GROUP BY chunk_id) ORDER BY score DESC, chunk_id LIMIT 10""",
)
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.hybrid_search(chunks_with_vectors(spark, sf), artifacts_of(spark, sf), QUERY_TEXT, first_vector(spark, sf), tenant=None, limit=10, tags=["en"])


_AFTER = "1997-01-01"
_LATER = """
WITH d AS (SELECT d.doc_id AS chunk_id, d.text, o_orderdate AS born FROM documents d JOIN orders ON o_orderkey = d.doc_id + 1 WHERE d.source = (SELECT min(source) FROM documents)),
k AS (SELECT chunk_id, born, row_number() OVER (ORDER BY {keyword} DESC, chunk_id) AS r FROM d WHERE {keyword} > 0 QUALIFY r <= 40),
v AS (SELECT d.chunk_id, d.born, row_number() OVER (ORDER BY score DESC, d.chunk_id) AS r FROM ({vector}) x JOIN d ON d.chunk_id = x.vec_id QUALIFY r <= 40)
SELECT chunk_id, score FROM (SELECT chunk_id, any_value(born) AS born, {rrf} AS score FROM (SELECT * FROM v UNION ALL SELECT * FROM k) GROUP BY chunk_id) WHERE born >= TIMESTAMP '{after}' ORDER BY score DESC, chunk_id LIMIT 10"""


@query("search_created_after", _LATER.format(keyword=_KEYWORD, vector=_VECTOR, rrf=_RRF, after=_AFTER))
def search_created_after(spark: SparkSession, sf: str) -> DataFrame:
    """A search within one tenant; the time filter comes after the fusion, so it may leave fewer hits."""
    tenant = t(spark, sf, "documents").agg(F.min("source")).first()[0]
    dates = t(spark, sf, "orders").select((F.col("o_orderkey") - 1).cast("string").alias("id"), F.col("o_orderdate").alias("created_at"))
    dated = artifacts_of(spark, sf).drop("created_at").withColumn("index_status", F.lit("READY")).join(dates, "id")
    found = retrieval.hybrid_search(chunks_with_vectors(spark, sf), dated, QUERY_TEXT, first_vector(spark, sf), tenant=tenant, limit=10, created_after=datetime.fromisoformat(_AFTER))
    return found.select("chunk_id", "score")


def _requests(spark: SparkSession, sf: str, key: F.Column, fingerprint: F.Column | None = None) -> DataFrame:
    docs = t(spark, sf, "documents")
    sha = keys.sha256(F.col("text"))
    mark = sha if fingerprint is None else fingerprint
    return docs.select(F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("tenant_id"), key.alias("idempotency_key"), sha.alias("sha256"), mark.alias("fingerprint"))


@query("register_fold", "SELECT doc_id AS seq, lang AS tenant_id, CASE WHEN row_number() OVER w = 1 THEN 'CREATED' ELSE 'CONTENT_DUPLICATE' END AS outcome, first_value(doc_id::VARCHAR) OVER w AS artifact_id FROM documents WINDOW w AS (PARTITION BY lang, sha256(text) ORDER BY doc_id)")
def register_fold(spark: SparkSession, sf: str) -> DataFrame:
    return intake.registered(_requests(spark, sf, F.col("doc_id").cast("string")))


_REGISTER = """
WITH RECURSIVE o AS (SELECT {tenant} AS tenant_id, doc_id AS seq, doc_id::VARCHAR AS id, {key} AS k, doc_id % 2 AS mark, {content} AS sha, row_number() OVER (PARTITION BY {tenant} ORDER BY doc_id) AS i FROM documents),
f AS (SELECT tenant_id, seq, i, 'CREATED' AS outcome, id AS artifact_id, [k] AS ks, [mark] AS marks, [sha] AS shas, [id] AS made FROM o WHERE i = 1
  UNION ALL SELECT tenant_id, seq, i, CASE WHEN at_key > 0 THEN CASE WHEN marks[at_key] = mark THEN 'IDEMPOTENT_REPLAY' ELSE 'CONFLICT' END WHEN at_sha > 0 THEN 'CONTENT_DUPLICATE' ELSE 'CREATED' END,
    CASE WHEN at_key > 0 THEN made[at_key] WHEN at_sha > 0 THEN made[at_sha] ELSE id END,
    CASE WHEN new THEN list_append(ks, k) ELSE ks END, CASE WHEN new THEN list_append(marks, mark) ELSE marks END, CASE WHEN new THEN list_append(shas, sha) ELSE shas END, CASE WHEN new THEN list_append(made, id) ELSE made END
  FROM (SELECT o.*, f.ks, f.marks, f.shas, f.made, coalesce(list_position(f.ks, o.k), 0) AS at_key, coalesce(list_position(f.shas, o.sha), 0) AS at_sha, at_key + at_sha = 0 AS new FROM f JOIN o ON o.tenant_id = f.tenant_id AND o.i = f.i + 1))
SELECT seq, tenant_id, outcome, artifact_id FROM f"""


@query("register_shared_keys", _REGISTER.format(tenant="lang", key="'k' || (doc_id // 9)", content="sha256(text)"))
def register_shared_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that nine requests share, of two fingerprints: replays, conflicts and duplicates."""
    return intake.registered(_requests(spark, sf, F.concat(F.lit("k"), F.floor(F.col("doc_id") / 9)), (F.col("doc_id") % 2).cast("string")))


@query("register_connected", _REGISTER.format(tenant="'t'", key="'k' || (doc_id * 7 % 43)", content="(n_chars % 61)::VARCHAR"))
def register_connected(spark: SparkSession, sf: str) -> DataFrame:
    """All requests of one tenant, nearly all connected by the keys and contents that they share."""
    rows = t(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("id"), F.lit("t").alias("tenant_id"), F.concat(F.lit("k"), F.col("doc_id") * 7 % 43).alias("idempotency_key"), (F.col("n_chars") % 61).cast("string").alias("sha256"), (F.col("doc_id") % 2).cast("string").alias("fingerprint"))
    return intake.registered(rows)


@query("checksum_first", "SELECT source AS tenant_id, sha256(text) AS sha256, min(doc_id)::VARCHAR AS id FROM documents GROUP BY 1, 2")
def checksum_first(spark: SparkSession, sf: str) -> DataFrame:
    docs = t(spark, sf, "documents").select(F.col("source").alias("tenant_id"), keys.sha256(F.col("text")).alias("sha256"), "doc_id")
    first = intake.oldest_by_content(docs.select("tenant_id", "sha256", F.col("doc_id").alias("id"), F.col("doc_id").alias("created_at"), F.lit("STORED").alias("storage_status")))
    return first.select("tenant_id", "sha256", F.col("id").cast("string").alias("id"))


@query("operation_ids", "SELECT doc_id::VARCHAR AS artifact_id, type, sha256(source || ':' || doc_id || ':1:' || type) AS id FROM documents, (VALUES ('STORE'), ('INDEX')) v(type)")
def operation_ids(spark: SparkSession, sf: str) -> DataFrame:
    docs = t(spark, sf, "documents").select(F.col("source").alias("tenant_id"), F.col("doc_id").cast("string").alias("id"), F.lit(1).alias("version"), F.lit(NOW).alias("created_at"))
    return intake.outbox_rows(docs).select("artifact_id", "type", "id")


@query("idempotency_fingerprint", "SELECT doc_id, sha256(source || chr(10) || 'INGEST' || chr(10) || sha256(text) || chr(10) || '{lang=' || lang || ', mediaType=text/plain, originalName=doc-' || doc_id || '.txt, tags=' || lang || '}') AS fingerprint FROM documents")
def idempotency_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    meta = F.create_map(F.lit("tags"), F.col("lang"), F.lit("lang"), F.col("lang"))
    name = F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".txt"))
    return t(spark, sf, "documents").select("doc_id", keys.fingerprint(F.col("source"), keys.sha256(F.col("text")), meta, name, F.lit("text/plain")).alias("fingerprint"))


_KEY = "'dev/' || sha256(o_custkey::VARCHAR) || '/' || CASE WHEN o_orderstatus = 'F' THEN 'image' ELSE 'document' END || '/' || strftime(o_orderdate, '%Y/%m') || '/' || o_orderkey || '/1/content'"


def _storage_keys(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "image/png").otherwise("application/pdf")
    key = keys.storage_key("dev", F.col("o_custkey").cast("string"), kind, F.col("o_orderdate"), F.col("o_orderkey").cast("string"), F.lit(1))
    return t(spark, sf, "orders").select("o_orderkey", "o_custkey", key.alias("storage_key"))


@query("storage_keys", f"SELECT o_orderkey, {_KEY} AS storage_key FROM orders")
def storage_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _storage_keys(spark, sf).select("o_orderkey", "storage_key")


@query("storage_key_validation", "SELECT o_orderkey, o_orderkey % 3 = 0 AS valid, to_base64(unhex(sha256(o_orderkey::VARCHAR))) AS checksum_base64 FROM orders")
def storage_key_validation(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("o_orderkey") % 3
    key = F.when(n == 0, F.col("storage_key")).when(n == 1, F.concat("storage_key", F.lit("/../x"))).otherwise(F.concat(F.lit("other/"), "storage_key"))
    hexed = keys.sha256(F.col("o_orderkey").cast("string"))
    return _storage_keys(spark, sf).select("o_orderkey", keys.valid_storage_key(key, "dev", F.col("o_custkey").cast("string")).alias("valid"), keys.hex_to_base64(hexed).alias("checksum_base64"))


@query("tags_normalize", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(replace(p_type, ' ', ', ,') || ', ' || p_brand, ','), lambda x: trim(x)), lambda x: x <> ''))), ',') AS tags FROM part")
def tags_normalize(spark: SparkSession, sf: str) -> DataFrame:
    csv = F.concat(F.replace("p_type", F.lit(" "), F.lit(", ,")), F.lit(", "), "p_brand")
    return t(spark, sf, "part").select("p_partkey", text.tags_csv(csv).alias("tags"))


@query("tags_filter", "SELECT p_partkey FROM part WHERE list_contains(string_split(p_type, ' '), split_part((SELECT min(p_type) FROM part), ' ', 1))")
def tags_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "part")
    wanted = rows.agg(F.min("p_type")).first()[0].split(" ")[0]
    return rows.where(text.has_all_tags(text.tags(F.replace("p_type", F.lit(" "), F.lit(","))), [f" {wanted} "])).select("p_partkey")


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as artifacts of their customer; finished ones are tombstones."""
    status = F.when(F.col("o_orderstatus") == "F", "DELETED").otherwise("STORED")
    return t(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("tenant_id"), F.col("o_orderdate").alias("created_at"), status.alias("storage_status"),
        F.lit("READY").alias("index_status"), F.concat(F.lit("k"), "o_orderkey").alias("idempotency_key"),
    )


_NEWEST = "SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100"


@query("list_newest", f"SELECT o_orderkey, o_orderdate FROM ({_NEWEST})")
def list_newest(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.newest(_orders(spark, sf), 100).select("o_orderkey", F.col("created_at").alias("o_orderdate"))


@query("list_live", f"SELECT o_orderkey FROM ({_NEWEST}) WHERE o_orderstatus <> 'F'")
def list_live(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.newest(_orders(spark, sf), 100).where(retrieval.readable()).select("o_orderkey")


@query("extracted_text", "SELECT conv_id, left(string_agg(text, chr(10) ORDER BY turn), 2000) AS extracted FROM conversations GROUP BY conv_id")
def extracted_text(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.extracted_text(t(spark, sf, "conversations"), ["conv_id"], index_col="turn", text_col="text", limit=2000)


@query("content_range", "SELECT doc_id, to_base64(encode(text)[11:60]) AS payload, 10 + len(encode(text)[11:60])::BIGINT AS next_offset, octet_length(encode(text)) - 10 <= 50 AS eof FROM documents")
def content_range(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", files.byte_range(F.col("text").cast("binary"), 10, 50).alias("r")).select("doc_id", "r.*")


SQL["content_range"] = "WITH b AS (SELECT doc_id, octet_length(encode(text)) AS n, from_hex(substr(hex(encode(text)), 21, 100)) AS part FROM documents) SELECT doc_id, to_base64(part) AS payload, 10 + octet_length(part) AS next_offset, n - 10 <= 50 AS eof FROM b"


@query("excerpt_projection", "SELECT doc_id, left(text, 8192) AS excerpt, 'artifact://' || doc_id || '/chunks/' || sha256(text) AS resource_uri FROM documents")
def excerpt_projection(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", text.excerpt(F.col("text"), 1_000_000).alias("excerpt"), retrieval.resource_uri(F.col("doc_id").cast("string"), keys.sha256(F.col("text"))).alias("resource_uri"))


@query("spool_usage_rollup", "SELECT source AS tenant, sum(n_chars)::BIGINT AS bytes, count(*) AS files, grouping(source)::INT AS is_total FROM documents GROUP BY ROLLUP (source)")
def spool_usage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return intake.usage(t(spark, sf, "documents").select(F.col("source").alias("tenant"), "n_chars"), by="tenant", bytes_col="n_chars")


@query(
    "quota_greedy",
    """
WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
f AS (SELECT source, doc_id, n_chars, i, n_chars <= 20000 AS accepted, CASE WHEN n_chars <= 20000 THEN n_chars ELSE 0 END AS used, CASE WHEN n_chars <= 20000 THEN 1 ELSE 0 END AS n FROM o WHERE i = 1
  UNION ALL SELECT o.source, o.doc_id, o.n_chars, o.i, f.used + o.n_chars <= 20000 AND f.n + 1 <= 10000,
    f.used + CASE WHEN f.used + o.n_chars <= 20000 AND f.n + 1 <= 10000 THEN o.n_chars ELSE 0 END, f.n + CASE WHEN f.used + o.n_chars <= 20000 AND f.n + 1 <= 10000 THEN 1 ELSE 0 END
  FROM f JOIN o ON o.source = f.source AND o.i = f.i + 1)
SELECT source, doc_id, n_chars, accepted FROM f""",
)
def quota_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return intake.accepted_within(t(spark, sf, "documents"), by="source", order_col="doc_id", bytes_col="n_chars", most_bytes=20_000, most_files=intake.TENANT_FILES)


def _spool(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select(keys.normal_path(F.concat(F.lit("/spool/./x/../"), "source", F.lit("/"), "doc_id", F.lit("/content.pending"))).alias("spool_path"))


def _spooled(spark: SparkSession, sf: str) -> DataFrame:
    path = F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("/spool/"), "source", F.lit("/"), F.col("doc_id") * 2, F.lit("/content.pending")))
    return t(spark, sf, "documents").select(F.col("doc_id").alias("id"), path.alias("spool_path"), F.when(F.col("doc_id") % 5 == 0, "STORED").otherwise("SPOOLED").alias("storage_status"))


_SPOOL = "SELECT '/spool/' || source || '/' || doc_id || '/content.pending' AS spool_path FROM documents"
_SPOOLED = "SELECT doc_id AS id, CASE WHEN doc_id % 7 > 0 THEN '/spool/' || source || '/' || doc_id * 2 || '/content.pending' END AS spool_path, CASE WHEN doc_id % 5 = 0 THEN 'STORED' ELSE 'SPOOLED' END AS storage_status FROM documents"


@query("reconcile_orphans", f"SELECT spool_path FROM ({_SPOOL}) WHERE spool_path NOT IN (SELECT spool_path FROM ({_SPOOLED}) WHERE spool_path IS NOT NULL)")
def reconcile_orphans(spark: SparkSession, sf: str) -> DataFrame:
    return intake.orphans(_spool(spark, sf), _spooled(spark, sf))


@query("reconcile_missing", f"SELECT id, spool_path FROM ({_SPOOLED}) WHERE spool_path IS NOT NULL AND storage_status = 'SPOOLED' AND spool_path NOT IN (SELECT spool_path FROM ({_SPOOL}))")
def reconcile_missing(spark: SparkSession, sf: str) -> DataFrame:
    return intake.missing(_spooled(spark, sf), _spool(spark, sf)).select("id", "spool_path")


@query("chunk_upsert_latest", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text || '!' ELSE text END AS text FROM (SELECT DISTINCT ON (conv_id, turn) * FROM conversations ORDER BY conv_id, turn, length(text) DESC)")
def chunk_upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "conversations").select("conv_id", "turn", "text", F.length("text").alias("seq"))
    again = rows.where("turn % 2 = 0").withColumn("text", F.concat("text", F.lit("!")))
    return indexing.upserted(rows, again, identity=("conv_id", "turn")).select("conv_id", "turn", "text")


@query("delete_cascade", "SELECT conv_id, turn FROM conversations WHERE conv_id % 3 <> 0")
def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "conversations").select(F.lit("t").alias("tenant_id"), F.col("conv_id").alias("artifact_id"), "turn")
    gone = rows.where("artifact_id % 3 = 0").select("tenant_id", "artifact_id").distinct()
    return indexing.without_artifacts(rows, gone).select(F.col("artifact_id").alias("conv_id"), "turn")


@query("tombstones", "SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 4 = 0 THEN 'DELETED' ELSE 'STORED' END AS storage_status FROM documents")
def tombstones(spark: SparkSession, sf: str) -> DataFrame:
    rows = artifacts_of(spark, sf)
    return intake.tombstoned(rows, rows.where("id % 4 = 0")).select("id", "storage_status")


@query("outbox_batch", "SELECT event_id AS id, ts AS created_at FROM events ORDER BY ts, event_id LIMIT 100")
def outbox_batch(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.outbox_batch(t(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at")))


_JOBS = "SELECT event_id AS id, 'INDEX' AS type, CASE event_type WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'RETRY_PENDING' WHEN 'purchase' THEN 'CLAIMED' ELSE 'COMPLETED' END AS status, CASE WHEN event_id % 9 > 0 THEN ts END AS due, ts, (SELECT quantile_disc(ts, 0.5) FROM events) AS now FROM events"


def _jobs(spark: SparkSession, sf: str) -> tuple[DataFrame, F.Column]:
    rows = t(spark, sf, "events")
    status = F.when(F.col("event_type") == "view", "PENDING").when(F.col("event_type") == "click", "RETRY_PENDING").when(F.col("event_type") == "purchase", "CLAIMED").otherwise("COMPLETED")
    found = rows.select(F.col("event_id").alias("id"), F.lit("INDEX").alias("type"), status.alias("status"), F.when(F.col("event_id") % 9 > 0, F.col("ts")).alias("next_attempt_at"), F.col("ts").alias("lease_expires_at"))
    now = rows.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY unix_micros(CAST(ts AS timestamp)))")).first()[0]
    return found, F.timestamp_micros(F.lit(int(now))).cast("timestamp_ntz")


@query("due_jobs", f"SELECT id, status FROM ({_JOBS}) WHERE status IN ('PENDING', 'RETRY_PENDING') AND (due IS NULL OR due <= now) ORDER BY due NULLS FIRST, id LIMIT 1000")
def due_jobs(spark: SparkSession, sf: str) -> DataFrame:
    found, now = _jobs(spark, sf)
    return jobs.due_jobs(found, now, "INDEX", 1000).select("id", "status")


@query("expired_leases", f"SELECT id FROM ({_JOBS}) WHERE status = 'CLAIMED' AND ts <= now")
def expired_leases(spark: SparkSession, sf: str) -> DataFrame:
    found, now = _jobs(spark, sf)
    return jobs.expired_leases(found, now).select("id")


@query("latest_state", "SELECT user_id, arg_max(event_type, {'a': ts, 'b': event_id}) AS state FROM events GROUP BY user_id")
def latest_state(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.latest_state(t(spark, sf, "events"), key="user_id", state="event_type", at="ts", tie="event_id")


_STATES = {"view": "PENDING", "click": "VALIDATING", "purchase": "BUFFERED", "signup": "RUNNING", "error": "COMPLETED"}
_CASE = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _STATES.items()) + " END"
_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, to in jobs.TRANSITIONS.items() for b in to)


@query("invalid_transitions", f"WITH h AS (SELECT user_id, event_id AS step_id, lag({_CASE}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, {_CASE} AS to_state FROM events) SELECT * FROM h WHERE from_state IS NOT NULL AND (from_state, to_state) NOT IN ({_ALLOWED})")
def invalid_transitions(spark: SparkSession, sf: str) -> DataFrame:
    state = F.create_map(*[F.lit(x) for pair in _STATES.items() for x in pair])[F.col("event_type")]
    history = t(spark, sf, "events").select("user_id", "event_id", "ts", state.alias("state"))
    return jobs.invalid_transitions(history, jobs.transition_table(spark), key="user_id", state="state", at="ts", tie="event_id")


@query("retry_delay_no_jitter", "SELECT n::INT AS attempts, least(120000, 1000 * power(2, greatest(0, n - 1)))::BIGINT AS delay_ms FROM range(0, 20) r(n)")
def retry_delay_no_jitter(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.range(20).select(F.col("id").cast("int").alias("attempts"))
    return rows.select("attempts", times.retry_delay_ms(F.col("attempts")).alias("delay_ms"))


@query("audit_redact", "SELECT event_id, '[REDACTED]' AS access_token, CASE WHEN event_id % 5 = 0 THEN '[REDACTED]' ELSE left(props, 512) END AS props, left(regexp_replace(repeat(event_type || chr(10), 100), chr(10), '_', 'g'), 512) AS long FROM events")
def audit_redact(spark: SparkSession, sf: str) -> DataFrame:
    props = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("Bearer "), "props")).otherwise(F.col("props"))
    details = F.create_map(F.lit("accessToken"), F.lit("secret-value"), F.lit("props"), props, F.lit("long"), F.repeat(F.concat("event_type", F.lit("\n")), F.lit(100)))
    events = t(spark, sf, "events").select(
        "event_id", F.lit("SEARCH").alias("operation"), F.col("user_id").cast("string").alias("principal_id"), F.lit("t").alias("tenant_id"), F.col("event_id").cast("string").alias("artifact_id"),
        F.lit("SUCCESS").alias("outcome"), F.lit(5).cast("long").alias("latency_millis"), F.col("ts").alias("occurred_at"), details.alias("safe_details"),
    )
    rows = audit.audit_rows(events, F.lit("9999-01-01").cast("timestamp_ntz"))
    d = F.col("safe_details")
    return rows.select(F.col("artifact_id").cast("long").alias("event_id"), d["accessToken"].alias("access_token"), d["props"].alias("props"), d["long"].alias("long"))


@query("redacted_keys", "SELECT DISTINCT event_type, '[REDACTED]' AS shown FROM events")
def redacted_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "events").select("event_type", redaction.safe_details(F.create_map(F.lit("my_PASSWORD"), F.col("props"))).alias("m"))
    return rows.select("event_type", F.col("m")["my_PASSWORD"].alias("shown")).distinct()


@query("grants_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 1)")
def grants_semi(spark: SparkSession, sf: str) -> DataFrame:
    grants = t(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("principal_id"), F.lit("t").alias("tenant_id"), F.lit("SEARCH").alias("permission"))
    rows = t(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("principal_id"), F.lit("t").alias("tenant_id"))
    return access.permitted(rows, grants, "SEARCH").select("c_custkey")


def _cache(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = t(spark, sf, "documents").select("doc_id", keys.sha256(F.col("text")).alias("content_sha256"), "text")
    cache = docs.where("doc_id % 2 = 0").select("content_sha256", F.lit("m").alias("embedding_model"), F.lit("1").alias("embedding_version"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    return docs, cache.dropDuplicates(["content_sha256"])


@query("embedding_cache_misses", "SELECT DISTINCT sha256(text) AS content_sha256 FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)")
def embedding_cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    return embed.with_cache(*_cache(spark, sf), "m", "1")[1].select("content_sha256")


@query("embedding_cache_hits", "SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents WHERE doc_id % 2 = 0)")
def embedding_cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    return embed.with_cache(*_cache(spark, sf), "m", "1")[0].select("doc_id")


@query("embed_documents")
def embed_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = t(spark, sf, "documents").select(keys.sha256(F.col("text")).alias("content_sha256"), "text").dropDuplicates(["content_sha256"])
    return embed.embedded(docs, lambda: embed.hashing_provider(64), 64)


@query("media_detect", "SELECT page_id AS id, 'text/html' AS media_type, true AS compatible FROM pages UNION ALL SELECT -1 - doc_id, CASE WHEN regexp_matches(lower(ltrim(text)), '^(<!doctype html|<html)') THEN 'text/html' ELSE 'text/plain' END, true FROM documents")
def media_detect(spark: SparkSession, sf: str) -> DataFrame:
    pages = t(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("html").cast("binary").alias("content"), F.lit(" Text/HTML; charset=utf-8").alias("declared"))
    docs = t(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("id"), F.col("text").cast("binary").alias("content"), F.lit("text/plain").alias("declared"))
    rows = pages.unionByName(docs).withColumn("media_type", media.detected(F.col("content"), F.col("declared"), docx=False))
    return rows.select("id", "media_type", media.compatible(media.normal(F.col("declared")), F.col("media_type")).alias("compatible"))


@query("html_text")
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "pages").select("page_id", extract.html_text("html").alias("text"))


@query("markdown_text")
def markdown_text(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents, each between a heading and a list."""
    source = F.concat(F.lit("# Title\n\n"), F.col("text"), F.lit("\n\n- **item** and `code`\n"))
    return t(spark, sf, "documents").select("doc_id", extract.markdown_text(source).alias("text"))


@query("extract_all", r"SELECT doc_id, CASE WHEN regexp_matches(text, '\S') THEN text END AS extracted, CASE WHEN NOT regexp_matches(text, '\S') THEN 'BLANK_TEXT' END AS failure FROM documents")
def extract_all(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("content"), F.lit("text/plain").alias("media_type"))
    return extract.extracted(rows).select("doc_id", "extracted", "failure")


@query("filename_sanitize", "SELECT page_id, '_' || replace(url, '/', '_') AS name FROM (SELECT page_id, replace(url, '..', '_') AS url FROM pages)")
def filename_sanitize(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "pages").select("page_id", text.safe_filename(F.concat(F.lit("../"), "url")).alias("name"))


SQL["filename_sanitize"] = "SELECT page_id, left('__' || replace(url, '/', '_'), 255) AS name FROM pages"

FTS_AND, FTS_RANK = "the that", '"of the" or license -version'


@query("fts_match", r"SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 'the') AND list_contains(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 'that')")
def fts_match(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.matching(t(spark, sf, "documents"), FTS_AND).select("doc_id")


_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query(
    "fts_rank",
    f"""
WITH w AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
c AS (SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS phrases, len(list_filter(w, lambda x: x = 'license')) AS licenses, list_contains(w, 'version') AS version FROM w)
SELECT doc_id, phrases / 2.0::DOUBLE + licenses AS rank FROM c WHERE phrases > 0 OR (licenses > 0 AND NOT version) ORDER BY rank DESC, doc_id LIMIT 50""",
)
def fts_rank(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.search(t(spark, sf, "documents"), FTS_RANK, 50, id_col="doc_id")


_EVENT = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _drained(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """What a stream yields once all its files are read, written into the shared folder."""
    folder = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir').rstrip('/') + '/_shared'}/stream-{uuid.uuid4().hex}"
    rows.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{folder}/out").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return spark.readStream.schema(_EVENT).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("enqueue_stream", "SELECT DISTINCT user_id::VARCHAR AS id FROM events")
def enqueue_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Each job id of the stream enters the queue once."""
    return _drained(spark, relay.first_of_each(_event_stream(spark, sf).select(F.col("user_id").cast("string").alias("id"))))


@query("enqueue_daily", "SELECT DISTINCT user_id || ':' || ts::DATE AS id FROM events")
def enqueue_daily(spark: SparkSession, sf: str) -> DataFrame:
    """A job for each user and day enters the queue once; no id comes again after its day, so the state ends."""
    day = F.concat(F.col("user_id"), F.lit(":"), F.to_date("ts"))
    jobs = _event_stream(spark, sf).select(day.alias("id"), F.col("ts").cast("timestamp").alias("at"))
    return _drained(spark, relay.first_within(jobs, "at", "1 day").select("id"))


_COMMANDS = {"view": "enqueue", "click": "claim", "purchase": "complete", "signup": "fail", "error": "recover"}
_LEASE_MS = 3 * 3600 * 1000


@query(
    "lease_stream",
    f"""
WITH RECURSIVE c AS (SELECT user_id::VARCHAR AS job_id, event_id AS seq, epoch_us(ts) // 1000 AS at_ms, CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in _COMMANDS.items())} END AS command, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT job_id, 0::BIGINT AS n, NULL::BIGINT AS seq, false AS accepted, NULL::VARCHAR AS status, 0::BIGINT AS attempts, NULL::BIGINT AS expires_ms, NULL::BIGINT AS next_ms, NULL::VARCHAR AS error FROM c WHERE n = 1
  UNION ALL SELECT job_id, n, seq, ok,
    CASE WHEN NOT ok THEN status WHEN command = 'enqueue' THEN 'PENDING' WHEN command = 'claim' THEN 'CLAIMED' WHEN command = 'complete' THEN 'COMPLETED' WHEN command = 'fail' AND attempts >= 5 THEN 'DEAD_LETTER' ELSE 'RETRY_PENDING' END,
    attempts + (ok AND command = 'claim')::BIGINT,
    CASE WHEN NOT ok THEN expires_ms WHEN command = 'claim' THEN at_ms + {_LEASE_MS} END,
    CASE WHEN NOT ok OR command = 'claim' THEN next_ms WHEN command = 'fail' AND attempts < 5 THEN at_ms + least(120000, 1000 * power(2, attempts - 1))::BIGINT WHEN command = 'recover' THEN at_ms END,
    CASE WHEN NOT ok OR command IN ('claim', 'complete') THEN error WHEN command = 'fail' THEN 'failed' WHEN command = 'recover' THEN 'lease expired' END
  FROM (SELECT s.* EXCLUDE (n, seq, accepted), c.n, c.seq, c.at_ms, c.command, CASE c.command WHEN 'enqueue' THEN s.status IS NULL
      WHEN 'claim' THEN coalesce(s.status IN ('PENDING', 'RETRY_PENDING') AND (s.next_ms IS NULL OR s.next_ms <= c.at_ms), false)
      WHEN 'recover' THEN coalesce(s.status = 'CLAIMED' AND s.expires_ms <= c.at_ms, false) ELSE coalesce(s.status = 'CLAIMED' AND s.expires_ms > c.at_ms, false) END AS ok
    FROM s JOIN c ON c.job_id = s.job_id AND c.n = s.n + 1))
SELECT job_id, seq, accepted, status, CASE WHEN status IS NOT NULL THEN attempts END AS attempts, expires_ms, next_ms, error FROM s WHERE n > 0""",
)
def lease_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Every event is a command for its user's job: enqueue, claim for three hours, complete, fail or recover."""
    rows = _event_stream(spark, sf)
    command = F.create_map(*[F.lit(x) for pair in _COMMANDS.items() for x in pair])[F.col("event_type")]
    commands = rows.select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), command.alias("command"), F.lit("worker").alias("owner"), F.lit(_LEASE_MS // 1000).cast("long").alias("lease_seconds"), F.lit("failed").alias("error"))
    return _drained(spark, leases.lease_stream(commands)).select("job_id", "seq", "accepted", "status", "attempts", "expires_ms", "next_ms", "error")


from tidemark.plans import cases, indexes  # noqa: E402, F401  (register their queries with the ones above)
