"""Further registered queries: lookups, content, chunk checks, jobs and limits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import keys, records, text, times, vectors
from tidemark.operators import audit, indexing, intake, jobs, retrieval
from tidemark.plans.queries import _JOBS, _KEYWORD, _READY, _RRF, _VECTOR, QUERY_TEXT, SQL, WS, _jobs, _orders, _spooled, artifacts_of, chunks_with_vectors, first_vector, query, t
from tidemark.sources import embed, extract, files, segments, shared


def _one(spark: SparkSession, sf: str) -> tuple[str, int]:
    """A customer and the least of their orders."""
    r = t(spark, sf, "orders").agg(F.min(F.struct("o_custkey", "o_orderkey")).alias("x")).first()["x"]
    return str(r["o_custkey"]), r["o_orderkey"]


_ONE = "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 1"


@query("point_lookup", f"SELECT o_orderkey, o_custkey::VARCHAR AS tenant_id, CASE WHEN o_orderstatus = 'F' THEN 'DELETED' ELSE 'STORED' END AS storage_status FROM orders JOIN ({_ONE}) USING (o_custkey, o_orderkey)")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    tenant, order = _one(spark, sf)
    return retrieval.one_of(_orders(spark, sf), tenant, order).select("o_orderkey", "tenant_id", "storage_status")


@query("idempotency_lookup", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND (o_custkey, o_orderkey) = (SELECT (o_custkey, o_orderkey) FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_custkey, o_orderkey LIMIT 1)")
def idempotency_lookup(spark: SparkSession, sf: str) -> DataFrame:
    r = t(spark, sf, "orders").where("o_orderstatus <> 'F'").agg(F.min(F.struct("o_custkey", "o_orderkey")).alias("x")).first()["x"]
    return intake.by_idempotency_key(_orders(spark, sf), str(r["o_custkey"]), f"k{r['o_orderkey']}").select("o_orderkey")


@query("spool_path_lookup", "SELECT doc_id AS id FROM documents WHERE doc_id % 7 > 0 AND doc_id = (SELECT min(doc_id) FROM documents WHERE doc_id % 7 > 0)")
def spool_path_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = _spooled(spark, sf)
    path = rows.agg(F.min_by("spool_path", F.when(F.col("spool_path").isNotNull(), F.col("id")))).first()[0]
    return intake.by_spool_path(rows, "/spool/./x/.." + path.removeprefix("/spool")).select("id")


@query("chunks_in_order", "SELECT turn, text FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations) ORDER BY turn")
def chunks_in_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "conversations")
    conv = rows.agg(F.min("conv_id")).first()[0]
    chunks = rows.select(F.lit("t").alias("tenant_id"), F.col("conv_id").alias("artifact_id"), F.col("turn").alias("chunk_index"), "text")
    return indexing.chunks_of(chunks, "t", conv).select(F.col("chunk_index").alias("turn"), "text")


@query("inline_or_reference", "SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 1000 THEN to_base64(encode(text)) END AS payload, CASE WHEN octet_length(encode(text)) > 1000 THEN 'artifact://' || doc_id || '/content' END AS uri FROM documents")
def inline_or_reference(spark: SparkSession, sf: str) -> DataFrame:
    part = files.inline_or_uri(F.col("text").cast("binary"), F.concat(F.lit("artifact://"), "doc_id", F.lit("/content")), 1000)
    return t(spark, sf, "documents").select("doc_id", part.alias("r")).select("doc_id", "r.*")


@query("content_source", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 5 > 0 THEN 'object/' || o_orderkey ELSE 'spool/' || o_orderkey END AS source FROM orders")
def content_source(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "STORED").otherwise("UPLOADING")
    key = F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("object/"), "o_orderkey"))
    return t(spark, sf, "orders").select("o_orderkey", files.content_source(status, key, F.concat(F.lit("spool/"), "o_orderkey")).alias("source"))


@query("object_verify", "SELECT doc_id, doc_id % 6 = 0 AS verified, CASE WHEN doc_id % 6 = 0 THEN 'STORED' ELSE 'RETRY_PENDING' END AS storage_status, CASE WHEN doc_id % 6 > 0 THEN 'STORAGE_FAILED' END AS failure_code FROM documents")
def object_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Objects of which five of six are wrong: missing, cut, other bytes, another tenant's mark, another key of encryption."""
    tenant, text = F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))
    docs = t(spark, sf, "documents").select("doc_id", tenant.alias("tenant_id"), text.cast("binary").alias("content"))
    key = F.concat(F.lit("dev/"), keys.sha256(F.col("tenant_id")), F.lit("/document/"), "doc_id")
    expected = docs.select("doc_id", "tenant_id", key.alias("storage_key"), keys.sha256(F.col("content")).alias("sha256"), F.length("content").cast("long").alias("size_bytes"))
    kind = F.col("doc_id") % 6
    other = F.when(F.substring("content", 1, 1) == F.lit(b"+"), F.lit(b"-")).otherwise(F.lit(b"+"))
    content = F.when(kind == 2, F.concat("content", F.lit(b"+"))).when(kind == 3, F.concat(other, F.substring("content", F.lit(2), F.length("content")))).otherwise(F.col("content"))
    put = docs.where(kind != 1).select(key.alias("path"), content.alias("content"), keys.sha256(F.when(kind == 4, F.lit("other")).otherwise(F.col("tenant_id"))).alias("tenant_sha256"), F.when(kind == 5, "k2").otherwise("k1").alias("kms_key"))
    checked = files.verified_objects(put.withColumn("sha256", keys.sha256(F.col("content"))), expected, "dev", kms_key="k1")
    return files.stored_status(checked).select("doc_id", "verified", "storage_status", "failure_code")


@query("lease_ownership", f"SELECT id, status = 'CLAIMED' AND id % 2 = 0 AND ts > now AS owned FROM ({_JOBS})")
def lease_ownership(spark: SparkSession, sf: str) -> DataFrame:
    rows, now = _jobs(spark, sf)
    owner = F.when(F.col("id") % 2 == 0, "me").when(F.col("id") % 3 == 0, "other")
    return rows.select("id", times.owns_lease(F.col("status"), owner, F.col("lease_expires_at"), "me", now).alias("owned"))


@query("lengths_agree", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN n_chars = octet_length(encode(text)) ELSE octet_length(encode(text)) = 7 END AS agrees FROM documents")
def lengths_agree(spark: SparkSession, sf: str) -> DataFrame:
    declared = F.when(F.col("doc_id") % 3 == 0, -1).when(F.col("doc_id") % 3 == 1, F.col("n_chars")).otherwise(7)
    return t(spark, sf, "documents").select("doc_id", intake.length_agrees(declared, F.octet_length("text")).alias("agrees"))


@query("chunk_quarantine", "SELECT vec_id, vec_id % 8 > 0 AS invalid FROM embeddings")
def chunk_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of which seven of eight have something wrong."""
    n = F.col("vec_id") % 8
    vector = F.when(n == 1, F.slice("embedding", 1, 3)).when(n == 2, F.transform("embedding", lambda x, i: F.when(i == 0, float("nan")).otherwise(x).cast("float"))).when(n == 3, F.transform("embedding", lambda x, i: F.when(i == 1, float("-inf")).otherwise(x).cast("float"))).otherwise(F.col("embedding"))
    rows = t(spark, sf, "embeddings").select(
        "vec_id", F.col("vec_id").cast("string").alias("chunk_id"), F.when(n == 4, " ").otherwise("t").alias("tenant_id"), F.lit("a").alias("artifact_id"), F.when(n != 5, "text").alias("text"), F.lit("h").alias("content_sha256"),
        F.lit("m").alias("embedding_model"), F.lit("1").alias("embedding_version"), F.when(n == 6, -1).otherwise(0).alias("chunk_index"), F.when(n == 7, -5).otherwise(1).alias("token_count"), vector.alias("embedding"),
    )
    size = rows.agg(F.max(F.size("embedding"))).first()[0]
    return rows.select("vec_id", indexing.invalid_chunk(size).alias("invalid"))


@query("vector_literal", "SELECT vec_id, true AS same, len(embedding)::INT AS dimensions FROM embeddings")
def vector_literal(spark: SparkSession, sf: str) -> DataFrame:
    again = vectors.parsed(vectors.written(F.col("embedding")))
    same = F.forall(F.arrays_zip(again.alias("a"), F.col("embedding").alias("b")), lambda x: x["a"] == x["b"])
    return t(spark, sf, "embeddings").select("vec_id", same.alias("same"), F.size(again).alias("dimensions"))


@query("bounded_messages", "SELECT doc_id, left(CASE WHEN doc_id % 4 > 0 THEN text ELSE source END, 500) AS message FROM documents")
def bounded_messages(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", text.bounded_message(F.when(F.col("doc_id") % 4 > 0, F.col("text")), F.col("source")).alias("message"))


@query("safe_ids", "SELECT page_id, page_id % 2 = 0 AS id_ok, regexp_full_match(url, '[A-Za-z0-9-]{1,128}') AS url_ok FROM pages")
def safe_ids(spark: SparkSession, sf: str) -> DataFrame:
    made = F.concat(F.when(F.col("page_id") % 2 == 0, "page-").otherwise("page/"), "page_id")
    return t(spark, sf, "pages").select("page_id", keys.safe_id(made).alias("id_ok"), keys.safe_id(F.col("url")).alias("url_ok"))


@query("json_round_trip", """SELECT doc_id, '{"id":"' || doc_id || '","lang":"' || lang || '","source":"' || source || '"}' AS json, true AS same FROM documents""")
def json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    m = F.create_map(F.lit("source"), F.col("source"), F.lit("id"), F.col("doc_id").cast("string"), F.lit("lang"), F.col("lang"))
    rows = t(spark, sf, "documents").select("doc_id", "text", m.alias("m"))
    whole = F.create_map(F.lit("text"), F.col("text"))
    same = records.decoded(records.encoded(whole))["text"] == F.col("text")
    return rows.select("doc_id", records.encoded(F.col("m")).alias("json"), same.alias("same"))


@query("insert_if_absent", "SELECT conv_id, turn, text FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, text || '?' FROM conversations WHERE turn % 2 = 1")
def insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "conversations").select("conv_id", "turn", "text")
    return indexing.inserted_if_absent(rows.where("turn % 2 = 0"), rows.withColumn("text", F.concat("text", F.lit("?"))), ("conv_id", "turn"))


@query("outbox_acknowledge", "SELECT event_id AS id FROM events WHERE event_type <> 'view'")
def outbox_acknowledge(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type")
    return jobs.acknowledged(rows, rows.where("event_type = 'view'").select((F.col("id")).alias("id")).union(spark.range(-3, 0))).select("id")


@query("dispatch", "SELECT event_id::VARCHAR AS id, CASE WHEN event_type IN ('click', 'error') THEN 'REJECTED' WHEN event_id % 2 = 0 THEN 'DUPLICATE' ELSE 'ACCEPTED' END AS outcome, CASE event_type WHEN 'click' THEN 'STATUS' WHEN 'error' THEN 'TYPE' END AS reason FROM events")
def dispatch(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "OTHER").otherwise("INDEX")
    rows = t(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"), F.lit("t").alias("tenant_id"), F.lit("a").alias("artifact_id"), kind.alias("type"), F.when(F.col("event_type") == "click", "CLAIMED").otherwise("PENDING").alias("status"))
    return jobs.dispatched(rows.where("id % 2 = 0"), rows)[1]


@query("audit_scope", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'FAILURE' ELSE 'SUCCESS' END AS outcome, (event_id % 100)::BIGINT AS latency_millis, CASE WHEN event_type = 'error' THEN props END AS code FROM events")
def audit_scope(spark: SparkSession, sf: str) -> DataFrame:
    start = F.timestamp_millis(F.col("event_id"))
    calls = t(spark, sf, "events").select(
        F.lit("SEARCH").alias("operation"), F.lit("p").alias("principal_id"), F.lit("t").alias("tenant_id"), F.col("event_id").cast("string").alias("artifact_id"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error_code"), start.alias("started_at"), F.timestamp_millis(F.col("event_id") + F.col("event_id") % 100).alias("ended_at"),
    )
    return audit.scope_rows(calls).select(F.col("artifact_id").cast("long").alias("event_id"), "outcome", "latency_millis", F.col("safe_details")["code"].alias("code"))


def _queue(spark: SparkSession, sf: str) -> tuple[DataFrame, F.Column]:
    rows, now = _jobs(spark, sf)
    claimed = F.col("status") == "CLAIMED"
    return rows.withColumn("attempts", (F.col("id") % 6).cast("int")).withColumn("lease_owner", F.when(claimed, F.concat(F.lit("w"), F.col("id") % 2))).withColumn("lease_expires_at", F.when(claimed, F.col("lease_expires_at"))).withColumn("last_error", F.lit(None).cast("string")), now


_QUEUE = f"SELECT id, status, due, CASE WHEN status = 'CLAIMED' THEN ts END AS expires, now, (id % 6)::INT AS attempts, CASE WHEN status = 'CLAIMED' THEN 'w' || (id % 2) END AS owner FROM ({_JOBS})"


@query("recovered_leases", f"SELECT q.id, CASE WHEN g.id IS NULL THEN q.status ELSE 'RETRY_PENDING' END AS status, CASE WHEN g.id IS NULL THEN q.owner END AS lease_owner, CASE WHEN g.id IS NOT NULL THEN 'lease expired' END AS last_error FROM ({_QUEUE}) q LEFT JOIN (SELECT id FROM ({_QUEUE}) WHERE status = 'CLAIMED' AND expires <= now ORDER BY expires, id LIMIT 100) g ON g.id = q.id")
def recovered_leases(spark: SparkSession, sf: str) -> DataFrame:
    rows, now = _queue(spark, sf)
    return jobs.recovered(rows, now).select("id", "status", "lease_owner", "last_error")


@query("claimed_jobs", f"SELECT q.id, CASE WHEN g.id IS NULL THEN q.status ELSE 'CLAIMED' END AS status, q.attempts + (g.id IS NOT NULL)::INT AS attempts, CASE WHEN g.id IS NULL THEN q.owner ELSE 'me' END AS lease_owner, CASE WHEN g.id IS NULL THEN q.expires ELSE q.now + INTERVAL 30 SECOND END AS lease_expires_at FROM ({_QUEUE}) q LEFT JOIN (SELECT id FROM ({_QUEUE}) WHERE status IN ('PENDING', 'RETRY_PENDING') AND (due IS NULL OR due <= now) ORDER BY due NULLS FIRST, id LIMIT 1) g ON g.id = q.id")
def claimed_jobs(spark: SparkSession, sf: str) -> DataFrame:
    rows, now = _queue(spark, sf)
    return jobs.claimed(rows, now, "INDEX", "me", 30).select("id", "status", "attempts", "lease_owner", "lease_expires_at")


@query(
    "settled_jobs",
    f"""
WITH q AS (SELECT *, coalesce(status = 'CLAIMED' AND owner = 'w0' AND expires > now, false) AS held, id % 4 = 0 AS ok FROM ({_QUEUE}))
SELECT id, CASE WHEN NOT held THEN status WHEN ok THEN 'COMPLETED' WHEN attempts < 5 THEN 'RETRY_PENDING' ELSE 'DEAD_LETTER' END AS status, CASE WHEN NOT held THEN owner END AS lease_owner, CASE WHEN held AND NOT ok THEN 'broken' END AS last_error,
  CASE WHEN NOT held THEN due WHEN NOT ok AND attempts < 5 THEN now + to_milliseconds(least(120000, 1000 * power(2, greatest(0, attempts - 1)))::BIGINT) END AS next_attempt_at FROM q""",
)
def settled_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Results of one owner for all jobs; they count where its lease is held."""
    rows, now = _queue(spark, sf)
    results = rows.select("id", F.lit("w0").alias("owner"), (F.col("id") % 4 == 0).alias("ok"), F.lit("broken").alias("error"))
    done = jobs.settled(rows, results, now)
    return done.select("id", "status", "lease_owner", "last_error", F.col("next_attempt_at").cast("timestamp_ntz").alias("next_attempt_at"))


@query("image_lines", "SELECT conv_id, CASE WHEN sum(length(text) + 1) - 1 <= 300 THEN string_agg(text, chr(10) ORDER BY turn) END AS extracted FROM conversations WHERE turn % 3 > 0 GROUP BY conv_id")
def image_lines(spark: SparkSession, sf: str) -> DataFrame:
    block = F.struct("turn", F.when(F.col("turn") % 3 == 0, "PAGE").otherwise("LINE").alias("type"), "text")
    blocks = t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    return blocks.where(F.exists("blocks", lambda b: b["type"] == "LINE")).select("conv_id", extract.lines_of(F.col("blocks"), 300).alias("extracted"))


@query("extraction_bounds", r"SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 4000 AND length(text) <= 2000 AND regexp_matches(text, '\S') THEN text END AS extracted, CASE WHEN octet_length(encode(text)) > 4000 THEN 'INPUT_TOO_LARGE' WHEN length(text) > 2000 THEN 'OUTPUT_TOO_LARGE' WHEN NOT regexp_matches(text, '\S') THEN 'BLANK_TEXT' END AS failure FROM documents")
def extraction_bounds(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("content"), F.lit("text/plain").alias("media_type"))
    return extract.extracted(rows, most_bytes=4000, most_chars=2000).select("doc_id", "extracted", "failure")


@query(
    "search_clamped",
    f"""
WITH d AS (SELECT d.doc_id AS chunk_id, d.text FROM documents d JOIN ({_READY}) r USING (doc_id)),
v AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM ({_VECTOR}) x JOIN d ON d.chunk_id = x.vec_id QUALIFY r <= 100),
k AS (SELECT chunk_id, row_number() OVER (ORDER BY {_KEYWORD} DESC, chunk_id) AS r FROM d WHERE {_KEYWORD} > 0 QUALIFY r <= 100)
SELECT chunk_id, score FROM (SELECT chunk_id, {_RRF} AS score FROM (SELECT * FROM v UNION ALL SELECT * FROM k) GROUP BY chunk_id) ORDER BY score DESC, chunk_id LIMIT 100""",
)
def search_clamped(spark: SparkSession, sf: str) -> DataFrame:
    """More hits asked for than there may be, with no more candidates than hits."""
    return retrieval.hybrid_search(chunks_with_vectors(spark, sf), artifacts_of(spark, sf), QUERY_TEXT, first_vector(spark, sf), tenant=None, limit=5000, multiplier=0).select("chunk_id", "score")


_QUOTA = intake.Limits(artifact_bytes=8000, bytes=300_000, files=150, tenant_bytes=15_000, tenant_files=8)


@query(
    "quota_global_tenant",
    f"""
WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
f AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS source, NULL::BIGINT AS doc_id, NULL::BIGINT AS n_chars, NULL::VARCHAR AS refusal, []::VARCHAR[] AS owners, []::BIGINT[] AS sizes
  UNION ALL SELECT i, source, doc_id, n_chars, refusal, CASE WHEN refusal IS NULL THEN list_append(owners, source) ELSE owners END, CASE WHEN refusal IS NULL THEN list_append(sizes, n_chars) ELSE sizes END
  FROM (SELECT o.i, o.source, o.doc_id, o.n_chars::BIGINT AS n_chars, f.owners, f.sizes,
    CASE WHEN o.n_chars > {_QUOTA.artifact_bytes} THEN 'ARTIFACT_BYTES' WHEN len(f.owners) + 1 > {_QUOTA.files} THEN 'GLOBAL_FILES' WHEN len(list_filter(f.owners, lambda x: x = o.source)) + 1 > {_QUOTA.tenant_files} THEN 'TENANT_FILES'
      WHEN coalesce(list_sum(f.sizes), 0) + o.n_chars > {_QUOTA.bytes} THEN 'GLOBAL_BYTES'
      WHEN coalesce(list_sum(list_transform(list_zip(f.owners, f.sizes), lambda x: CASE WHEN x[1] = o.source THEN x[2] ELSE 0 END)), 0) + o.n_chars > {_QUOTA.tenant_bytes} THEN 'TENANT_BYTES' END AS refusal
    FROM f JOIN o ON o.i = f.i + 1))
SELECT source, doc_id, n_chars, refusal FROM f WHERE i > 0""",
)
def quota_global_tenant(spark: SparkSession, sf: str) -> DataFrame:
    return intake.admitted(t(spark, sf, "documents"), by="source", order_col="doc_id", bytes_col="n_chars", limits=_QUOTA)


_EDITED = "CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN text || ' and one more word' ELSE repeat('pad ', 80) || text END"


def _chunked(spark: SparkSession, sf: str, of: F.Column) -> DataFrame:
    docs = t(spark, sf, "documents").select(F.col("source").alias("tenant_id"), F.col("doc_id").cast("string").alias("artifact_id"), F.lit(1).alias("version"), of.alias("text"))
    return indexing.chunk_rows(docs).select("tenant_id", "artifact_id", "chunk_index", "content_sha256")


def _chunk_sql(of: str) -> str:
    words = f"string_split(trim(regexp_replace(t, '{WS}', ' ', 'g')), ' ')"
    return f"""(SELECT *, row_number() OVER (PARTITION BY doc_id, sha ORDER BY i)::INT AS occurrence FROM (SELECT doc_id, i, sha256(array_to_string(w[i * 80 + 1 : i * 80 + 100], ' ')) AS sha
  FROM (SELECT doc_id, w, unnest(range(0, 1 + greatest(0, ceil((len(w) - 100) / 80.0))::BIGINT))::INT AS i FROM (SELECT doc_id, {words} AS w FROM (SELECT doc_id, {of} AS t FROM documents) WHERE trim(regexp_replace(t, '{WS}', ' ', 'g')) <> ''))))"""


@query(
    "chunk_diff",
    f"""SELECT coalesce(a.doc_id, b.doc_id)::VARCHAR AS artifact_id, coalesce(a.sha, b.sha) AS content_sha256, coalesce(a.occurrence, b.occurrence) AS occurrence, a.i AS old_index, b.i AS new_index,
  CASE WHEN a.i IS NULL THEN 'added' WHEN b.i IS NULL THEN 'removed' ELSE 'kept' END AS change
FROM {_chunk_sql("text")} a FULL JOIN {_chunk_sql(_EDITED)} b ON a.doc_id = b.doc_id AND a.sha = b.sha AND a.occurrence = b.occurrence""",
)
def chunk_diff(spark: SparkSession, sf: str) -> DataFrame:
    """From the documents to versions of them with words put before or behind."""
    return indexing.difference(_chunked(spark, sf, F.col("text")), _chunked(spark, sf, F.expr(_EDITED))).drop("tenant_id")


_UNCHANGED = f"""
WITH a AS {_chunk_sql("text")}, b AS {_chunk_sql("CASE doc_id % 2 WHEN 0 THEN text ELSE repeat('pad ', 80) || text END")},
k AS (SELECT doc_id, sha, occurrence, a.i AS old_index, b.i AS new_index FROM a JOIN b USING (doc_id, sha, occurrence)),
m AS (SELECT doc_id, old_index, new_index, max(new_index) OVER (PARTITION BY doc_id ORDER BY old_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k)
SELECT doc_id::VARCHAR AS artifact_id, count(*) AS n_kept, bool_and(before IS NULL OR before < new_index) AS in_order FROM m GROUP BY doc_id HAVING in_order"""


@query("chunk_moves", _UNCHANGED)
def chunk_moves(spark: SparkSession, sf: str) -> DataFrame:
    """Artifacts of which no kept chunk has moved past another."""
    changes = indexing.with_moves(indexing.difference(_chunked(spark, sf, F.col("text")), _chunked(spark, sf, F.expr("CASE doc_id % 2 WHEN 0 THEN text ELSE repeat('pad ', 80) || text END"))))
    kept = F.col("change").isin("kept", "moved")
    return changes.where(kept).groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n_kept"), F.every(F.col("change") == "kept").alias("in_order")).where("in_order")


_CACHED = 137


@query(
    "embedding_cache_kept",
    f"""SELECT content_sha256, last_use FROM (SELECT sha256(text) AS content_sha256, max(o_orderdate::TIMESTAMP) AS last_use FROM documents LEFT JOIN orders ON o_orderkey = doc_id // 4 GROUP BY 1)
ORDER BY last_use DESC NULLS LAST, content_sha256 LIMIT {_CACHED}""",
)
def embedding_cache_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The contents used last, of a cache that holds so many; contents are used at the dates of orders."""
    used = t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("at"))
    docs = t(spark, sf, "documents").select(keys.sha256(F.col("text")).alias("content_sha256"), F.floor(F.col("doc_id") / 4).alias("k")).join(used, "k", "left")
    cache = docs.groupBy("content_sha256").agg(F.max("at").alias("last_use")).select(F.lit("m").alias("embedding_model"), F.lit("1").alias("embedding_version"), "content_sha256", "last_use")
    return embed.last_used(cache, _CACHED).select("content_sha256", F.col("last_use").cast("timestamp_ntz").alias("last_use"))


_SEGMENT = 32


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    docs = t(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size_bytes"), F.col("text").cast("binary").alias("content"))
    return shared.kept(segments.divided(docs, size=_SEGMENT).sortWithinPartitions("segment"), "segments")


@query("content_range_segments", SQL["content_range"])
def content_range_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of `content_range`, from contents that are kept in segments."""
    return segments.byte_range(_segments(spark, sf), ["doc_id"], 10, 50, size=_SEGMENT)


@query(
    "segment_roots",
    f"""
WITH RECURSIVE b AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents),
l AS (SELECT doc_id, n, list_transform(range(0, 1 + greatest(0, n - 1) // {_SEGMENT}), lambda i: sha256(unhex(substr(h, i * {2 * _SEGMENT} + 1, {2 * _SEGMENT})))) AS hashes FROM b),
m AS (SELECT doc_id, n, len(hashes) AS segments, hashes FROM l
  UNION ALL SELECT doc_id, n, segments, list_transform(range(1, len(hashes) + 1, 2), lambda i: CASE WHEN i < len(hashes) THEN sha256(hashes[i] || hashes[i + 1]) ELSE hashes[i] END) FROM m WHERE len(hashes) > 1)
SELECT doc_id, segments AS n_segments, n AS size_bytes, hashes[1] AS root FROM m WHERE len(hashes) = 1""",
)
def segment_roots(spark: SparkSession, sf: str) -> DataFrame:
    """The Merkle root of every document's segments, from the documents as they are."""
    docs = t(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return segments.manifest_of(docs, ["doc_id"], size=_SEGMENT)
