"""The engine's calls on tables: ingest, metadata, list, content, text, search, delete.

Every read authorises first, is confined to its tenant and hides tombstones. Contents are kept apart
from artifacts: in the spool until they are stored, then as objects. A write states what it adds or
replaces in the parts of the tables that it touches, and commits all of it as one version; if another
writer came first, it raises `Conflict`, has changed nothing and can be done again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import keys, media, records, text, times
from tidemark.operators import fulltext, indexing, intake, postings, retrieval
from tidemark.operators.access import Grants, require_scope
from tidemark.sources import embed, extract, files, segments
from tidemark.sources.embed import Provider, embedded
from tidemark.sources.tables import Change, Conflict, Store, Table, columns_of, of_tenant

ARTIFACT = (
    "id string, tenant_id string, idempotency_key string, idempotency_fingerprint string, source_type string, source_uri string, original_name string, media_type string, "
    "size_bytes long, sha256 string, storage_key string, spool_path string, storage_status string, index_status string, version long, metadata map<string,string>, tags array<string>, "
    "failure_code string, failure_message string, created_at timestamp, updated_at timestamp"
)
CHUNK = (
    "chunk_id string, tenant_id string, artifact_id string, version long, chunk_index int, text string, token_count int, content_sha256 string, page_number int, section string, "
    "coordinates map<string,string>, embedding_model string, embedding_version string, embedding array<float>"
)
OUTBOX = "id string, tenant_id string, artifact_id string, type string, status string, attempts int, created_at timestamp, next_attempt_at timestamp, last_error string"
SPOOL = "tenant_id string, artifact_id string, spool_path string, size_bytes long, content binary"
#: A segment of an object with what is kept of it beside its bytes: checksum, hash of the tenant, and the key that encrypts it.
OBJECT = "tenant_id string, artifact_id string, storage_key string, size_bytes long, sha256 string, tenant_sha256 string, kms_key string, segment int, segment_sha256 string, content binary"
QUARANTINE = CHUNK
ARTIFACT_COLUMNS = [c.strip().split(" ")[0] for c in columns_of(ARTIFACT)]
TABLES = {
    "artifact": Table(ARTIFACT, "id"),
    "chunk": Table(CHUNK, "artifact_id"),
    "quarantine": Table(QUARANTINE, "artifact_id"),
    "outbox": Table(OUTBOX, "artifact_id"),
    "spool": Table(SPOOL, "artifact_id"),
    "object": Table(OBJECT, "artifact_id", sort=("artifact_id", "segment")),
    "posting": Table(postings.schema("string"), "bucket", "scope", ("term", "block")),
    "vector_cache": Table(embed.CACHE, "content_sha256", "embedding_model"),
}
#: Artifacts of a commit of background work, vectors that the cache may hold, and times that a commit is rebuilt after others.
BATCH, MOST_CACHED, REBUILDS = 10_000, 10_000_000, 20
MOST_LISTED = 10_000


@dataclass
class Engine:
    """Tables under one folder, with grants, an embedding provider, limits of the spool and the parameters of an index."""

    spark: SparkSession
    root: str
    grants: Grants
    provider: Provider
    dimensions: int
    model: str = "default"
    model_version: str = "1"
    environment: str = "dev"
    kms_key: str | None = None
    limits: intake.Limits = field(default_factory=intake.Limits)
    most_cached: int = MOST_CACHED

    def __post_init__(self) -> None:
        self.store = Store(self.spark, self.root, TABLES)

    def _kept(self, rows: DataFrame, schema: str) -> DataFrame:
        """Rows that hold what is drawn at random, written once and read from there."""
        path = f"{self.root}/batch/{intake.fresh_name()}"
        rows.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def ingest(self, principal: str, tenant: str, requests: DataFrame, now: datetime) -> DataFrame:
        """Registers a batch (seq, idempotency_key, original_name, declared_media_type, content, content_length, metadata) of one tenant.

        Returns seq, outcome, artifact_id; outcome is that of registration, REJECTED for content of
        unknown or other than the declared type or of another length, or QUOTA where a limit of the
        spool refuses what would be created.
        """
        self.grants.require(principal, tenant, "INGEST")
        at_version = self.store.version()
        found = media.detected(F.col("content"), F.col("declared_media_type"))
        rows = requests.select(
            "seq", "content", "content_length", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"), F.lit(tenant).alias("tenant_id"), F.uuid().alias("id"),
            F.coalesce(F.when(F.trim("idempotency_key") != "", F.col("idempotency_key")), F.uuid()).alias("idempotency_key"),
            text.safe_filename(F.col("original_name")).alias("original_name"), media.normal(F.col("declared_media_type")).alias("declared"), found.alias("media_type"),
            keys.sha256(F.col("content")).alias("sha256"), F.length("content").cast("long").alias("size_bytes"),
        )
        fits = F.col("media_type").isNotNull() & (F.col("declared").isNull() | media.compatible(F.col("declared"), F.col("media_type")))
        fits = fits & intake.length_agrees(F.col("content_length"), F.col("size_bytes")) & (F.col("size_bytes") <= self.limits.artifact_bytes)
        mark = keys.fingerprint(F.col("tenant_id"), F.col("sha256"), F.col("metadata"), F.col("original_name"), F.col("media_type"))
        staged = rows.withColumn("fits", F.coalesce(fits, F.lit(False))).withColumn("fingerprint", mark)
        staged = self._kept(staged, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in staged.schema.fields))
        known = self.store.read("artifact", version=at_version, tenant=tenant).where(F.col("storage_status") != "DELETED").select(
            F.unix_millis("created_at").alias("seq"), "id", "tenant_id", "idempotency_key", "sha256", F.col("idempotency_fingerprint").alias("fingerprint")
        )
        outcomes = intake.registered(staged.where("fits"), known)
        wanted = staged.select("seq", "tenant_id", "size_bytes", "fits").join(outcomes.select("seq", "outcome", "artifact_id"), "seq", "left")
        mine = F.col("tenant_id") == tenant  # this tenant's use, and that of all others together
        held = self.store.read("spool", version=at_version).groupBy(F.when(mine, F.col("tenant_id")).alias("tenant_id")).agg(F.sum("size_bytes").alias("bytes"), F.count(F.lit(1)).alias("files"))
        quota = intake.admitted(wanted.where("outcome = 'CREATED'"), by="tenant_id", order_col="seq", bytes_col="size_bytes", limits=self.limits, used=held)
        refused = quota.where("refusal is not null").select("seq", F.lit(True).alias("refused"))
        outcome = F.when(~F.col("fits"), "REJECTED").when(F.col("refused"), "QUOTA").otherwise(F.col("outcome"))
        answer = wanted.join(refused, "seq", "left").select("seq", outcome.alias("outcome"), F.when(F.col("fits") & F.col("refused").isNull(), F.col("artifact_id")).alias("artifact_id"))
        # what was made of content that the quota refuses was not made: its duplicates and replays are refused with it
        lost = answer.where("outcome = 'QUOTA'").select("seq").join(staged.select("seq", F.col("id").alias("lost")), "seq").select("lost")
        answer = answer.join(lost, F.col("artifact_id") == F.col("lost"), "left").select("seq", F.when(F.col("lost").isNotNull(), "QUOTA").otherwise(F.col("outcome")).alias("outcome"), F.when(F.col("lost").isNull(), F.col("artifact_id")).alias("artifact_id"))
        answer = self._kept(answer, "seq long, outcome string, artifact_id string")
        created = staged.join(answer.where("outcome = 'CREATED'").select("seq"), "seq", "left_semi")
        at = F.lit(now).cast("timestamp")
        null = F.lit(None).cast("string")
        path = F.concat(F.lit("/spool/"), keys.sha256(F.col("tenant_id")), F.lit("/"), F.col("id"), F.lit(f"/{files.SPOOL_NAME}"))
        new = created.select(
            "id", "tenant_id", "idempotency_key", F.col("fingerprint").alias("idempotency_fingerprint"), F.lit("UPLOAD").alias("source_type"), null.alias("source_uri"), "original_name", "media_type",
            "size_bytes", "sha256", null.alias("storage_key"), path.alias("spool_path"), F.lit("SPOOLED").alias("storage_status"), F.lit("PENDING").alias("index_status"), F.lit(1).cast("long").alias("version"), "metadata",
            text.tags(F.element_at("metadata", "tags")).alias("tags"), null.alias("failure_code"), null.alias("failure_message"), at.alias("created_at"), at.alias("updated_at"),
        )
        self.store.commit(at_version, {
            "artifact": self.store.added("artifact", new),
            "outbox": self.store.added("outbox", self._jobs(new)),
            "spool": self.store.added("spool", created.select("tenant_id", F.col("id").alias("artifact_id"), path.alias("spool_path"), "size_bytes", "content")),
        }, {"artifact": of_tenant(tenant), "spool": ""})
        return answer

    def _jobs(self, artifacts: DataFrame) -> DataFrame:
        rows = intake.outbox_rows(artifacts.select("tenant_id", "id", "version", "created_at"))
        return rows.select("*", F.lit(None).cast("timestamp").alias("next_attempt_at"), F.lit(None).cast("string").alias("last_error"))

    def _changed(self, version: int, changed: DataFrame, only: tuple[str, ...] | None = None) -> Change:
        """Artifacts in place of those of their tenant and id, in the parts where they are; with `only`, those columns of them."""
        parts = self.store.parts_of("artifact", changed)
        now = self.store.read("artifact", version=version, parts=parts)
        others = now.join(changed.select("tenant_id", "id"), ["tenant_id", "id"], "left_anti")
        if only:
            changed = now.drop(*only).join(changed.select("tenant_id", "id", *only), ["tenant_id", "id"])
        return self.store.rewritten("artifact", others.unionByName(changed.select(*others.columns)), parts)

    def _without(self, name: str, version: int, gone: DataFrame, *more: str) -> Change:
        """A table without the rows of (tenant_id, artifact_id and more) in `gone`."""
        parts = self.store.parts_of(name, gone)
        rows = self.store.read(name, version=version, parts=parts)
        return self.store.rewritten(name, rows.join(gone, ["tenant_id", "artifact_id", *more], "left_anti").select(*rows.columns), parts)

    def _committed(self, build: Callable[[int], tuple[dict[str, Change], dict[str, str]]]) -> None:
        """Commits what `build` makes of a version, built again on a later one if others have touched its parts."""
        for left in range(REBUILDS, 0, -1):
            version = self.store.version()
            try:
                changes, relies = build(version)
                if changes:
                    self.store.commit(version, changes, relies)
                return
            except Conflict:
                if left == 1:
                    raise

    def _batches(self, kind: str, column: str, now: datetime | None, most: int) -> Iterator[tuple[int, DataFrame]]:
        """Versions and the artifacts of them whose job is due, `most` at a time, each once; what fails comes again in a later run."""
        seen = self.spark.createDataFrame([], "tenant_id string, id string")
        while True:
            version = self.store.version()
            job = self.store.read("outbox", version=version).where(F.col("type") == kind)
            due = times.due(F.col("status"), F.col("next_attempt_at"), F.lit(now).cast("timestamp")) if now else F.col("status").isin("PENDING", "RETRY_PENDING")
            ready = self.store.read("artifact", version=version).where(F.col(column).isin("PENDING", "SPOOLED", "RETRY_PENDING"))
            ready = ready.join(job.where(due).select("tenant_id", F.col("artifact_id").alias("id")), ["tenant_id", "id"], "left_semi").join(seen, ["tenant_id", "id"], "left_anti")
            todo = self._kept(ready.orderBy("created_at", "tenant_id", "id").limit(most).select(*[x.name for x in ready.schema.fields if x.name in ARTIFACT_COLUMNS]), ARTIFACT)
            n = todo.count()
            if not n:
                return
            yield version, todo
            if n < most:
                return
            seen = seen.unionByName(todo.select("tenant_id", "id"))

    def _unchanged(self, version: int, results: DataFrame, todo: DataFrame, column: str) -> DataFrame:
        """Of the results, those of artifacts that are still what they were when the work on them began."""
        now = self.store.read("artifact", version=version, parts=self.store.parts_of("artifact", results)).select("tenant_id", "id", F.col("version").alias("_v"), F.col(column).alias("_s"), F.col("storage_status").alias("_d"))
        was = todo.select("tenant_id", "id", F.col("version").alias("_w"), F.col(column).alias("_t"))
        same = results.join(now, ["tenant_id", "id"]).join(was, ["tenant_id", "id"]).where("_v = _w and _s = _t and _d <> 'DELETED'")
        return same.drop("_v", "_w", "_s", "_t", "_d")

    def _settled(self, version: int, kind: str, done: DataFrame, failed: DataFrame, now: datetime | None) -> Change:
        """The outbox without the jobs that are done (tenant_id, id); a failed one (and its error) waits longer with each attempt and is a dead letter after the last."""
        every = done.select("tenant_id", "id").unionByName(failed.select("tenant_id", "id")).withColumnRenamed("id", "artifact_id")
        parts = self.store.parts_of("outbox", every)
        rows = self.store.read("outbox", version=version, parts=parts)
        marks = done.select("tenant_id", F.col("id").alias("artifact_id"), F.lit(True).alias("_ok"), F.lit(None).cast("string").alias("_error")).unionByName(failed.select("tenant_id", F.col("id").alias("artifact_id"), F.lit(False).alias("_ok"), F.col("error").alias("_error")))
        marked = rows.join(marks.withColumn("type", F.lit(kind)), ["tenant_id", "artifact_id", "type"], "left").where("_ok is null or not _ok")
        missed = F.col("_ok").isNotNull()
        attempts = F.col("attempts") + missed.cast("int")
        wait = F.lit(now).cast("timestamp") + F.make_interval(secs=times.retry_delay_ms(attempts) / 1000)
        out = marked.select(
            "id", "tenant_id", "artifact_id", "type", F.when(missed, F.when(attempts < times.ATTEMPTS, "RETRY_PENDING").otherwise("DEAD_LETTER")).otherwise(F.col("status")).alias("status"), attempts.alias("attempts"), "created_at",
            F.when(missed, wait).otherwise(F.col("next_attempt_at")).alias("next_attempt_at"), F.when(missed, F.col("_error")).otherwise(F.col("last_error")).alias("last_error"),
        )
        return self.store.rewritten("outbox", out, parts)

    def store_pending(self, now: datetime | None = None, batch: int = BATCH) -> None:
        """Runs STORE: contents go from the spool to objects, which are read back and verified; then the spool and the outbox let go of them.

        What is not verified, or not in the spool, stays where it is, RETRY_PENDING with the reason. Each
        batch is a commit of its own, which what others do to other artifacts does not disturb.
        """
        for version, todo in self._batches("STORE", "storage_status", now, batch):
            self._store(version, todo, now)

    def _store(self, version: int, todo: DataFrame, now: datetime | None) -> None:
        key = keys.storage_key(self.environment, F.col("tenant_id"), F.col("media_type"), F.col("created_at"), F.col("id"), F.col("version"))
        planned = todo.withColumn("storage_key", key)
        spool_parts = self.store.parts_of("spool", todo.select("tenant_id", F.col("id").alias("artifact_id")))
        spooled = self.store.read("spool", version=version, parts=spool_parts).select("tenant_id", F.col("artifact_id").alias("id"), "content")
        objects = planned.select("tenant_id", "id", "storage_key", "sha256").join(spooled, ["tenant_id", "id"]).select(
            "tenant_id", F.col("id").alias("artifact_id"), "storage_key", F.length("content").cast("long").alias("size_bytes"), "sha256", keys.sha256(F.col("tenant_id")).alias("tenant_sha256"),
            F.lit(self.kms_key).cast("string").alias("kms_key"), "content",
        )
        put = self.store.added("object", segments.divided(objects))
        back = self.store.at("object", put.added.values())
        read = segments.joined(back.where(keys.sha256(F.col("content")) == F.col("segment_sha256")), ["artifact_id", "storage_key", "tenant_sha256", "kms_key"])
        heads = read.select(F.col("storage_key").alias("path"), "content", keys.sha256(F.col("content")).alias("sha256"), "tenant_sha256", "kms_key")
        checked = files.stored_status(files.verified_objects(heads, planned, self.environment, kms_key=self.kms_key)).drop("verified").withColumn("updated_at", F.lit(now).cast("timestamp") if now else F.col("updated_at"))
        checked = checked.withColumn("storage_key", F.when(F.col("storage_status") == "STORED", F.col("storage_key")))
        checked = self._kept(checked.select(*ARTIFACT_COLUMNS), ARTIFACT)

        def build(at: int) -> tuple[dict[str, Change], dict[str, str]]:
            here = self._unchanged(at, checked, todo, "storage_status")
            good = here.where("storage_status = 'STORED'")
            stored = good.select("tenant_id", F.col("id").alias("artifact_id"))
            objects = put if good.count() == back.where("segment = 0").count() else self.store.added("object", back.join(stored, ["tenant_id", "artifact_id"], "left_semi"))
            changes = {
                "artifact": self._changed(at, here, ("storage_status", "storage_key", "spool_path", "failure_code", "failure_message", "updated_at")),
                "object": objects,
                "spool": self._without("spool", at, stored),
                "outbox": self._settled(at, "STORE", good, here.where("storage_status <> 'STORED'").select("tenant_id", "id", F.col("failure_message").alias("error")), now),
            }
            return changes, {}

        self._committed(build)

    def contents(self, version: int | None = None, tenant: str | None = None, of: DataFrame | None = None) -> DataFrame:
        """tenant_id, id, content of each artifact that has any: the object if it is stored, else what is in the spool.

        With artifacts given (`of`) only the parts that hold their contents are opened.
        """
        version = self.store.version() if version is None else version
        artifacts = self.store.read("artifact", version=version, tenant=tenant) if of is None else of
        parts = None if of is None else self.store.parts_of("object", of.select("tenant_id", F.col("id").alias("artifact_id")))
        source = files.content_source(F.col("storage_status"), F.col("storage_key"), F.col("spool_path"))
        where = artifacts.select("tenant_id", F.col("id").alias("artifact_id"), source.alias("source"))
        objects = self.store.read("object", version=version, tenant=tenant, parts=parts).select("tenant_id", "artifact_id", F.col("storage_key").alias("source"), "segment", "content")
        objects = segments.joined(objects, ["tenant_id", "artifact_id", "source"])
        spooled = self.store.read("spool", version=version, tenant=tenant, parts=parts).select("tenant_id", "artifact_id", F.col("spool_path").alias("source"), "content")
        return objects.unionByName(spooled).join(where, ["tenant_id", "artifact_id", "source"], "left_semi").select("tenant_id", F.col("artifact_id").alias("id"), "content")

    def index_pending(self, *, size: int = 100, overlap: int = 20, now: datetime | None = None, batch: int = BATCH) -> None:
        """Runs INDEX: extract, chunk, embed and replace the chunks of every pending artifact, whose failure is kept with it.

        Chunks that are not valid are kept apart, in quarantine, and their artifact is to be tried again:
        with `now`, when its wait is over, and not beyond the last attempt. Only contents that neither the
        cache nor the artifacts' chunks before have a vector for are embedded. Each batch is a commit of
        its own; if others change the same parts meanwhile, the commit alone is made again.
        """
        for version, todo in self._batches("INDEX", "index_status", now, batch):
            self._index(version, todo, size, overlap, now)

    def _vectors(self, version: int, rows: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Vectors of all contents of the chunk rows, those among them that were asked for, and those that were known."""
        texts = rows.select("content_sha256", "text").dropDuplicates(["content_sha256"])
        mine = (F.col("embedding_model") == self.model) & (F.col("embedding_version") == self.model_version)
        parts = self.store.parts_of("vector_cache", texts.select(F.lit(self.model).alias("embedding_model"), "content_sha256"))
        cache = self.store.read("vector_cache", version=version, parts=parts).where(mine)
        known = cache.select("content_sha256", "embedding").unionByName(old.where(mine).select("content_sha256", "embedding")).dropDuplicates(["content_sha256"])
        hits = self._kept(known.join(texts, "content_sha256", "left_semi"), "content_sha256 string, embedding array<float>")
        provider = self.provider
        asked = self._kept(embedded(texts.join(hits, "content_sha256", "left_anti"), lambda: provider, self.dimensions), "content_sha256 string, embedding array<float>")
        return hits.unionByName(asked), asked, hits

    def _index(self, version: int, todo: DataFrame, size: int, overlap: int, now: datetime | None) -> None:
        texts = extract.extracted(todo.select("id", "tenant_id", "version", "media_type").join(self.contents(version, of=todo), ["tenant_id", "id"]))
        texts = self._kept(texts.select("tenant_id", "id", "version", "extracted", "failure"), "tenant_id string, id string, version long, extracted string, failure string")
        good = texts.where("failure is null").select("tenant_id", F.col("id").alias("artifact_id"), "version", F.col("extracted").alias("text"))
        rows = indexing.chunk_rows(good, size=size, overlap=overlap)
        before = self.store.read("chunk", version=version, parts=self.store.parts_of("chunk", good)).join(good.select("tenant_id", "artifact_id"), ["tenant_id", "artifact_id"], "left_semi")
        vectors, asked, hits = self._vectors(version, rows, before)
        null = F.lit(None)
        new = rows.join(vectors, "content_sha256").select(
            "chunk_id", "tenant_id", "artifact_id", "version", "chunk_index", "text", "token_count", "content_sha256", null.cast("int").alias("page_number"), null.cast("string").alias("section"),
            F.create_map().cast("map<string,string>").alias("coordinates"), F.lit(self.model).alias("embedding_model"), F.lit(self.model_version).alias("embedding_version"), "embedding",
        )
        new = self._kept(new, CHUNK)
        bad = new.where(indexing.invalid_chunk(self.dimensions))
        worthless = bad.select("tenant_id", F.col("artifact_id").alias("id")).distinct().withColumn("bad", F.lit(True))
        of = texts.join(worthless, ["tenant_id", "id"], "left").withColumn("why", F.coalesce(text.bounded_message(F.col("failure"), F.lit(None).cast("string")), F.when(F.col("bad"), "a chunk is not valid")))
        done = of.select("tenant_id", "id", F.col("why").isNull().alias("ok"), "why")
        outcome = todo.join(done, ["tenant_id", "id"], "left").withColumn("why", F.when(~F.coalesce("ok", F.lit(False)), F.coalesce("why", F.lit("no content"))))
        outcome = outcome.withColumn("index_status", F.when(F.col("why").isNull(), "READY").otherwise("RETRY_PENDING"))
        outcome = outcome.withColumn("failure_code", F.when(F.col("why").isNotNull(), "INDEXING_FAILED")).withColumn("failure_message", F.col("why")).select(*ARTIFACT_COLUMNS)
        outcome = self._kept(outcome, ARTIFACT)
        lists = self._kept(postings.postings(new.join(bad, "chunk_id", "left_anti"), id_col="chunk_id", scope_col="tenant_id", segment=version + 1), postings.schema("string"))

        def build(at: int) -> tuple[dict[str, Change], dict[str, str]]:
            here = self._unchanged(at, outcome, todo, "index_status")
            good = here.where("index_status = 'READY'")
            ready = good.select("tenant_id", F.col("id").alias("artifact_id"))
            parts = self.store.parts_of("chunk", ready)
            old = self.store.read("chunk", version=at, parts=parts)
            fresh = new.join(ready, ["tenant_id", "artifact_id"], "left_semi").select(*old.columns)
            changes = {
                "artifact": self._changed(at, here, ("index_status", "failure_code", "failure_message")),
                "chunk": self.store.rewritten("chunk", indexing.without_artifacts(old, ready).unionByName(fresh), parts),
                "quarantine": self.store.added("quarantine", bad),
                "posting": self.store.added("posting", lists),
                "outbox": self._settled(at, "INDEX", good, here.where("index_status <> 'READY'").select("tenant_id", "id", F.col("failure_message").alias("error")), now),
            }
            return changes, {}

        self._committed(build)
        self._remember(asked, hits, now)

    def _remember(self, asked: DataFrame, hits: DataFrame, now: datetime | None) -> None:
        """Writes vectors back to the cache and notes what was used; a cache that others change meanwhile is left as they made it."""
        at = now or datetime.now()
        touched = asked.select("content_sha256").union(hits.select("content_sha256")).select(F.lit(self.model).alias("embedding_model"), "content_sha256")
        version = self.store.version()
        parts = self.store.parts_of("vector_cache", touched)
        if not parts:
            return
        cache = self.store.read("vector_cache", version=version, parts=parts)
        now_kept = embed.used(cache, hits, asked, self.model, self.model_version, at)
        try:
            self.store.commit(version, {"vector_cache": self.store.rewritten("vector_cache", now_kept, parts)})
            self._evict()
        except Conflict:
            return

    def _evict(self) -> None:
        version = self.store.version()
        cache = self.store.read("vector_cache", version=version)
        if cache.count() > self.most_cached:
            kept = self._kept(embed.last_used(cache, self.most_cached), embed.CACHE)
            self.store.commit(version, {"vector_cache": self.store.rewritten("vector_cache", kept, set(self.store.state(version)["vector_cache"]))}, {"vector_cache": ""})

    def reindex(self, principal: str, tenant: str, artifact: str) -> None:
        """Has an artifact indexed again, as its next version."""
        self.grants.require(principal, tenant, "INGEST")

        def build(at: int) -> tuple[dict[str, Change], dict[str, str]]:
            mine = retrieval.one_of(self.store.read("artifact", version=at, tenant=tenant).where(retrieval.readable()), tenant, artifact)
            again = mine.withColumn("version", F.col("version") + 1).withColumn("index_status", F.lit("PENDING"))
            return {"artifact": self._changed(at, again), "outbox": self.store.added("outbox", self._jobs(again).where("type = 'INDEX'"))}, {}

        self._committed(build)

    def compact_postings(self, tenant: str) -> None:
        """Rewrites a tenant's posting lists without the chunks that are gone."""

        def build(at: int) -> tuple[dict[str, Change], dict[str, str]]:
            index = self.store.read("posting", version=at, tenant=tenant)
            parts = {p for p in self.store.state(at)["posting"] if p.startswith(of_tenant(tenant))}
            live = self.store.read("chunk", version=at, tenant=tenant).select(F.col("chunk_id").alias("id"))
            return {"posting": self.store.rewritten("posting", postings.without(index, live), parts)}, {"chunk": of_tenant(tenant)}

        self._committed(build)

    def live(self, tenant: str) -> DataFrame:
        return self.store.read("artifact", tenant=tenant).where(retrieval.readable())

    def metadata(self, principal: str, tenant: str, artifact: str) -> DataFrame:
        self.grants.require(principal, tenant, "READ_METADATA")
        return retrieval.one_of(self.live(tenant), tenant, artifact)

    def list_metadata(self, principal: str, tenant: str, limit: int) -> DataFrame:
        """The newest artifacts; the limit counts tombstones too, which are then left out."""
        self.grants.require(principal, tenant, "LIST")
        return retrieval.newest(self.store.read("artifact", tenant=tenant), max(1, min(limit, MOST_LISTED))).where(retrieval.readable())

    def content(self, principal: str, tenant: str, artifact: str, offset: int = 0, requested: int = files.CONTENT_BYTES) -> DataFrame:
        """A range of the content: of a stored one only the segments that it touches are read."""
        self.grants.require(principal, tenant, "READ_CONTENT")
        mine = self.live(tenant).where(F.col("id") == artifact).select("id", "media_type", F.col("size_bytes").alias("size"), "storage_status", "storage_key")
        stored = mine.where((F.col("storage_status") == "STORED") & F.col("storage_key").isNotNull())
        parts = self.store.parts_of("object", stored.select(F.lit(tenant).alias("tenant_id"), F.col("id").alias("artifact_id")))
        if not parts:
            return self._content(tenant, artifact, files.byte_range(F.col("content"), offset, requested))
        held = self.store.read("object", tenant=tenant, parts=parts).where(F.col("artifact_id") == artifact)
        read = segments.byte_range(held, ["artifact_id", "storage_key"], offset, requested)
        return stored.join(read.withColumnRenamed("artifact_id", "id"), ["id", "storage_key"]).select("id", "media_type", F.col("size").alias("size_bytes"), "payload", "next_offset", "eof")

    def damaged(self, tenant: str) -> DataFrame:
        """artifact_id, segment of a tenant's stored contents whose bytes are no longer those that were stored."""
        held = self.store.read("object", tenant=tenant)
        return held.where(~(keys.sha256(F.col("content")) == F.col("segment_sha256"))).select("artifact_id", "segment")

    def whole_content(self, principal: str, tenant: str, artifact: str) -> DataFrame:
        """The content as base64 if it is small, else where to read it in parts."""
        self.grants.require(principal, tenant, "READ_CONTENT")
        return self._content(tenant, artifact, files.inline_or_uri(F.col("content"), F.concat(F.lit("artifact://"), F.col("id"), F.lit("/content"))))

    def _content(self, tenant: str, artifact: str, part: Column) -> DataFrame:
        mine = self.live(tenant).where(F.col("id") == artifact).select("tenant_id", "id", "media_type", "size_bytes")
        return mine.join(self.contents(tenant=tenant), ["tenant_id", "id"]).select("id", "media_type", "size_bytes", part.alias("r")).select("id", "media_type", "size_bytes", "r.*")

    def extracted_text(self, principal: str, tenant: str, artifact: str, max_chars: int = files.TEXT_CHARS) -> DataFrame:
        self.grants.require(principal, tenant, "READ_TEXT")
        live = self.live(tenant).where(F.col("id") == artifact).select(F.col("id").alias("artifact_id"))
        mine = indexing.chunks_of(self.store.read("chunk", tenant=tenant), tenant, artifact, self.model).join(live, "artifact_id", "left_semi")
        return indexing.extracted_text(mine, ["artifact_id"], index_col="chunk_index", text_col="text", limit=min(max_chars, files.TEXT_HARD))

    def search(self, principal: str, tenant: str, query: str, limit: int = 10, scopes: set[str] | None = None, full_text: bool = False, **filters) -> DataFrame:
        """The best hits by vectors and by words: parts of words that occur, or with `full_text` the rank of matches in the posting lists."""
        self.grants.require(principal, tenant, "SEARCH")
        if scopes is not None:
            require_scope(scopes, "artifact.search")
        asked = {"query": query, "limit": limit, "mediaTypes": filters.get("media_types"), "tags": filters.get("tags")}
        checked = records.search_arguments({k: v for k, v in asked.items() if v is not None})
        version = self.store.version()
        (vector,) = self.provider([checked["query"]])
        words = None
        if full_text:
            terms = [(w,) for w in postings.words_of(fulltext.parsed(query))]
            buckets = self.spark.createDataFrame(terms, "term string").select(F.lit(tenant).alias("scope"), postings.bucket(F.col("term")).alias("bucket"))
            index = self.store.read("posting", version=version, parts=self.store.parts_of("posting", buckets))

            def words(found: DataFrame, k: int) -> DataFrame:
                best = postings.search(index, query, k, scope=tenant, live=found.select(F.col("chunk_id").alias("id")))
                return found.select("chunk_id", "artifact_id").join(F.broadcast(best.select(F.col("id").alias("chunk_id"), F.col("rank").alias("score"))), "chunk_id")  # k rows

        return retrieval.hybrid_search(self.store.read("chunk", version=version, tenant=tenant), self.store.read("artifact", version=version, tenant=tenant), query, vector, tenant=tenant, limit=limit, words=words, **filters)

    def delete(self, principal: str, tenant: str, artifact: str) -> None:
        """A tombstone, and neither chunks nor content, in one commit; doing it again changes nothing. Other tenants' files are not touched.

        Posting lists are left as they are: a search asks whether its chunks are there.
        """
        self.grants.require(principal, tenant, "DELETE")
        gone = self.spark.createDataFrame([(tenant, artifact)], "tenant_id string, artifact_id string")

        def build(at: int) -> tuple[dict[str, Change], dict[str, str]]:
            mine = self.store.read("artifact", version=at, tenant=tenant).where((F.col("id") == artifact) & retrieval.readable())
            if mine.isEmpty():
                return {}, {}
            marked = intake.tombstoned(mine, gone.withColumnRenamed("artifact_id", "id")).withColumn("spool_path", F.lit(None).cast("string")).withColumn("storage_key", F.lit(None).cast("string"))
            changes = {name: self._without(name, at, gone) for name in ("chunk", "quarantine", "spool", "object", "outbox")}
            return {"artifact": self._changed(at, marked)} | changes, {}

        self._committed(build)
