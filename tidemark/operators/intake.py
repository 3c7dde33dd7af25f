"""Intake: registration with replay and duplicate checks, quotas, spool accounts and reconciliation."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quotas import TENANT_FILES, Limits, accepted_within, admitted  # noqa: F401  (part of intake)
from tidemark.sources import shared

def fresh_name() -> str:
    return uuid.uuid4().hex


#: Rounds in which requests are decided side by side before the rest, if any, is decided in order.
ROUNDS = 12
REQUEST = ["tenant_id", "seq", "id", "idempotency_key", "sha256", "fingerprint"]


def registered(requests: DataFrame, stored: DataFrame | None = None, *, rounds: int = ROUNDS) -> DataFrame:
    """Outcome and artifact of each request (seq, id, tenant_id, idempotency_key, sha256, fingerprint).

    Requests of a tenant count in the order of seq, then id: a known key is a replay or, with another
    fingerprint, a conflict; else known content is a duplicate; else the artifact is created, and only
    then are its key and content known. So artifacts are created by the first independent set, in that
    order, of requests that share a key or a content. It is found in rounds: a request that is the first
    of its key and of its content among those undecided creates, and all that share either with it do
    not. Every round is two minima, combined before the shuffle, and joins with what was created, so
    neither a large tenant nor a common content is one task's. Few rounds are needed unless requests
    wait for each other in long chains; what is undecided after `rounds` is decided in order by tenant.

    `stored` has tombstones already left out. Artifacts with equal content: the oldest is returned.
    """
    every = shared.kept(requests.select("tenant_id", F.col("seq").cast("long").alias("seq"), *REQUEST[2:]).select(*[F.col(c) if c == "seq" else F.col(c).cast("string").alias(c) for c in REQUEST]), "requests")
    answers, left = [], every
    if stored is not None:
        held = stored.select("tenant_id", "idempotency_key", "sha256", "fingerprint", F.col("seq").cast("long").alias("seq"), "id")
        of_key = held.where("idempotency_key is not null").groupBy("tenant_id", "idempotency_key").agg(F.max(F.struct("seq", "fingerprint", "id")).alias("k"))
        of_content = held.groupBy("tenant_id", "sha256").agg(F.min(F.struct("seq", "id")).alias("c"))
        met = shared.kept(every.join(of_key, ["tenant_id", "idempotency_key"], "left").join(of_content, ["tenant_id", "sha256"], "left"), "known")
        replay = F.when(F.col("k.fingerprint").eqNullSafe(F.col("fingerprint")), "IDEMPOTENT_REPLAY").otherwise("CONFLICT")
        answers.append(met.where("k is not null").select("seq", "tenant_id", replay.alias("outcome"), F.col("k.id").alias("artifact_id")))
        every = met.where("k is null").select(*REQUEST, F.col("c.id").alias("held"))
        left = every.where("held is null").select(*REQUEST)
    else:
        every = left.withColumn("held", F.lit(None).cast("string"))
    created = None
    for n in range(rounds + 1):
        new = shared.kept(_first_of_both(left) if n < rounds else _in_turn(left), "created")
        created = new if created is None else created.unionByName(new)
        if n == rounds:
            break
        left = left.join(new.select("tenant_id", "sha256"), ["tenant_id", "sha256"], "left_anti").join(new.where("idempotency_key is not null").select("tenant_id", "idempotency_key"), ["tenant_id", "idempotency_key"], "left_anti")
        left = shared.kept(left.select(*REQUEST), "undecided")
        if left.isEmpty():
            break
    mark = F.struct("seq", "id")
    of_key = created.where("idempotency_key is not null").select("tenant_id", "idempotency_key", F.struct("seq", "id", "fingerprint").alias("k"))
    of_content = created.select("tenant_id", "sha256", mark.alias("c"))
    met = every.join(of_key, ["tenant_id", "idempotency_key"], "left").join(of_content, ["tenant_id", "sha256"], "left")
    mine = F.col("held").isNull() & (F.col("c") == mark)
    earlier = F.col("k").isNotNull() & (F.struct("k.seq", "k.id") < mark)
    replay = F.when(F.col("k.fingerprint").eqNullSafe(F.col("fingerprint")), "IDEMPOTENT_REPLAY").otherwise("CONFLICT")
    outcome = F.when(mine, "CREATED").when(earlier, replay).otherwise("CONTENT_DUPLICATE")
    answer = met.select("seq", "tenant_id", outcome.alias("outcome"), F.when(earlier, F.col("k.id")).otherwise(F.coalesce("held", "c.id")).alias("artifact_id"))
    for more in answers:
        answer = answer.unionByName(more)
    return answer


def _first_of_both(left: DataFrame) -> DataFrame:
    """Requests that are the first of their content and, if they have one, of their key."""
    of_content = left.groupBy("tenant_id", "sha256").agg(F.min(F.struct("seq", "id", "idempotency_key", "fingerprint")).alias("m")).select("tenant_id", "m.seq", "m.id", "m.idempotency_key", "sha256", "m.fingerprint")
    of_key = left.where("idempotency_key is not null").groupBy("tenant_id", "idempotency_key").agg(F.min(F.struct("seq", "id")).alias("m")).select("tenant_id", "m.seq", "m.id")
    both = of_content.where("idempotency_key is not null").join(of_key, ["tenant_id", "seq", "id"], "left_semi")
    return both.select(*REQUEST).unionByName(of_content.where("idempotency_key is null").select(*REQUEST))


def _in_turn(left: DataFrame) -> DataFrame:
    """Requests that create, each tenant's decided one after the other."""
    schema = "tenant_id string, seq long, id string, idempotency_key string, sha256 string, fingerprint string"

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tenant, keys, contents = None, set(), set()
        for frame in frames:
            creates = []
            for owner, key, sha in zip(frame["tenant_id"], frame["idempotency_key"], frame["sha256"], strict=True):
                if owner != tenant:
                    tenant, keys, contents = owner, set(), set()
                new = sha not in contents and (key is None or key not in keys)
                creates.append(new)
                if new:
                    contents.add(sha)
                    keys.add(key)
            yield frame[creates]

    return left.repartition("tenant_id").sortWithinPartitions("tenant_id", "seq", "id").select(*REQUEST).mapInPandas(fold, schema)


def by_idempotency_key(artifacts: DataFrame, tenant: str, key: str) -> DataFrame:
    """The live artifact of a tenant that was registered with a key."""
    return artifacts.where((F.col("tenant_id") == tenant) & (F.col("idempotency_key") == key) & ~F.col("storage_status").eqNullSafe("DELETED"))


def by_spool_path(artifacts: DataFrame, path: str) -> DataFrame:
    """The artifacts whose content is at a path of the spool, however it is written."""
    from tidemark.functions.keys import normal_path

    return artifacts.where(normal_path(F.col("spool_path")) == normal_path(F.lit(path)))


def outbox_rows(artifacts: DataFrame) -> DataFrame:
    """The STORE and INDEX jobs of created artifacts (tenant_id, id, version, created_at)."""
    from tidemark.functions.keys import operation_id

    each = artifacts.withColumn("type", F.explode(F.array(F.lit("STORE"), F.lit("INDEX"))))
    job = operation_id(F.col("tenant_id"), F.col("id"), F.col("version"), F.col("type"))
    return each.select(job.alias("id"), "tenant_id", F.col("id").alias("artifact_id"), "type", F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"), "created_at")


def oldest_by_content(artifacts: DataFrame) -> DataFrame:
    """The oldest live artifact of each tenant and checksum, ties by id."""
    live = artifacts.where(~F.col("storage_status").eqNullSafe("DELETED"))
    return live.groupBy("tenant_id", "sha256").agg(F.min_by("id", F.struct("created_at", "id")).alias("id"))


def usage(files: DataFrame, *, by: str, bytes_col: str) -> DataFrame:
    """Bytes and files of each tenant and, with a null tenant, of all."""
    return files.rollup(by).agg(F.sum(bytes_col).cast("long").alias("bytes"), F.count(F.lit(1)).alias("files"), F.grouping(by).cast("int").alias("is_total"))


def orphans(spool: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Spool files that no artifact names; both sides have a normalised spool_path."""
    return spool.join(artifacts.where("spool_path is not null").select("spool_path"), "spool_path", "left_anti")


def missing(artifacts: DataFrame, spool: DataFrame) -> DataFrame:
    """Artifacts not yet stored whose spool file is gone; those without a path are none of them."""
    open_ones = artifacts.where(F.col("spool_path").isNotNull() & ~F.col("storage_status").isin("STORED", "DELETED"))
    return open_ones.join(spool.select("spool_path"), "spool_path", "left_anti")


def length_agrees(declared: Column, actual: Column) -> Column:
    """A declared length of -1 says nothing; any other must be the actual one."""
    return (declared < 0) | (declared == actual)


def tombstoned(artifacts: DataFrame, gone: DataFrame) -> DataFrame:
    """Both statuses become DELETED for (tenant_id, id) in `gone`; everything else stays. Deleting again changes nothing."""
    marked = artifacts.join(gone.select("tenant_id", "id", F.lit(True).alias("_gone")).distinct(), ["tenant_id", "id"], "left")
    for c in ("storage_status", "index_status"):
        marked = marked.withColumn(c, F.when(F.col("_gone"), F.lit("DELETED")).otherwise(F.col(c)))
    return marked.drop("_gone").select(*artifacts.columns)
