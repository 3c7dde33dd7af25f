"""Jobs: due work, claims, leases, retries, dead letters and the tables of allowed transitions."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import times

#: From each state of a job the states it may go to.
TRANSITIONS = {
    "PENDING": ("VALIDATING", "CANCELLED"),
    "VALIDATING": ("BUFFERED", "DEAD_LETTER"),
    "BUFFERED": ("RUNNING", "CANCELLED"),
    "RUNNING": ("COMPLETED", "RETRY_PENDING", "DEAD_LETTER"),
    "RETRY_PENDING": ("BUFFERED", "DEAD_LETTER"),
}
#: Outbox rows of a relay round, leases recovered in one.
RELAY_BATCH, RECOVER_BATCH = 100, 100


def _at(now: datetime | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(now)


def outbox_batch(outbox: DataFrame, n: int = RELAY_BATCH) -> DataFrame:
    """The oldest rows."""
    return outbox.orderBy("created_at", "id").limit(n)


def enqueued(queue: DataFrame, jobs: DataFrame) -> DataFrame:
    """Adds pending jobs whose id is not queued yet."""
    fresh = jobs.where(F.col("status") == "PENDING").dropDuplicates(["id"]).join(queue.select("id"), "id", "left_anti")
    return queue.unionByName(fresh.select(*queue.columns))


def due_jobs(jobs: DataFrame, now: datetime | Column, kind: str | None = None, n: int | None = None) -> DataFrame:
    """Jobs that may be claimed, the longest due first."""
    found = jobs.where(times.due(F.col("status"), F.col("next_attempt_at"), _at(now)))
    found = found.where(F.col("type") == kind) if kind else found
    return found.orderBy(F.col("next_attempt_at").asc_nulls_first(), "id").limit(n) if n else found


def claimed(jobs: DataFrame, now: datetime | Column, kind: str, owner: str, lease_seconds: int) -> DataFrame:
    """All jobs, the first due one of a type claimed by `owner` with one more attempt."""
    one = due_jobs(jobs, now, kind, 1).select("id", F.lit(True).alias("_mine"))
    mine = F.coalesce(F.col("_mine"), F.lit(False))
    rows = jobs.join(F.broadcast(one), "id", "left")  # one row
    return (
        rows.withColumn("status", F.when(mine, "CLAIMED").otherwise(F.col("status")))
        .withColumn("attempts", F.col("attempts") + mine.cast("int"))
        .withColumn("lease_owner", F.when(mine, F.lit(owner)).otherwise(F.col("lease_owner")))
        .withColumn("lease_expires_at", F.when(mine, _at(now) + F.make_interval(secs=F.lit(lease_seconds))).otherwise(F.col("lease_expires_at")))
        .select(*jobs.columns)
    )


def renewed(jobs: DataFrame, job_id: str, owner: str, now: datetime | Column, lease_seconds: int) -> DataFrame:
    """A longer lease for its owner while it has not run out."""
    mine = (F.col("id") == job_id) & times.owns_lease(F.col("status"), F.col("lease_owner"), F.col("lease_expires_at"), owner, _at(now))
    return jobs.withColumn("lease_expires_at", F.when(mine, _at(now) + F.make_interval(secs=F.lit(lease_seconds))).otherwise(F.col("lease_expires_at")))


def settled(jobs: DataFrame, results: DataFrame, now: datetime | Column, most_attempts: int = times.ATTEMPTS) -> DataFrame:
    """Applies results (id, owner, ok, error): completed, to be retried, or a dead letter after the last attempt.

    A result counts only if its owner holds the lease; owner and expiry are then cleared.
    """
    r = results.select("id", F.col("owner").alias("_owner"), F.col("ok").alias("_ok"), F.col("error").alias("_error")).dropDuplicates(["id"])
    held = F.coalesce((F.col("status") == "CLAIMED") & (F.col("lease_owner") == F.col("_owner")) & (F.col("lease_expires_at") > _at(now)), F.lit(False))
    again = F.col("attempts") < most_attempts
    status = F.when(F.col("_ok"), "COMPLETED").when(again, "RETRY_PENDING").otherwise("DEAD_LETTER")
    wait = times.retry_delay_ms(F.col("attempts"))
    next_at = F.timestamp_micros(F.unix_micros(_at(now).cast("timestamp")) + 1000 * wait)
    rows = jobs.join(r, "id", "left").withColumn("_held", held)
    return (
        rows.withColumn("_status", F.when(F.col("_held"), status).otherwise(F.col("status")))
        .withColumn("last_error", F.when(F.col("_held") & ~F.col("_ok"), F.left("_error", F.lit(500))).otherwise(F.col("last_error")))
        .withColumn("next_attempt_at", F.when(F.col("_held"), F.when(F.col("_status") == "RETRY_PENDING", next_at)).otherwise(F.col("next_attempt_at")))
        .withColumn("lease_owner", F.when(~F.col("_held"), F.col("lease_owner")))
        .withColumn("lease_expires_at", F.when(~F.col("_held"), F.col("lease_expires_at")))
        .withColumn("status", F.col("_status"))
        .select(*jobs.columns)
    )


def expired_leases(jobs: DataFrame, now: datetime | Column) -> DataFrame:
    return jobs.where(times.lease_expired(F.col("status"), F.col("lease_expires_at"), _at(now)))


def recovered(jobs: DataFrame, now: datetime | Column, n: int = RECOVER_BATCH) -> DataFrame:
    """The n jobs whose lease ran out first wait for another try, due at once; the others stay as they are."""
    first = expired_leases(jobs, now).orderBy("lease_expires_at", "id").limit(n).select("id", F.lit(True).alias("_gone"))
    rows = jobs.join(F.broadcast(first), "id", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))  # n rows
    return (
        rows.withColumn("status", F.when(F.col("_gone"), "RETRY_PENDING").otherwise(F.col("status")))
        .withColumn("next_attempt_at", F.when(F.col("_gone"), _at(now)).otherwise(F.col("next_attempt_at")))
        .withColumn("last_error", F.when(F.col("_gone"), "lease expired").otherwise(F.col("last_error")))
        .withColumn("lease_owner", F.when(~F.col("_gone"), F.col("lease_owner")))
        .withColumn("lease_expires_at", F.when(~F.col("_gone"), F.col("lease_expires_at")))
        .select(*jobs.columns)
    )


def acknowledged(outbox: DataFrame, taken: DataFrame) -> DataFrame:
    """The outbox without the rows (id) that have been taken; an id that is not there does no harm."""
    return outbox.join(taken.select("id").distinct(), "id", "left_anti").select(*outbox.columns)


def refusal() -> Column:
    """Why a job can't be dispatched; null if it can: it must be pending, with an id, a tenant, an artifact and a known type."""

    def blank(c: str) -> Column:
        return F.coalesce(F.trim(F.col(c)) == "", F.lit(True))

    return (
        F.when(blank("id") | blank("tenant_id") | blank("artifact_id"), "IDENTITY")
        .when(~F.coalesce(F.col("type").isin("STORE", "INDEX"), F.lit(False)), "TYPE")
        .when(~F.col("status").eqNullSafe("PENDING"), "STATUS")
    )


def dispatched(queue: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the queue with the jobs that it takes, id and acknowledgement of each job: ACCEPTED, DUPLICATE or REJECTED with the reason)."""
    judged = jobs.withColumn("reason", refusal()).join(queue.select("id", F.lit(True).alias("_queued")).distinct(), "id", "left")
    outcome = F.when(F.col("reason").isNotNull(), "REJECTED").when(F.col("_queued"), "DUPLICATE").otherwise("ACCEPTED")
    return enqueued(queue, jobs.where(refusal().isNull())), judged.select("id", outcome.alias("outcome"), "reason")


def settled_by(jobs: DataFrame, run: Callable[[DataFrame], DataFrame], now: datetime | Column, kind: str, owner: str, *, lease_seconds: int = 60, most_attempts: int = times.ATTEMPTS) -> DataFrame:
    """One turn of a worker: leases that ran out are recovered, the next due job of a type is claimed and run, its result applied.

    `run` gets the claimed row and returns id, ok, error. A job that fails waits, or is a dead letter after its last attempt.
    """
    mine = claimed(recovered(jobs, now), now, kind, owner, lease_seconds)
    held = mine.where(times.owns_lease(F.col("status"), F.col("lease_owner"), F.col("lease_expires_at"), owner, _at(now)) & (F.col("type") == kind))
    return settled(mine, run(held).withColumn("owner", F.lit(owner)), now, most_attempts)


def latest_state(events: DataFrame, *, key: str, state: str, at: str, tie: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(state, F.struct(at, tie)).alias("state"))


def transition_table(spark: SparkSession, allowed: dict[str, tuple[str, ...]] = TRANSITIONS) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, to in allowed.items() for b in to], "from_state string, to_state string")


def invalid_transitions(history: DataFrame, allowed: DataFrame, *, key: str, state: str, at: str, tie: str) -> DataFrame:
    """Consecutive states of a job that the table does not allow; `allowed` is the fixed table."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(at, tie))
    steps = history.select(key, F.col(tie).alias("step_id"), before.alias("from_state"), F.col(state).alias("to_state")).where("from_state is not null")
    return steps.join(F.broadcast(allowed), ["from_state", "to_state"], "left_anti")
