"""Audit: validated, bounded and redacted rows for an append-only table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.redaction import bounded, safe_details


def complete(now: datetime | Column) -> Column:
    """Operation, principal, tenant and outcome are there, and the time is not over five minutes ahead."""
    there = F.lit(True)
    for c in ("operation", "principal_id", "tenant_id", "outcome"):
        there = there & F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    at = now if isinstance(now, Column) else F.lit(now)
    return there & F.coalesce(F.col("occurred_at") <= at + F.make_interval(secs=F.lit(300)), F.lit(False))


def audit_rows(events: DataFrame, now: datetime | Column) -> DataFrame:
    """Rows that may be written; incomplete ones are left out (see `refused`)."""
    good = events.where(complete(now))
    sizes = {"operation": 80, "principal_id": 256, "tenant_id": 128, "artifact_id": 64, "outcome": 32}
    return good.select(*[bounded(F.col(c), n).alias(c) for c, n in sizes.items()], F.greatest(F.lit(0), F.col("latency_millis")).alias("latency_millis"), "occurred_at", safe_details(F.col("safe_details")).alias("safe_details"))


def refused(events: DataFrame, now: datetime | Column) -> DataFrame:
    return events.where(~complete(now))


def scope_rows(calls: DataFrame) -> DataFrame:
    """Calls with start, end and error code as audit events: SUCCESS, or FAILURE with the code."""
    failed = F.col("error_code").isNotNull()
    return calls.select(
        "operation", "principal_id", "tenant_id", "artifact_id",
        F.when(failed, "FAILURE").otherwise("SUCCESS").alias("outcome"),
        (F.unix_millis("ended_at") - F.unix_millis("started_at")).alias("latency_millis"),
        F.col("ended_at").alias("occurred_at"),
        F.when(failed, F.create_map(F.lit("code"), F.col("error_code"))).otherwise(F.create_map().cast("map<string,string>")).alias("safe_details"),
    )
