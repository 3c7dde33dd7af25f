"""Outbox relay: jobs of a file stream enter the queue once each, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def outbox_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Outbox rows as they are written; the checkpoint remembers what was taken, which is the acknowledgement."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_of_each(jobs: DataFrame, key: str = "id") -> DataFrame:
    """Each id once, for all time, by keyed state."""
    return jobs.dropDuplicates([key])


def first_within(jobs: DataFrame, at: str, again_within: str, key: str = "id") -> DataFrame:
    """Each id once, for ids that come again only within some time of their first; the state lets go of those that can't.

    `at` is the jobs' time. An id leaves the state when the watermark, `again_within` behind the latest
    time seen, has passed its first time by as much; a job older than the watermark is not taken.
    """
    return jobs.withWatermark(at, again_within).dropDuplicatesWithinWatermark([key])


def relayed(jobs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Hands each micro-batch to `sink`, at an interval or (without one) until all there is has been taken.

    A batch may come again after a failure, with the same number: a sink keyed by job id, or one that
    remembers the last number, makes that harmless.
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return jobs.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**trigger).start()
