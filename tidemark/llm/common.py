"""Shared helpers of the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts are handed to Python in batches of at most so many rows and bytes (or of one text), so that long documents stay in memory.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus folder; the path is left to Spark's readers."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def utf8_length(c: Column) -> Column:
    """Bytes of a string as UTF-8, 0 for null."""
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


def n_words(c: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts incoming batches so that no more than `rows` texts, or about `most` bytes, are decoded at once."""
    for batch in batches:
        each = max(1, min(rows, batch.num_rows * most // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, each):
            part = batch.slice(at, each)
            while part.num_rows > 1 and part.nbytes > 2 * most:  # the long texts of the batch are here
                half = part.num_rows // 2
                yield from small_batches(iter([part.slice(0, half)]), rows, most)
                part = part.slice(half)
            yield part


def whole_groups(batches: Iterator[pa.RecordBatch], column: int, least: int) -> Iterator[pa.RecordBatch]:
    """Joins sorted batches into ones of at least `least` rows that end where the column's value changes."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        joined = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys = joined.column(column).to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(keys[1:] != keys[:-1])
        if len(ends):
            yield joined.slice(0, int(ends[-1]) + 1)
            joined = joined.slice(int(ends[-1]) + 1)
        held, rows = [joined], joined.num_rows
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow with a function from one small batch to one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, rows):
            yield fn(batch)

    return df.mapInArrow(run, schema)


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes the rows under the cluster's checkpoint folder and reads them again.

    The folder is spark.checkpoint.dir of the session. Where neither that setting nor a checkpoint
    directory exists (a local test), one below the warehouse folder is used.
    """
    return df.sparkSession.read.schema(df.schema).parquet(store(df))


def store(df: DataFrame) -> str:
    """Writes a table into the shared folder and returns its path."""
    path = fresh(df.sparkSession)
    df.write.parquet(path)
    return path


def fresh(spark: SparkSession) -> str:
    """A path in the shared folder that is not taken."""
    return f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A stored table of a few short columns, marked for broadcast if it is counted and has no more rows than `most`."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return at.rstrip("/")
