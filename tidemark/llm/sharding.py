"""Sharding: sampled splitters.

Records are ordered by a hash of their text and then by id, so that equal texts are neighbours.
A sample, drawn with probability in proportion to size (and number) of records, gives quantiles of
that order; they split it into ranges of about equal load. Exact sums of each range then show where
a range is overfull; such ranges are sampled again on their own and subdivided. Running sums within
ranges and the sums of those before give each record its exact place in the whole order.

Equal texts are a group and stay in one shard as long as shards can be near equal. The sample also
shows which groups may be large. Those of more than `GROUP_SHARE` of a shard, by exact sums, are dealt
first, the largest one to the emptiest shard, if it has room for the whole of it. All other records
are a line, cut where shards are full, but not within a group of up to that share. A group that no
shard has room for is divided by id along the line. So a shard differs from the mean by `GROUP_SHARE`
of it or by the largest record at most, or by a group that the sample has missed: one of `GROUP_SHARE`
of 16 shards is missed with a chance of one in a thousand, a larger one far more seldom.

Ranges, not shards, are the unit of work, and their number grows with the records, so a shard of any
size is laid out by many tasks.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, table

SHARDS = 16
#: Ranges for each shard at least, records for each range on average, and ranges at most (larger ones are sorted with spills).
RANGES, RANGE_ROWS, MOST_RANGES = 16, 1 << 20, 4096
#: Sampled records for each range; the sample that reaches the driver holds about MOST_RANGES * SAMPLES at most, 8 MB.
SAMPLES = 64
#: A range is overfull beyond so many times the mean load; it is subdivided at most ROUNDS times.
OVERFULL, ROUNDS = 2.0, 3
GROUP_SHARE = 0.01


def position(h: Column, tie: Column) -> Column:
    """The place in the order as one binary string: text hash, then id hash."""
    flipped = [c.bitwiseXOR(F.lit(-(1 << 63))) for c in (h, tie)]
    return F.concat(*[F.unhex(F.lpad(F.hex(c), 16, "0")) for c in flipped])


def splitters(sample: list, parts: int) -> list[bytes]:
    """Boundaries between `parts` ranges: weighted quantiles of (position, weight)."""
    if not sample or parts < 2:
        return []
    sample = sorted((bytes(p), w) for p, w in sample)
    upto = np.cumsum([w for _, w in sample])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts)
    found = [sample[min(i, len(sample) - 1)][0] for i in at.tolist()]
    out = []
    for i, p in enumerate(found):
        same = any(q[:8] == p[:8] for q in (found[i - 1 : i] + found[i + 1 : i + 2]))
        out.append(p if same else p[:8] + bytes(8))  # a boundary goes through a group only if the group holds several
    return sorted(set(out))


def in_ranges(df: DataFrame, bounds: list[bytes]) -> DataFrame:
    """Column `range`: how many boundaries are at or before the row's position."""
    heads = np.frombuffer(b"".join(bounds), ">u8").reshape(-1, 2) if bounds else np.zeros((0, 2), ">u8")
    first, second = heads[:, 0].astype("u8"), heads[:, 1].astype("u8")

    def run(batches):
        for batch in batches:
            where = np.frombuffer(b"".join(batch.column("position").to_pylist()), ">u8").reshape(-1, 2).astype("u8")
            low, high = np.searchsorted(first, where[:, 0], "left"), np.searchsorted(first, where[:, 0], "right")
            split = np.flatnonzero(high > low)
            out = low.copy()
            for i in np.unique(low[split]).tolist():
                rows = split[low[split] == i]
                out[rows] = i + np.searchsorted(second[i : high[rows[0]]], where[rows, 1], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "range"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("range", T.LongType())]))


def whole_groups(rows: DataFrame, heads: list[bytes], total: int, shards: int) -> tuple[dict[bytes, tuple[int, int]], list[float]]:
    """The shard and order of each large group that stays whole, and what is left of each shard for the line.

    `heads` are the groups of several sampled records, so they are fewer than those.
    """
    mean = total / shards
    group = F.substring("position", 1, 8)
    sums = rows.where(group.isin(heads)).groupBy(group.alias("head")).agg(F.sum("size").alias("bytes")).collect() if heads else []
    room = [(0.0, i) for i in range(shards)]
    out: dict[bytes, tuple[int, int]] = {}
    for r in sorted(sums, key=lambda r: (-r["bytes"], bytes(r["head"]))):
        load, i = room[0]
        if GROUP_SHARE * mean < r["bytes"] <= mean - load:
            heapq.heapreplace(room, (load + r["bytes"], i))
            out[bytes(r["head"])] = i, len(out)
    return out, [mean - load for load, _ in sorted(room, key=lambda x: x[1])]


def laid_out(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Adds shard and slot to rows with `size` (long, positive) and `position`, which must be stored, not recomputed."""
    spark = rows.sparkSession
    n, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    total = int(total or 0)
    load = F.col("size") / max(total, 1) / 2 + F.lit(0.5 / max(n, 1))
    parts = max(shards * RANGES, min(MOST_RANGES, n // RANGE_ROWS))
    chance = load * float(parts * SAMPLES)
    draw = (F.abs(F.xxhash64("position", F.lit("sample"))) % (1 << 30)) / float(1 << 30)
    # a record of more than one sample's load is drawn surely and counts with its load
    sample = rows.where(draw < chance).select("position", F.greatest(F.lit(1.0), chance).alias("w")).collect()
    bounds = splitters(sample, parts)
    heads = [head for head, times in Counter(bytes(p)[:8] for p, _ in sample).items() if times > 1]
    whole, room = whole_groups(rows, heads, total, shards)
    for _ in range(ROUNDS):
        ranged = in_ranges(rows, bounds)
        loads = {r["range"]: r["load"] for r in ranged.groupBy("range").agg(F.sum(load).alias("load")).collect()}
        over = [i for i, x in loads.items() if x > OVERFULL / parts]
        if not over:
            break
        again = ranged.where(F.col("range").isin(over) & (draw < chance * 4)).select("position", F.greatest(F.lit(1.0), chance * 4).alias("w"), "range")
        by: dict[int, list] = {}
        for p, w, i in again.collect():
            by.setdefault(i, []).append((p, w))
        more = sorted({*bounds, *(b for i in over for b in splitters(by.get(i, []), int(np.ceil(2 * loads[i] * parts))))})
        if len(more) == len(bounds):
            break
        bounds = more
    dealt = spark.createDataFrame([(head, i, k) for head, (i, k) in whole.items()], "head binary, of_shard int, turn int")  # a row for each group of more than GROUP_SHARE
    ranged = in_ranges(rows, bounds).withColumn("head", F.substring("position", 1, 8)).join(F.broadcast(dealt), "head", "left")
    turn = F.coalesce("turn", F.lit(-1))  # -1: the line
    sums = ranged.groupBy("range", turn.alias("turn")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    before = Window.partitionBy("turn").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("range", "turn", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"))
    order = Window.partitionBy("range", "turn").orderBy("position")
    group = Window.partitionBy("range", "turn", "head")
    each = (
        ranged.withColumn("turn", turn)
        .join(F.broadcast(offsets), ["range", "turn"])  # a row for each range, and for each that a whole group is in
        .withColumn("place", F.row_number().over(order) - 1 + F.col("rows_before"))
        .withColumn("start", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") + F.col("bytes_before"))
        .withColumn("group_start", F.min("start").over(group))
        .withColumn("group_bytes", F.sum("size").over(group))
    )
    together = F.col("group_bytes") <= GROUP_SHARE * total / shards
    at = F.when(together, F.col("group_start") + F.col("group_bytes") / 2).otherwise(F.col("start") + F.col("size") / 2)  # a middle halves a large record's pull on two shards
    cuts = F.array(*[F.lit(float(x)) for x in np.cumsum(room)[:-1]]) if shards > 1 else F.array().cast("array<double>")
    in_line = F.size(F.filter(cuts, lambda c: c <= at))
    placed = cut(each.select("doc_id", "size", "text_crc32", "turn", "place", F.coalesce("of_shard", in_line).cast("int").alias("shard")))
    runs = placed.groupBy("shard", "turn").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("shard", "turn", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(F.broadcast(starts), ["shard", "turn"]).withColumn("slot", F.col("place") + F.col("shift")).drop("place", "shift", "turn")  # a row for each shard and whole group


def shard(df: DataFrame, *, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row; shards have near equal bytes.

    Size is the bytes of the text (null: none) plus 1. Slots run from 0 in each shard without gaps.
    Equal texts share a shard unless they are more than a shard has room for.
    Null and repeated ids and equal rows each take a slot of their own; which of equal rows takes
    which is not fixed. No rows give no rows. Columns other than the two are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        position(F.xxhash64(text), F.xxhash64(F.col(id_col))).alias("position"),
    )
    return laid_out(cut(rows), shards).select("doc_id", "size", "text_crc32", "shard", "slot")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", law, "shard", F.col("slot").cast("long").alias("slot"), grown)
