"""Quotas: which files fit when they come, with limits for a tenant and for all, decided side by side.

A refused file frees nothing and takes nothing, so whether one fits depends on all decisions before it.
What is held when a file comes lies between what is already known to be accepted before it and that
plus all that is still open before it. Where even the upper end leaves room the file is accepted, where
even the lower end does not it is refused; each such decision narrows the range of those after it.
Files lie in blocks in the order of arrival; a round is running sums within blocks and over the blocks'
sums, for all files and for each tenant, so no task has a tenant or all files. The first open file is
decided in every round, and most are in the first: all that comes before a limit is near. When no more
are open than fit into a block, these are replayed one by one, with what is known between them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources import shared

#: What may be in the spool: bytes of an artifact, and bytes and files in all and for a tenant.
MOST_BYTES = 128 << 20
GLOBAL_BYTES, GLOBAL_FILES, TENANT_BYTES, TENANT_FILES = 10 << 30, 100_000, 1 << 30, 10_000
#: Files of a block, and rounds after which what is open is replayed however much it is.
BLOCK, ROUNDS = 16_384, 16
#: No limit.
NONE = (1 << 63) - 1


@dataclass(frozen=True)
class Limits:
    """What may be held: bytes of one artifact, and bytes and files in all and of a tenant."""

    artifact_bytes: int = MOST_BYTES
    bytes: int = GLOBAL_BYTES
    files: int = GLOBAL_FILES
    tenant_bytes: int = TENANT_BYTES
    tenant_files: int = TENANT_FILES


#: Refusals, in the order in which limits are tried.
REFUSALS = ("ARTIFACT_BYTES", "GLOBAL_FILES", "TENANT_FILES", "GLOBAL_BYTES", "TENANT_BYTES")


def _before(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """For each sum its value over all files that came before (g_) and over those of the owner (t_)."""
    rows = rows.withColumns(sums)
    total = [F.sum(c).alias(c) for c in sums]
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    over = lambda df, w, name: df.withColumns({f"{name}{c}": F.coalesce(F.sum(c).over(earlier(w)), F.lit(0)) for c in sums})
    blocks = over(rows.groupBy("block").agg(*total), Window.orderBy("block"), "bg_").drop(*sums)  # a row for each block
    owners = over(rows.groupBy("block", "owner").agg(*total), Window.partitionBy("owner").orderBy("block"), "bt_").drop(*sums).withColumnsRenamed({"block": "_b", "owner": "_o"})
    within = over(over(rows, Window.partitionBy("block").orderBy("pos"), "wg_"), Window.partitionBy("block", "owner").orderBy("pos"), "wt_")
    met = within.join(blocks, "block").join(owners, (F.col("block") == F.col("_b")) & F.col("owner").eqNullSafe(F.col("_o")))
    return met.select(*[c for c in rows.columns if c not in sums], *[(F.col(f"w{k}_{c}") + F.col(f"b{k}_{c}")).alias(f"{k}_{c}") for k in "gt" for c in sums])


def _over(limits: Limits, all_bytes: Column, all_files: Column, own_bytes: Column, own_files: Column) -> list[Column]:
    """For each refusal whether it applies to a file that finds so much held."""
    size = F.col("size")
    return [size > limits.artifact_bytes, all_files >= limits.files, own_files >= limits.tenant_files, all_bytes > F.lit(limits.bytes) - size, own_bytes > F.lit(limits.tenant_bytes) - size]


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _replayed(rows: DataFrame, limits: Limits) -> DataFrame:
    """block, pos, accepted of open files in their order; each brings what is known to be held before it (g_b, g_f, t_b, t_f)."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_bytes = all_files = 0
        own: dict[object, tuple[int, int]] = {}
        for frame in frames:
            out = []
            for owner, size, gb, gf, tb, tf in frame[["owner", "size", "g_b", "g_f", "t_b", "t_f"]].itertuples(index=False):
                own_bytes, own_files = own.get(owner, (0, 0))
                fits = size <= limits.artifact_bytes and gf + all_files < limits.files and tf + own_files < limits.tenant_files and gb + all_bytes + size <= limits.bytes and tb + own_bytes + size <= limits.tenant_bytes
                if fits:
                    own[owner] = own_bytes + size, own_files + 1
                    all_bytes, all_files = all_bytes + size, all_files + 1
                out.append(fits)
            yield pd.DataFrame({"block": frame["block"], "pos": frame["pos"], "fits": out})

    one = rows.select("block", "pos", "owner", "size", "g_b", "g_f", "t_b", "t_f").repartition(1).sortWithinPartitions("block", "pos")
    return one.mapInPandas(fold, "block int, pos int, fits boolean")


def admitted(files: DataFrame, *, by: str, order_col: str, bytes_col: str, limits: Limits, used: DataFrame | None = None, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """tenant, order, bytes, refusal (null if it fits) of each file, in the order in which they come.

    `used` has what is held already: tenant, bytes, files. A null size is 0. Files of equal order come by
    tenant and size.
    """
    rows = files.select(F.col(by).alias("owner"), F.col(order_col).alias("at"), F.coalesce(F.col(bytes_col).cast("long"), F.lit(0)).alias("size"))
    held_bytes = held_files = 0
    if used is not None:
        total = used.agg(F.sum("bytes"), F.sum("files")).first()
        held_bytes, held_files = int(total[0] or 0), int(total[1] or 0)
        rows = rows.join(used.select(F.col(by).alias("_o"), F.col("bytes").cast("long").alias("b0"), F.col("files").cast("long").alias("f0")), F.col("owner").eqNullSafe(F.col("_o")), "left").drop("_o")
    else:
        rows = rows.withColumns({"b0": F.lit(0).cast("long"), "f0": F.lit(0).cast("long")})
    rows = shared.kept(rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("b0", "f0")}), "files")
    blocks = max(1, -(-rows.count() // block))
    dealt = rows.repartitionByRange(blocks, "at", "owner", "size").withColumn("block", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("block").orderBy("at", "owner", "size"))
    rows = shared.kept(shared.kept(dealt, "blocks").withColumn("pos", place).withColumn("fits", F.when(F.col("size") > limits.artifact_bytes, False)), "files")
    taken, open_ = F.col("fits"), F.col("fits").isNull()
    known = {"b": F.when(taken, F.col("size")).otherwise(0), "f": taken.cast("int")}
    known["f"] = F.coalesce(known["f"], F.lit(0))
    maybe = {"mb": F.when(open_, F.col("size")).otherwise(0), "mf": open_.cast("int")}
    for _ in range(rounds):
        n = rows.where(open_).count()
        if n <= block:
            break
        met = _before(rows, known | maybe)
        least = (F.col("g_b") + held_bytes, F.col("g_f") + held_files, F.col("t_b") + F.col("b0"), F.col("t_f") + F.col("f0"))
        most = tuple(x + F.col(c) for x, c in zip(least, ("g_mb", "g_mf", "t_mb", "t_mf"), strict=True))
        decided = F.when(taken.isNotNull(), taken).when(~_any(_over(limits, *most)), True).when(_any(_over(limits, *least)), False)
        rows = shared.kept(met.withColumn("fits", decided).select(*rows.columns), "files")
    if not rows.where(open_).isEmpty():
        met = _before(rows, known).where(open_)
        start = met.withColumns({"g_b": F.col("g_b") + held_bytes, "g_f": F.col("g_f") + held_files, "t_b": F.col("t_b") + F.col("b0"), "t_f": F.col("t_f") + F.col("f0")})
        last = _replayed(start, limits).withColumnRenamed("fits", "_fits")
        rows = shared.kept(rows.join(last, ["block", "pos"], "left").withColumn("fits", F.coalesce("fits", "_fits")).drop("_fits"), "files")
    met = _before(rows, known)
    over = _over(limits, F.col("g_b") + held_bytes, F.col("g_f") + held_files, F.col("t_b") + F.col("b0"), F.col("t_f") + F.col("f0"))
    refusal = F.coalesce(*[F.when(c, name) for name, c in zip(REFUSALS, over, strict=True)])
    return met.select(F.col("owner").alias(by), F.col("at").alias(order_col), F.col("size").alias(bytes_col), F.when(~taken, refusal).alias("refusal"))


def accepted_within(files: DataFrame, *, by: str, order_col: str, bytes_col: str, most_bytes: int, most_files: int, block: int = BLOCK) -> DataFrame:
    """Whether each file fits its tenant's quota when it comes; a refused file frees what it had reserved, so later ones may still fit."""
    limits = Limits(NONE, NONE, NONE, most_bytes, most_files)
    found = admitted(files, by=by, order_col=order_col, bytes_col=bytes_col, limits=limits, block=block)
    return found.select(by, order_col, bytes_col, F.col("refusal").isNull().alias("accepted"))
