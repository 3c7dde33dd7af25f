"""Token counts: an exact histogram of encoded lengths answers every context limit.

Each text is encoded once and only its length leaves the task, counted there before anything is
shuffled. All further questions are about the histogram: suffix sums give, for each length that
occurs, how many documents reach it and how many tokens they have, hence totals, quantiles and the
tokens that remain when documents are cut at a limit.

The sums run in two levels, within blocks of `BLOCK` lengths and over the blocks, so that no task
sees more than `BLOCK` rows or one row for each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, map_batches, table
from tidemark.llm.tokenizer import encoder

BLOCK = 128


def token_lengths(df: DataFrame, tokenizer: str, *, text_col: str = "text") -> DataFrame:
    """Column n_tokens for each row's whole text, 0 for a null or empty one; other columns are not read."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.diff(encoder(tokenizer).encode_many(batch.column(0))[1]), pa.int64())], ["n_tokens"])

    return map_batches(df.select(F.col(text_col).cast("string").alias("text")), run, "n_tokens long", rows=4096)


def histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs: how many documents have each length. Lengths are counted in each task before the shuffle."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L that occurs: documents and tokens at or above it, below it, and what remains if every document is cut at L.

    share_below is the part of documents shorter than L, so L is the q-quantile (the least length
    that at least a part q of documents does not exceed) for share_below < q <= share_up_to.
    An empty histogram gives no rows.
    """
    block = (F.col("n_tokens") / BLOCK).cast("long")
    rows = hist.withColumn("block", block).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    blocks = sums.select(
        "block",
        F.coalesce(F.sum("block_docs").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("block_tokens").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("block_docs").over(everything).alias("all_docs"),
        F.sum("block_tokens").over(everything).alias("all_tokens"),
    )
    docs = F.sum("n_docs").over(inside) + F.col("later_docs")
    tokens = F.sum("tokens").over(inside) + F.col("later_tokens")
    return (
        rows.join(blocks, "block")
        .withColumn("docs_at_least", docs)
        .withColumn("tokens_at_least", tokens)
        .select(
            "n_tokens",
            "n_docs",
            "docs_at_least",
            "tokens_at_least",
            (F.col("all_docs") - F.col("docs_at_least")).alias("docs_below"),
            (F.col("all_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias("tokens_if_cut"),
            (F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_up_to"),
            ((F.col("all_docs") - F.col("docs_at_least")) / F.col("all_docs")).alias("share_below"),
            ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("share_up_to"),
        )
    )


def totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents longer than it, their tokens, tokens that remain if cut and tokens lost."""
    over = F.col("n_tokens") > F.col("limit")
    length, n = F.col("n_tokens"), F.col("n_docs")
    each = hist.withColumn("limit", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])))
    return each.groupBy("limit").agg(
        F.sum(F.when(over, n).otherwise(0)).alias("docs_over"),
        F.sum(F.when(over, length * n).otherwise(0)).alias("tokens_over"),
        F.sum(F.least(length, F.col("limit")) * n).alias("tokens_if_cut"),
        F.sum(F.greatest(length - F.col("limit"), F.lit(0)) * n).alias("tokens_lost"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """For each share q in (0, 1]: the least length that at least that part of the documents does not exceed."""
    each = sums.withColumn("share", F.explode(F.array(*[F.lit(float(x)) for x in shares])))
    return each.where((F.col("share_below") < F.col("share")) & (F.col("share") <= F.col("share_up_to"))).select("share", "n_tokens")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    lengths = token_lengths(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return suffix_sums(cut(histogram(lengths)))
