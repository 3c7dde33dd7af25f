"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b), root being the least node of its component.

    Large-star and small-star steps alternate until nothing changes (Kiveris et al. 2014): every
    step is a minimum for each node, combined before the shuffle, and a join with it, so no list of
    neighbours is ever gathered and the number of edges does not grow. Each round is written to the
    shared folder. Loops, repeated and reversed edges do no harm.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (mark := now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()) != before:
        before = mark
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
