"""Mixing sources to target weights: Efraimidis-Spirakis sampling to token budgets.

Every source has a target number of words. As many complete epochs as fit come first; for the rest,
documents follow in the order of exponential keys, `-ln(u) / quality`, whose prefix sums run up to
the budget (Efraimidis and Spirakis 2006: the first of such an order are a weighted sample without
replacement). u is a hash of seed, id and text, so a rerun draws the same documents.

No source is ever sorted as a whole. A monotone function of the key deals each source into buckets
of about `BUCKET` rows, sums over buckets find the one in which the budget ends, and only its rows
are put in order. What a document needs to know is then a bucket and a key of its source, so the
decision is a join with a table of sources, and texts are never shuffled. DataFrame operations only.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, n_words, small, table

SEED = "mix-1"
BUCKET = 4096
#: The least quality weight; a document of no symbols has 1.
LEAST_WEIGHT = 0.25
#: Weights of the sources in order, repeating.
CYCLE = (1, 2, 3)
#: No source is taken more often than so many times.
EPOCHS = 3


def quality_weight(text: Column) -> Column:
    """1 less four times the share of symbols `#*$%&|<>!`, at least LEAST_WEIGHT; 1 for a null or empty text."""
    plain = F.length(F.translate(text, "#*$%&|<>!", ""))
    share = 1 - plain.cast("double") / F.nullif(F.length(text), F.lit(0))
    return F.coalesce(F.greatest(F.lit(LEAST_WEIGHT), 1 - 4 * share), F.lit(1.0))


def exponential_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of a hash; the least keys come first."""
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.ln(u) / quality_weight(text)


def in_order(sources: DataFrame) -> DataFrame:
    """Adds `rank`, from 0, by code point with null last; ranges of sources are counted side by side."""
    dealt = cut(sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    here = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source"))
    return dealt.join(offsets, "part").withColumn("rank", here - 1 + F.col("before")).drop("part", "before")


def targets(sources: DataFrame, cycle: tuple[int, ...] = CYCLE, most: int = EPOCHS) -> DataFrame:
    """Adds `weight` and `target` to source, source_size, rows.

    The words of all sources are shared by weight; a share stops at `most` times its source's size
    and the excess goes to the others by weight until none is above. Each round is one sum over the
    sources, in exact integers.
    """
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.col("rank") % len(cycle) + 1).cast("int")).cast("long")
    ranked = cut(in_order(sources).withColumn("weight", weight))
    big = "decimal(38,0)"
    limit = (F.col("source_size") * most).cast(big)
    total = ranked.agg(F.sum(F.col("source_size").cast(big))).first()[0] or 0
    above, count = F.lit(False), -1
    num, den = int(total), 1
    while True:
        capped, weights, n = ranked.agg(F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, 1))).first()
        if n == count or not weights:
            break
        count, num, den = n, int(total) - int(capped or 0), int(weights)
        above = limit * F.lit(Decimal(den)).cast("decimal(19,0)") < F.col("weight").cast("decimal(10,0)") * F.lit(Decimal(num)).cast("decimal(28,0)")
    share = F.col("weight").cast("double") * F.lit(float(num)) / F.lit(float(den))
    return ranked.withColumn("target", F.when(above, limit.cast("double")).otherwise(share))


def plan(keyed: DataFrame) -> DataFrame:
    """For each source of (source, size, key): size, target, epochs, and the bucket and key up to which the rest is taken."""
    sources = keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    per = cut(
        targets(sources)
        .withColumn("epochs", epochs)
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("buckets", F.ceil(F.col("rows") / BUCKET))
        .select("source", "source_size", "target", "epochs", "rest", "buckets")
    )
    dealt = keyed.join(small(per).withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).withColumn("bucket", bucket())
    sums = dealt.groupBy("of", "bucket", "rest").agg(F.sum("size").alias("size"))
    before = F.sum("size").over(Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    ends = sums.withColumn("before", F.coalesce(before, F.lit(0))).where("before <= rest and rest < before + size").select(F.col("of").alias("end_of"), F.col("bucket").alias("end_bucket"), "before")
    last = dealt.join(ends, F.col("of").eqNullSafe(F.col("end_of")) & (F.col("bucket") == F.col("end_bucket")))
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("of").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    taken = last.withColumn("upto", upto).withColumn("nearer", (F.col("upto") <= F.col("rest")) | (F.col("upto") - F.col("rest") <= F.col("rest") - (F.col("upto") - F.col("size"))))
    marks = taken.groupBy("end_of", "end_bucket").agg(F.max(F.when(F.col("nearer"), F.col("key"))).alias("end_key"))
    return cut(per.join(marks, F.col("source").eqNullSafe(F.col("end_of")), "left").drop("end_of", "rest"))


def bucket() -> Column:
    """Grows with the key; of equal weight, keys fall into buckets about evenly."""
    return F.floor((1 - F.exp(-F.col("key") * LEAST_WEIGHT)) * F.col("buckets"))


def copies(keyed: DataFrame, planned: DataFrame) -> DataFrame:
    """Adds source_size, target and `copies`, how often the mix takes the row, to rows with source, size and key."""
    per = small(planned).withColumnRenamed("source", "of")
    within = (F.col("size") > 0) & ((bucket() < F.col("end_bucket")) | ((bucket() == F.col("end_bucket")) & (F.col("key") <= F.col("end_key"))))
    joined = keyed.join(per, F.col("source").eqNullSafe(F.col("of")))
    return joined.withColumn("copies", F.col("epochs") + F.when(within, 1).otherwise(0)).drop("of", "epochs", "buckets", "end_bucket", "end_key")


def key_rows(docs: DataFrame, *extra: Column) -> DataFrame:
    """source, size, key of each document, with further columns."""
    text = F.col("text").cast("string")
    return docs.select(*extra, F.col("source").cast("string").alias("source"), n_words(text).alias("size"), exponential_key(F.col("doc_id"), text).alias("key"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its columns as they were.

    A document of no words is kept as often as its source is complete. Equal rows are taken alike.
    The columns doc_id, source and text are read; others pass through, whatever their names.
    """
    planned = plan(cut(key_rows(docs)))
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    chosen = copies(key_rows(docs, row), planned).where("copies > 0")
    return chosen.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(*[F.col("row")[c].alias(c) for c in names])


def mixed(docs: DataFrame) -> DataFrame:
    """One row for each document: its size, its source's size and target, and the words that the mix takes of it.

    A null or empty text has size 0; a null source is one of its own, the last. Equal rows are taken
    alike, ids may be null or repeat. No rows give no rows; other columns are not read.
    """
    keyed = cut(key_rows(docs, F.col("doc_id").cast("long").alias("doc_id")))
    return copies(keyed, plan(keyed)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


#: Rounds of sharing end when no further source is above; sorted by size over weight, the capped ones come first.
OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / coalesce(greatest(0.25::DOUBLE, 1 - 4 * (1 - length(translate(text, '#*$%&|<>!', ''))::DOUBLE / nullif(length(text), 0))), 1.0::DOUBLE) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (
  SELECT *, sum(s) OVER () AS total, sum(w) OVER () AS weights,
    coalesce(sum(3 * s) OVER (ORDER BY s::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    coalesce(sum(w) OVER (ORDER BY s::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_w
  FROM s),
b AS (SELECT (total - capped)::DOUBLE AS num, (weights - capped_w)::DOUBLE AS den FROM o
  WHERE (total - capped) * w <= 3 * s * (weights - capped_w) ORDER BY capped_w LIMIT 1),
t AS (SELECT source, s AS source_size, CASE WHEN 3 * s * den < w * num THEN (3 * s)::DOUBLE ELSE w::DOUBLE * num / den END AS target FROM o, b),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
r AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest, d.key, d.source,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
k AS (SELECT *, max(CASE WHEN source_size > 0 AND (upto <= rest OR upto - rest <= rest - (upto - size)) THEN key END) OVER (PARTITION BY source) AS last FROM r)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN key <= last THEN 1 ELSE 0 END))::BIGINT AS taken FROM k
"""
