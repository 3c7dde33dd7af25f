"""Contents as numbered segments, each with its hash, under the root of a Merkle tree.

A range opens the segments that it touches. Segments are verified one by one, wherever they lie; the
root, a hash of the pairs of hashes, of their pairs, and so on, tells that none is missing or in
another place. A hash without a partner goes up a level as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import keys
from tidemark.sources import files

#: Bytes of a segment: those of a read at most, so that a read touches two.
SEGMENT = files.CONTENT_BYTES
#: Levels of pairs, enough for 2^20 segments.
LEVELS = 20


def pairwise(items: Column, join: Callable[[Column, Column], Column]) -> Column:
    """All items of a non-empty array joined by pairs, then pairs of pairs, so that each is copied once for a level."""

    def level(now: Column, _: Column) -> Column:
        def pair(i: Column) -> Column:
            left, right = F.get(now, 2 * i), F.get(now, 2 * i + 1)
            return F.when(right.isNotNull(), join(left, right)).otherwise(left)

        return F.when(F.size(now) > 1, F.transform(F.sequence(F.lit(0), F.floor((F.size(now) - 1) / 2).cast("int")), pair)).otherwise(now)

    return F.get(F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), items, level), F.lit(0))


def _cut(content: Column, size: int, make: Callable[[Column], Column]) -> Column:
    """What `make` makes of each segment of a content, in order."""
    last = F.floor(F.greatest(F.lit(0), F.length(content) - 1) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: make(F.substring(content, i * size + 1, F.lit(size))))


def divided(rows: DataFrame, *, content_col: str = "content", size: int = SEGMENT) -> DataFrame:
    """The rows with `segment` and `segment_sha256`, once for each segment of their content; an empty or null content is one empty segment."""
    pieces = _cut(F.coalesce(F.col(content_col), F.lit(b"")), size, lambda piece: piece)
    others = [c for c in rows.columns if c != content_col]
    each = rows.select(*others, F.posexplode(pieces).alias("segment", content_col))
    return each.withColumn("segment_sha256", keys.sha256(F.col(content_col)))


def joined(segments: DataFrame, by: list[str], *, content_col: str = "content") -> DataFrame:
    """by, content: the segments that there are, put together in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("segment", F.col(content_col).alias("part")))), lambda x: x["part"])
    return segments.groupBy(*by).agg(pairwise(parts, lambda a, b: F.concat(a, b)).alias(content_col))


def _root(hashes: Column) -> Column:
    return pairwise(hashes, lambda a, b: F.sha2(F.concat(a, b), 256))


def manifest_of(rows: DataFrame, by: list[str], *, content_col: str = "content", size: int = SEGMENT) -> DataFrame:
    """What `manifest` says of the segments of contents, before they are divided: row by row, without a shuffle."""
    content = F.coalesce(F.col(content_col), F.lit(b""))
    each = rows.select(*by, F.length(content).cast("long").alias("size_bytes"), _cut(content, size, keys.sha256).alias("_hashes"))
    return each.select(*by, F.size("_hashes").cast("long").alias("n_segments"), "size_bytes", _root(F.col("_hashes")).alias("root"))


def manifest(segments: DataFrame, by: list[str], *, content_col: str = "content") -> DataFrame:
    """by, n_segments, size_bytes, root: what segments of a content there should be."""
    hashes = F.transform(F.array_sort(F.collect_list(F.struct("segment", "segment_sha256"))), lambda x: x["segment_sha256"])
    return segments.groupBy(*by).agg(F.count(F.lit(1)).alias("n_segments"), F.sum(F.length(content_col)).alias("size_bytes"), _root(hashes).alias("root"))


def damaged(segments: DataFrame, expected: DataFrame, by: list[str], *, content_col: str = "content") -> DataFrame:
    """by, segment, problem for each segment whose bytes have another hash (`changed`), and with a null segment for each content whose segments don't make up its root (`incomplete`)."""
    seen = segments.withColumn("_ok", keys.sha256(F.col(content_col)) == F.col("segment_sha256"))
    changed = seen.where(~F.coalesce("_ok", F.lit(False))).select(*by, "segment", F.lit("changed").alias("problem"))
    now = manifest(segments, by, content_col=content_col).select(*by, F.col("root").alias("_root"), F.col("n_segments").alias("_n"))
    met = expected.join(now, by, "left").where(~(F.col("root").eqNullSafe(F.col("_root")) & F.col("n_segments").eqNullSafe(F.col("_n"))))
    return changed.unionByName(met.select(*by, F.lit(None).cast("int").alias("segment"), F.lit("incomplete").alias("problem")))


def touched(offset: int, requested: int, size: int = SEGMENT) -> tuple[int, int]:
    """The first and the last segment of a range."""
    return offset // size, (offset + max(1, requested) - 1) // size


def byte_range(segments: DataFrame, by: list[str], offset: int, requested: int, *, total_col: str = "size_bytes", content_col: str = "content", size: int = SEGMENT, most: int = files.CONTENT_BYTES) -> DataFrame:
    """by, payload (base64), next_offset, eof of at most min(requested, most) bytes of each content from an offset.

    Every content has its first segment read, for its length (`total_col`) where the range lies beyond
    its end, and those that the range touches; no others.
    """
    if offset < 0 or requested < 1:
        raise ValueError("a range begins at 0 or later and has a byte at least")
    n = min(requested, most, files.CONTENT_HARD)
    first, last = touched(offset, n, size)
    near = F.col("segment").between(first, last)
    some = segments.where(near | (F.col("segment") == 0))
    parts = F.transform(F.array_sort(F.collect_list(F.when(near, F.struct("segment", F.col(content_col).alias("part"))))), lambda x: x["part"])
    read = some.groupBy(*by).agg(F.max(total_col).alias("_total"), parts.alias("_parts"))
    whole = F.when(F.size("_parts") > 0, pairwise(F.col("_parts"), lambda a, b: F.concat(a, b))).otherwise(F.lit(b""))
    part = F.substring(whole, offset - first * size + 1, n)
    cut = read.select(*by, "_total", part.alias("_part"))
    return cut.select(*by, F.regexp_replace(F.base64("_part"), r"\s", "").alias("payload"), (F.lit(offset).cast("long") + F.length("_part")).alias("next_offset"), (F.col("_total") - offset <= n).alias("eof"))
