"""N-gram Jaccard join: MinHash banding, verified on full n-gram sets.

Texts are sets of word 5-grams. Each distinct text gets MinHash values in bands; band and row counts
follow from the similarity and the recall asked for. Texts that share a band meet in that band's
bucket (or, if they are many, in pairs of its blocks), where their MinHash values are counted against
each other: only texts with as many equal ones as a similar pair has, but for a chance of `MISSED`, go
on together, so that texts which merely share a band by chance or by some common phrase do not chain.
What a bucket yields is an edge for each text, not pairs. The components of these edges are verified
as wholes: their n-gram sets meet in one task, or in one for each pair of blocks of bounded size, where
a product of incidence matrices yields all intersections exactly. What leaves a task is a row for each
text: its number of links and the class that the links form. No pair is ever a row, copies are
verified once, and equal texts are one node from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, small_batches, table, whole_groups
from tidemark.llm.graph import components

WORDS = 5
#: Similarity as a ratio of integers, so that its test is exact.
SIMILARITY = (4, 5)
#: Part of the pairs at just that similarity that share a band, and the part of them whose MinHash values agree too seldom.
RECALL, MISSED = 0.9999, 1e-6
#: MinHash values at most.
MOST_HASHES = 128
#: A block of a bucket holds about so many texts.
BUCKET_TEXTS = 4096
#: A block of a component holds about so many texts and bytes of n-gram sets.
BLOCK_TEXTS, BLOCK_BYTES = 512, 8 << 20
#: The side of texts in a group of one block, and in one that is a whole component.
WITHIN, WHOLE = 2, 3
#: Places of a sieve for each of its keys, most places (32 MB, which hold 1.7 * 10**7 keys so; with more it lets more pass), and bits of one part.
SIEVE, MOST_PLACES, BITMAP = 16, 1 << 28, 32768
#: Columns of an incidence matrix at once.
COLUMNS = 4096


def bands_and_rows(similarity: float, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """The longest bands that reach the recall with at most that many hashes; longer ones have fewer false candidates."""
    found = (1, math.ceil(math.log(1 - recall) / math.log(1 - similarity))) if similarity < 1 else (1, 1)
    rows = 1
    while rows <= most:
        hit = similarity**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows <= most:
            found = (rows, bands)
        rows += 1
    return found[1], found[0]


class _Hashes(dict):
    """64-bit hash of each word, the same in every process."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) > 100_000:
            self.clear()
        self[word] = value
        return value


_hashes = _Hashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatters 64 bits (the finaliser of MurmurHash3)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The set of word n-grams as sorted 64-bit hashes. A shorter text with a word is one n-gram; one without has none."""
    found = text.encode().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    width = min(words, len(found))
    n = len(found) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return np.unique(out)


@lru_cache(1)
def drawn(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of n hash functions, the same in every process."""
    draw = np.random.default_rng(20240229)
    return draw.integers(0, 1 << 31, (n, 1), np.uint32) * np.uint32(2) + np.uint32(1), draw.integers(0, 1 << 32, (n, 1), np.uint32)


def min_hashes(grams: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values of 32 bits."""
    a, b = drawn(n)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(n, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 512):
        least = np.minimum(least, (a * x[at : at + 512] + b).min(1))
    return least


def band_hashes(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band of MinHash values; a band's number is part of it."""
    out = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + least.reshape(bands, rows)[:, k])
    return out


def least_equal(n: int, similarity: float, missed: float = MISSED) -> int:
    """How many of n MinHash values a similar pair has in common, but for that chance."""
    below = 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * similarity**k * (1 - similarity) ** (n - k)
        if below > missed:
            return k
    return n


def text_key(text: Column) -> Column:
    """128 bits by which equal texts are known; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def signatures(docs: DataFrame) -> DataFrame:
    """id, key, n_grams, bands and signature (a byte of each MinHash value) of each document."""
    bands, rows = bands_and_rows(SIMILARITY[0] / SIMILARITY[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sizes, lists, marks = [], [], []
            for text in batch.column("text"):
                grams = shingles(text.as_py())
                least = min_hashes(grams, bands * rows) if len(grams) else None
                sizes.append(len(grams))
                lists.append(None if least is None else band_hashes(least, bands, rows).view(np.int64))
                marks.append(None if least is None else least.astype(np.uint8).tobytes())
            columns = [batch.column("id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(pa.int64())), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "key", "n_grams", "bands", "signature"])

    columns = docs.select(F.col("doc_id").cast("long").alias("id"), text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(run, "id long, key binary, n_grams long, bands array<long>, signature binary")


def alike(signatures: np.ndarray, least: int) -> np.ndarray:
    """For each row the first row that it is connected with, rows with `least` equal bytes or more being connected."""
    root = np.arange(len(signatures))
    rest = root.copy()
    while len(rest):
        first, rest = rest[0], rest[1:]
        reached = [first]
        while reached and len(rest):
            near = (signatures[rest] == signatures[reached.pop()]).sum(1) >= least
            root[rest[near]] = first
            reached += rest[near].tolist()
            rest = rest[~near]
    return root


def connected(groups: DataFrame) -> DataFrame:
    """a, b: each text of a group (group, key, signature) that is like another there, with the first one it is connected with."""
    bands, rows = bands_and_rows(SIMILARITY[0] / SIMILARITY[1])
    similarity = SIMILARITY[0] / SIMILARITY[1]
    least = least_equal(bands * rows, similarity + (1 - similarity) / 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, 0, BUCKET_TEXTS):
            group = batch.column("group").to_numpy()
            keys = batch.column("key")
            marks = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(-1, bands * rows)
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            sizes = np.diff(np.append(starts, len(group)))
            root = np.repeat(starts, sizes)
            near = (marks == marks[root]).sum(1) >= least
            # where all are like the first there is no more to know, nor in a pair
            for i in np.flatnonzero((sizes > 2) & (np.add.reduceat(near, starts) < sizes)).tolist():
                part = slice(starts[i], starts[i] + sizes[i])
                root[part] = starts[i] + alike(marks[part], least)
                near[part] = True
            found = np.flatnonzero(near & (root != np.arange(len(root))))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(found)), keys.take(pa.array(root[found]))], ["a", "b"])

    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.select("group", "key", "signature").repartition(n, "group").sortWithinPartitions("group").mapInArrow(run, "a binary, b binary")


def candidates(texts: DataFrame) -> DataFrame:
    """a, b: edges between texts that share a band and look similar by their signatures; each text has one at most for each of its buckets and blocks."""
    banded = texts.select("key", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", F.ceil(F.col("n") / BUCKET_TEXTS).cast("int").alias("blocks"))
    rows = banded.join(shared.hint("merge"), "band").join(texts.select("key", "signature").hint("merge"), "key")
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    dealt = rows.select("key", "signature", "band", "blocks", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    group = F.when(F.col("blocks") == 1, F.col("band")).otherwise(F.xxhash64("band", F.least("block", "other"), F.greatest("block", "other")))
    return connected(dealt.withColumn("group", group))


def sieve(keys: DataFrame, *columns: str) -> tuple[Column, int]:
    """A bit for each place, set where a key falls, as one array that its size bounds; and the number of places, which follows that of the keys."""
    places = min(MOST_PLACES, max(BITMAP, 1 << (max(1, keys.count()) * SIEVE - 1).bit_length()))
    place = F.pmod(F.xxhash64(*columns), F.lit(places))
    bitmaps = keys.groupBy(F.floor(place / BITMAP).cast("int").alias("part")).agg(F.bitmap_construct_agg(place % BITMAP).alias("bits"))
    parts = keys.sparkSession.range(places // BITMAP).select(F.col("id").cast("int").alias("part"))
    every = parts.join(bitmaps, "part", "left").select("part", F.coalesce("bits", F.unhex(F.repeat(F.lit("00"), F.lit(BITMAP // 8)))).alias("bits"))
    one = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "bits"))), lambda x: x["bits"]).alias("sieve"))
    return cut(one).scalar(), places


def passes(held: tuple[Column, int], *key: Column) -> Column:
    """False only for keys that a sieve does not hold."""
    bits, places = held
    place = F.pmod(F.xxhash64(*key), F.lit(places))
    part = F.element_at(bits, (F.floor(place / BITMAP) + 1).cast("int"))
    byte = F.conv(F.hex(F.substring(part, (F.floor(place % BITMAP / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, (place % 8).cast("int")) == 1


def linked(sets: list[np.ndarray], side: np.ndarray) -> np.ndarray:
    """Matrix of the pairs whose similarity is at least SIMILARITY; if there are two sides, of pairs between them only."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.flatnonzero(times > 1)
    number = np.full(len(times), -1)
    number[common] = np.arange(len(common))
    column = number[column]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    inter = np.zeros((m, m))
    for at in range(0, len(common), COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        part = np.zeros((m, min(COLUMNS, len(common) - at)), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        inter += part @ part.T
    union = sizes[:, None] + sizes[None, :] - inter
    found = SIMILARITY[1] * inter >= SIMILARITY[0] * union
    np.fill_diagonal(found, False)
    if (side < WITHIN).any():
        found &= side[:, None] != side[None, :]
    return found


def least_reached(found: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each node the node of least `order` that its links lead to."""
    best = order.copy()
    while True:
        reach = np.minimum(best, np.where(found, best[None, :], len(order)).min(1, initial=len(order)))
        reach = reach[np.argsort(order)][reach]  # what the node found so far has found itself
        reach = np.minimum(best, reach)
        if (reach == best).all():
            return best
        best = reach


VERIFIED = "key binary, links long, root binary, whole boolean"


def verified(groups: DataFrame) -> DataFrame:
    """key, links, root, whole for each text of a group (group, side, key, copies, grams) that has a link there; links count documents.

    A group is a component (side WHOLE), one block of it (WITHIN) or a pair of its blocks (sides 0 and 1),
    of which one may be empty: then it has no links.
    """

    def one(rows: list[tuple]) -> list[tuple[bytes, int, bytes, bool]]:
        rows = list({(r[0], r[1]): r for r in rows}.values())
        keys = [r[1] for r in rows]
        side = np.array([r[0] for r in rows])
        if side[0] < WITHIN and (side == side[0]).all():
            return []
        found = linked([np.frombuffer(r[3], np.uint64) for r in rows], side)
        order = np.argsort(np.argsort(np.array([k.hex() for k in keys])))
        back = np.argsort(order)
        links = found @ np.array([r[2] for r in rows], np.float64)
        roots = back[least_reached(found, order)]
        return [(keys[i], int(links[i]), keys[roots[i]], bool(side[i] == WHOLE)) for i in np.flatnonzero(found.any(1)).tolist()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", "links", "root", "whole"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, out = None, [], []
        for batch in small_batches(batches):
            columns = [c.to_pylist() for c in batch.columns]
            for g, *row in zip(*columns, strict=True):
                if g != group:
                    if len(rows) > 1:
                        out += one(rows)
                    group, rows = g, []
                rows.append(tuple(row))
            if len(out) > 1000:
                yield packed(out)
                out = []
        if len(rows) > 1:
            out += one(rows)
        yield packed(out)

    dealt = groups.select("group", "side", "key", "copies", "grams")
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "group").sortWithinPartitions("group").mapInArrow(run, VERIFIED)


def gram_sets(rows: DataFrame) -> DataFrame:
    """Replaces `text`, the last column, by `grams`, its n-gram set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets = pa.array([shingles(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sets], [*batch.schema.names[:-1], "grams"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}, grams binary")


def linked_texts(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """key, links, root of the texts that have links to others, each once."""
    parts = components(candidates(texts))
    members = cut(texts.join(parts.withColumnRenamed("node", "key"), "key").select("key", "id", "copies", "n_grams", "root"))
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("n_grams") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    placed = members.join(sizes, "root").select("key", "id", "copies", "root", "blocks", block.alias("block"))
    text = docs.select(text_key(F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = text.where(passes(sieve(members.select("key", "id"), "key", "id"), F.col("key"), F.col("doc_id")))
    of_member = placed.hint("merge").join(text, (placed["key"] == text["key"]) & placed["id"].eqNullSafe(text["doc_id"])).select(placed["key"], "copies", "root", "blocks", "block", "text")
    pairs = gram_sets(of_member).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.concat("root", F.encode(F.concat(F.lit(":"), F.least("block", "other"), F.lit(":"), F.greatest("block", "other")), "UTF-8"))
    side = F.when(F.col("blocks") == 1, WHOLE).when(F.col("block") == F.col("other"), WITHIN).when(F.col("block") < F.col("other"), 0).otherwise(1)
    found = cut(verified(pairs.withColumn("group", group).withColumn("side", side)))
    whole, of_blocks = found.where("whole").select("key", "links", "root"), found.where("not whole")
    if of_blocks.isEmpty():
        return whole
    joined = components(of_blocks.select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = of_blocks.groupBy("key").agg(F.sum("links").alias("links"))
    return whole.union(links.join(joined.withColumnRenamed("node", "key"), "key"))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents: id, key), (texts: key, id, copies, root, class_id, links), both stored; ids are the least of their texts and classes, roots tell classes apart."""
    signed = cut(signatures(docs))
    texts = cut(signed.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n_grams", "bands", "signature")]))
    found = cut(texts.select("key", "id", "copies").join(linked_texts(docs, texts), "key"))
    class_ids = found.groupBy("root").agg(F.min("id").alias("class_id"))
    of_text = found.join(class_ids, "root").select("key", "root", "class_id", "links")
    every = texts.select("key", "id", "copies").join(of_text, "key", "left").withColumn("root", F.coalesce("root", "key")).withColumn("class_id", F.coalesce("class_id", "id")).withColumn("links", F.coalesce("links", F.lit(0)))
    return signed.select("id", "key"), cut(every)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links of each document.

    Two documents are linked if their texts are equal or their sets of word 5-grams have a Jaccard
    similarity of at least 4/5; words are case-sensitive runs without ASCII white space. n_links
    counts the other documents linked to one. A class is what links connect, and its id the least
    doc_id in it. A text of fewer than five words is a single n-gram; texts without a word (null or
    empty) are linked only to equal ones. Ids may be null or repeat: every row is a document. No
    rows give no rows; the columns doc_id and text are read.
    """
    rows, texts = classes(docs)
    return rows.join(texts.select("key", "class_id", "copies", "links"), "key").select(F.col("id").alias("doc_id"), "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document of least doc_id of each class (of equal rows or ids in it, one), with its columns as they were.

    Classes are told apart by their texts, so ids may be null or repeat. What goes is decided on keys
    and ids alone. Documents stay where they are but for those that a sieve of the ones to go lets pass.
    """
    names = docs.columns
    rows, texts = classes(docs)
    best = texts.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("x")).select("x.key", F.lit(True).alias("best"))
    several = texts.where("copies > 1 or links > 0").select("key", F.col("id").alias("least")).join(best, "key", "left")
    stays = F.coalesce("best", F.lit(False)) & F.col("id").eqNullSafe(F.col("least"))
    fates = rows.join(several.hint("merge"), "key").groupBy("key", "id").agg(F.first(stays).alias("stays"), F.count(F.lit(1)).alias("n"))
    fates = cut(fates.where("not stays or n > 1").select("key", "id", "stays"))
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    keyed = docs.select(text_key(F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("id"), row)
    may_go = passes(sieve(fates, "key", "id"), F.col("key"), F.col("id"))

    def of(fates: DataFrame, how: str) -> DataFrame:
        mine = keyed.where(may_go).alias("a")
        return mine.join(fates.alias("b").hint("merge"), (F.col("a.key") == F.col("b.key")) & F.col("a.id").eqNullSafe(F.col("b.id")), how)

    out = keyed.where(~may_go).select("row").union(of(fates, "left_anti").select("row"))
    again = fates.where("stays")
    if not again.isEmpty():  # rows that have both text and id in common
        out = out.union(of(again, "left_semi").groupBy("key", "id").agg(F.first("row").alias("row")).select("row"))
    return out.select(*[F.col("row")[c].alias(c) for c in names])


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
