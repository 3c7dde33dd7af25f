"""An inverted index for full-text search: posting lists by blocks of documents, in a table of their own.

A block is what one task met together, `BLOCK` documents of one scope (a tenant) at most. It has a row
with the ids of its documents, and for each term a row with the term's places in them (a place is the
number of the document in its block and the position there, in one integer) and the most that any
document has. So lists are bounded, an id is held once, a common term has a row for every block, and
indexing new documents adds rows without touching old ones. The table is dealt by a hash of the term
and sorted by term: a query reads the folders of its terms, and of those the row groups that hold them.

A search first reads how often each block's documents have the terms, which bounds the rank that a
document of the block may have. The blocks of the greatest bounds are ranked; all others whose bound
does not fall below the k-th rank found there follow. The result is that of a scan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from operator import add, and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import fulltext
from tidemark.operators.fulltext import Query

#: Documents and tokens of a block at most (a longer document is a block of its own), folders of terms, and blocks that are ranked first.
BLOCK, BLOCK_TOKENS, BUCKETS, FIRST = 4096, 1 << 20, 64, 8
#: Bits of a place that are the position. A document of more tokens is a block of its own, whose number is negative and whose places are positions.
POSITION = 19


def schema(id_kind: str) -> str:
    return f"scope string, bucket int, term string, block long, ids array<{id_kind}>, places array<int>, most int"


def bucket(term: Column) -> Column:
    """The folder of a term, as in `folder`."""
    return F.pmod(F.crc32(term.cast("binary")), F.lit(BUCKETS)).cast("int")


def folder(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def _lists(scope: str, ids: pa.Array, words: pa.Array, block: int, bits: int) -> pa.RecordBatch:
    """The rows of a block: its documents, then its posting lists."""
    sizes = np.diff(words.offsets.to_numpy())
    coded = words.flatten().dictionary_encode()
    term = coded.indices.to_numpy()
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    place = (doc << bits) + (np.arange(len(term), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes))
    order = np.argsort(term, kind="stable")  # places stay in order within a term
    term, doc, place = term[order], doc[order], place[order]
    new_term = np.append(True, term[1:] != term[:-1])
    new_doc = new_term | np.append(True, doc[1:] != doc[:-1])
    at, at_doc = np.flatnonzero(new_term), np.flatnonzero(new_doc)
    most = np.maximum.reduceat(np.diff(np.append(at_doc, len(term))), np.flatnonzero(new_term[new_doc]))
    n = len(at)
    terms = pa.concat_arrays([pa.array([""]), coded.dictionary.take(pa.array(term[at])).cast(pa.string())])
    of_docs = pa.ListArray.from_arrays(pa.array([0, *[len(ids)] * (n + 1)], pa.int32(), mask=np.array([False, *[True] * n, False])), ids)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], at, [len(term)])).astype(np.int32), mask=np.array([True, *[False] * (n + 1)])), pa.array(place))
    counts = pa.array(np.append(len(ids), most).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array([scope] * (n + 1), pa.string()), terms, pa.array([block] * (n + 1), pa.int64()), of_docs, lists, counts], ["scope", "term", "block", "ids", "places", "most"])


def postings(rows: DataFrame, *, id_col: str, text_col: str = "text", scope_col: str | None = None, segment: int = 0) -> DataFrame:
    """The posting lists of documents; those without a word have none. Rows whose ids repeat are taken for one document's.

    `segment` tells the blocks of one call from those of another; should two blocks meet all the same,
    their documents are merely ranked together. No shuffle: a task's documents make its blocks. Words
    come to Python joined by spaces and are cut again block by block, so that a worker never has those
    of a whole batch one by one.
    """
    scope = F.col(scope_col).cast("string") if scope_col else F.lit(None).cast("string")
    kind = rows.schema[id_col].dataType.simpleString()
    words = rows.select(scope.alias("scope"), F.col(id_col).alias("id"), F.array_join(fulltext.tokens(F.col(text_col)), " ").alias("words"))
    if scope_col:
        words = words.sortWithinPartitions("scope")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (segment << 44) | (TaskContext.get().partitionId() << 24)
        n = 0
        for batch in batches:
            if not pc.all(pc.not_equal(batch.column(2), "")).as_py():
                batch = batch.filter(pc.not_equal(batch.column(2), ""))
            scopes = batch.column(0).dictionary_encode(null_encoding="encode")
            each, at = scopes.indices.to_numpy(), 0
            tokens = pc.count_substring(batch.column(2), " ").to_numpy() + 1
            while at < batch.num_rows:
                same = np.flatnonzero(each[at:] != each[at])
                end = min(at + BLOCK, at + int(same[0]) if len(same) else batch.num_rows)
                wide = np.flatnonzero(tokens[at:end] >= 1 << POSITION)
                end = at + max(1, min(int(np.searchsorted(np.cumsum(tokens[at:end]), BLOCK_TOKENS, side="right")), int(wide[0]) if len(wide) else end))
                part = batch.slice(at, end - at)
                number = first + n
                yield _lists(part.column(0)[0].as_py(), part.column(1), pc.split_pattern(part.column(2), " "), -1 - number if len(wide) and not wide[0] else number, POSITION)
                at, n = end, n + 1
                pa.default_memory_pool().release_unused()

    found = words.mapInArrow(run, f"scope string, term string, block long, ids array<{kind}>, places array<int>, most int")
    return found.select("scope", F.when(F.col("term") == "", BUCKETS).otherwise(bucket(F.col("term"))).alias("bucket"), "term", "block", "ids", "places", "most")


def dealt(lists: DataFrame, files: int = 4) -> DataFrame:
    """Posting lists as they are to be written: each folder in at most so many files, by block, so that no common term is one task's; sorted by term."""
    return lists.repartition(F.col("bucket"), F.pmod(F.col("block"), F.lit(files))).sortWithinPartitions("bucket", "term", "block")


def words_of(query: Query) -> list[str]:
    return list(dict.fromkeys(w for alternative in query.alternatives for phrase, _ in alternative for w in phrase))


def lists_of(index: DataFrame, query: Query, scope: str | None = None) -> DataFrame:
    """The posting lists of a query's words, of one scope if given."""
    words = words_of(query)
    if not words:
        return index.limit(0)
    mine = index.where(F.col("bucket").isin(sorted({folder(w) for w in words})) & F.col("term").isin(words))
    return mine if scope is None else mine.where(F.col("scope") == scope)


def bounds(lists: DataFrame, query: Query) -> DataFrame:
    """block, bound: at most so great a rank has any document of the block; blocks where nothing can match are left out.

    Each place of a phrase completes one cover at most; while one place of the rarest phrase is the last
    seen, each phrase can begin one cover at most; no cover is shorter than its longest phrase or than
    the number of its different words; and a phrase is no more frequent than its rarest word.
    """
    words = words_of(query)
    most = {w: f"m{i}" for i, w in enumerate(words)}
    each = lists.groupBy("block").agg(*[F.max(F.when(F.col("term") == w, F.col("most"))).alias(c) for w, c in most.items()])
    parts = []
    for alternative in query.alternatives:
        wanted = list(dict.fromkeys(p for p, w in alternative if w))
        short = max(max(map(len, wanted)), len({w for p in wanted for w in p}))
        there = reduce(and_, [F.col(most[w]).isNotNull() for p in wanted for w in p])
        counts = [F.least(F.col(most[p[0]]), *[F.col(most[w]) for w in p]) for p in wanted]
        covers = F.least(reduce(add, counts), F.least(counts[0], *counts) * len(counts))
        parts.append(F.when(there, covers * (1.0 / short)).otherwise(0.0))
    return each.select("block", reduce(add, parts).alias("bound")).where("bound > 0")


def doc_of(place: str) -> Column:
    """The number of a place's document in its block."""
    return F.when(F.col("block") < 0, F.lit(0)).otherwise(F.shiftright(place, POSITION))


def documents(index: DataFrame) -> DataFrame:
    """block, doc, id of all documents that have words."""
    return index.where(F.col("bucket") == BUCKETS).select("block", F.posexplode("ids").alias("doc", "id"))


def ranked(lists: DataFrame, query: Query, rank: bool = True) -> DataFrame:
    """block, doc, rank of the documents of these lists that match; the lists of a block meet in one task."""
    words = words_of(query)
    place = {w: f"p{i}" for i, w in enumerate(words)}
    blocks = lists.repartition("block").groupBy("block").agg(*[F.max(F.when(F.col("term") == w, F.col("places"))).alias(c) for w, c in place.items()])

    def starts(phrase: tuple[str, ...]) -> Column:
        """Places where a phrase begins; positions of two documents are never neighbours."""
        at = [F.transform(F.col(place[w]), _back(i)) if i else F.col(place[w]) for i, w in enumerate(phrase)]
        return F.coalesce(reduce(F.array_intersect, at), F.array().cast("array<int>"))

    phrases = list(dict.fromkeys(p for alternative in query.alternatives for p, _ in alternative))
    marks = F.flatten(F.array(*[F.transform(starts(p), _of(i)) for i, p in enumerate(phrases)]))
    each = blocks.select("block", F.explode(marks).alias("m")).select("block", "m.phrase", doc_of("m.place").alias("doc"), F.when(F.col("block") < 0, F.col("m.place")).otherwise(F.col("m.place") % (1 << POSITION)).alias("at"))
    names = {p: f"s{i}" for i, p in enumerate(phrases)}
    docs = each.groupBy("block", "doc").agg(*[F.array_sort(F.collect_list(F.when(F.col("phrase") == i, F.col("at")))).alias(c) for i, c in enumerate(names.values())])
    found = docs.where(fulltext.fits(query, lambda p: F.size(names[p]) > 0))
    return found.select("block", "doc", (fulltext.cover_density(query, lambda p: F.col(names[p])) if rank else F.lit(0.0)).alias("rank"))


def _back(i: int):
    return lambda x: x - i


def _of(phrase: int):
    return lambda x: F.struct(F.lit(phrase).alias("phrase"), x.alias("place"))


def matching(index: DataFrame, query: str, scope: str | None = None) -> DataFrame:
    """The ids of all documents that match."""
    asked = fulltext.parsed(query)
    if not asked.alternatives:
        return documents(index).select("id").limit(0)
    return ranked(lists_of(index, asked, scope), asked, rank=False).join(documents(index), ["block", "doc"]).select("id")


def search(index: DataFrame, query: str, k: int, *, scope: str | None = None, live: DataFrame | None = None, first: int = FIRST) -> DataFrame:
    """id, rank of the k documents of greatest rank, ties by id; of `live` (id) only, if given.

    Lists of documents that are gone do no harm with `live`: their blocks are bounded too high, not too low.
    """
    asked = fulltext.parsed(query)
    if not asked.alternatives:
        return documents(index).select("id", F.lit(0.0).alias("rank")).limit(0)
    lists = lists_of(index, asked, scope)
    blocks = bounds(lists, asked)

    def best(of: DataFrame) -> DataFrame:
        rows = ranked(lists.join(of.select("block"), "block", "left_semi"), asked).join(documents(index), ["block", "doc"]).select("id", "rank")
        rows = rows if live is None else rows.join(live, "id", "left_semi")
        return rows.orderBy(F.desc("rank"), "id").limit(k)

    least = [r["rank"] for r in best(F.broadcast(blocks.orderBy(F.desc("bound"), "block").limit(first))).select("rank").collect()]  # k numbers
    enough = min(least) * (1 - 1e-9) if len(least) == k and k else 0.0
    return best(blocks.where(F.col("bound") >= enough))


def without(index: DataFrame, live: DataFrame) -> DataFrame:
    """The lists of live documents (id) alone, for when many are gone. The numbers of documents in their blocks stay."""
    there = documents(index).join(live, "id", "left_semi").select("block", "doc")
    of_docs = index.where(F.col("bucket") == BUCKETS).join(there.select("block").distinct(), "block", "left_semi")
    each = index.where(F.col("bucket") < BUCKETS).select("scope", "bucket", "term", "block", F.explode("places").alias("place"))
    kept = each.withColumn("doc", doc_of("place")).join(there, ["block", "doc"], "left_semi")
    lists = kept.groupBy("scope", "bucket", "term", "block", "doc").agg(F.collect_list("place").alias("places"))
    lists = lists.groupBy("scope", "bucket", "term", "block").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"), F.max(F.size("places")).alias("most"))
    return of_docs.select(*index.columns).unionByName(lists, allowMissingColumns=True)
