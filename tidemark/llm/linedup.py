"""Line deduplication: documents probe compact arrays behind a minimal perfect hash.

A line's key is the line without white space at its ends, in lower case (A-Z). Keys are known by 128
bits of XXH3. Each document gives its distinct long keys once; those found in enough documents go
into an index, sharded by the leading bits of the hash: per shard a minimal perfect hash that numbers
the keys, and by that number a fingerprint (the half of the hash that does not choose the shard), the
count of documents and the document that keeps its lines. A probe is one look at each array. A line
that is not in the index meets some number's fingerprint with a chance of 2^-64.

Documents are never joined with lines. An index of at most `MOST_BYTES`, which is counted before, is
broadcast, and the pass over the texts probes it. A larger one is probed in groups of shards of at
most that size each: the hashes of the documents' lines are stored by group, each group is broadcast
to its own part of them, and what is found goes to the documents by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bits import Bits
from tidemark.llm.common import cut, fresh, map_batches, small_batches, table
from tidemark.llm.perfecthash import PerfectHash

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys of a shard on average, and bytes of the arrays that may be broadcast at once.
SHARD_KEYS = 1 << 16
MOST_BYTES = 32 << 20
#: Bytes of a key in the arrays: fingerprint, count, keeper, and its share of the bitvectors.
KEY_BYTES = 21

_SPACE = b" \t\n\v\f\r"


def _keys(raw: bytes, least: int) -> list[tuple[int, bytes]]:
    """Number of the line and digest of each line whose key has at least so many characters."""
    found = []
    for i, line in enumerate(raw.split(b"\n")):
        if len(line) >= least:
            key = line.strip(_SPACE).lower()
            if len(key) >= least and (key.isascii() or len(key.decode()) >= least):
                found.append((i, xxhash.xxh3_128_digest(key)))
    return found


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 0], both[:, 1]


def lines(docs: DataFrame, least: int) -> DataFrame:
    """id, high, low: each document's distinct keys of at least so many characters. Rows are id and text."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows, digests = [], []
            for i, text in enumerate(batch.column(1)):
                found = {d for _, d in _keys(text.as_buffer().to_pybytes(), least)} if text.is_valid else ()
                rows += [i] * len(found)
                digests += found
            high, low = _halves(digests)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(high.view(np.int64)), pa.array(low.view(np.int64))], ["id", "high", "low"])

    return docs.mapInArrow(run, f"id {kind}, high long, low long")


def repeated(of_docs: DataFrame, min_docs: int) -> DataFrame:
    """high, low, n, keeper of the keys in at least so many documents (distinct ids, null being one)."""
    return of_docs.distinct().groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)


class Shard:
    """The arrays of one shard, probed by many keys at once."""

    def __init__(self, row: dict):
        self.hash = PerfectHash(list(row["sizes"]), Bits(np.frombuffer(row["words"], "<u8")))
        self.prints, self.counts, self.keepers = np.frombuffer(row["prints"], np.uint64), np.frombuffer(row["counts"], np.int32), row["keepers"]

    def probe(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for one that is not in the index."""
        found = self.hash.number(high, low)
        return np.where((found >= 0) & (self.prints[found] == low), found, -1)


INDEX = "shard long, size long, sizes array<int>, words binary, prints binary, counts binary, keepers array<{}>"


def index(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """A row of arrays for each shard, and the number of leading bits that choose it.

    A shard's keys are hashes without repetition, so shards are even and no key is hot.
    """
    bits = max(0, (n_keys // SHARD_KEYS).bit_length())
    kind = keys.schema["keeper"].dataType.simpleString()

    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        high, low = (group[c].to_numpy().view(np.uint64) for c in ("high", "low"))
        hashed = PerfectHash.of(high, low)
        order = np.argsort(hashed.number(high, low))
        taken = group.take(pa.array(order))
        counts = np.minimum(taken["n"].to_numpy(), np.iinfo(np.int32).max).astype(np.int32)
        row = [group["shard"][0].as_py(), group.num_rows * KEY_BYTES, hashed.sizes, hashed.bits.words.tobytes(), low[order].tobytes(), counts.tobytes(), taken["keeper"].to_pylist()]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.list_(group["keeper"].type)]
        names = ["shard", "size", "sizes", "words", "prints", "counts", "keepers"]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

    return keys.withColumn("shard", shard_of(bits)).groupBy("shard").applyInArrow(build, INDEX.format(kind)), bits


def shard_of(bits: int) -> Column:
    """The leading bits of the hash."""
    return F.shiftrightunsigned(F.col("high"), 64 - bits) if bits else F.lit(0).cast("long")


class Probe:
    """Broadcast shards, opened once in each Python worker."""

    def __init__(self, spark: SparkSession, shards: list[dict], bits: int):
        shards = [row | {"keepers": pa.array(row["keepers"])} for row in shards]
        self.held, self.bits, self.open = spark.sparkContext.broadcast(shards), bits, None

    def __getstate__(self) -> dict:
        return {"held": self.held, "bits": self.bits, "open": None}

    def __call__(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, list]:
        """Whether each key is in the index, and the keepers of those that are, in order."""
        if self.open is None:
            self.open = {row["shard"]: Shard(row) for row in self.held.value}
        shard = (high >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(high), np.int64)
        there = np.zeros(len(high), bool)
        keepers: dict[int, object] = {}
        for s in np.unique(shard).tolist():
            if s in self.open:
                at = np.flatnonzero(shard == s)
                found = self.open[s].probe(high[at], low[at])
                hits = found >= 0
                there[at] = hits
                keepers |= zip(at[hits].tolist(), self.open[s].keepers.take(pa.array(found[hits])).to_pylist(), strict=True)
        return there, [keepers[i] for i in np.flatnonzero(there).tolist()]


def _groups(shards: DataFrame, most: int) -> list[tuple[int, int]]:
    """First and last shard of each group of at most `most` bytes (or of one shard)."""
    groups: list[list[int]] = []
    for row in shards.select("shard", "size").orderBy("shard").collect():  # a few bytes for each 65,536 keys
        if groups and groups[-1][2] + row["size"] <= most:
            groups[-1][1:] = [row["shard"], groups[-1][2] + row["size"]]
        else:
            groups.append([row["shard"], row["shard"], row["size"]])
    return [(a, b) for a, b, _ in groups]


def _dropped(batch: pa.RecordBatch, least: int, doomed) -> pa.RecordBatch:
    """Leaves the lines out for which doomed(rows, digests) is true. Columns are id, text and what doomed needs."""
    raws = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1)]
    found = [(row, i, d) for row, raw in enumerate(raws) for i, d in _keys(raw, least)]
    out = doomed(np.array([f[0] for f in found], np.int64), [f[2] for f in found])
    gone: dict[int, set[int]] = {}
    for (row, i, _), drop in zip(found, out, strict=True):
        if drop:
            gone.setdefault(row, set()).add(i)
    n_lines = [raw.count(b"\n") + 1 for raw in raws]
    kept = [b"\n".join(line for i, line in enumerate(raw.split(b"\n")) if i not in gone[row]) if row in gone else raw for row, raw in enumerate(raws)]
    n_dropped = [len(gone.get(row, ())) for row in range(len(raws))]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_lines", "n_dropped", "kept"])


def drop_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Id, n_lines, n_dropped and the kept text of each document.

    Lines are parted by line feeds; a key of at least `min_chars` characters in at least `min_docs`
    documents keeps its lines in the document of the largest id alone. A null or empty text is one
    empty line. Documents are known by id: rows of one id count once for a key and keep or lose its
    lines together, and a null id is one more document, less than all others. A text that loses all
    its lines is empty. Repeated rows are kept; no rows give none; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_lines long, n_dropped long, kept string"
    keys = cut(repeated(lines(rows, min_chars), min_docs))
    made, bits = index(keys, keys.count())
    shards = cut(made)
    groups = _groups(shards, most_bytes)
    loaded = lambda a, b: Probe(spark, [r.asDict() for r in shards.where(F.col("shard").between(a, b)).collect()], bits)  # noqa: E731  at most most_bytes

    if len(groups) <= 1:
        probe = loaded(*groups[0]) if groups else Probe(spark, [], bits)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column(0).to_pylist()

            def doomed(row: np.ndarray, digests: list[bytes]) -> np.ndarray:
                there, keepers = probe(*_halves(digests))
                there[there] = [ids[r] != k for r, k in zip(row[there].tolist(), keepers, strict=True)]
                return there

            return _dropped(batch, min_chars, doomed)

        return map_batches(rows, run, schema).withColumnRenamed("id", id_col)

    group = F.lit(0)
    for i, (a, _) in enumerate(groups):
        group = F.when(F.col("shard") >= a, F.lit(i)).otherwise(group)
    path = fresh(spark)
    lines(rows, min_chars).distinct().withColumn("shard", shard_of(bits)).withColumn("part", group).drop("shard").write.partitionBy("part").parquet(path)
    found = None
    for i, (a, b) in enumerate(groups):
        probe = loaded(a, b)

        def hit(batch: pa.RecordBatch, probe: Probe = probe) -> pa.RecordBatch:
            high, low = (batch.column(c).to_numpy().view(np.uint64) for c in (1, 2))
            there, keepers = probe(high, low)
            ids = batch.column(0).to_pylist()
            there[there] = [ids[r] != k for r, k in zip(np.flatnonzero(there).tolist(), keepers, strict=True)]
            return batch.filter(pa.array(there))

        part = spark.read.schema(f"id {kind}, high long, low long, part int").parquet(path).where(F.col("part") == i).drop("part")
        part = map_batches(part, hit, f"id {kind}, high long, low long", rows=1 << 16)
        found = part if found is None else found.unionByName(part)
    doomed_of = cut(found.groupBy(F.col("id").alias("of")).agg(F.collect_list(F.struct("high", "low")).alias("gone"), F.lit(True).alias("any")))
    both = rows.join(doomed_of, F.col("id").eqNullSafe(F.col("of")), "left").select("id", "text", "gone")

    def drop(batch: pa.RecordBatch) -> pa.RecordBatch:
        gone = [{(g["high"], g["low"]) for g in x or ()} for x in batch.column(2).to_pylist()]

        def doomed(row: np.ndarray, digests: list[bytes]) -> list[bool]:
            high, low = (x.view(np.int64).tolist() for x in _halves(digests))
            return [(h, w) in gone[r] for r, h, w in zip(row.tolist(), high, low, strict=True)]

        return _dropped(batch, min_chars, doomed)

    return map_batches(both, drop, schema).withColumnRenamed("id", id_col)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d),
k AS (SELECT *, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM (SELECT DISTINCT key, doc_id FROM k WHERE length(key) >= {MIN_CHARS}) GROUP BY key HAVING count(*) >= {MIN_DOCS}),
m AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.keeper AS gone FROM k LEFT JOIN s USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r
"""
