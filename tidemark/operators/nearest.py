"""An index of vectors by coarse clusters: few lists are probed, and what they hold is ranked exactly.

Centroids come from a bounded sample; every vector goes to the list of the centroid nearest to it by
cosine. The index is a table with a folder for each list, and a small table of what each list has:
its centroid, how many vectors, and how far the farthest of them is from the centroid. A search reads
the folders of its probes only. Asked to be exact, it goes on to every list that could hold a better
vector: the angle between query and member is at least that between query and centroid less the
list's width.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vectors

#: Vectors of the sample and components in it at most, lists at most, and rounds of refinement.
SAMPLE, SAMPLE_CELLS, MOST_LISTS, ROUNDS = 16_384, 1 << 22, 4096, 6
#: Lists that a search probes.
PROBES = 8
#: Vectors and queries of a block in a search with many queries.
BLOCK, QUERIES = 1024, 256
#: Candidates that a task holds before it passes the best of them on.
HELD = 1 << 18
#: Slack of bounds against rounding.
SLACK = 1e-6


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; those without a length stay."""
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1.0)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors as a matrix in double precision."""
    if not len(column):
        return np.zeros((0, 0))
    width = set(np.diff(column.offsets.to_numpy()).tolist())
    if len(width) != 1:
        raise ValueError("vector dimensions differ")
    return column.flatten().to_numpy().reshape(len(column), width.pop()).astype(np.float64)


def _least(whole: DataFrame, most: int) -> np.ndarray:
    """The vectors (v) of the `most` least hashes (h, in hex), in order.

    Hashes are evenly spread, so those beyond a little more than the part asked for are left out before
    anything is sorted. One task sorts what is left and sends the sample on; a limit that the driver
    collects itself would get so many rows of every task.
    """
    n = whole.count()
    part = (most + 8 * math.sqrt(most) + 64) / max(1, n)

    def taken(some: DataFrame) -> np.ndarray:
        return matrix(some.orderBy("h", "v").limit(most).select("v").toArrow()["v"].combine_chunks())

    found = taken(whole.where(F.col("h") < f"{int(part * 2**64):016x}")) if part < 1 else taken(whole)
    return found if len(found) == min(most, n) else taken(whole)  # ids that repeat are not evenly spread


def centroids(rows: DataFrame, lists: int, *, id_col: str, vector_col: str, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of length 1 from a sample of at most `SAMPLE` vectors, those of the least hashes of ids.

    They begin as the first `lists` different vectors of the sample and follow the means of its
    clusters for some rounds. There are fewer if there are fewer different vectors, and one at least.
    """
    whole = rows.where(vectors.valid(F.col(vector_col))).select(F.md5(F.col(id_col).cast("string")).alias("h"), F.col(vector_col).cast("array<double>").alias("v"))
    first = whole.select(F.size("v")).first()
    sample = _least(whole, min(SAMPLE, SAMPLE_CELLS // max(1, first[0]))) if first else np.zeros((0, 0))  # the sample is bounded
    if not len(sample):
        return np.zeros((1, 0))
    found = unit(sample)
    _, at = np.unique(found, axis=0, return_index=True)
    now = found[np.sort(at)[: max(1, min(lists, MOST_LISTS))]]
    for _ in range(rounds):
        nearest = (found @ now.T).argmax(axis=1)
        sums = np.zeros_like(now)
        np.add.at(sums, nearest, found)
        now = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, unit(sums), now)
    return now


def default_lists(n: int) -> int:
    """A list for each vector of a list: the square root of their number."""
    return max(1, min(MOST_LISTS, math.isqrt(n)))


def assigned(rows: DataFrame, centres: np.ndarray, *, id_col: str, vector_col: str) -> DataFrame:
    """list, id, embedding, near (cosine with the centroid) of every row that has a vector of finite numbers; the lesser list of equal ones."""
    kind = rows.schema[id_col].dataType.simpleString()
    have = rows.where(vectors.valid(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                near = unit(matrix(batch.column(1))) @ centres.T
                best = near.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(best.astype(np.int32)), batch.column(0), batch.column(1), pa.array(near[np.arange(len(best)), best])], ["list", "id", "embedding", "near"])

    return have.mapInArrow(run, f"list int, id {kind}, embedding array<float>, near double")


def dealt(lists: DataFrame, files: int = 8) -> DataFrame:
    """Lists as they are to be written: each in at most so many files, so that a list of very many equal vectors is not one task's."""
    return lists.repartition(F.col("list"), F.pmod(F.xxhash64("id"), F.lit(files)))


def widths(index: DataFrame) -> dict[int, tuple[int, float]]:
    """For each list how many vectors it has and the least cosine with its centroid; as many rows as lists at most."""
    return {r["list"]: (r["n"], r["least"]) for r in index.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("least")).collect()}


def probe_order(query: np.ndarray, centres: np.ndarray) -> list[int]:
    """All lists, those of the nearest centroids first."""
    near = centres @ unit(query[None])[0]
    return np.lexsort((np.arange(len(near)), -near)).tolist()


def upper(query: np.ndarray, centres: np.ndarray, width: dict[int, tuple[int, float]]) -> dict[int, float]:
    """The greatest cosine that a member of each list can have with a query."""
    if not np.linalg.norm(query):
        return dict.fromkeys(width, 0.0)
    angles = np.arccos(np.clip(centres @ unit(query[None])[0], -1, 1))
    return {i: math.cos(max(0.0, angles[i] - math.acos(max(-1.0, min(1.0, least))))) + SLACK for i, (_, least) in width.items()}


def _best(index: DataFrame, lists: list[int], query: list[float], k: int) -> DataFrame:
    score = vectors.cosine(F.col("embedding"), vectors.literal(query))
    return index.where(F.col("list").isin(lists)).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def search(index: DataFrame, centres: np.ndarray, query: list[float], k: int, *, probes: int = PROBES) -> DataFrame:
    """id, score of the k nearest vectors in the lists of the `probes` nearest centroids, ties by id."""
    asked = np.array(query, np.float64)
    return _best(index, probe_order(asked, centres)[: max(1, probes)], query, k)


def exact_search(index: DataFrame, centres: np.ndarray, width: dict[int, tuple[int, float]], query: list[float], k: int, *, probes: int = PROBES) -> DataFrame:
    """id, score of the k nearest of all vectors: the probed lists give a score to beat, then come all lists that could beat or draw with it."""
    asked = np.array(query, np.float64)
    order = [i for i in probe_order(asked, centres) if i in width]
    first = [r["score"] for r in _best(index, order[: max(1, probes)], query, k).collect()]  # k numbers
    at_most = upper(asked, centres, width)
    return _best(index, [i for i in order if len(first) < k or at_most[i] >= first[-1]], query, k)


def _packed(rows: DataFrame, most: int, kind: str) -> DataFrame:
    """Rows (list, id, embedding), in order of lists, as blocks of one list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, at = batch.column(0).to_numpy(), 0
            while at < batch.num_rows:
                other = np.flatnonzero(lists[at:] != lists[at])
                n = min(most, int(other[0]) if len(other) else batch.num_rows - at)
                part = batch.slice(at, n)
                ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).slice(0, 1), ids, pa.array([unit(matrix(part.column(2))).tobytes()], pa.binary())], ["list", "ids", "rows"])
                at += n

    return rows.select("list", "id", "embedding").mapInArrow(run, f"list int, ids array<{kind}>, rows binary")


def neighbours(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, *, id_col: str, vector_col: str, probes: int = PROBES) -> DataFrame:
    """query_id, list, id, score, rank: for each query the k nearest vectors of its probed lists, itself included, ties by id.

    Queries and vectors meet list by list in blocks; a task keeps the k best of its blocks for each query.
    The join carries a row for a pair of blocks, never for a pair of vectors. Scores are in double
    precision, and equal when rounded to nine places.
    """
    kind, asked = index.schema["id"].dataType.simpleString(), queries.schema[id_col].dataType.simpleString()
    wanted = queries.where(vectors.valid(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("embedding"))

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                near = unit(matrix(batch.column(1))) @ centres.T
                n = min(probes, near.shape[1])
                lists = np.argsort(-near, axis=1, kind="stable")[:, :n]
                row = pa.array(np.repeat(np.arange(batch.num_rows), n))
                yield pa.RecordBatch.from_arrays([pa.array(lists.ravel().astype(np.int32)), batch.column(0).take(row), batch.column(1).take(row)], ["list", "id", "embedding"])

    to_probe = wanted.mapInArrow(probed, f"list int, id {asked}, embedding array<float>")
    left = _packed(to_probe.repartition("list").sortWithinPartitions("list"), QUERIES, asked).select("list", F.col("ids").alias("asked"), F.col("rows").alias("queries"))
    right = _packed(index.sortWithinPartitions("list"), BLOCK, kind)

    def top(found: list[pa.RecordBatch]) -> pa.Table:
        rows = pa.Table.from_batches(found)
        rows = rows.take(pc.sort_indices(rows, [("query_id", "ascending"), ("score", "descending"), ("id", "ascending")])).combine_chunks()
        query = rows["query_id"].combine_chunks()
        begins = np.flatnonzero(np.append(True, pc.not_equal(query.slice(1), query.slice(0, len(query) - 1)).to_numpy(zero_copy_only=False)))
        nth = np.arange(len(query)) - np.repeat(begins, np.diff(np.append(begins, len(query))))
        return rows.filter(pa.array(nth < k))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            for i in range(batch.num_rows):
                asked_ids, ids = batch.column("asked")[i].values, batch.column("ids")[i].values
                of = np.frombuffer(batch.column("queries")[i].as_buffer()).reshape(len(asked_ids), -1)
                scores = np.round(of @ np.frombuffer(batch.column("rows")[i].as_buffer()).reshape(len(ids), -1).T, 9) + 0.0
                by_id = np.argsort(pc.sort_indices(ids).to_numpy())
                first = np.lexsort((np.broadcast_to(by_id, scores.shape), -scores))[:, :k]
                row = pa.array(np.repeat(np.arange(len(asked_ids)), first.shape[1]))
                columns = [pa.array([batch.column("list")[i].as_py()] * len(row), pa.int32()), asked_ids.take(row), ids.take(pa.array(first.ravel())), pa.array(np.take_along_axis(scores, first, axis=1).ravel())]
                held.append(pa.RecordBatch.from_arrays(columns, ["list", "query_id", "id", "score"]))
                n += len(row)
                if n > HELD:
                    kept = top(held)
                    if kept.num_rows > HELD // 2:  # of too many queries to hold the best of each
                        yield from kept.to_batches()
                        kept = kept.slice(0, 0)
                    held, n = kept.to_batches(), kept.num_rows
        if held:
            yield from top(held).to_batches()

    found = right.join(left, "list").mapInArrow(best, f"list int, query_id {asked}, id {kind}, score double")
    of_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(of_query)).where(F.col("rank") <= k)


def probes_for(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, target: float, *, id_col: str, vector_col: str, sample: int = 64) -> int:
    """The least number of probes that finds a part `target` of the k nearest vectors of sampled queries.

    The sample's queries (`sample` at most, of the least hashes of ids) are answered from all lists; how
    far down each query's order of lists its neighbours are gives the recall of every number of probes.
    """
    some = queries.where(vectors.valid(F.col(vector_col))).orderBy(F.md5(F.col(id_col).cast("string"))).limit(sample).select(F.col(id_col).alias("q"), F.col(vector_col).cast("array<float>").alias("v"))
    of = {r["q"]: r["v"] for r in some.collect()}
    held = index.sparkSession.createDataFrame(list(of.items()), some.schema)
    found = neighbours(index, centres, held, k, id_col="q", vector_col="v", probes=len(centres)).select("query_id", "list").collect()  # k rows for each of the sample
    place = {q: {i: n for n, i in enumerate(probe_order(np.array(v, np.float64), centres))} for q, v in of.items()}
    depths = sorted(place[r["query_id"]][r["list"]] + 1 for r in found)
    return depths[min(len(depths), math.ceil(target * len(depths))) - 1] if depths else 1
