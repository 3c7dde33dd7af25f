"""Packing: window cuts by order-preserving dynamic programming.

Documents stay in the order in which their partition holds them and form one stream of ids, each
followed by a separator. Windows of at most `window` ids tile that stream. A cut may stand at a
document's end (free), at a sentence's end (a small penalty) or, where neither comes for `grid` ids,
inside a sentence (a larger one); the cuts minimise padding plus penalties. Since

    best[j] = penalty[j] + window - p[j] + min(best[i] + p[i]),  p[j] - window <= p[i] < p[j],

the minimum slides, and a queue whose values increase gives it in constant time. A window whose
length is a power of two needs no padding and is a second kind of step.

Each partition is packed on its own in one pass with a bounded buffer: there is no shuffle, a lost
task is simply run again, and padding at the end of a partition is at most one window.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, table
from tidemark.llm.tokenizer import encoder

WINDOW = 1024
#: Penalties of a cut, in ids of padding.
SENTENCE, INSIDE = 8, 48
#: Where no document or sentence ends for so many ids, a cut inside is allowed.
GRID = 64
#: Shorter windows that need no padding, and what one more window costs.
POWERS, ONE_MORE = (512, 256, 128), 4
#: Ids that are gathered before windows are chosen.
BUFFER = 1 << 20

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, begins: np.ndarray, grid: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut may stand and the penalties there; 0 is the first, the last document's end the last."""
    sentence = np.flatnonzero(ends[ids[:-1]] & begins[ids[1:]]) + 1
    natural = np.union1d(np.append(0, doc_ends), sentence)
    gaps = np.diff(natural)
    n = (gaps - 1) // grid
    inside = np.repeat(natural[:-1], n) + grid * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1)
    at = np.union1d(natural, inside)
    cost = np.full(len(at), INSIDE)
    cost[np.searchsorted(at, sentence)] = SENTENCE
    cost[np.searchsorted(at, doc_ends)] = 0
    return at, cost


def best_cuts(at: np.ndarray, cost: np.ndarray, window: int) -> list[int]:
    """Indexes in `at` of the best cuts, without the first position, with the last."""
    p, pen = at.tolist(), cost.tolist()
    where = {x: i for i, x in enumerate(p)}
    best, back = [0] * len(p), [0] * len(p)
    queue: deque[tuple[int, int]] = deque([(p[0], 0)])
    powers = tuple(x for x in POWERS if x < window)
    for j in range(1, len(p)):
        x = p[j]
        low = x - window
        while p[queue[0][1]] < low:
            queue.popleft()
        value, i = queue[0]
        value += window - x
        for length in powers:
            k = where.get(x - length)
            if k is not None and best[k] < value:
                value, i = best[k], k
        value += pen[j] + ONE_MORE
        best[j], back[j] = value, i
        value += x
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    out, j = [], len(p) - 1
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


class Packer:
    """Packs a stream of documents with a bounded buffer."""

    def __init__(self, tokenizer: str, window: int, separator: int, first_sequence: int, with_ids: bool) -> None:
        self.encoder, self.window, self.separator, self.sequence, self.with_ids = encoder(tokenizer), window, separator, first_sequence, with_ids
        self.ends, self.begins = self.encoder.cut_marks()
        self.ids = np.zeros(0, "<u4")
        self.doc_ids: list[int | None] = []
        self.starts = np.zeros(0, np.int64)  # of the documents in the buffer; the first may have begun before it
        self.sizes = np.zeros(0, np.int64)

    def add(self, doc_ids: list[int | None], texts: pa.Array) -> None:
        ids, at = self.encoder.encode_many(texts)
        n = len(doc_ids)
        sizes = np.diff(at) + 1
        all_ids = np.full(len(ids) + n, self.separator, "<u4")
        keep = np.ones(len(all_ids), bool)
        keep[np.cumsum(sizes) - 1] = False
        all_ids[keep] = ids
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.ids = np.append(self.ids, all_ids)
        self.doc_ids += doc_ids

    def pack(self, last: bool) -> pa.RecordBatch | None:
        """Windows over the buffer; unless it is the last one, the final two are chosen anew with what follows."""
        if not len(self.ids):
            return None
        doc_ends = self.starts + self.sizes
        at, cost = candidates(self.ids, doc_ends, self.ends, self.begins, min(GRID, self.window))
        cuts = at[best_cuts(at, cost, self.window)]
        if not last:
            cuts = cuts[:-2]
        if not len(cuts):
            return None
        stop = int(cuts[-1])
        bounds = np.union1d(cuts, doc_ends[doc_ends < stop])
        begin = np.append(0, bounds[:-1])
        window_start = np.append(0, cuts[:-1])
        seq = np.searchsorted(window_start, begin, "right") - 1
        doc = np.searchsorted(self.starts, begin, "right") - 1
        raw = memoryview(np.ascontiguousarray(self.ids)).cast("B")
        columns = [
            pa.array([self.doc_ids[i] for i in doc.tolist()], pa.int64()),
            begin - self.starts[doc],
            bounds - begin,
            pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), bounds.tolist(), strict=True)], pa.int64()),
            self.sizes[doc],
            self.sequence + seq,
            begin - window_start[seq],
        ]
        names = [x.split()[0] for x in PIECES.split(", ")]
        if self.with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, stop), pa.int32()), pa.array(self.ids[:stop].astype(np.int32))))
            names.append("ids")
        self.sequence += len(cuts)
        first = int(np.searchsorted(doc_ends, stop, "right"))
        self.ids, self.doc_ids = self.ids[stop:].copy(), self.doc_ids[first:]
        self.starts, self.sizes = self.starts[first:] - stop, self.sizes[first:]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)


def pack(df: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, separator: int = 0, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document: where it begins there, its length, its window and its place in it.

    A null or empty text is one separator. Null and repeated ids are kept as they are, each row being
    a document of its own; other columns are not read. A text longer than a window is cut as often as
    needed, and every id lies in exactly one piece. No rows give no rows. `with_ids` adds the ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(tokenizer, window, separator, TaskContext.get().partitionId() << 40, with_ids)
        for batch in small_batches(batches, 4096):
            packer.add(batch.column(0).to_pylist(), batch.column(1))
            if len(packer.ids) >= BUFFER and (out := packer.pack(last=False)) is not None:
                yield out
        if (out := packer.pack(last=True)) is not None:
            yield out

    columns = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return columns.mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
