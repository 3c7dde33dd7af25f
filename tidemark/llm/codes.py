"""Vector code compression: product codes whose codebooks come from Lloyd rounds on kd-trees.

Vectors become integers and are cut into equal parts. Blocks of vectors are written once into the
shared folder, each with a kd-tree for every part position: its points in tree order and, for every
node, the bounding box and the sums of its points. A Lloyd round goes down the trees of each block
with the entries of the codebook that are still in question (the filtering algorithm of Kanungo et
al. 2002): at each node the entry nearest to the middle of the box is compared with every other one
at the corner of the box that favours the other most; an entry that loses there is nearest to no
point of the box. Where one entry is left, the node's sums and count go to it at once, and its points
are never looked at. Blocks add up to a few sums for each entry, which is all that is shuffled and all
that reaches the driver.

All numbers are integers, so results don't depend on blocks or on the order of additions, and ties
are exact: an entry that draws at a corner goes out only if its index is the greater one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Points of a leaf at most, vectors and components of a block at most.
LEAF, BLOCK_ROWS, BLOCK_CELLS = 16, 4096, 1 << 20
#: Components are below this, so that squared distances of whole vectors fit into 64 bits.
LARGEST = 1 << 26
#: Distances computed at once, in components.
AT_ONCE = 1 << 21
#: A label of at least the 1/65,536th part of all rows is joined by broadcast; there are no more than 65,536 of them.
COMMON = 1 << 16


def kept(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """id, label, v: integer components of the vectors that are whole and finite."""
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("v").isNotNull() & ~bad)
    far = F.exists("v", lambda x: F.abs(x) * scale >= LARGEST)
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("int"))
    return rows.withColumn("v", F.when(far, F.raise_error(F.lit(f"a component times {scale} is {LARGEST} or more"))).otherwise(whole))


def levels(n: int) -> list[np.ndarray]:
    """Where the nodes of each level begin in tree order, the end included; halves down to leaves."""
    deep = max(0, int(n - 1).bit_length() - int(LEAF).bit_length() + 1)
    return [(np.arange(2**k + 1) * n) >> k for k in range(deep + 1)]


def grow(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order, points in order, and of all nodes level by level the boxes' lows and highs and the sums.

    `points` is (parts, n, width): one tree for each part, all of one shape. A node is halved at the
    median of the side on which its box is longest.
    """
    parts, n, width = points.shape
    order = np.tile(np.arange(n), (parts, 1))
    bounds = levels(n)
    for at in bounds[:-1]:
        if not width:
            break
        low, high = np.minimum.reduceat(points, at[:-1], axis=1), np.maximum.reduceat(points, at[:-1], axis=1)
        node = np.repeat(np.arange(len(at) - 1), np.diff(at))
        side = (high - low).argmax(axis=2)[:, node]
        value = np.take_along_axis(points, side[:, :, None], axis=2)[:, :, 0]
        moved = np.lexsort((value, np.broadcast_to(node, value.shape)))
        order = np.take_along_axis(order, moved, axis=1)
        points = np.take_along_axis(points, moved[:, :, None], axis=1)
    boxes = [[f.reduceat(points, at[:-1], axis=1) for at in bounds] for f in (np.minimum, np.maximum, np.add)]
    return order, points, *(np.concatenate(b, axis=1) for b in boxes)


class Block:
    """The trees of a block of vectors."""

    def __init__(self, n: int, width: int, order: bytes, points: bytes, low: bytes, high: bytes, sums: bytes):
        self.n, self.width, self.bounds = n, width, levels(n)
        nodes = sum(len(b) - 1 for b in self.bounds)
        self.order = np.frombuffer(order, np.uint16).reshape(PARTS, n)
        self.points = np.frombuffer(points, np.int32).reshape(PARTS, n, width)
        self.low, self.high = (np.frombuffer(raw, np.int32).reshape(PARTS, nodes, width) for raw in (low, high))
        self.sums = np.frombuffer(sums, np.int64).reshape(PARTS, nodes, width)

    def filtered(self, book: np.ndarray, take_node, take_points) -> None:
        """Hands each point to its nearest entry (the lesser of equal ones), in nodes where that is possible.

        take_node(part, level, node, entry) and take_points(part, place, entry) get arrays; `book` is
        (parts, entries, width).
        """
        k = book.shape[1]
        part, node = np.arange(PARTS), np.zeros(PARTS, np.int64)
        alive = np.ones((PARTS, k), bool)
        index, start = np.arange(k), 0
        for level, at in enumerate(self.bounds):
            left_part, left_node, left_alive = [], [], []
            for i in range(0, len(part), step := max(1, AT_ONCE // max(1, k * self.width))):
                p, nd, al = part[i : i + step], node[i : i + step], alive[i : i + step].copy()
                low, high = self.low[p, start + nd].astype(np.int64), self.high[p, start + nd].astype(np.int64)
                entries = book[p]
                middle = np.where(al, ((2 * entries - (low + high)[:, None]) ** 2).sum(axis=2), np.iinfo(np.int64).max)
                best = middle.argmin(axis=1)
                chosen = entries[np.arange(len(p)), best][:, None]
                corner = np.where(entries > chosen, high[:, None], low[:, None])
                behind = ((entries - corner) ** 2).sum(axis=2) - ((chosen - corner) ** 2).sum(axis=2)
                al &= (behind < 0) | ((behind == 0) & (index <= best[:, None]))
                one = al.sum(axis=1) == 1
                if one.any():
                    take_node(p[one], level, nd[one], best[one])
                left_part.append(p[~one])
                left_node.append(nd[~one])
                left_alive.append(al[~one])
            part, node, alive = np.concatenate(left_part), np.concatenate(left_node), np.concatenate(left_alive)
            if level + 1 < len(self.bounds):
                part, node, alive, start = np.repeat(part, 2), (2 * node[:, None] + np.arange(2)).ravel(), np.repeat(alive, 2, axis=0), start + len(at) - 1
            if not len(part):
                return
        sizes = np.diff(self.bounds[-1])[node]
        place = np.repeat(self.bounds[-1][node] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        part, alive = np.repeat(part, sizes), np.repeat(alive, sizes, axis=0)
        for i in range(0, len(part), step := max(1, AT_ONCE // max(1, k * self.width))):
            p, at, al = part[i : i + step], place[i : i + step], alive[i : i + step]
            far = np.where(al, ((self.points[p, at].astype(np.int64)[:, None] - book[p]) ** 2).sum(axis=2), np.iinfo(np.int64).max)
            take_points(p, at, far.argmin(axis=1))

    def add_to(self, book: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
        """Adds the sums and counts of the points of each entry."""
        starts = np.cumsum([0] + [len(b) - 1 for b in self.bounds])

        def take_node(part, level, node, entry):
            np.add.at(sums, (part, entry), self.sums[part, starts[level] + node])
            np.add.at(counts, (part, entry), np.diff(self.bounds[level])[node])

        def take_points(part, place, entry):
            np.add.at(sums, (part, entry), self.points[part, place].astype(np.int64))
            np.add.at(counts, (part, entry), 1)

        self.filtered(book, take_node, take_points)

    def coded(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each part of each vector, and each vector's squared distance from its code."""
        codes, errors = np.zeros((self.n, PARTS), np.int64), np.zeros(self.n, np.int64)
        in_order = np.zeros((PARTS, self.n), np.int64)

        def take_node(part, level, node, entry):
            for p, nd, e in zip(part.tolist(), node.tolist(), entry.tolist(), strict=True):
                in_order[p, self.bounds[level][nd] : self.bounds[level][nd + 1]] = e

        def take_points(part, place, entry):
            in_order[part, place] = entry

        self.filtered(book, take_node, take_points)
        for p in range(PARTS):
            codes[self.order[p], p] = in_order[p]
            errors[self.order[p]] += ((self.points[p].astype(np.int64) - book[p, in_order[p]]) ** 2).sum(axis=1)
        return codes, errors


TREES = "n int, width int, order binary, points binary, low binary, high binary, sums binary"


def blocks(rows: DataFrame, width: int) -> DataFrame:
    """Rows (id, label, v) as blocks with their trees."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    most = max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(1, PARTS * width)))

    def block(held: pa.Table) -> pa.RecordBatch:
        ids, labels, v = (held.column(c).combine_chunks() for c in range(3))
        n = len(v)
        if set(np.diff(v.offsets.to_numpy()).tolist()) != {PARTS * width}:
            raise ValueError(f"vectors of other lengths than {PARTS * width}")
        flat = v.flatten().to_numpy().reshape(n, PARTS, width).transpose(1, 0, 2).astype(np.int64)
        order, points, low, high, sums = grow(flat)
        raw = [order.astype(np.uint16), points.astype(np.int32), low.astype(np.int32), high.astype(np.int32), sums]
        lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c) for c in (ids, labels)]
        return pa.RecordBatch.from_arrays([*lists, pa.array([n], pa.int32()), pa.array([width], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in raw)], ["ids", "labels", *(c.split()[0] for c in TREES.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most - n)
                held, n, batch = [*held, part], n + part.num_rows, batch.slice(part.num_rows)
                if n == most:
                    yield block(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield block(pa.Table.from_batches(held))

    return rows.mapInArrow(run, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, {TREES}")


def _opened(batch: pa.RecordBatch, i: int) -> Block:
    return Block(*(batch.column(c.split()[0])[i].as_py() for c in TREES.split(", ")))


def lloyd(trees: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebook after one round over all blocks; an entry of no point stays as it is."""
    parts, k, width = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(book.shape, np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                _opened(batch, i).add_to(book, sums, counts)
        used = np.flatnonzero(counts.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts.ravel()[used]), pa.array(list(sums.reshape(-1, width)[used]), pa.list_(pa.int64()))], ["entry", "n", "sums"])

    if not width:
        return book
    each = trees.drop("ids", "labels").mapInArrow(run, "entry long, n long, sums array<long>")
    wide = each.select("entry", F.posexplode(F.concat(F.array("n"), "sums")).alias("at", "x"))
    found = wide.groupBy("entry", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()  # a number for each component of the codebook
    total = {(r["entry"], r["at"]): int(r["x"]) for r in found}
    out = book.copy()
    for e in {e for e, _ in total}:
        out[e // k, e % k] = [total[e, at + 1] // total[e, 0] for at in range(width)]
    return out


def compress(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Rows (id, label, code, error, label_error) of the kept vectors, and the codebooks (parts, entries, width).

    Vectors that are null or hold a null, NaN or infinity are left out. The codebooks start as the
    vectors of the least ids (a null id after all others, rows of one id by their components); there are
    fewer entries if there are fewer vectors. Components must stay below 2^26 after scaling and
    vectors have one length, a multiple of 8; anything else is an error, as distances would not be
    defined or not fit. Vectors without components have code 0 throughout. `label_error` sums over rows of
    equal labels, null being one. Repeated rows are kept; no rows give none and empty codebooks.
    """
    rows = kept(df, id_col, vector_col, label_col, scale)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    length = len(first[0]["v"]) if first else 0
    if length % PARTS:
        raise ValueError(f"vectors of {length} components can't be cut into {PARTS} equal parts")
    if any(len(r["v"]) != length for r in first):
        raise ValueError(f"vectors of other lengths than {length}")
    book = np.array([r["v"] for r in first], np.int64).reshape(len(first), PARTS, length // PARTS).transpose(1, 0, 2)
    trees = cut(blocks(rows, length // PARTS))
    for _ in range(rounds if first else 0):
        book = lloyd(trees, book)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes, errors = _opened(batch, i).coded(book)
                text = [bytes(c).hex() for c in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, batch.column("labels")[i].values, pa.array(text, pa.string()), pa.array(errors)], ["id", "label", "code", "error"])

    coded = cut(trees.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long"))
    return with_label_errors(coded).withColumnRenamed("id", id_col).withColumnRenamed("label", label_col), book


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Joins each row with the sum of its label: common labels by broadcast, so that none is hot in the join of the rest."""
    sums = cut(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    total = sums.agg(F.sum("n")).first()[0] or 0
    is_common = F.col("n") * COMMON >= total
    same = F.col("label").eqNullSafe(F.col("of"))
    common = F.broadcast(sums.where(is_common))
    columns = ["id", "label", "code", "error", "label_error"]
    rest = coded.join(common, same, "left_anti").join(sums.where(~is_common), same)
    return coded.join(common, same).select(columns).unionByName(rest.select(columns))


def digest(book: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def decode(code: str, book: np.ndarray) -> list[int]:
    """The integer vector that a code stands for."""
    return [x for p, e in enumerate(bytes.fromhex(code)) for x in book[p, e].tolist()]


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, book = compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))


def _sql() -> str:
    width = f"(len(v) // {PARTS})"
    rounds = []
    for i in range(ROUNDS + 1):
        distance = "list_sum(list_transform(range(1, len(x) + 1), lambda j: (x[j] - c[j]) * (x[j] - c[j])))"
        rounds.append(f"a{i} AS MATERIALIZED (SELECT rn, part, any_value(x) AS x, min({{'d': {distance}, 'e': entry}}) AS best FROM p JOIN c{i} USING (part) GROUP BY rn, part)")
        if i < ROUNDS:
            rounds.append(f"""s{i} AS (SELECT part, best.e AS entry, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM a{i}, unnest(range(1, len(x) + 1)) AS u(j) GROUP BY ALL),
m{i} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM s{i} GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (part, entry))""")
    return f"""
WITH w AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rn, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (SELECT rn, part, v[part * {width} + 1:(part + 1) * {width}] AS x FROM w, unnest(range({PARTS})) AS u(part)),
c0 AS MATERIALIZED (SELECT part, rn - 1 AS entry, x AS c FROM p WHERE rn <= {ENTRIES}),
{", ".join(rounds)},
k AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS}),
e AS (SELECT rn, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY rn)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM w JOIN e USING (rn), k
"""


OP12_SQL = _sql()
