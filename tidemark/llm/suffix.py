"""Suffix-array deduplication: bytes covered by a string of 200 that also starts anywhere else.

Only some suffixes have to be ordered. Winnowing marks anchors: the least hash of `GRAM` bytes in
every `SPAN` starts, so that each string of `LENGTH` bytes holds an anchor with its gram, chosen by
content alone, and equal strings hold equal anchors. A string that repeats is therefore found where
anchors of equal grams meet, and lies within `LEFT` bytes before an anchor and `LENGTH` after it: its
context. Contexts that are equal as a whole are repeated throughout and need no further look. Where
different contexts share a gram (the ends of repeated passages) one of each kind goes on, and their
suffixes are put in order by deep-shallow sorting: a multikey quicksort by words of eight bytes down
to a shallow depth, then blind tries for the groups that still agree. The order of suffixes from the
anchor on, and that of the reversed text before it, with the longest common prefixes of neighbours,
say for every offset which contexts share a string of `LENGTH` bytes there.

A gram of very many different contexts (what is around the ends of a passage that all documents
have) would be one task's to sort. Such a gram is split by more of its content: strings that start at
one of several neighbouring offsets all hold the bytes that these strings have in common, their core.
Halves of the offsets have longer cores, so contexts are dealt by the core of each half, halves of
halves where that is still too many, down to single offsets; only what is beside the core is shuffled
and sorted. Contexts that agree in the core of a single offset share the whole string.

Each distinct text is handled once and kept in a table bucketed by its number, so that texts are
shuffled once; a text that occurs twice repeats as a whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, fresh, small_batches, table, whole_groups
from tidemark.llm.jaccard import mixed

LENGTH = 200
GRAM = 64
SPAN = LENGTH - GRAM + 1
#: Bytes of a context before its anchor; there are LENGTH from the anchor on.
LEFT = LENGTH - GRAM
#: Depth at which sorting turns from quicksort to blind tries.
SHALLOW = 80
#: Stands for what lies beyond a text's ends; no UTF-8 text has this byte.
BEYOND = 255
#: Rows of whole groups that are looked at together, and rows of one gram at which it is looked at in parts.
CHUNK, MOST_ROWS = 1 << 18, 1 << 20
#: Contexts that are sorted together, 44 MB; a gram or core that has more is split.
SORTED = 1 << 17
#: Marks in the last two bits of an anchor's place.
ONE_OF_MANY, SETTLED = 1, 2
_HALF, _MASK = LEFT // 2, 0x7FFF
_BASE = 0x9E3779B97F4A7C15


def _powers(k: int) -> list[int]:
    return [pow(_BASE, 1 << i, 1 << 64) for i in range(k)]


_TABLE = np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of every `width` bytes, by doubling: a hash of 2n bytes is made of two of n."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    part, done, out = _TABLE[data], 0, np.zeros(n, np.uint64)
    for i, power in enumerate(_powers(width.bit_length())):
        size = 1 << i
        if width & size:
            out = out * np.uint64(pow(_BASE, size, 1 << 64)) + part[done : done + n]
            done += size
        if 2 * size > width:
            break
        part = part[: len(part) - size] * np.uint64(power) + part[size:]
    return mixed(out)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, x
    while 2 * size <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    return np.minimum(out[: len(out) - (width - size)], out[width - size :]) if size < width else out


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose gram has the least hash of some SPAN starts around, and these hashes."""
    hashes = gram_hashes(data, GRAM)
    if len(hashes) < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = sliding_least(hashes, SPAN)
    edge = np.zeros(SPAN - 1, np.uint64)
    top = ~sliding_least(~np.concatenate([edge, least, edge]), SPAN)
    at = np.flatnonzero(hashes == top)
    return at, hashes[at]


def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """t, gram, context, place of each anchor; place holds the position, 15 bits of what is just before and after the gram, and a mark.

    Where a batch has a context several times, one anchor stands for all (ONE_OF_MANY) and the others
    need no company (SETTLED): they get a gram of their own, so that none is dealt to a hot gram's task.
    """
    for batch in small_batches(batches, 1024):
        out: list[list[np.ndarray]] = [[], [], [], []]
        for t, text in zip(batch.column("t").to_numpy(zero_copy_only=False), batch.column("text"), strict=True):
            raw = text.as_buffer()
            data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size >= LENGTH else None
            if data is None:
                continue
            at, grams = anchors(data)
            wide = np.concatenate([np.full(LEFT, BEYOND, np.uint8), data, np.full(LENGTH, BEYOND, np.uint8)])
            around = memoryview(wide)
            contexts = np.fromiter((xxhash.xxh3_64_intdigest(around[i : i + LEFT + LENGTH]) for i in at.tolist()), np.uint64, len(at))
            halves = gram_hashes(wide, _HALF)
            before, after = halves[at + LEFT - _HALF] & np.uint64(_MASK), halves[at + LEFT + GRAM] & np.uint64(_MASK)
            place = at.astype(np.uint64) << np.uint64(32) | before << np.uint64(17) | after << np.uint64(2)
            for column, x in zip(out, (np.full(len(at), t), grams.view(np.int64), contexts.view(np.int64), place.view(np.int64)), strict=True):
                column.append(x)
        if out[0]:
            t, grams, contexts, place = map(np.concatenate, out)
            order = np.lexsort((contexts, grams))
            new = np.append(True, (grams[order][1:] != grams[order][:-1]) | (contexts[order][1:] != contexts[order][:-1]))
            times = np.bincount(np.cumsum(new) - 1)
            first = order[new]
            place[first[times > 1]] |= ONE_OF_MANY
            settled = order[~new]
            place[settled] |= SETTLED
            grams[settled] = mixed(place[settled].view(np.uint64) ^ mixed(t[settled].view(np.uint64))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (t, grams, contexts, place)], ["t", "gram", "context", "place"])


def gram_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Batches sorted by their second column, joined so that they end where it changes; or, beyond MOST_ROWS of one gram, parts of it, marked True."""
    held: list[pa.RecordBatch] = []
    rows, parted = 0, False

    def ready(last: bool) -> Iterator[tuple[pa.RecordBatch, bool]]:
        nonlocal held, rows, parted
        joined = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        grams = joined.column(1).to_numpy(zero_copy_only=False)
        ends = np.append(np.flatnonzero(grams[1:] != grams[:-1]) + 1, [len(grams)] if last else []).astype(int)
        done = 0
        if parted:  # what is left of the gram before
            done = int(ends[0]) if len(ends) else len(grams)
            parted = not len(ends)
            yield joined.slice(0, done), True
            ends = ends[ends > done]
        if len(ends):
            yield joined.slice(done, int(ends[-1]) - done), False
            done = int(ends[-1])
        elif not parted and len(grams) - done >= MOST_ROWS:
            yield joined.slice(done), True
            done, parted = len(grams), True
        held, rows = ([joined.slice(done)], len(grams) - done) if done < len(grams) else ([], 0)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
            if rows >= min(CHUNK, MOST_ROWS):
                yield from ready(last=False)
    if rows:
        yield from ready(last=True)


def counts_of(*keys: np.ndarray) -> np.ndarray:
    """For each row, how many rows have its keys."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    group = np.cumsum(new) - 1
    out = np.empty(len(order), np.int64)
    out[order] = np.bincount(group)[group]
    return out


def sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From anchors by gram: t, place, gram, what; 0: the context is repeated as a whole, 1: it must be compared, 2: both.

    Of equal contexts one is compared on behalf of all. A context goes on only if another kind shares
    the half context before or after the gram, since a repeated string covers one of the two; or, in a
    part of a gram, in any case, as the others are not at hand.
    """
    for batch, parted in gram_groups(batches):
        t, gram, context, place = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        settled = place & SETTLED > 0
        if settled.any():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (t[settled], place[settled], gram[settled], np.zeros(settled.sum(), np.int64))], ["t", "place", "gram", "what"])
            t, gram, context, place = (x[~settled] for x in (t, gram, context, place))
            if not len(t):
                continue
        same = counts_of(context, gram) + (place & ONE_OF_MANY)
        order = np.lexsort((place, t, context, gram))
        first = np.zeros(len(order), bool)
        first[order] = np.append(True, (context[order][1:] != context[order][:-1]) | (gram[order][1:] != gram[order][:-1]))
        f = np.flatnonzero(first)
        before, after = place[f] >> 17 & _MASK, place[f] >> 2 & _MASK
        meets = (counts_of(before, gram[f]) > 1) | (counts_of(after, gram[f]) > 1)
        single = np.zeros(len(order), np.int64)
        single[f] = same[f] == 1
        open_gram = np.zeros(len(order), bool)  # some context of the gram occurs once
        new = np.append(True, gram[order][1:] != gram[order][:-1])
        group = np.cumsum(new) - 1
        open_gram[order] = (np.bincount(group, single[order]) > 0)[group]
        compare = np.zeros(len(order), bool)
        compare[f] = meets & open_gram[f] | parted
        what = np.where(same > 1, np.where(compare, 2, 0), np.where(compare, 1, -1))
        keep = what >= 0
        yield pa.RecordBatch.from_arrays([pa.array(x[keep], pa.int64()) for x in (t, place, gram, what)], ["t", "place", "gram", "what"])


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, t, at, left, right, bytes of the contexts asked for; left and right are the bytes there are on both sides of the gram."""
    for batch in small_batches(batches):
        rows = []
        for t, text, asked in zip(batch.column("t").to_pylist(), batch.column("text"), batch.column("asked").to_pylist(), strict=True):
            raw = text.as_py().encode()
            for x in asked:
                at = x["place"] >> 32
                left, right = min(at, LEFT), min(len(raw) - at - GRAM, LEFT)
                rows.append((x["gram"], t, at, left, right, x["what"], bytes([BEYOND]) * (LEFT - left) + raw[at - left : at + GRAM + right] + bytes([BEYOND]) * (LEFT - right)))
        kinds = (*[pa.int64()] * 6, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["gram", "t", "at", "left", "right", "what", "bytes"])


class BlindTrie:
    """Orders strings that agree in their first bytes; a node knows only where its strings differ.

    A string follows its branching bytes to some leaf without regard to what lies between, is compared
    with that leaf once, and is put in at the depth where the two differ (Ferragina and Grossi 1999).
    """

    __slots__ = ("root", "strings")

    def __init__(self, strings: list[bytes]) -> None:
        self.strings, self.root = strings, None
        for i in range(len(strings)):
            self.add(i)

    def add(self, i: int) -> None:
        """Leaves are lists of equal strings, inner nodes [depth, {byte: node}] tuples."""
        if self.root is None:
            self.root = [i]
            return
        s, node = self.strings[i], self.root
        while isinstance(node, tuple):
            branch = node[1]
            node = branch.get(s[node[0]]) or next(iter(branch.values()))
        other = self.strings[node[0]]
        if s == other:
            node.append(i)
            return
        depth = agreeing(s, other)
        above, byte, node = None, 0, self.root
        while isinstance(node, tuple) and node[0] < depth:
            above, byte = node, s[node[0]]
            node = node[1][byte]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][s[depth]] = [i]
            return
        inner = (depth, {s[depth]: [i], other[depth]: node})
        if above is None:
            self.root = inner
        else:
            above[1][byte] = inner

    def ordered(self) -> tuple[list[int], list[int]]:
        """The strings in order, and what each has in common with the one before it (0 for the first)."""
        order, common = [], []
        stack = [(self.root, 0)]
        while stack:
            node, shared = stack.pop()
            if isinstance(node, list):
                order += node
                common += [shared, *[len(self.strings[node[0]])] * (len(node) - 1)]
            else:
                depth, branch = node
                for k, byte in enumerate(keys := sorted(branch, reverse=True)):
                    stack.append((branch[byte], shared if k == len(keys) - 1 else depth))
        return order, common


def agreeing(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two different strings of one length."""
    x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (x.bit_length() + 7) // 8


def deep_shallow(rows: np.ndarray, groups: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of bytes by group and content, and the prefix that each shares with the one before it; -1 where a group begins."""
    n, width = rows.shape
    order = np.argsort(groups, kind="stable")
    new = np.append(True, groups[order][1:] != groups[order][:-1])
    common = np.where(new, -1, 0)
    depth = 0
    active = np.flatnonzero(~new | np.append(~new[1:], False))  # places in `order` whose group is not alone
    while len(active) and depth < min(shallow, width):
        size = min(8, width - depth)
        part = np.zeros((len(active), 8), np.uint8)
        part[:, :size] = rows[order[active], depth : depth + size]
        word = part.view(">u8")[:, 0].astype(np.uint64)
        group = np.cumsum(new[active])
        within = np.lexsort((word, group))
        order[active] = order[active][within]
        word = word[within]
        differs = np.append(False, word[1:] != word[:-1]) & ~new[active]
        x = word ^ np.append(np.uint64(0), word[:-1])
        common[active[differs]] = depth + sum((x[differs] >> np.uint64(8 * k)) == 0 for k in range(1, 8))
        new[active] |= differs
        active = active[~new[active] | np.append(~new[active][1:], False)]
        depth += size
    if len(active) and depth >= width:
        common[active[~new[active]]] = width
    elif len(active):
        starts = np.flatnonzero(new[active])
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(active)).tolist(), strict=True):
            members = order[active[a:b]]
            found, shared = BlindTrie([rows[i].tobytes() for i in members.tolist()]).ordered()
            order[active[a:b]] = members[found]
            common[active[a + 1 : b]] = shared[1:]
    return order, common


def covered(groups: np.ndarray, left: np.ndarray, right: np.ndarray, context: np.ndarray, side: int = LEFT, core: int = GRAM, lo: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that share a string with another of their group, and the first and last offset in their contexts where one starts.

    `context` has `side` bytes before the core that all rows of a group share, `core` bytes of it that
    are there, and `side` bytes after it; strings start at the offsets from `lo` to `lo` + `side`.
    """
    n = len(groups)
    after, after_common = deep_shallow(context[:, side:], groups)
    before, before_common = deep_shallow(np.ascontiguousarray(context[:, side - 1 :: -1]) if side else context[:, :0], groups, 16)
    low, high = np.full(n, LEFT + 1), np.full(n, -1)
    kind_after, kind_before = np.empty(n, np.int64), np.empty(n, np.int64)
    for k in range(side + 1):
        rows = np.flatnonzero((lo + k >= LEFT - left) & (lo + k <= right))
        kind_after[after] = np.cumsum(after_common < core + k)
        kind_before[before] = np.cumsum(before_common < side - k)
        hit = rows[counts_of(kind_before[rows], kind_after[rows]) > 1] if len(rows) else rows
        low[hit] = np.minimum(low[hit], lo + k)
        high[hit] = lo + k
    found = np.flatnonzero(high >= 0)
    return found, low[found], high[found]


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """t, start, stop: the part of a context that shared strings cover."""
    for batch in whole_groups(batches, 0, CHUNK // 8):
        gram, t, at, left, right, what = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:6])
        context = np.frombuffer(b"".join(batch.column("bytes").to_pylist()), np.uint8).reshape(-1, LEFT + LENGTH)
        rows, low, high = covered(gram, left, right, context)
        keep = what[rows] == 1
        rows, low, high = rows[keep], low[keep], high[keep]
        start = at[rows] - LEFT + low
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (t[rows], start, at[rows] - LEFT + high + LENGTH)], ["t", "start", "stop"])


#: First and last offset of strings, and for each such range the keys of cores that have too many contexts.
Hot = dict[tuple[int, int], set[int]]


def halves(lo: int, hi: int) -> list[tuple[int, int]]:
    middle = (lo + hi) // 2
    return [(lo, middle), (middle + 1, hi)]


def core_key(context: memoryview, gram: int, lo: int, hi: int) -> int:
    """A key of the bytes that all strings from offset `lo` to `hi` of a context have in common."""
    return xxhash.xxh3_64_intdigest(context[hi : lo + LENGTH], (gram + lo * LENGTH + hi) & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def parts_of(context: memoryview, gram: int, left: int, right: int, hot: Hot) -> Iterator[tuple[int, int, int, int]]:
    """lo, hi, key, depth of the ranges of offsets to which a context of a hot gram belongs: those that are not split, or can't be."""
    waiting = [(lo, hi, 1) for lo, hi in halves(0, LEFT)]
    while waiting:
        lo, hi, depth = waiting.pop()
        if hi < LEFT - left or lo > right:  # the context ends before
            continue
        key = core_key(context, gram, lo, hi)
        if lo < hi and key in hot.get((lo, hi), ()):
            waiting += [(a, b, depth + 1) for a, b in halves(lo, hi)]
        else:
            yield lo, hi, key, depth


def _parts(rows: DataFrame, hot: Hot, depth: int | None = None) -> DataFrame:
    """lo, hi, key and the context's own columns for each part of each context, with the bytes on both sides of the core; with a depth, lo, hi, key of the parts at it alone."""
    columns = ["t", "at", "left", "right", "what"] if depth is None else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4096):
            out: list[list] = [[], [], [], []]
            row: list[int] = []
            for i, (gram, left, right, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("gram", "left", "right", "bytes")), strict=True)):
                for lo, hi, key, deep in parts_of(memoryview(raw), gram, left, right, hot):
                    if depth is None or deep == depth:
                        row.append(i)
                        for column, x in zip(out, (lo, hi, key, raw[lo:hi] + raw[lo + LENGTH : hi + LENGTH] if depth is None else None), strict=True):
                            column.append(x)
            taken = [batch.column(c).take(pa.array(row, pa.int64())) for c in columns]
            sides = [pa.array(out[3], pa.binary())] if depth is None else []
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), *taken, *sides], ["lo", "hi", "key", *columns, *["sides"] * len(sides)])

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ["lo", "hi", "key", *columns]) + (", sides binary" if depth is None else ""))


def compared_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What `compared` gives, from contexts dealt by their cores; those of one key have one range of offsets."""
    for batch in whole_groups(batches, 2, CHUNK // 8):
        lo, hi, key, t, at, left, right, what = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:8])
        for a, b in {(int(a), int(b)) for a, b in zip(lo, hi, strict=True)}:
            rows = np.flatnonzero((lo == a) & (hi == b))
            rows = rows[counts_of(key[rows]) > 1]
            if not len(rows):
                continue
            sides = np.frombuffer(b"".join(batch.column(8).take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), 2 * (b - a))
            found, low, high = covered(key[rows], left[rows], right[rows], sides, b - a, 0, a)
            low, high, rows = (x[what[rows[found]] == 1] for x in (low, high, rows[found]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (t[rows], at[rows] - LEFT + low, at[rows] - LEFT + high + LENGTH)], ["t", "start", "stop"])


def split_and_sorted(around: DataFrame, n: int) -> DataFrame:
    """What `compared` gives, for contexts of grams that have too many to be sorted together.

    There are fewer hot cores than contexts divided by `SORTED`; each round of counting splits them once
    more, and there are eight rounds at most. A hot core of a single offset is a string that all its
    contexts share, which needs no sorting and stays where it is.
    """
    rows = cut(around)
    hot: Hot = {}
    for depth in range(1, LEFT.bit_length() + 1):
        counts = _parts(rows, hot, depth).groupBy("lo", "hi", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SORTED).collect()
        for r in counts:
            hot.setdefault((r["lo"], r["hi"]), set()).add(r["key"])
        if not any(r["lo"] < r["hi"] for r in counts):
            break
    single = {(lo, key) for (lo, hi), keys in hot.items() if lo == hi for key in keys}

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi, key, at, what = (batch.column(c).to_numpy() for c in ("lo", "hi", "key", "at", "what"))
            hit = np.array([w == 1 and a == b and (a, k) in single for a, b, k, w in zip(lo.tolist(), hi.tolist(), key.tolist(), what.tolist(), strict=True)], bool)
            yield pa.RecordBatch.from_arrays([batch.column("t").filter(pa.array(hit)), pa.array((at - LEFT + lo)[hit]), pa.array((at - LEFT + lo + LENGTH)[hit])], ["t", "start", "stop"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi, key = (batch.column(c).to_pylist() for c in ("lo", "hi", "key"))
            yield batch.filter(pa.array([a < b or (a, k) not in single for a, b, k in zip(lo, hi, key, strict=True)], pa.bool_()))

    parts = _parts(rows, hot)
    dealt = parts.mapInArrow(others, parts.schema).repartition(n, "key").sortWithinPartitions("key")
    spans = "t long, start long, stop long"
    return dealt.mapInArrow(compared_parts, spans).unionByName(parts.mapInArrow(shared, spans))


def merged(raw: bytes, spans: list[dict], copies: int) -> tuple[int, list[tuple[int, int]]]:
    """Bytes removed and the maximal runs of them; a text that occurs twice goes as a whole."""
    if len(raw) < LENGTH:
        return 0, []
    if copies > 1:
        return len(raw), [(0, len(raw))]
    out: list[tuple[int, int]] = []
    for a, b in sorted((max(0, x["start"]), min(len(raw), x["stop"])) for x in spans or ()):
        if b - a < LENGTH:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return sum(b - a for a, b in out), out


def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        rows = []
        for t, text, copies, spans in zip(batch.column("t").to_pylist(), batch.column("text"), batch.column("copies").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            raw = text.as_py().encode()
            n, runs = merged(raw, spans, copies)
            edges = [0, *(x for run in runs for x in run), len(raw)]
            kept = hashlib.sha256(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))).hexdigest()
            rows.append((t, len(raw), n, [{"start": a, "stop": b} for a, b in runs], kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["t", "n_bytes", "n_removed", "spans", "kept_sha256"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans, kept_sha256 of each document; spans are maximal runs of removed bytes.

    Texts are UTF-8 bytes, null is empty, and matches stay within documents. Every byte covered by a
    string of 200 bytes that also starts elsewhere (in the same document too, overlapping or not) is
    removed, judged on the input. Ids may be null or repeat; equal texts, hence repeated rows, remove
    each other. No rows give no rows; the columns doc_id and text are read.
    """
    name = f"tidemark_{uuid.uuid4().hex}"
    try:
        return _repeated_spans(docs, name)
    finally:
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def _repeated_spans(docs: DataFrame, name: str) -> DataFrame:
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    for seed in range(8):
        number = F.xxhash64(text, F.lit(seed))
        check = F.md5(text.cast("binary"))
        texts = docs.select(number.alias("t"), text.alias("text"), check.alias("check")).groupBy("t").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"), F.min("check").alias("low"), F.max("check").alias("high"))
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        texts.write.bucketBy(n, "t").option("compression", "zstd").option("path", fresh(spark)).saveAsTable(name)
        if spark.table(name).where("low <> high").isEmpty():
            break
        spark.sql(f"DROP TABLE {name}")  # two texts of one number: number them anew
    else:
        raise RuntimeError("texts share numbers under every seed")
    kept = spark.table(name)
    marks = kept.select("t", "text").mapInArrow(anchor_rows, "t long, gram long, context long, place long")
    sorted_marks = marks.repartition(n, "gram").sortWithinPartitions("gram", "context")
    found = cut(sorted_marks.mapInArrow(sorted_out, "t long, place long, gram long, what long"))
    compare = found.where("what > 0")
    hot = cut(compare.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SORTED).select("gram"))

    def around(rows: DataFrame) -> DataFrame:
        asked = rows.groupBy("t").agg(F.collect_list(F.struct("gram", "place", "what")).alias("asked"))
        return kept.select("t", "text").join(asked, "t").mapInArrow(contexts, "gram long, t long, at long, left long, right long, what long, bytes binary")

    few = compare.join(hot, "gram", "left_anti")
    ends = around(few).repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(compared, "t long, start long, stop long")
    if not hot.isEmpty():
        ends = ends.union(split_and_sorted(around(compare.join(hot, "gram", "left_semi")), n))
    at = F.shiftright("place", 32)
    whole = found.where("what <> 1").select("t", (at - LEFT).alias("start"), (at + LENGTH).alias("stop"))
    spans = whole.union(ends).groupBy("t").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    done = kept.select("t", "text", "copies").join(spans, "t", "left")
    of_text = cut(done.mapInArrow(removed, "t long, n_bytes long, n_removed long, spans array<struct<start: long, stop: long>>, kept_sha256 string"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text, F.lit(seed)).alias("t")).join(of_text, "t").drop("t")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
