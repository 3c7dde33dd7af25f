from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.compare import same
from tests.llm.conftest import DOCS
from tidemark.llm import codes, fim, linedup, registry
from tidemark.llm.bits import BLOCK, Bits
from tidemark.llm.perfecthash import PerfectHash

QUERIES = ("op11_fill_in_middle", "op12_vector_codes", "op13_line_dedup")


@pytest.mark.parametrize("name", QUERIES)
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    same(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.booleans(), max_size=3 * BLOCK), st.integers(0, 3 * BLOCK))
def test_rank_and_select(flags, at):
    bits = Bits.of(np.array(flags, bool))
    ones = [i for i, f in enumerate(flags) if f]
    at = min(at, len(flags))
    assert bits.rank(np.array([0, at, len(flags)])).tolist() == [0, sum(flags[:at]), len(ones)]
    assert bits.select(np.arange(len(ones))).tolist() == ones
    assert bits.get(np.arange(len(flags))).tolist() == flags


def split(text: str, unit: str) -> list[str]:
    return re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)


def plain_fim(key, text, seed, rate, spm, unit):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    units = split(text, unit)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = ["", None, "\n", "\n\n", "a\n", "a\nb", "é\n漢字\U0001f600\n", "x<P>y", "<<S", "a<", "P>b\n", "<\nP>\nS><\nM>", "\r\n\x0b\x85 \n", "word\n" * 3000]


@pytest.mark.parametrize(("unit", "rate", "spm"), [("line", 100, 50), ("line", 60, 20), ("character", 100, 50)])
def test_fill_in_middle_and_back(spark, docs, rows, no_docs, unit, rate, spm):
    more = [(1000 + i, t, None, None, 0, 0, "", "") for i, t in enumerate(ODD * 4)]
    every = docs.union(spark.createDataFrame(more, DOCS))
    out = fim.transform(every, rate=rate, spm=spm, unit=unit).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    found = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in out.collect()), key=repr)
    expected = sorted(((k, *plain_fim(k, t, 7, rate, spm, unit), t or "") for k, t, *_ in [*rows, *more]), key=repr)
    assert found == expected
    assert {r[2] for r in found} == {"plain", "psm", "spm"}
    assert all(r["suffix_chars"] == len(r["back"]) - r["prefix_chars"] - r["middle_chars"] for r in out.where("form <> 'plain'").collect())
    assert fim.transform(no_docs, unit=unit).count() == 0


def test_fill_in_middle_takes_sliced_batches_and_known_units_only(docs):
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["q" * 70, "a\nb\n", None, "é\nü"])], ["id", "text"]).slice(1)
    got = fim._transformed(batch, 7, 100, 50, "line")
    assert [(r["n"], r["output"]) for r in got.to_pylist()] == [(x[0], x[4]) for x in (plain_fim(k, t, 7, 100, 50, "line") for k, t in ((2, "a\nb\n"), (3, None), (4, "é\nü")))]
    with pytest.raises(ValueError, match="unit"):
        fim.transform(docs, unit="word")


def plain_codes(rows, entries, rounds, parts=8, scale=4096):
    kept = [(k, label, [math.floor(x * scale) for x in v]) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts if kept else 0
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    book = [[cut(v)[p] for _, _, v in kept[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            members = defaultdict(list)
            for _, _, v in kept:
                members[nearest(p, cut(v)[p])[1]].append(cut(v)[p])
            new.append([[sum(c) // len(members[e]) for c in zip(*members[e], strict=True)] if members[e] else c for e, c in enumerate(book[p])])
        book = new
    out = []
    for k, label, v in kept:
        best = [nearest(p, cut(v)[p]) for p in range(parts)]
        out.append((k, label, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    sums = defaultdict(int)
    for _, label, _, error in out:
        sums[label] += error
    return sorted([(*r, sums[r[1]]) for r in out], key=repr), book


def vectors(kind: str) -> list[tuple]:
    rng = np.random.default_rng(3)
    if kind == "grid":  # few values: many points are as near to one entry as to another
        v = rng.integers(-2, 3, (400, 16)) / 4096
    elif kind == "copies":
        v = np.repeat(rng.normal(0, 0.3, (4, 16)), 100, axis=0)
    else:
        v = rng.normal(0, 0.3, (400, 24)) * np.repeat([1, 8], 200)[:, None]
    rows = [(int(i), [float(np.float32(x)) for x in r], None if i % 5 == 0 else int(i % 3)) for i, r in enumerate(v)]
    width = len(rows[0][1])
    bad = [[None] + [0.0] * (width - 1), [float("nan")] * width, [0.0] * (width - 1) + [float("-inf")], None]
    return [*rows, rows[17], (None, rows[3][1], None), *[(-5 - i, b, 1) for i, b in enumerate(bad)]]


VECTORS = "vec_id long, embedding array<float>, label int, part int, code string, v string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "", "") for r in rows], VECTORS)


@pytest.mark.parametrize("kind", ["grid", "copies", "scaled"])
@pytest.mark.parametrize("entries", [16, 3])
def test_codes_are_those_of_plain_lloyd(spark, monkeypatch, kind, entries):
    monkeypatch.setattr(codes, "BLOCK_ROWS", 90)
    rows = vectors(kind)
    out, book = codes.compress(frame(spark, rows).repartition(3), entries=entries)
    expected, plain_book = plain_codes(rows, entries, 6)
    assert book.tolist() == plain_book
    assert sorted(map(tuple, out.select("vec_id", "label", "code", "error", "label_error").collect()), key=repr) == expected
    first = out.where("vec_id = 0").first()
    whole = [math.floor(x * 4096) for x in rows[0][1]]
    assert sum((a - b) ** 2 for a, b in zip(whole, codes.decode(first["code"], book), strict=True)) == first["error"]


def test_few_empty_and_unfit_vectors(spark, monkeypatch):
    none, book = codes.compress(frame(spark, []))
    assert none.count() == 0 and book.size == 0
    few = vectors("scaled")[:5]
    assert sorted(map(tuple, codes.compress(frame(spark, few))[0].select("vec_id", "label", "code", "error", "label_error").collect()), key=repr) == plain_codes(few, 16, 6)[0]
    assert [tuple(r) for r in codes.compress(frame(spark, [(1, [], 4)]))[0].collect()] == [(1, 4, "00" * 8, 0, 0)]
    with pytest.raises(ValueError, match="8 equal parts"):
        codes.compress(frame(spark, [(1, [0.5] * 9, 0)]))
    with pytest.raises(ValueError, match="other lengths"):
        codes.compress(frame(spark, [(1, [0.5] * 8, 0), (2, [0.5] * 16, 0)]))
    with pytest.raises(Exception, match="67108864 or more"):
        codes.compress(frame(spark, [(1, [1e30] * 8, 0)]))
    monkeypatch.setattr(codes, "COMMON", 2)  # labels below half of the rows go by shuffle
    rows = vectors("grid")
    assert sorted(map(tuple, codes.compress(frame(spark, rows))[0].select("vec_id", "label", "code", "error", "label_error").collect()), key=repr) == plain_codes(rows, 16, 6)[0]


def test_whole_subtrees_are_assigned():
    """On points in two far groups nearly all go to an entry as nodes, and no leaf is opened."""
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(0, 50, (512, 16)), rng.integers(100_000, 100_050, (512, 16))])
    flat = points.reshape(1024, 8, 2).transpose(1, 0, 2).astype(np.int64)
    order, moved, low, high, sums = codes.grow(flat)
    block = codes.Block(1024, 2, order.astype(np.uint16).tobytes(), moved.astype(np.int32).tobytes(), low.astype(np.int32).tobytes(), high.astype(np.int32).tobytes(), sums.tobytes())
    nodes, opened = [], []
    book = np.tile(np.array([[0, 0], [100_000, 100_000]]), (8, 1, 1))
    block.filtered(book, lambda part, level, node, entry: nodes.extend(part.tolist()), lambda part, place, entry: opened.extend(place.tolist()))
    assert len(nodes) == 16 and not opened


def plain_lines(rows, least=40, most=5):
    key = lambda line: line.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or len(held[key(x)]) < most or doc_id == max(held[key(x)], key=lambda d: (d is not None, d or 0))]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def line_rows():
    hot = "A line that most of the documents have, é in it"
    rare = "this line is found in four documents and stays there"
    short = "é" * 39
    exact = "É" * 40
    rows = [(i, f"own {i}\n {hot.upper() if i % 2 else hot}\t\n{hot}\r\n\n") for i in range(300)]
    rows += [(1000 + i, rare if i < 4 else f"{short}\n{exact}\n\x85{exact}") for i in range(12)]
    rows += [(2000 + i, "\n".join(f"{i % 7} shared line {k} of a long page, one of many" for k in range(i, i + 40))) for i in range(60)]
    return [*rows, rows[7], (None, hot), (None, "only\n" + hot), (5000, None), (5001, ""), (5002, "\n" * 5), (5003, (hot + "\n") * 2000 + "end")]


@pytest.mark.parametrize("most_bytes", [linedup.MOST_BYTES, 1])
def test_lines_of_many_documents_stay_in_one(spark, monkeypatch, most_bytes):
    """The second bound makes each shard a group of its own, and documents get their lines by id."""
    monkeypatch.setattr(linedup, "SHARD_KEYS", 20)
    rows = line_rows()
    docs = spark.createDataFrame([(i, t, "", 1, b"", False) for i, t in rows], "doc_id long, text string, high string, shard int, kept binary, gone boolean").repartition(5)
    found = linedup.drop_lines(docs, most_bytes=most_bytes)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_lines(rows)
    assert linedup.drop_lines(docs.limit(0), most_bytes=most_bytes).count() == 0


def test_lines_of_given_documents(docs, rows):
    found = linedup.drop_lines(docs, min_chars=5, min_docs=2)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_lines([r[:2] for r in rows], 5, 2)


@pytest.mark.parametrize("n", [0, 1, 5, 20_000])
def test_perfect_hash_is_minimal_and_prints_tell_others(n):
    rng = np.random.default_rng(n)
    high, low, other, more = (rng.integers(0, 2**64, n, np.uint64) for _ in range(4))
    high[: n // 2] = high[0] if n else 0  # keys that differ in their second half only
    hashed = PerfectHash.of(high, low)
    assert sorted(hashed.number(high, low).tolist()) == list(range(n))
    if n:
        order = np.argsort(hashed.number(high, low))
        shard = linedup.Shard({"sizes": hashed.sizes, "words": hashed.bits.words.tobytes(), "prints": low[order].tobytes(), "counts": np.arange(n, dtype=np.int32).tobytes(), "keepers": pa.array(np.arange(n))})
        assert (shard.probe(high, low) >= 0).all() and (shard.probe(other, more) < 0).all()
        assert hashed.bits.words.size * 64 < 8 * n + 4096
