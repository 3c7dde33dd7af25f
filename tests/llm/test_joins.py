from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import graph, jaccard, suffix


def plain_classes(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    n = len(texts)
    near = [[i != j and ((texts[i] or "") == (texts[j] or "") or bool(sets[i]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])) for j in range(n)] for i in range(n)]
    group = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if near[i][j] and group[j] != group[i]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    return [sum(r) for r in near], group


def test_links_and_classes_by_all_pairs(docs, rows, no_docs):
    links, group = plain_classes([r[1] for r in rows])
    ids = [r[0] for r in rows]
    least = {g: min((ids[i] for i in range(len(ids)) if group[i] == g and ids[i] is not None), default=None) for g in set(group)}
    expected = sorted(repr((ids[i], least[group[i]], links[i])) for i in range(len(ids)))
    assert sorted(repr(tuple(r)) for r in jaccard.near_duplicates(docs).collect()) == expected
    assert jaccard.near_duplicates(no_docs).count() == 0 and jaccard.one_of_each(no_docs).count() == 0
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    found = kept.collect()
    assert len(found) == len(set(group)) and {repr(tuple(r)) for r in found} <= {repr(r) for r in rows}
    assert {r["doc_id"] for r in found} == set(least.values())


def test_blocks_find_the_same_links(docs, rows, monkeypatch):
    whole = sorted(map(repr, jaccard.near_duplicates(docs).collect()))
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 3)
    assert sorted(map(repr, jaccard.near_duplicates(docs).collect())) == whole


def test_blocks_of_buckets_find_the_same_links(docs, rows, monkeypatch):
    whole = sorted(map(repr, jaccard.near_duplicates(docs).collect()))
    monkeypatch.setattr(jaccard, "BUCKET_TEXTS", 2)
    assert sorted(map(repr, jaccard.near_duplicates(docs).collect())) == whole


def test_a_full_sieve_changes_nothing(docs, rows, monkeypatch):
    whole = sorted(map(repr, jaccard.near_duplicates(docs).collect()))
    kept = sorted(r["doc_id"] or -1 for r in jaccard.one_of_each(docs).collect())
    monkeypatch.setattr(jaccard, "passes", lambda held, *key: key[0].isNotNull())
    assert sorted(map(repr, jaccard.near_duplicates(docs).collect())) == whole
    assert sorted(r["doc_id"] or -1 for r in jaccard.one_of_each(docs).collect()) == kept


def test_empty_blocks_add_no_links(docs, monkeypatch):
    whole = sorted(map(repr, jaccard.near_duplicates(docs).collect()))
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 256)
    assert sorted(map(repr, jaccard.near_duplicates(docs).collect())) == whole


def test_classes_do_not_depend_on_ids(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    near = [" ".join([*base[:k], "edit", *base[k + 1 :]]) for k in (20, 70)]
    rows = [(7, "one text of its own here"), (7, "another text that has nothing of it"), (7, "a third one"), (None, near[0]), (None, near[1]), (None, "no id and no copy")]
    kept = [r["text"] for r in jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept) == sorted([t for _, t in rows if t not in near] + [t for t in near if t in kept]) and len(kept) == 5


def test_all_links_of_given_documents(spark):
    """Links of every document of a table, against all pairs of texts that have an n-gram in common."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = Counter(r["text"] for r in docs.collect())
    grams, of = {}, {}
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams[text] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        for g in grams[text]:
            of.setdefault(g, []).append(text)
    common = Counter((a, b) for some in of.values() for i, a in enumerate(some) for b in some[i + 1 :])
    links = Counter({t: n - 1 for t, n in texts.items()})
    unequal = 0
    for (a, b), n in common.items():
        if 5 * n >= 4 * (len(grams[a]) + len(grams[b]) - n):
            links[a] += texts[b]
            links[b] += texts[a]
            unequal += 1
    found = docs.join(jaccard.near_duplicates(docs), "doc_id").select("text", "n_links").collect()
    assert unequal > 0 and all(r["n_links"] == links[r["text"]] for r in found) and len(found) == docs.count()


def test_bands_reach_their_recall():
    bands, rows = jaccard.bands_and_rows(0.8)
    assert bands * rows <= jaccard.MOST_HASHES and 1 - (1 - 0.8**rows) ** bands >= jaccard.RECALL
    rng = np.random.default_rng(1)
    hits = 0
    for _ in range(300):
        both = rng.integers(0, 1 << 63, 80, np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, 10, np.uint64)])) for _ in range(2))
        x, y = (jaccard.min_hashes(s, bands * rows) for s in (a, b))
        hits += bool(set(jaccard.band_hashes(x, bands, rows).tolist()) & set(jaccard.band_hashes(y, bands, rows).tolist()))
        assert (x.astype(np.uint8) == y.astype(np.uint8)).sum() >= jaccard.least_equal(bands * rows, 0.8)
    assert hits == 300


def test_buckets_connect_what_is_alike():
    rng = np.random.default_rng(3)
    marks = rng.integers(0, 256, (40, 120)).astype(np.uint8)
    for i in range(1, 12):  # a chain: each like the one before it, far from the first
        marks[i] = marks[i - 1]
        marks[i, rng.choice(120, 30, replace=False)] = rng.integers(0, 256, 30)
    marks = marks[rng.permutation(40)]
    near = (marks[:, None] == marks[None]).sum(2) >= 75
    root = jaccard.alike(marks, 75)
    expected = np.arange(40)
    for _ in range(40):
        expected = np.where(near, expected[None], 40).min(1)
    assert (root == expected).all() and len(set(root.tolist())) == 29


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in edges:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    found = graph.components(spark.createDataFrame(edges, "a int, b int"))
    assert {r["node"]: r["root"] for r in found.collect()} == root and found.count() == len(root)
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_deep_shallow_orders_like_sorting(seed):
    rng = np.random.default_rng(seed)
    width = int(rng.choice([7, 40, 136]))
    rows = rng.integers(0, 2, (200, width)).astype(np.uint8)
    rows[50:90] = rows[40]
    rows[60:90, width - 3 :] = rng.integers(0, 3, (30, 3))
    rows[100:150, : width // 2] = 1
    groups = rng.integers(0, 3, 200)
    order, common = suffix.deep_shallow(rows, groups, 16)
    keys = [(groups[i], rows[i].tobytes()) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(200))
    for k in range(200):
        if k == 0 or keys[k][0] != keys[k - 1][0]:
            assert common[k] == -1
        else:
            a, b = keys[k - 1][1], keys[k][1]
            assert common[k] == next((i for i in range(width) if a[i] != b[i]), width)


def plain_removed(raws):
    times = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    out = []
    for r in raws:
        mask = bytearray(len(r))
        for i in range(len(r) - 199):
            if times[r[i : i + 200]] > 1:
                mask[i : i + 200] = b"\1" * 200
        runs = sum(1 for i in range(len(r)) if mask[i] and (i == 0 or not mask[i - 1]))
        out.append((len(r), sum(mask), runs, hashlib.sha256(bytes(b for b, m in zip(r, mask, strict=True) if not m)).hexdigest()))
    return out


def test_repeated_strings_by_counting_all(docs, rows, no_docs):
    expected = sorted(repr((r[0], *x)) for r, x in zip(rows, plain_removed([(r[1] or "").encode() for r in rows]), strict=True))
    found = suffix.repeated_spans(docs).collect()
    assert sorted(repr((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"])) for r in found) == expected
    assert suffix.repeated_spans(no_docs).count() == 0


def test_grams_of_many_contexts(spark, docs, rows, monkeypatch):
    expected = sorted(repr((r[0], *x)) for r, x in zip(rows, plain_removed([(r[1] or "").encode() for r in rows]), strict=True))

    def found():
        return sorted(repr((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"])) for r in suffix.repeated_spans(docs).collect())

    for most in (1, 3):
        monkeypatch.setattr(suffix, "SORTED", most)
        assert found() == expected
    monkeypatch.setattr(suffix, "MOST_ROWS", 2)
    assert found() == expected


@pytest.mark.parametrize("most", [1, 2, 5, 40])
def test_parts_of_hot_grams_are_sorted(spark, monkeypatch, most):
    """Contexts of one gram that agree on both sides of it by any number of bytes, at the ends of texts too."""
    rng = random.Random(most)
    base = bytes(rng.choice(b"abcd") for _ in range(2 * suffix.LEFT + suffix.GRAM))
    rows = []
    for t in range(160):
        a, b = rng.choice([0, 1, 40, 68, 69, 100, 135, 136]), rng.choice([0, 1, 36, 67, 68, 96, 135, 136])
        raw = bytearray(bytes(rng.choice(b"efg" if t % 3 else b"e") for _ in base))
        raw[suffix.LEFT - a : suffix.LEFT + suffix.GRAM + b] = base[suffix.LEFT - a : suffix.LEFT + suffix.GRAM + b]
        left, right = rng.choice([136, 136, a]), rng.choice([136, 136, b])
        raw[: suffix.LEFT - left] = bytes([255]) * (suffix.LEFT - left)
        raw[len(raw) - (suffix.LEFT - right) :] = bytes([255]) * (suffix.LEFT - right)
        rows.append((7, t, 1000, left, right, 2 if t % 10 == 0 else 1, raw))
    around = spark.createDataFrame(rows, "gram long, t long, at long, left long, right long, what long, bytes binary").repartition(3)
    expected = {}
    for r in around.coalesce(1).mapInArrow(suffix.compared, "t long, start long, stop long").collect():
        expected[r["t"]] = (r["start"], r["stop"])
    monkeypatch.setattr(suffix, "SORTED", most)
    found = {}
    for r in suffix.split_and_sorted(around, 4).collect():
        a, b = found.get(r["t"], (r["start"], r["stop"]))
        found[r["t"]] = (min(a, r["start"]), max(b, r["stop"]))
    assert found == expected and 20 < len(expected) < 144


def test_parts_lose_no_comparison(rows, monkeypatch):
    import pyarrow as pa

    texts = sorted({r[1] for r in rows if r[1]})
    (marks,) = suffix.anchor_rows(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["t", "text"])]))
    marks = pa.Table.from_batches([marks]).sort_by([("gram", "ascending"), ("context", "ascending")]).combine_chunks().to_batches()[0]

    def found():
        out = [r for b in suffix.sorted_out(iter([marks.slice(i, 3) for i in range(0, marks.num_rows, 3)])) for r in b.to_pylist()]
        return {(r["t"], r["place"]) for r in out if r["what"] > 0}, {(r["t"], r["place"]) for r in out if r["what"] != 1}

    compared, whole = found()
    monkeypatch.setattr(suffix, "MOST_ROWS", 2)
    more, less = found()
    assert compared and compared <= more and less <= whole and whole - less <= more


def test_parts_of_grams():
    import pyarrow as pa

    grams = [1, 1, 2, 3, 3, 3, 3, 3, 4, 5, 5, 5, 5, 6]
    for most in (2, 3, 100):
        for size in (1, 2, 5, 14):
            suffix_rows = suffix.MOST_ROWS
            try:
                suffix.MOST_ROWS = most
                batches = [pa.RecordBatch.from_arrays([pa.array(range(at, min(14, at + size))), pa.array(grams[at : at + size])], ["t", "gram"]) for at in range(0, 14, size)]
                out = [(b.to_pydict(), parted) for b, parted in suffix.gram_groups(iter(batches))]
            finally:
                suffix.MOST_ROWS = suffix_rows
            assert [x for b, _ in out for x in b["t"]] == list(range(14))
            whole = [set(b["gram"]) for b, parted in out if not parted]
            parts = [set(b["gram"]) for b, parted in out if parted]
            assert all(len(p) == 1 for p in parts) and sum(map(len, whole)) == len(set().union(set(), *whole)) and not set().union(set(), *whole) & set().union(set(), *parts)


def test_strings_of_just_the_length(spark):
    rng = random.Random(9)

    def noise(n):
        return "".join(rng.choice("abcdefgh") for _ in range(n))

    short, exact, start = noise(199), noise(200), noise(230)
    texts = [noise(300) + short + noise(50), short + noise(300), noise(77) + exact + noise(200), noise(10) + exact, start + noise(5), start, "z" * 450, noise(20) + "ab" * 120 + noise(3), exact[:199] + "ü" + noise(30)]
    texts += [noise(150) + start[k : k + 205] + noise(40) for k in range(0, 26, 5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in suffix.repeated_spans(docs).collect()}
    assert found == dict(enumerate(plain_removed([t.encode() for t in texts])))
