from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fulltext, nearest, postings, retrieval
from tidemark.sources import shared

WORDS = "alpha beta gamma delta the of license version über 42".split()


def texts(n: int) -> list[tuple]:
    rng = random.Random(11)
    rows = [(i, "t" if i % 3 else "u", " ".join(rng.choice(WORDS[: 3 + i % 8]) for _ in range(rng.randrange(1, 60)))) for i in range(n)]
    return [*rows, (n, "t", None), (n + 1, "t", " ... "), (n + 2, "t", "the " * 3000 + "License, the VERSION"), (n + 3, "u", "alpha-beta alpha")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(260), "id long, tenant string, text string").repartition(5)


QUERIES = ["the", "alpha beta", '"alpha beta"', '"alpha beta" gamma or license -version', "über 42", "-the", "", "none", '"the the the"', 'alpha or alpha "beta alpha"', '"of the" "the of"', "license version or delta -alpha"]


@pytest.mark.parametrize("block", [7, 1024])
def test_posting_lists_give_what_a_scan_gives(spark, docs, monkeypatch, block):
    monkeypatch.setattr(postings, "BLOCK", block)
    monkeypatch.setattr(postings, "POSITION", 6 if block == 7 else postings.POSITION)  # texts of 64 words or more are blocks of their own
    index = shared.kept(postings.dealt(postings.postings(docs, id_col="id")), "test", "bucket")
    for asked in QUERIES if block > 7 else QUERIES[2:5] + QUERIES[9:10]:
        assert sorted(r["id"] for r in postings.matching(index, asked).collect()) == sorted(r["id"] for r in fulltext.matching(docs, asked).collect()), asked
        for k in (2, 500)[: 1 + (block == 7)]:
            expected = [tuple(r) for r in fulltext.search(docs, asked, k, id_col="id").collect()]
            assert [tuple(r) for r in postings.search(index, asked, k, first=2).collect()] == expected, (asked, k)


def test_posting_lists_by_scope_and_of_live_documents(spark, docs, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 10)
    first = postings.postings(docs.where("id < 100"), id_col="id", scope_col="tenant", segment=1)
    later = postings.postings(docs.where("id >= 100"), id_col="id", scope_col="tenant", segment=2)
    index = shared.kept(postings.dealt(first.unionByName(later)), "test", "bucket")
    live = docs.where("id % 4 > 0")
    mine = live.where("tenant = 't'")
    for asked in QUERIES[2:4]:
        expected = [tuple(r) for r in fulltext.search(mine, asked, 9, id_col="id").collect()]
        for lists in (index, postings.without(index, live.select("id"))):
            assert [tuple(r) for r in postings.search(lists, asked, 9, scope="t", live=live.select("id")).collect()] == expected
    purged = postings.without(index, live.select("id"))
    kept = purged.where("term <> ''").select("block", F.explode("places").alias("p")).select("block", postings.doc_of("p").alias("doc")).join(postings.documents(purged), ["block", "doc"])
    assert kept.join(live, "id", "left_anti").count() == 0 and kept.select("id").distinct().count() == live.where("size(split(text, '[a-z0-9ü]')) > 1").count()
    assert postings.without(index, docs.select("id")).count() == index.count()


def test_a_search_reads_its_terms_and_the_blocks_that_can_matter(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a the b version c " * (1 + 9 * (i % 67 == 0))) for i in range(300)], "id long, text string").coalesce(1)
    monkeypatch.setattr(postings, "BLOCK", 10)
    index = shared.kept(postings.dealt(postings.postings(docs, id_col="id")), "test", "bucket")
    asked = fulltext.parsed("the version")
    plan = postings.search(index, "the version", 1)._jdf.queryExecution().executedPlan().toString()
    folders = sorted({postings.folder(w) for w in ("the", "version")})
    assert "bucket#" in plan and f"IN ({','.join(map(str, folders))})" in plan and "In(term, [the,version])" in plan
    blocks = postings.bounds(postings.lists_of(index, asked), asked)
    (best,) = postings.search(index, "the version", 1).collect()
    assert 0 < blocks.where(F.col("bound") >= best["rank"]).count() < blocks.count() / 2
    above = postings.ranked(postings.lists_of(index, asked), asked).join(blocks, "block")
    assert above.where("rank > bound + 1e-9").count() == 0 and above.count() > 20


def made(n: int, kind: str) -> list[tuple]:
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (12, 16))
    v = centres[rng.integers(0, 12, n)] + rng.normal(0, 0.25, (n, 16)) if kind == "clusters" else rng.normal(0, 1, (n, 16))
    v[n // 3 : n // 2] = v[0]  # very many equal ones
    v[7] = 0
    return [(i, [float(x) for x in np.float32(r)]) for i, r in enumerate(v)] + [(n, None), (n + 1, [float("nan")] * 16)]


@pytest.mark.parametrize("kind", ["clusters", "noise"])
def test_vector_lists(spark, monkeypatch, kind):
    monkeypatch.setattr(nearest, "BLOCK", 50)
    monkeypatch.setattr(nearest, "QUERIES", 3)
    monkeypatch.setattr(nearest, "HELD", 300 if kind == "noise" else nearest.HELD)
    rows = spark.createDataFrame(made(600, kind), "id long, v array<float>").repartition(4)
    centres = nearest.centroids(rows, 20, id_col="id", vector_col="v")
    index = shared.kept(nearest.dealt(nearest.assigned(rows, centres, id_col="id", vector_col="v")), "test", "list")
    width = nearest.widths(index)
    assert index.count() == 600 == sum(n for n, _ in width.values())
    asked = rows.where("id % 20 = 0 and id < 600 or id = 7")
    whole = rows.where("id < 600")
    exact = {}
    for r in asked.collect():
        exact[r["id"]] = [tuple(x) for x in retrieval.vector_topk(whole, list(r["v"]), 10, id_col="id", vector_col="v").collect()]
    for q in (0, 7, 40):
        vector = list(rows.where(F.col("id") == q).first()["v"])
        assert [tuple(r) for r in nearest.exact_search(index, centres, width, vector, 10, probes=1).collect()] == exact[q]
        found = nearest.search(index, centres, vector, 10, probes=2)
        assert found.count() == 10
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [list#" in plan
    every = {}
    for r in nearest.neighbours(index, centres, asked, 10, id_col="id", vector_col="v", probes=len(centres)).collect():
        every.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    for q, found in every.items():
        assert [s for _, _, s in sorted(found)] == pytest.approx([s for _, s in exact[q]], abs=1e-6)
    assert set(every) == set(exact)
    probes = nearest.probes_for(index, centres, asked, 10, 0.95, id_col="id", vector_col="v")
    hits = total = 0
    for r in nearest.neighbours(index, centres, asked, 10, id_col="id", vector_col="v", probes=probes).groupBy("query_id").agg(F.min("score").alias("least"), F.collect_list("score").alias("scores")).collect():
        least = exact[r["query_id"]][-1][1]
        hits, total = hits + sum(s >= least - 1e-6 for s in r["scores"]), total + 10
    assert hits / total >= 0.95
    if kind == "clusters":
        assert probes <= len(centres) / 2 and sum(u >= exact[40][-1][1] for u in nearest.upper(np.array(rows.where("id = 40").first()["v"]), centres, width).values()) < len(width)


def test_recall_over_all_vectors(spark):
    """Of the registered search, against the exact scan."""
    from tidemark.plans import indexes

    sf = "/root/testdata/sf0.1"
    found = {}
    for r in indexes.vector_neighbours(spark, sf).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in rows])
    v = nearest.unit(np.array([r["embedding"] for r in rows], np.float64))
    scores = v[ids % 100 == 0] @ v.T
    hits = sum(len(found[q] & set(ids[np.lexsort((ids, -s))[:10]].tolist())) for q, s in zip(ids[ids % 100 == 0].tolist(), scores, strict=True))
    assert len(found) == 20 and hits / 200 >= 0.9


def test_empty_indexes(spark):
    none = spark.createDataFrame([], "id long, v array<float>, text string")
    centres = nearest.centroids(none, 5, id_col="id", vector_col="v")
    index = shared.kept(nearest.dealt(nearest.assigned(none, centres, id_col="id", vector_col="v")), "test", "list")
    assert nearest.search(index, centres, [1.0], 3).count() == nearest.exact_search(index, centres, nearest.widths(index), [1.0], 3).count() == 0 if centres.shape[1] else index.count() == 0
    lists = shared.kept(postings.dealt(postings.postings(none, id_col="id")), "test", "bucket")
    assert postings.search(lists, "a", 3).count() == postings.matching(lists, "a").count() == 0


@pytest.mark.parametrize("ids", ["id", "id div 1000 * 7"])
def test_the_driver_gets_a_sample_and_not_one_of_each_task(spark, monkeypatch, ids):
    monkeypatch.setattr(nearest, "SAMPLE", 1000)
    rows = spark.range(0, 20_000, 1, 20).select(F.expr(ids).alias("id"), F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.cos(F.col("id") * i)).alias("v"))
    group = f"sample of {ids}"
    spark.sparkContext.setJobGroup(group, group)
    found = nearest.centroids(rows, 50, id_col="id", vector_col="v", rounds=0)
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    tracker = spark.sparkContext.statusTracker()
    stages = {i for job in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(job).stageIds}
    spark.sparkContext._jsc.clearJobGroup()
    sent = sum(context.statusStore().lastStageAttempt(i).resultSize() for i in stages)
    first = rows.orderBy(F.md5(F.col("id").cast("string")), "v").limit(1000).collect()
    expected = nearest.unit(np.array([r["v"] for r in first]))
    _, at = np.unique(expected, axis=0, return_index=True)
    assert np.array_equal(found, expected[np.sort(at)[:50]])
    assert sent < 2 << 20


def test_words_come_to_python_as_one_string_and_are_cut_once(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_TOKENS", 5)
    texts = [None, "", "a B a", "...", "über, 42; b", "b", "a a a a a a a", ""]
    lists = postings.postings(spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1), id_col="id")
    plan = lists._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == plan.count("array_join(regexp_extract_all") == 1
    rows = lists.collect()
    assert [(r["ids"], r["most"]) for r in rows if not r["term"]] == [([2], 1), ([4, 5], 2), ([6], 1)]
    found = {(r["term"], r["block"]): ([(p >> postings.POSITION, p % (1 << postings.POSITION)) for p in r["places"]], r["most"]) for r in rows if r["term"]}
    assert found == {("a", 0): ([(0, 0), (0, 2)], 2), ("b", 0): ([(0, 1)], 1), ("über", 1): ([(0, 0)], 1), ("42", 1): ([(0, 1)], 1), ("b", 1): ([(0, 2), (1, 0)], 1), ("a", 2): ([(0, i) for i in range(7)], 7)}
