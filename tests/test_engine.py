from __future__ import annotations

import base64
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.operators import indexing, intake
from tidemark.operators.access import PERMISSIONS, Forbidden, Grants
from tidemark.plans.engine import Engine
from tidemark.sources import files, tables
from tidemark.sources.embed import hashing_provider

NOW = datetime(2026, 8, 10)
REQUEST = "seq long, idempotency_key string, original_name string, declared_media_type string, content binary, content_length long, metadata map<string,string>"


def test_from_intake_to_deletion(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), Grants({("p", "t"): set(PERMISSIONS)}), hashing_provider(16), 16)

    def ingest(*rows):
        batch = [(i, key, "../notes.txt", kind, bytearray(content), length, {"tags": "b, a"}) for i, (key, kind, content, length) in enumerate(rows)]
        return {r["seq"]: (r["outcome"], r["artifact_id"]) for r in engine.ingest("p", "t", spark.createDataFrame(batch, REQUEST), NOW).collect()}

    first = ingest(("k1", "text/plain", b"hello world", 11), ("k2", "text/html", b"<html><p>other page", -1), ("k3", "image/png", b"%PDF-1.7", -1), ("k4", "text/plain", b"short", 9))
    assert [first[i][0] for i in range(4)] == ["CREATED", "CREATED", "REJECTED", "REJECTED"]
    assert engine.store.read("outbox").count() == 4
    again = ingest(("k1", "text/plain", b"hello world", 11), ("k1", "text/plain", b"different", -1), ("k9", "text/plain", b"hello world", -1))
    one = first[0][1]
    assert again == {0: ("IDEMPOTENT_REPLAY", one), 1: ("CONFLICT", one), 2: ("CONTENT_DUPLICATE", one)}
    assert engine.search("p", "t", "hello").count() == 0
    assert engine.content("p", "t", one, 6, 3).first()["payload"] == "d29y" and engine.store.read("object").count() == 0
    engine.store_pending()
    assert engine.store.read("spool").count() == 0 and engine.store.read("object").count() == 2
    engine.index_pending()
    assert engine.store.read("outbox").count() == 0
    (row,) = engine.metadata("p", "t", one).collect()
    assert (row["storage_status"], row["index_status"], row["original_name"], row["tags"]) == ("STORED", "READY", "__notes.txt", ["a", "b"])
    assert row["storage_key"].endswith(f"/document/2026/08/{one}/1/content")
    assert [r["artifact_id"] for r in engine.search("p", "t", "hello", tags=["a"]).collect()][0] == one
    assert engine.extracted_text("p", "t", one).first()["extracted"] == "hello world"
    assert engine.content("p", "t", one, 6, 3).first()["payload"] == "d29y"
    assert engine.whole_content("p", "t", one).first()["payload"] == "aGVsbG8gd29ybGQ="
    assert engine.list_metadata("p", "t", 10).count() == 2
    with pytest.raises(Forbidden):
        engine.metadata("q", "t", one)
    for _ in range(2):
        engine.delete("p", "t", one)
    assert engine.store.read("object").where(F.col("artifact_id") == one).count() == engine.store.read("chunk").where(F.col("artifact_id") == one).count() == 0
    assert engine.metadata("p", "t", one).count() == 0 and engine.list_metadata("p", "t", 10).count() == 1
    assert one not in [r["artifact_id"] for r in engine.search("p", "t", "hello").collect()]
    assert ingest(("k8", "text/plain", b"hello world", -1))[0][0] == "CREATED"


def test_quotas_objects_and_quarantine(spark, tmp_path):
    grants = Grants({("p", t): set(PERMISSIONS) for t in ("t", "u")})
    engine = Engine(spark, str(tmp_path), grants, hashing_provider(8), 8, limits=intake.Limits(artifact_bytes=10, bytes=20, files=9, tenant_bytes=12, tenant_files=3))

    def ingest(tenant, *contents):
        batch = [(i, f"{tenant}{c}", "n.txt", "text/plain", bytearray(c.encode()), -1, None) for i, c in enumerate(contents)]
        return [r["outcome"] for r in engine.ingest("p", tenant, spark.createDataFrame(batch, REQUEST), NOW).orderBy("seq").collect()]

    # of eleven bytes; eight; eight more of a tenant, with its copy; four
    assert ingest("t", "x" * 11, "a" * 8, "b" * 8, "b" * 8, "cccc") == ["REJECTED", "CREATED", "QUOTA", "QUOTA", "CREATED"]
    assert ingest("u", "d" * 9, "e") == ["QUOTA", "CREATED"]
    before = engine.store.state()
    engine.store_pending()
    assert ingest("t", "b" * 8) == ["CREATED"]  # the spool is empty again
    (gone,) = [r["artifact_id"] for r in engine.store.read("object", tenant="u").collect()]
    at = engine.store.state()
    engine.delete("p", "u", gone)
    of_t = {name: {p: f for p, f in parts.items() if p.startswith(tables.of_tenant("t"))} for name, parts in engine.store.state().items()}
    assert of_t == {name: {p: f for p, f in parts.items() if p.startswith(tables.of_tenant("t"))} for name, parts in at.items()} and before != at
    # an object that is not what it should be is not taken, and its content stays in the spool
    engine.kms_key = "k"
    real = files.verified_objects
    try:
        files.verified_objects = lambda heads, *a, **k: real(heads.withColumn("kms_key", F.lit("other")), *a, **k)
        engine.store_pending()
    finally:
        files.verified_objects = real
    (bad,) = engine.store.read("artifact").where("storage_status = 'RETRY_PENDING'").collect()
    assert bad["failure_code"] == "STORAGE_FAILED" and bad["storage_key"] is None and engine.store.read("spool").count() == 1
    engine.store_pending()
    assert engine.store.read("artifact").where("storage_status <> 'STORED'").count() == 1 and engine.store.read("spool").count() == 0  # the tombstone
    engine.provider = lambda texts: [[0.0] * 7 + [1.0] for _ in texts]
    invalid = indexing.invalid_chunk
    try:
        indexing.invalid_chunk = lambda n=None: F.col("text") == "cccc"
        engine.index_pending()
    finally:
        indexing.invalid_chunk = invalid
    assert engine.store.read("quarantine").count() == 1 and engine.store.read("chunk").count() == 2
    assert [r["failure_message"] for r in engine.store.read("artifact").where("index_status = 'RETRY_PENDING'").collect()] == ["a chunk is not valid"]
    engine.index_pending()
    assert engine.store.read("chunk").count() == 3 and engine.store.read("outbox").count() == 0


def test_of_two_writers_one_commits(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path), {"a": tables.Table("id long, tenant_id string, m map<string,string>", "id"), "b": tables.Table("id long, tenant_id string", "id")})

    def rows(*ids):
        return spark.createDataFrame([(i, "t", {}) for i in ids], "id long, tenant_id string, m map<string,string>")

    seen = store.version()
    changes = [{"a": store.added("a", rows(i)), "b": store.added("b", rows(i).drop("m"))} for i in (1, 2)]
    assert store.commit(seen, changes[0]) == 1
    with pytest.raises(tables.Conflict):
        store.commit(seen, changes[1], {"a": ""})
    # both have seen that the name is free, and race for it
    late = tables.Store(spark, str(tmp_path), store.tables)
    late.version = lambda: 0
    with pytest.raises(tables.Conflict):
        late.commit(0, changes[1])
    assert [r["id"] for r in store.read("a").collect()] == [r["id"] for r in store.read("b").collect()] == [1]
    # a crash after the data and before the log leaves nothing to be seen
    store.written("a", rows(7))
    assert store.read("a").count() == 1 and store.vacuum() >= 3 and store.read("a").count() == 1
    for i in range(tables.FULL_EVERY + 2):
        store.commit(store.version(), {"a": store.added("a", rows(1))})
    assert store.read("a").count() == tables.FULL_EVERY + 3 and store.read("a", version=3).count() == 3
    assert store.read("b", tenant="t").count() == 1 and store.read("b", tenant="other").count() == 0
    store.compact("a")
    assert store.read("a").count() == tables.FULL_EVERY + 3 and {len(f) for f in store.state()["a"].values()} == {1}


def asked(provider, calls):
    """A provider that notes what it is asked for."""

    def embed(texts):
        with open(calls, "a") as f:
            f.writelines(t.replace("\n", " ") + "\n" for t in texts)
        return provider(texts)

    return embed


def test_work_that_others_do_meanwhile_is_not_lost(spark, tmp_path, monkeypatch):
    grants = Grants({("p", t): set(PERMISSIONS) for t in ("t", "u")})
    calls = tmp_path / "calls"
    engine = Engine(spark, str(tmp_path / "store"), grants, asked(hashing_provider(8), calls), 8)

    def ingest(tenant, *texts):
        batch = [(i, None, "n.txt", "text/plain", bytearray(x.encode()), -1, None) for i, x in enumerate(texts)]
        return [r["artifact_id"] for r in engine.ingest("p", tenant, spark.createDataFrame(batch, REQUEST), NOW).orderBy("seq").collect()]

    def lines():
        return calls.read_text().splitlines() if calls.exists() else []

    one, two, blank = ingest("t", "red green blue", "yellow", "\n ")
    # while a batch is at work, another tenant brings artifacts and one of the batch's is deleted
    real = engine._committed

    def meanwhile(build):
        engine._committed = real
        ingest("u", "of another tenant")
        engine.delete("p", "t", two)
        real(build)

    engine._committed = meanwhile
    engine.index_pending(now=NOW)
    status = {r["id"]: (r["index_status"], r["failure_message"]) for r in engine.store.read("artifact", tenant="t").collect()}
    assert status == {one: ("READY", None), two: ("DELETED", None), blank: ("RETRY_PENDING", "BLANK_TEXT")}
    assert engine.store.read("artifact", tenant="u").where("index_status = 'PENDING'").count() == 1
    assert [r["text"] for r in engine.store.read("chunk").collect()] == ["red green blue"]
    assert sorted(lines()) == ["red green blue", "yellow"]
    # what failed waits longer each time, and no longer after its last attempt
    (job,) = engine.store.read("outbox", tenant="t").where("type = 'INDEX'").collect()
    assert (job["artifact_id"], job["status"], job["attempts"], job["last_error"]) == (blank, "RETRY_PENDING", 1, "BLANK_TEXT") and job["next_attempt_at"] > NOW
    at = engine.store.version()
    engine.index_pending(now=NOW)  # the other tenant's; the blank one is not due
    assert engine.store.read("outbox", tenant="t").where("type = 'INDEX'").first()["attempts"] == 1 and engine.store.version() > at
    monkeypatch.setattr(times, "ATTEMPTS", 2)
    for _ in range(2):
        engine.index_pending()
    (job,) = engine.store.read("outbox", tenant="t").where("type = 'INDEX'").collect()
    assert (job["status"], job["attempts"]) == ("DEAD_LETTER", 2)
    # again as another version: nothing is asked for, as the vectors are known; of other windows only those that are new
    asked_before = len(lines())
    engine.reindex("p", "t", one)
    engine.index_pending(batch=1)
    (chunk,) = engine.store.read("chunk", tenant="t").collect()
    assert chunk["version"] == 2 and len(lines()) == asked_before
    engine.reindex("p", "t", one)
    engine.index_pending(size=2, overlap=0)
    assert sorted(lines()[asked_before:]) == ["blue", "red green"]
    assert [r["chunk_id"] for r in engine.search("p", "t", "green -yellow", full_text=True).collect()][0] == engine.store.read("chunk", tenant="t").where("text = 'red green'").first()["chunk_id"]
    postings_before = engine.store.read("posting", tenant="t").where("term = 'green'").count()
    engine.compact_postings("t")
    assert postings_before == 3 and engine.store.read("posting", tenant="t").where("term = 'green'").count() == 1
    assert engine.search("p", "t", "green -yellow", full_text=True).count() == 2
    with pytest.raises(ValueError, match="limit"):
        engine.search("p", "t", "green", limit=101)


def test_cache_is_bounded(spark, tmp_path):
    calls = tmp_path / "calls"
    engine = Engine(spark, str(tmp_path / "store"), Grants({("p", "t"): set(PERMISSIONS)}), asked(hashing_provider(8), calls), 8, most_cached=2)

    def index(day, *texts):
        batch = [(i, None, "n.txt", "text/plain", bytearray(x.encode()), -1, None) for i, x in enumerate(texts)]
        ids = [r["artifact_id"] for r in engine.ingest("p", "t", spark.createDataFrame(batch, REQUEST), NOW).collect()]
        engine.index_pending(now=datetime(2026, 8, 10 + day))
        for one in ids:
            engine.delete("p", "t", one)
        return len(calls.read_text().splitlines())

    assert index(1, "one", "two") == 2
    assert index(2, "two", "three") == 3  # "one" is used longest ago
    assert engine.store.read("vector_cache").count() == 2
    assert index(3, "three", "two") == 3
    assert index(4, "one") == 4


def test_ranges_of_stored_contents(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), Grants({("p", "t"): set(PERMISSIONS)}), hashing_provider(8), 8)
    text = "".join(f"{i:07d} " for i in range(75_000)).encode()  # of three segments
    request = spark.createDataFrame([(0, None, "n.txt", "text/plain", bytearray(text), len(text), None)], REQUEST)
    one = engine.ingest("p", "t", request, NOW).first()["artifact_id"]
    engine.store_pending()
    assert sorted(r["segment"] for r in engine.store.read("object").collect()) == [0, 1, 2]
    for offset, n in ((0, 5), (262_140, 10), (524_280, 100_000), (700_000, 3)):
        row = engine.content("p", "t", one, offset, n).first()
        part = text[offset : offset + n]
        assert (base64.b64decode(row["payload"]), row["next_offset"], row["eof"], row["size_bytes"]) == (part, offset + len(part), offset + n >= len(text), len(text))
    assert engine.damaged("t").count() == 0
    changed = engine.store.read("object").withColumn("content", F.when(F.col("segment") == 1, F.lit(b"other")).otherwise(F.col("content")))
    version = engine.store.version()
    engine.store.commit(version, {"object": engine.store.rewritten("object", changed, set(engine.store.state()["object"]))})
    assert [tuple(r) for r in engine.damaged("t").collect()] == [(one, 1)]
