from __future__ import annotations

import base64
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import access, audit, fulltext, indexing, intake, jobs, quotas, retrieval
from tidemark.plans import queries
from tidemark.sources import config, embed, extract, files, segments, shared
from tidemark.streaming import leases, relay

NOW = datetime(2026, 8, 10)


def test_registration_depends_on_order(spark):
    rows = [(1, "a1", "t", "k1", "s1", "f1"), (2, "a2", "t", "k2", "s1", "f2"), (3, "a3", "t", "k2", "s3", "f3"), (4, "a4", "t", "k1", "s1", "f1"), (5, "a5", "t", "k1", "s9", "f9"), (6, "a6", "u", "k1", "s1", "f1"), (7, "a7", "t", None, "s7", "f7")]
    requests = spark.createDataFrame(rows, "seq long, id string, tenant_id string, idempotency_key string, sha256 string, fingerprint string")
    found = {r["seq"]: (r["outcome"], r["artifact_id"]) for r in intake.registered(requests).collect()}
    assert found == {1: ("CREATED", "a1"), 2: ("CONTENT_DUPLICATE", "a1"), 3: ("CREATED", "a3"), 4: ("IDEMPOTENT_REPLAY", "a1"), 5: ("CONFLICT", "a1"), 6: ("CREATED", "a6"), 7: ("CREATED", "a7")}
    stored = requests.where("seq = 1")
    later = {r["seq"]: r["outcome"] for r in intake.registered(requests.where("seq > 3"), stored).collect()}
    assert later == {4: "IDEMPOTENT_REPLAY", 5: "CONFLICT", 6: "CREATED", 7: "CREATED"}


def test_a_refused_file_leaves_room_for_a_smaller_one(spark):
    rows = spark.createDataFrame([("t", 1, 60), ("t", 2, 50), ("t", 3, 40), ("u", 4, 101), ("u", 5, 100)], "tenant string, seq int, size long")
    found = intake.accepted_within(rows, by="tenant", order_col="seq", bytes_col="size", most_bytes=100, most_files=9)
    assert {r["seq"]: r["accepted"] for r in found.collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}
    few = intake.accepted_within(rows, by="tenant", order_col="seq", bytes_col="size", most_bytes=1000, most_files=1)
    assert sorted(r["seq"] for r in few.where("accepted").collect()) == [1, 4]


def test_fusion(spark):
    lists = [spark.createDataFrame(x, "chunk_id string, score double") for x in ([("a", 0.9), ("b", 0.9), ("c", 0.1)], [("c", 5.0)])]
    found = {r["chunk_id"]: r["score"] for r in retrieval.fused(lists).collect()}
    assert found == {"a": 1 / 61, "b": 1 / 62, "c": 1 / 63 + 1 / 61}
    assert retrieval.fused([lists[0], lists[1].limit(0)]).count() == 3


def test_created_after_keeps_the_instant_itself(spark):
    chunks = spark.createDataFrame([("c1", "t", "a1", "x y", [1.0, 0.0]), ("c2", "t", "a2", "x", [0.0, 1.0]), ("c3", "u", "a3", "x", [1.0, 0.0])], "chunk_id string, tenant_id string, artifact_id string, text string, embedding array<float>")
    one = ("text/plain", ["p"], "STORED", "READY")
    artifacts = spark.createDataFrame([("a1", "t", *one, NOW), ("a2", "t", *one, NOW - timedelta(seconds=1)), ("a3", "u", *one, NOW)], "id string, tenant_id string, media_type string, tags array<string>, storage_status string, index_status string, created_at timestamp")

    def search(**more):
        return [r["chunk_id"] for r in retrieval.hybrid_search(chunks, artifacts, "x", [1.0, 0.0], tenant="t", limit=10, **more).collect()]

    assert search() == ["c1", "c2"]
    assert search(created_after=NOW) == ["c1"] == search(created_after=NOW, prefilter=True)
    assert search(media_types=["image/png"]) == [] and search(tags=["q"]) == [] and search(tags=[" p "]) == ["c1", "c2"]
    with pytest.raises(ValueError):
        retrieval.hybrid_search(chunks, artifacts, " ", [1.0, 0.0], tenant="t", limit=1)


def test_full_text(spark):
    texts = {1: "the quick brown fox", 2: "the fox was quick", 3: "quick quick fox", 4: "nothing", 5: None, 6: "quick a b c d e f g h fox"}
    rows = spark.createDataFrame(list(texts.items()), "id int, text string")

    def found(query):
        return [r["id"] for r in fulltext.search(rows, query, 10, id_col="id").collect()]

    assert set(found("quick fox")) == {1, 2, 3, 6} and found("quick fox")[-1] == 6
    assert found('"quick fox"') == [3] and set(found("fox -the")) == {3, 6} and set(found("brown or nothing")) == {1, 4}
    assert found("") == [] and found("-fox") == []


def test_extracted_text(spark):
    rows = spark.createDataFrame([("a", 1, "bc"), ("a", 0, "a"), ("b", 0, ""), ("b", 1, "x")], "artifact string, i int, t string")

    def text(limit):
        return {r["artifact"]: r["extracted"] for r in indexing.extracted_text(rows, ["artifact"], index_col="i", text_col="t", limit=limit).collect()}

    assert text(9) == {"a": "a\nbc", "b": "x"} and text(2)["a"] == "a\n" and text(0)["a"] == "" and text(-1)["a"] == ""


def test_upsert_and_replacement(spark):
    schema = "tenant_id string, artifact_id string, chunk_index int, embedding_model string, embedding_version string, text string, seq int"
    old = spark.createDataFrame([("t", "a", 0, "m", "1", "old", 9), ("t", "a", 1, "m", "1", "old", 9), ("t", "b", 0, "m", "1", "b", 1)], schema)
    new = spark.createDataFrame([("t", "a", 0, "m", "1", "first", 1), ("t", "a", 0, "m", "1", "last", 2)], schema)
    assert sorted(r["text"] for r in indexing.upserted(old, new).collect()) == ["b", "last", "old"]
    assert sorted(r["text"] for r in indexing.replaced(old, new.where("seq = 2")).collect()) == ["b", "last"]
    assert indexing.inserted_if_absent(old, new, ("tenant_id", "artifact_id", "chunk_index")).count() == 3


def test_job_life(spark):
    schema = "id string, type string, status string, attempts int, next_attempt_at timestamp, lease_owner string, lease_expires_at timestamp, last_error string, created_at timestamp"
    empty = spark.createDataFrame([], schema)
    pending = spark.createDataFrame([("j1", "INDEX", "PENDING", 0, None, None, None, None, NOW), ("j1", "INDEX", "PENDING", 0, None, None, None, None, NOW), ("j2", "INDEX", "CLAIMED", 0, None, None, None, None, NOW)], schema)
    queue = jobs.enqueued(empty, pending)
    assert queue.count() == 1 and jobs.enqueued(queue, pending).count() == 1
    claimed = jobs.claimed(queue, NOW, "INDEX", "w", 30)
    row = claimed.first()
    assert (row["status"], row["attempts"], row["lease_owner"], row["lease_expires_at"]) == ("CLAIMED", 1, "w", NOW + timedelta(seconds=30))
    assert jobs.due_jobs(claimed, NOW).count() == 0
    end = NOW + timedelta(seconds=30)
    assert jobs.expired_leases(claimed, end).count() == 1 and jobs.recovered(claimed, end).first()["status"] == "RETRY_PENDING"

    def settle(owner, ok, now, most=5):
        results = spark.createDataFrame([("j1", owner, ok, "boom")], "id string, owner string, ok boolean, error string")
        return jobs.settled(claimed, results, now, most).first()

    assert settle("other", True, NOW)["status"] == "CLAIMED" and settle("w", True, end)["status"] == "CLAIMED"
    assert settle("w", True, NOW)["status"] == "COMPLETED"
    again = settle("w", False, NOW)
    assert (again["status"], again["next_attempt_at"], again["last_error"], again["lease_owner"]) == ("RETRY_PENDING", NOW + timedelta(seconds=1), "boom", None)
    assert settle("w", False, NOW, 1)["status"] == "DEAD_LETTER"
    assert jobs.renewed(claimed, "j1", "w", NOW, 90).first()["lease_expires_at"] == NOW + timedelta(seconds=90)


def test_transitions(spark):
    steps = [("x", 1, "PENDING"), ("x", 2, "VALIDATING"), ("x", 3, "COMPLETED"), ("y", 1, "COMPLETED"), ("y", 2, "PENDING")]
    history = spark.createDataFrame(steps, "job string, n int, state string")
    bad = jobs.invalid_transitions(history, jobs.transition_table(spark), key="job", state="state", at="n", tie="n")
    assert sorted((r["job"], r["from_state"], r["to_state"]) for r in bad.collect()) == [("x", "VALIDATING", "COMPLETED"), ("y", "COMPLETED", "PENDING")]


def test_audit(spark):
    schema = "operation string, principal_id string, tenant_id string, artifact_id string, outcome string, latency_millis long, occurred_at timestamp, safe_details map<string,string>"
    rows = [("SEARCH", "p\n", "t", None, "SUCCESS", -5, NOW, {"accessToken": "s"}), ("", "p", "t", None, "SUCCESS", 1, NOW, {}), ("SEARCH", "p", "t", None, "SUCCESS", 1, NOW + timedelta(seconds=301), {})]
    events = spark.createDataFrame(rows, schema)
    (row,) = audit.audit_rows(events, NOW).collect()
    assert (row["principal_id"], row["latency_millis"], row["safe_details"]) == ("p_", 0, {"accessToken": "[REDACTED]"})
    assert audit.refused(events, NOW).count() == 2


def test_access():
    grants = access.Grants({("p", "t"): {"SEARCH"}})
    grants.require("p", "t", "SEARCH")
    for bad in (("p", "t", "DELETE"), ("p", "u", "SEARCH")):
        with pytest.raises(access.Forbidden):
            grants.require(*bad)
    with pytest.raises(ValueError):
        grants.require(" ", "t", "SEARCH")
    access.require_scope({"artifact.*"}, "artifact.search")
    assert access.expired(NOW, NOW) and not access.expired(None, NOW) and not access.expired(NOW + timedelta(1), NOW)


@pytest.mark.parametrize(("offset", "requested", "most", "expected"), [(2, 1000, 4, ("Y2RlZg==", 6, False)), (6, 4, 4, ("Z2hpag==", 10, True)), (10, 5, 5, ("", 10, True)), (20, 5, 5, ("", 20, True))])
def test_byte_range(spark, offset, requested, most, expected):
    row = spark.createDataFrame([(bytearray(b"abcdefghij"),)], "c binary").select(files.byte_range(F.col("c"), offset, requested, most).alias("r")).first()["r"]
    assert (row["payload"], row["next_offset"], row["eof"]) == expected


def test_spool_and_objects(spark, tmp_path):
    for name in ("t1/a/content.pending", "t1/b/content.pending", "t1/a/other", "deep/a/b/c/content.pending"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    found = {r["spool_path"].removeprefix(f"{tmp_path}/"): r["bytes"] for r in files.spool_files(spark, str(tmp_path)).collect()}
    assert found == {"t1/a/content.pending": 20, "t1/b/content.pending": 20}
    assert files.contents(spark, str(tmp_path)).count() == 4
    with pytest.raises(ValueError):
        files.byte_range(F.col("c"), -1, 1)


@pytest.mark.parametrize(("page", "expected"), [("<html><body><h1>Heading</h1><p>Hello</p></body></html>", "Heading Hello"), ("<p>a<b>b</b>c<script>x</script><br>d&amp;e", "abc d&e"), ("", ""), (None, None)])
def test_html(page, expected):
    assert extract.visible_text(page) == expected


def test_markdown_and_docx():
    assert extract.markdown_plain("# Heading\n\nHello **world**.") == "Heading\nHello world."
    assert extract.markdown_plain("- [x](y) `a*b*c`\n> q _e_ snake_case_name\n\n```\n*code*\n```\n---\n&lt;b&gt;") == "x a*b*c\nq e snake_case_name\n*code*\n<b>"
    from tests.test_functions import docx

    assert extract.docx_plain(docx("DOCX extraction works")) == "DOCX extraction works" and extract.docx_plain(b"no") is None


def test_extraction_by_type(spark):
    rows = spark.createDataFrame([(1, bytearray(b"plain"), "text/plain"), (2, bytearray(b"<p>x"), "text/html"), (3, bytearray(b"%PDF"), "application/pdf"), (4, bytearray(b"\xff"), "image/png"), (5, bytearray(b"0123456789"), "text/plain")], "id int, content binary, media_type string")
    found = {r["id"]: (r["extracted"], r["failure"]) for r in extract.extracted(rows, pdf=lambda b: "from pdf", most_bytes=9).collect()}
    assert found == {1: ("plain", None), 2: ("x", None), 3: ("from pdf", None), 4: (None, "EXTRACTION_FAILED"), 5: (None, "INPUT_TOO_LARGE")}
    given = [("PAGE", None), ("LINE", "First line"), ("WORD", "First"), ("LINE", "Second line")]
    blocks = spark.createDataFrame([(given,)], "b array<struct<type: string, text: string>>")
    assert blocks.select(extract.lines_of(F.col("b"))).first()[0] == "First line\nSecond line"


def test_embedding_responses(spark):
    data = [{"index": 1, "embedding": [0, 1]}, {"index": 0, "embedding": [1, 0]}]
    assert embed.ordered_response(data, 2, 2) == [[1.0, 0.0], [0.0, 1.0]]
    for bad in (data[:1], [*data, data[0]], [{"index": 0, "embedding": [1]}, data[0]], [{"index": 0, "embedding": [1, float("nan")]}, data[0]]):
        with pytest.raises(ValueError):
            embed.ordered_response(bad, 2, 2)


def test_configuration(spark):
    layers = config.Settings(config.command_line(["--a.b=1", "--flag", "--c", "3"]), config.environment({"D_E_F": "env", "a.b": "no"}), config.properties("# no\nx = 1\ny: two\\\n  lines\n"))
    assert [layers.get(n) for n in ("a.b", "flag", "c", "d.e-f", "x", "y", "none")] == ["1", "true", "3", "env", "1", "twolines", None]
    with pytest.raises(KeyError):
        layers.required("none")
    rows = spark.createDataFrame([(2, "a", "later"), (1, "a", None), (3, "a", "last")], "layer int, name string, value string")
    assert [tuple(r) for r in config.resolved(rows).collect()] == [("a", "later")]


def test_lease_rules():
    step = leases.applied
    ok, r = step(None, "enqueue", 0, None, 0, None)
    assert ok and not step(r, "enqueue", 0, None, 0, None)[0]
    ok, r = step(r, "claim", 0, "w", 1000, None)
    assert ok and r.attempts == 1 and not step(r, "claim", 0, "v", 1000, None)[0]
    assert not step(r, "complete", 1000, "w", 0, None)[0] and not step(r, "complete", 1, "v", 0, None)[0]
    assert step(r, "renew", 999, "w", 1000, None)[1].expires_ms == 1999
    assert step(r, "recover", 1000, None, 0, None)[1].status == "RETRY_PENDING" and not step(r, "recover", 999, None, 0, None)[0]
    failed = step(r, "fail", 1, "w", 0, "boom")[1]
    assert (failed.status, failed.next_ms, failed.error) == ("RETRY_PENDING", 1001, "boom") and not step(failed, "claim", 1000, "w", 1, None)[0]
    assert step(r, "fail", 1, "w", 0, "boom", 1)[1].status == "DEAD_LETTER"


def test_streams(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for seq in range(120):
        rows.append((f"j{rng.randrange(5)}", seq, NOW + timedelta(seconds=seq), rng.choice(["enqueue", "claim", "claim", "renew", "complete", "fail", "recover"]), rng.choice("wv"), rng.choice([1, 5, 40]), "e"))
    for k in range(3):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], leases.COMMAND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    records, expected = {}, {}
    for job, seq, at, command, owner, seconds, error in rows:
        ok, records[job] = leases.applied(records.get(job), command, int((at - datetime(1970, 1, 1)).total_seconds() * 1000), owner, 1000 * seconds, error)
        expected[seq] = (ok, records[job].status if records[job] else None)
    commands = relay.outbox_stream(spark, f"{tmp_path}/in", leases.COMMAND, files_per_batch=100)
    seen = {}

    def sink(batch, _):
        for r in batch.collect():
            seen[r["seq"]] = (r["accepted"], r["status"])

    relay.relayed(leases.lease_stream(commands), sink, f"{tmp_path}/checkpoint").awaitTermination()
    assert seen == expected


def test_registration_in_rounds_is_that_in_order(spark):
    """Of requests that share keys and contents at random, in long chains, and with what is stored."""
    rng = random.Random(4)
    rows = [(i, f"a{i}", rng.choice(["t", "t", "u"]), rng.choice([None, *(f"k{rng.randrange(40)}" for _ in range(5))]), f"s{rng.randrange(60)}", f"f{rng.randrange(2)}") for i in range(300)]
    rows += [(1000 + i, f"b{i}", "chain", f"k{i // 2}", f"s{(i + 1) // 2}", "f") for i in range(40)]  # each shares with the one before
    rows += [(2000 + i, f"c{i}", "hot", f"k{i}", "s", "f") for i in range(50)] + [(5000, f"d{i}", "ties", "k", f"s{i}", "f") for i in range(3)]
    held = [(-9, "x1", "t", "k1", "s1", "f0"), (-8, "x2", "t", None, "s1", None), (-7, "x3", "u", "k2", "s9", "f1"), (-6, "x4", "hot", None, "none", "f")]
    schema = "seq long, id string, tenant_id string, idempotency_key string, sha256 string, fingerprint string"

    def in_order(stored):
        keys, contents, out = {}, {}, []
        for _, one, tenant, key, sha, mark in stored:
            keys |= {(tenant, key): (mark, one)} if key else {}
            contents.setdefault((tenant, sha), one)
        for seq, one, tenant, key, sha, mark in sorted(rows, key=lambda r: (r[0], r[1])):
            if key and (tenant, key) in keys:
                known, artifact = keys[tenant, key]
                out.append((seq, tenant, "IDEMPOTENT_REPLAY" if known == mark else "CONFLICT", artifact))
            elif (tenant, sha) in contents:
                out.append((seq, tenant, "CONTENT_DUPLICATE", contents[tenant, sha]))
            else:
                contents[tenant, sha] = one
                keys |= {(tenant, key): (mark, one)} if key else {}
                out.append((seq, tenant, "CREATED", one))
        return sorted(out)

    requests = spark.createDataFrame(rows, schema).repartition(3)
    for stored in ([], held):
        for rounds in (12, 1):
            found = intake.registered(requests, spark.createDataFrame(stored, schema) if stored else None, rounds=rounds)
            assert sorted(map(tuple, found.collect())) == in_order(stored)
    assert intake.registered(requests.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", ["even", "mixed", "shrinking"])
def test_quotas_side_by_side_are_those_in_order(spark, monkeypatch, sizes):
    rng = random.Random(sizes)
    size = {"even": lambda i: 10, "mixed": lambda i: rng.choice([0, 1, 5, 40, 200, 999]), "shrinking": lambda i: max(1, 300 - i)}[sizes]
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), i, size(i)) for i in range(500)]
    used = [("a", 50, 2), (None, 7, 1), ("elsewhere", 100, 3)]
    files, held = spark.createDataFrame(rows, "tenant string, seq int, size long").repartition(3), spark.createDataFrame(used, "tenant string, bytes long, files long")

    def in_order(limits):
        own = {t: (b, f) for t, b, f in used}
        all_bytes, all_files, out = sum(u[1] for u in used), sum(u[2] for u in used), []
        for t, i, n in rows:
            b, f = own.get(t, (0, 0))
            over = (n > limits.artifact_bytes, all_files + 1 > limits.files, f + 1 > limits.tenant_files, all_bytes + n > limits.bytes, b + n > limits.tenant_bytes)
            why = next((name for name, x in zip(quotas.REFUSALS, over, strict=True) if x), None)
            if why is None:
                own[t], all_bytes, all_files = (b + n, f + 1), all_bytes + n, all_files + 1
            out.append((t, i, n, why))
        return sorted(out, key=lambda r: r[1])

    replayed = []
    real = quotas._replayed
    monkeypatch.setattr(quotas, "_replayed", lambda rows, limits: replayed.append(rows.count()) or real(rows, limits))
    refusals = set()
    for limits, rounds in ((quotas.Limits(900, 4000, 400, 1500, 200), 16), (quotas.Limits(900, 4000, 400, 1500, 200), 1), (quotas.Limits(5000, 100_000, 450, 2500, 100), 16)):
        found = intake.admitted(files, by="tenant", order_col="seq", bytes_col="size", limits=limits, used=held, block=40, rounds=rounds)
        assert sorted(map(tuple, found.collect()), key=lambda r: r[1]) == in_order(limits)
        refusals |= {r[3] for r in in_order(limits)}
    assert len(refusals) > 2 and all(0 < n < 500 for n in replayed) and replayed
    assert intake.admitted(files.limit(0), by="tenant", order_col="seq", bytes_col="size", limits=limits, block=40).count() == 0


def test_contents_in_segments(spark):
    rng = random.Random(2)
    contents = [b"", None, b"a", b"0123456789", *(rng.randbytes(n) for n in (9, 20, 95, 100, 333))]
    rows = spark.createDataFrame([(i, len(c or b""), None if c is None else bytearray(c)) for i, c in enumerate(contents)], "id int, size_bytes long, content binary")
    held = shared.kept(segments.divided(rows, size=10).repartition(3), "test")
    assert held.count() == sum(max(1, -(-len(c or b"") // 10)) for c in contents)
    assert {r["id"]: bytes(r["content"]) for r in segments.joined(held, ["id"]).collect()} == {i: c or b"" for i, c in enumerate(contents)}
    for offset, n in ((0, 1), (0, 10), (9, 2), (15, 60), (95, 5), (400, 7)):
        found = {r["id"]: (base64.b64decode(r["payload"]), r["next_offset"], r["eof"]) for r in segments.byte_range(held, ["id"], offset, n, size=10).collect()}
        assert found == {i: ((c or b"")[offset : offset + n], offset + len((c or b"")[offset : offset + n]), len(c or b"") - offset <= n) for i, c in enumerate(contents)}
    # the scan gives the segments of the range alone
    one = segments.byte_range(held.where("id = 8"), ["id"], 95, 5, size=10)
    one.collect()
    scan = one._jdf.queryExecution().executedPlan().toString()
    assert "segment" in scan.split("PushedFilters: [")[1].split("]")[0]
    assert held.where("id = 8 and (segment between 9 and 9 or segment = 0)").count() == 2
    expected = shared.kept(segments.manifest(held, ["id"]), "test")
    assert segments.damaged(held, expected, ["id"]).count() == 0
    broken = held.withColumn("content", F.when((F.col("id") == 8) & (F.col("segment") == 3), F.lit(b"x")).otherwise(F.col("content"))).where("not (id = 7 and segment = 5)")
    assert sorted(map(tuple, segments.damaged(broken, expected, ["id"]).collect()), key=repr) == [(7, None, "incomplete"), (8, 3, "changed")]


def test_state_of_ids_ends(spark, tmp_path):
    """Over thirty days the state holds the ids of a few; the first of each id is taken once, and a restart takes nothing again."""
    for d in range(30):
        jobs = [(f"{d}:{i % 50}", datetime(2026, 8, 1) + timedelta(days=d, minutes=i)) for i in range(120)]
        spark.createDataFrame(jobs, "id string, at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen, held = [], []

    def sink(batch, _):
        seen.extend(r["id"] for r in batch.collect())

    for _ in range(2):
        stream = relay.outbox_stream(spark, f"{tmp_path}/in", "id string, at timestamp", files_per_batch=1)
        run = relay.relayed(relay.first_within(stream, "at", "1 day"), sink, f"{tmp_path}/checkpoint")
        run.awaitTermination()
        held += [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert sorted(seen) == sorted(f"{d}:{i}" for d in range(30) for i in range(50))
    assert max(held) <= 4 * 50


def test_roots_of_contents_are_those_of_their_segments_without_a_shuffle(spark, sf_dir):
    contents = [None, b"", b"a", *[bytes(i % 251 for i in range(n)) for n in (9, 10, 11, 20, 21, 99, 1234)]]
    rows = spark.createDataFrame(list(enumerate(contents)), "id int, content binary").repartition(3)
    made = segments.manifest_of(rows, ["id"], size=10)
    stored = segments.manifest(shared.kept(segments.divided(rows, size=10).repartition(3), "test"), ["id"])
    assert made.dtypes == stored.dtypes
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, stored.collect()))
    plan = queries.QUERIES["segment_roots"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "documents.parquet" in plan
