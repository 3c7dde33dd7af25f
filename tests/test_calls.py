from __future__ import annotations

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import records
from tidemark.operators import access, jobs

NOW = datetime(2026, 8, 10, 12)


def test_arguments_are_checked():
    good = {"query": "q", "limit": 3.0, "tags": ["a"], "createdAfter": "2026-01-02T03:04:05Z"}
    assert records.search_arguments(good) == {"query": "q", "limit": 3, "media_types": [], "tags": ["a"], "created_after": datetime(2026, 1, 2, 3, 4, 5, tzinfo=UTC)}
    assert records.search_arguments({"query": "x" * 8192})["limit"] == 10
    wrong = [
        {}, {"query": " "}, {"query": 5}, {"query": "x" * 8193}, {"query": "q", "limit": 0}, {"query": "q", "limit": 101}, {"query": "q", "limit": 1.5}, {"query": "q", "limit": "3"}, {"query": "q", "limit": True},
        {"query": "q", "limit": float("nan")}, {"query": "q", "tags": "a"}, {"query": "q", "tags": ["a"] * 33}, {"query": "q", "tags": ["x" * 256]}, {"query": "q", "tags": [" "]}, {"query": "q", "tags": [1]},
        {"query": "q", "createdAfter": "2026-01-02"}, {"query": "q", "createdAfter": "2026-01-02T03:04:05"}, {"query": "q", "createdAfter": "soon"}, {"query": "q", "createdAfter": 5},
    ]
    for arguments in wrong:
        with pytest.raises(records.InvalidArgument):
            records.search_arguments(arguments)
    assert records.artifact_id({"artifactId": "a.B-9_"}) == "a.B-9_"
    for value in ("", "-a", "a/b", "a" * 129, "a\n", None):
        with pytest.raises(records.InvalidArgument):
            records.artifact_id({"artifactId": value})


def test_handles_lead_to_identities():
    sessions = access.Sessions({"h": ("p", "t", {"artifact.search"}, None), "old": ("p", "t", set(), NOW)})
    assert sessions.identity("h", NOW) == ("p", "t", {"artifact.search"}) and "h" not in sessions.given
    for handle in (None, "", " ", "other", "old"):
        with pytest.raises(access.Forbidden):
            sessions.identity(handle, NOW)


def test_rows_of_another_tenant_fail(spark):
    rows = spark.createDataFrame([(1, "t"), (2, "t")], "id int, tenant_id string")
    assert access.require_tenant(rows, "t").count() == 2
    with pytest.raises(Exception, match="another tenant"):
        access.require_tenant(rows.union(spark.createDataFrame([(3, "u")], rows.schema)), "t").collect()


def test_maps_as_json(spark):
    rows = spark.createDataFrame([({"b": 'x"\n', "a": None},), ({},), (None,)], "m map<string,string>")
    found = [(r["j"], r["m"]) for r in rows.select(records.encoded(F.col("m")).alias("j")).withColumn("m", records.decoded(F.col("j"))).collect()]
    assert found == [('{"a":null,"b":"x\\"\\n"}', {"a": None, "b": 'x"\n'}), ("{}", {}), ("{}", {})]


def test_a_worker_takes_jobs_until_none_is_due(spark):
    schema = "id string, type string, status string, attempts int, next_attempt_at timestamp, lease_owner string, lease_expires_at timestamp, last_error string, tenant_id string, artifact_id string"
    now = F.lit(NOW)
    given = [
        ("good", "INDEX", "PENDING", 0, None, None, None, None), ("bad", "INDEX", "PENDING", 0, NOW, None, None, None), ("worst", "INDEX", "RETRY_PENDING", 4, NOW, None, None, None),
        ("lost", "INDEX", "CLAIMED", 1, None, "gone", datetime(2026, 8, 10, 11), None), ("later", "INDEX", "RETRY_PENDING", 1, datetime(2026, 8, 11), None, None, None), ("other", "STORE", "PENDING", 0, None, None, None, None),
    ]
    queue = spark.createDataFrame([(*r, "t", "a") for r in given], schema)

    def run(claimed):
        ok = ~F.col("id").isin("bad", "worst")
        return claimed.select("id", ok.alias("ok"), F.when(~ok, "broken").alias("error"))

    rows = queue
    for _ in range(5):
        rows = spark.createDataFrame(jobs.settled_by(rows, run, now, "INDEX", "me").collect(), schema)
    found = {r["id"]: r for r in rows.collect()}
    assert {k: (r["status"], r["attempts"], r["last_error"]) for k, r in found.items()} == {
        "good": ("COMPLETED", 1, None), "bad": ("RETRY_PENDING", 1, "broken"), "worst": ("DEAD_LETTER", 5, "broken"), "lost": ("COMPLETED", 2, "lease expired"), "later": ("RETRY_PENDING", 1, None), "other": ("PENDING", 0, None),
    }
    assert found["bad"]["next_attempt_at"] == datetime(2026, 8, 10, 12, 0, 1) and all(r["lease_owner"] is None for r in found.values())
    odd = spark.createDataFrame([("good", "INDEX", "PENDING", 0, None, None, None, None, "t", "a"), ("new", "INDEX", "PENDING", 0, None, None, None, None, "t", "a"), (" ", "INDEX", "PENDING", 0, None, None, None, None, "t", "a"), ("n2", "INDEX", "PENDING", 0, None, None, None, None, None, "a")], schema)
    taken, answers = jobs.dispatched(queue, odd)
    assert taken.count() == 7 and {r["id"]: (r["outcome"], r["reason"]) for r in answers.collect()} == {"good": ("DUPLICATE", None), "new": ("ACCEPTED", None), " ": ("REJECTED", "IDENTITY"), "n2": ("REJECTED", "IDENTITY")}
    many = spark.createDataFrame([(f"j{i:03d}", "INDEX", "CLAIMED", 1, None, "x", NOW, None, "t", "a") for i in range(150)], schema)
    assert jobs.recovered(many, now).where("status = 'RETRY_PENDING'").count() == 100
