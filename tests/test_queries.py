from __future__ import annotations

import duckdb
import pytest

from tests.compare import same
from tidemark.plans import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), queries.SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_markdown_is_read_to_its_end(spark, tmp_path):
    words = "long text " * 20000
    plain = {
        "one **two** three\n\nlast *line*": "one two three\nlast line",
        "see [a link](http://x.org/a) and ![a picture](p.png)\n> quoted": "see a link and a picture\nquoted",
        "before\n```python\nx = **kw\n# no heading\n```\nafter": "before\nx = **kw\n# no heading\nafter",
        "| a | b |\n|---|---|\n| **c** | d |": "| a | b |\n| c | d |",
        "<div>raw <b>html</b></div>\n&lt;kept&gt;": "raw html\n<kept>",
        words + "**end**": words + "end",
        "": "",
        None: None,
    }
    spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r["text"] for r in queries.markdown_text(spark, str(tmp_path)).collect()}
    expected = [None if t is None else f"Title\n{t}\nitem and code".replace("\n\n", "\n") for t in plain.values()]
    assert [found[i] for i in range(len(plain))] == expected


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_searches_end_in_a_top_k(spark, sf_dir):
    plan = queries.keyword_topk(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_texts_are_cut_into_words_once(spark, sf_dir):
    def optimised(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    assert optimised(queries.fts_rank(spark, sf_dir)).count("regexp_extract_all") == 1
    assert optimised(queries.chunk_ids(spark, sf_dir)).count("split(") == 1


def test_long_texts_are_cut_in_time_linear_in_them(spark):
    """A window that split its text anew would take minutes here: 5,000 windows of 400,000 words."""
    from pyspark.sql import functions as F

    from tidemark.functions import text

    rows = spark.range(1).select(F.repeat(F.concat(F.lit("word"), F.col("id"), F.lit(" ")), F.lit(400_000)).alias("t"))
    assert rows.select(F.size(text.chunks(F.col("t"))).alias("n")).first()["n"] == 5000


def test_objects_of_other_bytes_are_found_whatever_their_first_byte(spark, tmp_path):
    from tests.compare import rows_of

    texts = ["+1 (235) 555", "+", "-", "", None, "plain", "über"]
    rows = [(6 * i + kind, None if text == "plain" else "s", text) for i, text in enumerate(texts) for kind in range(6)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["object_verify"](spark, str(tmp_path))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        asked = con.execute(queries.SQL["object_verify"])
        expected = rows_of([c[0] for c in asked.description], asked.fetchall())
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == expected
