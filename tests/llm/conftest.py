from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, `odd name` string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def make_docs() -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empty and long texts, hot source, repeated rows; columns with names that operators use."""
    rng = random.Random(5)
    passage = words(rng, 90)
    base = words(rng, 120).split(" ")
    texts: list[str | None] = [None, "", " \n\t ", "one", "two words", "é" * 150, "ab" * 300, "x", passage, "line of five short words\n" * 40]
    for i in range(12):
        changed = list(base)
        changed[rng.randrange(len(changed))] = f"edit{i}"
        texts.append(" ".join(changed))
    texts += [words(rng, 30) + " " + passage + "\n" + words(rng, 20) for _ in range(6)]
    texts += [words(rng, 40)] * 5 + [words(rng, rng.randrange(1, 200)) for _ in range(30)]
    texts += [words(rng, 4000), "word " * 3000, "%%% ### " * 60 + words(rng, 20)]
    rows = [(i, t, rng.choice(["en", "de", "xx", None]), rng.choice(["hot", "hot", "b", "c", None]), len(t or ""), i, "r", "o") for i, t in enumerate(texts)]
    return [*rows, rows[30], (None, "a row without an id and some words", None, None, 5, 1, "r", "o"), (None, None, None, "b", 0, 1, "r", "o")]


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def brute():
    return sorted_rows


def sorted_rows(rows) -> list:
    return sorted(rows, key=repr)
