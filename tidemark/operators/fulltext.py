"""Full-text search: web-style queries, matches by term positions, and ranks by cover density.

A query has terms, "phrases", `or` and leading `-`. Documents are tokenised once into lower-case
words; matching is an expression on that array. The rank sums 1 / length over the shortest windows
that hold all terms of an alternative (Clarke, Cormack and Tudhope 2000), so close terms rank higher.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.binding import let

TOKEN = r"[\p{L}\p{N}]+"


@dataclass(frozen=True)
class Query:
    """Alternatives, each a list of (phrase, wanted)."""

    alternatives: tuple[tuple[tuple[tuple[str, ...], bool], ...], ...]


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({TOKEN})"))


def parsed(query: str) -> Query:
    out: list[list[tuple[tuple[str, ...], bool]]] = [[]]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query.lower()):
        if word == "or" and not minus:
            out.append([])
            continue
        phrase = tuple(re.findall(r"[^\W_]+", quoted or word))
        if phrase:
            out[-1].append((phrase, not minus))
    return Query(tuple(tuple(x) for x in out if any(wanted for _, wanted in x)))


def starts(words: Column, phrase: tuple[str, ...]) -> Column:
    """Positions, from 0, at which a phrase begins."""
    at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == phrase[0])
    at = F.when(F.array_contains(words, phrase[0]), at).otherwise(F.array().cast("array<int>"))

    def follows(k: int) -> Callable[[Column], Column]:
        return lambda i: F.get(words, i + k) == phrase[k]

    for k in range(1, len(phrase)):
        at = F.filter(at, follows(k))
    return at


def fits(query: Query, there: Callable[[tuple[str, ...]], Column]) -> Column:
    """Whether any alternative has all wanted phrases and no unwanted one; an empty query fits nothing."""
    out = F.lit(False)
    for alternative in query.alternatives:
        out = out | reduce(and_, [there(phrase) if wanted else ~there(phrase) for phrase, wanted in alternative])
    return out


def matches(words: Column, query: Query) -> Column:
    """Whether a document of these words fits the query."""
    return fits(query, lambda phrase: F.array_contains(words, phrase[0]) if len(phrase) == 1 else F.size(starts(words, phrase)) > 0)


def _mark(term: int, size: int) -> Callable[[Column], Column]:
    return lambda i: F.struct((i + (size - 1)).cast("int").alias("at"), F.lit(term).alias("term"), i.cast("int").alias("start"))


def cover_density(query: Query, starts_of: Callable[[tuple[str, ...]], Column]) -> Column:
    """From the places where phrases begin, for each alternative: over places where its last-seen phrases complete a cover, the sum of 1 / its length, each start once."""
    out = F.lit(0.0)
    for alternative in query.alternatives:
        wanted = list(dict.fromkeys(p for p, w in alternative if w))
        marks = F.flatten(F.array(*[F.transform(starts_of(p), _mark(n, len(p))) for n, p in enumerate(wanted)]))
        empty = F.struct(F.array_repeat(F.lit(-1), len(wanted)).alias("last"), F.lit(-1).alias("used"), F.lit(0.0).alias("sum"))

        def step(s: Column, m: Column) -> Column:
            last = F.transform(s["last"], lambda x, i: F.when(i == m["term"], m["start"]).otherwise(x))
            least = F.array_min(last)
            new = (least >= 0) & (least > s["used"])
            return F.struct(last.alias("last"), F.when(new, least).otherwise(s["used"]).cast("int").alias("used"), (s["sum"] + F.when(new, 1.0 / (m["at"] - least + 1)).otherwise(0.0)).alias("sum"))

        out = out + F.aggregate(F.array_sort(marks), empty, step, lambda s: s["sum"])
    return out


def search(rows: DataFrame, query: str, k: int, *, id_col: str, text_col: str = "text") -> DataFrame:
    """The k rows of greatest rank that match, ties by id."""
    asked = parsed(query)
    rank = let(tokens(F.col(text_col)), lambda words: F.when(matches(words, asked), cover_density(asked, lambda phrase: starts(words, phrase))))
    scored = rows.where(may_match(F.col(text_col), asked)).select(id_col, rank.alias("rank"))
    return scored.orderBy(F.desc_nulls_last("rank"), id_col).limit(k).where("rank is not null")  # a filter before the limit would compute ranks twice


def matching(rows: DataFrame, query: str, *, text_col: str = "text") -> DataFrame:
    """The rows that match, whole."""
    asked = parsed(query)
    found = let(tokens(F.col(text_col)), lambda words: matches(words, asked))
    return rows.where(may_match(F.col(text_col), asked)).where(found)


def may_match(c: Column, query: Query) -> Column:
    """A scan that spares most texts the tokens: some alternative has all its wanted words as parts of the text."""
    lower, out = F.lower(c), F.lit(False)
    for alternative in query.alternatives:
        out = out | reduce(and_, [lower.contains(w) for phrase, wanted in alternative if wanted for w in dict.fromkeys(phrase)])
    return out
