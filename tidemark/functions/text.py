"""Text: windows of words, token estimates, terms, cleaning of names and values."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.binding import let

#: All characters up to U+0020.
BLANK = "".join(map(chr, range(0x21)))


def trimmed(c: Column) -> Column:
    """Strips all characters up to U+0020 at both ends, where Spark's trim strips spaces only."""
    return F.btrim(c, F.lit(BLANK))


def words(c: Column) -> Column:
    """Words between ASCII white space; none for a blank or null text."""
    return let(trimmed(F.coalesce(c, F.lit(""))), lambda p: F.when(p == "", F.array().cast("array<string>")).otherwise(F.split(p, r"\s+")))


def chunks(c: Column, size: int = 100, overlap: int = 20) -> Column:
    """Windows of `size` words, each repeating the last `overlap` of the one before; the last one ends with the text."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("a window needs at least one word more than its overlap")
    step = size - overlap

    def windows(each: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(each) - size) / step)).cast("int")
        found = F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice(each, k * step + 1, size), " "))
        return F.when(F.size(each) > 0, found).otherwise(F.array().cast("array<string>"))

    return let(words(c), windows)


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, which counts characters beyond the basic plane twice."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def token_estimate(c: Column) -> Column:
    """A quarter of the length, rounded up, and 1 at least."""
    return F.greatest(F.lit(1), F.ceil(utf16_length(c) / 4)).cast("int")


def query_terms(query: str) -> list[str]:
    """Distinct lower-case terms of a query in the order of their first use."""
    return list(dict.fromkeys(x for x in query.lower().split() if x))


def keyword_score(c: Column, terms: list[str]) -> Column:
    """Part of the terms that occur in the lower-case text; 0 without terms. Terms are literals."""
    if not terms:
        return F.lit(0.0)
    lower = F.lower(c)
    return sum((lower.contains(t).cast("int") for t in terms), F.lit(0)) / F.lit(float(len(terms)))


def tags(csv: Column) -> Column:
    """Tags of a comma-separated list: trimmed, not blank, distinct, in order."""
    parts = F.transform(F.split(F.coalesce(csv, F.lit("")), ","), lambda x: trimmed(x))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def tags_csv(csv: Column) -> Column:
    return F.array_join(tags(csv), ",")


def requested_tags(asked: list[str] | None) -> list[str]:
    """Trims requested tags once, and refuses blank ones and ones with a comma."""
    out = [t.strip() for t in asked or []]
    if any(not t or "," in t for t in out):
        raise ValueError("a tag must not be blank or contain a comma")
    return list(dict.fromkeys(out))


def has_all_tags(have: Column, asked: list[str] | None) -> Column:
    """All requested tags are there; none requested is no condition."""
    wanted = requested_tags(asked)
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), have)) == 0 if wanted else F.lit(True)


def bounded_message(message: Column, fallback: Column, most: int = 500) -> Column:
    return F.left(F.coalesce(message, fallback), F.lit(most))


def excerpt(c: Column, most: int, cap: int = 8192) -> Column:
    """The first characters of a text, `most` or `cap` at most."""
    return F.left(c, F.lit(max(0, min(most, cap))))


def control_free(c: Column) -> Column:
    """Control characters but tab become underscores."""
    return F.regexp_replace(c, r"[\x00-\x08\x0A-\x1F\x7F-\x9F]", "_")


@F.pandas_udf(T.StringType())
def compatible_form(names: pd.Series) -> pd.Series:
    """Unicode NFKC, for which Spark has no function."""
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def safe_filename(name: Column, most: int = 255) -> Column:
    """A name that cannot leave its folder: NFKC, control and format characters, slashes and runs of dots become underscores; `artifact` if nothing is left."""
    clean = F.regexp_replace(compatible_form(name), r"[\p{Cc}\p{Cf}]", "_")
    clean = F.regexp_replace(F.translate(clean, "/\\", "__"), r"\.{2,}", "_")
    clean = F.regexp_replace(clean, r"(?U)^\s+|\s+$", "")
    blank = name.isNull() | (trimmed(name) == "")
    return let(clean, lambda x: F.when(blank | x.isin("", ".", ".."), F.lit("artifact")).otherwise(F.left(x, F.lit(most))))
