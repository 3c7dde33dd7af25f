"""Audit values: bounded, free of control characters, and redacted where they look sensitive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.binding import let
from tidemark.functions.text import control_free

#: Parts of keys whose values are never shown.
SENSITIVE_KEYS = ("token", "secret", "password", "authorization", "cookie", "presigned", "content", "document", "credential")
REDACTED = "[REDACTED]"
#: Entries of a map, characters of a key and of a value.
MOST_ENTRIES, KEY_LENGTH, VALUE_LENGTH = 50, 64, 512


def sensitive_key(key: Column) -> Column:
    return F.lower(key).rlike("|".join(SENSITIVE_KEYS))


def sensitive_value(value: Column) -> Column:
    """Bearer tokens, signed requests, and three long dotted parts of a web token."""
    token = "[A-Za-z0-9_-]{20,}+"
    return (F.lower(F.left(value, F.lit(7))) == "bearer ") | value.rlike("(?i)x-amz-(?:signature|credential)=") | value.rlike(rf"^{token}\.{token}\.{token}$")


def bounded(c: Column, most: int) -> Column:
    return control_free(F.left(c, F.lit(most)))


def safe_details(details: Column) -> Column:
    """The first 50 entries with bounded keys and values; the first of equal keys stays."""
    entries = F.slice(F.map_entries(F.coalesce(details, F.create_map().cast("map<string,string>"))), 1, MOST_ENTRIES)

    def named(e: Column) -> Column:
        return F.struct(bounded(e["key"], KEY_LENGTH).alias("key"), F.coalesce(e["value"], F.lit("")).alias("value"))

    def shown(e: Column) -> Column:
        hidden = sensitive_key(e["key"]) | sensitive_value(e["value"])
        return F.struct(e["key"].alias("key"), F.when(hidden, F.lit(REDACTED)).otherwise(bounded(e["value"], VALUE_LENGTH)).alias("value"))

    def firsts(safe: Column) -> Column:
        return let(F.transform(safe, lambda e: e["key"]), lambda keys: F.filter(safe, lambda e, i: F.array_position(keys, e["key"]) == i + 1))

    return F.map_from_entries(F.transform(let(F.transform(entries, named), firsts), shown))
