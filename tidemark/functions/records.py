"""Maps as JSON text, and arguments of calls checked before any plan is built."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a query, values of a filter and characters of each, and the form of an artifact's id.
QUERY_CHARS, FILTER_VALUES, FILTER_CHARS = 8192, 32, 255
ARTIFACT_ID = "[A-Za-z0-9][A-Za-z0-9._-]{0,127}"


def encoded(m: Column) -> Column:
    """A map as a JSON object in key order; null counts as empty."""
    entries = F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))))
    return F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"})


def decoded(text: Column) -> Column:
    """The map of a JSON object; null if it is none."""
    return F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"})


class InvalidArgument(ValueError):
    """A call's argument is missing, of another type or out of bounds."""


def required_text(arguments: dict, name: str, most: int = QUERY_CHARS) -> str:
    value = arguments.get(name)
    if not isinstance(value, str) or not value.strip() or len(value) > most:
        raise InvalidArgument(f"{name} must be a text of 1 to {most} characters")
    return value


def artifact_id(arguments: dict, name: str = "artifactId") -> str:
    value = required_text(arguments, name, 128)
    if not re.fullmatch(ARTIFACT_ID, value):
        raise InvalidArgument(f"{name} is no artifact id")
    return value


def whole_number(arguments: dict, name: str, default: int | None, least: int, most: int) -> int | None:
    """An integral number within bounds; 3.0 is one, true is none."""
    value = arguments.get(name)
    if value is None:
        return default
    if isinstance(value, bool) or not isinstance(value, int | float) or value != value or value in (float("inf"), float("-inf")) or int(value) != value or not least <= value <= most:
        raise InvalidArgument(f"{name} must be a whole number from {least} to {most}")
    return int(value)


def texts(arguments: dict, name: str) -> list[str]:
    """A list of values to filter by; a missing one is empty."""
    values = arguments.get(name)
    if values is None:
        return []
    if not isinstance(values, list) or len(values) > FILTER_VALUES or not all(isinstance(v, str) and v.strip() and len(v) <= FILTER_CHARS for v in values):
        raise InvalidArgument(f"{name} must be a list of at most {FILTER_VALUES} texts")
    return list(values)


def instant(arguments: dict, name: str) -> datetime | None:
    """An ISO 8601 instant, which has an offset or Z."""
    value = arguments.get(name)
    if value is None:
        return None
    try:
        found = datetime.fromisoformat(value) if isinstance(value, str) and "T" in value else None
    except ValueError:
        found = None
    if found is None or found.tzinfo is None:
        raise InvalidArgument(f"{name} must be an instant")
    return found


def search_arguments(arguments: dict) -> dict:
    """The arguments of a search as `Engine.search` takes them."""
    return {
        "query": required_text(arguments, "query"),
        "limit": whole_number(arguments, "limit", 10, 1, 100),
        "media_types": texts(arguments, "mediaTypes"),
        "tags": texts(arguments, "tags"),
        "created_after": instant(arguments, "createdAfter"),
    }
