"""Configuration: layers of named values, the first that has one wins."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Layer = Callable[[str], str | None]


def mapping(values: Mapping[str, str | None]) -> Layer:
    return values.get


def environment(values: Mapping[str, str]) -> Layer:
    """Exact names, then the usual form of environment variables: A_B_C for a.b-c."""
    return lambda name: values.get(name, values.get(re.sub(r"[^A-Za-z0-9]", "_", name).upper()))


def command_line(args: list[str]) -> Layer:
    """--key=value, --key value, or --flag for true; the first of a name counts."""
    found: dict[str, str] = {}
    for i, arg in enumerate(args):
        if arg.startswith("--") and len(arg) > 2:
            name, eq, value = arg[2:].partition("=")
            follows = i + 1 < len(args) and not args[i + 1].startswith("--")
            found.setdefault(name, value if eq else args[i + 1] if follows else "true")
    return found.get


def properties(text: str) -> Layer:
    """Lines of key=value or key: value; # and ! begin comments, a backslash at the end continues a line."""
    found = {}
    for line in re.sub(r"\\\r?\n[ \t]*", "", text).splitlines():
        m = re.match(r"\s*([^#!\s=:][^\s=:]*)\s*[=:\s]\s*(.*)$", line)
        if m:
            found[m[1]] = m[2]
    return found.get


class Settings:
    """Looks names up layer by layer."""

    def __init__(self, *layers: Layer) -> None:
        self.layers = layers

    def get(self, name: str, default: str | None = None) -> str | None:
        return next((v for layer in self.layers if (v := layer(name)) is not None), default)

    def required(self, name: str) -> str:
        if (value := self.get(name)) is None:
            raise KeyError(f"no value for {name}")
        return value


def resolved(rows: DataFrame) -> DataFrame:
    """The same over a table (layer, name, value): for each name the value of its lowest layer that has one."""
    w = Window.partitionBy("name").orderBy("layer")
    return rows.where("value is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("name", "value")
