"""Media types: detection by content, normal forms, what a declared type may stand for."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
TEXT_TYPES = ("text/plain", "text/markdown", "text/html")
SNIFF = 8192


def normal(c: Column) -> Column:
    """A type without parameters, in lower case; null if blank."""
    plain = F.lower(F.regexp_replace(F.substring_index(c, ";", 1), r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    return F.when(F.regexp_replace(c, r"\s", "") == "", F.lit(None)).otherwise(plain)


@F.pandas_udf(T.BooleanType())
def is_docx(content: pd.Series) -> pd.Series:
    """A zip archive with the two parts that every such document has."""

    def one(data: bytes | None) -> bool:
        try:
            with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                return {"[Content_Types].xml", "word/document.xml"} <= set(z.namelist())
        except (zipfile.BadZipFile, ValueError):
            return False

    return content.map(one)


def whole_characters(prefix: Column) -> Column:
    """Bytes without a multi-byte character that is cut off at their end."""
    tail = F.hex(F.substring(prefix, -3, 3))
    cut = (
        F.when(tail.rlike("(?:C[2-9A-F]|D[0-9A-F]|E[0-9A-F]|F[0-4])$"), 1)
        .when(tail.rlike("(?:E[0-9A-F]|F[0-4])[89AB][0-9A-F]$"), 2)
        .when(tail.rlike("F[0-4][89AB][0-9A-F][89AB][0-9A-F]$"), 3)
        .otherwise(0)
    )
    return F.substring(prefix, F.lit(1), F.length(prefix) - cut)


def detected(content: Column, declared: Column | None = None, docx: bool = True) -> Column:
    """The type that the content's first bytes show; null if none is recognised.

    Text is UTF-8 without a zero byte in the first 8192 bytes. With `docx=False` archives are not
    opened, and the whole expression is native.
    """
    prefix = F.substring(content, 1, SNIFF)
    start = F.hex(F.substring(content, 1, 12))
    whole = F.when(F.length(content) > SNIFF, whole_characters(prefix)).otherwise(prefix)
    is_text = F.is_valid_utf8(whole.cast("string")) & (F.instr(whole.cast("string"), "\x00") == 0)
    lead = F.lower(F.regexp_replace(F.left(whole.cast("string"), F.lit(SNIFF)), r"(?U)^\s+", ""))
    html = lead.startswith("<!doctype html") | lead.startswith("<html")
    markdown = F.coalesce(normal(declared) == "text/markdown", F.lit(False)) if declared is not None else F.lit(False)
    archive = F.when(start.startswith("504B0304"), is_docx(content)).otherwise(F.lit(False)) if docx else F.lit(False)
    return F.when(
        content.isNotNull(),
        F.when(start.startswith("89504E47"), "image/png")
        .when(start.startswith("FFD8FF"), "image/jpeg")
        .when(start.startswith("52494646") & (F.substring(start, 17, 8) == "57454250"), "image/webp")
        .when(start.startswith("25504446"), "application/pdf")
        .when(archive, DOCX)
        .when(is_text & html, "text/html")
        .when(is_text & markdown, "text/markdown")
        .when(is_text, "text/plain"),
    )


def compatible(declared: Column, found: Column) -> Column:
    """A declared type fits what was detected: the same, or both text and not declared as HTML."""
    both = declared.isin(*TEXT_TYPES) & found.isin(*TEXT_TYPES) & (declared != "text/html")
    return F.coalesce((declared == found) | both, F.lit(False))
