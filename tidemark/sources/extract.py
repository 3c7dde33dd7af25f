"""Extraction: bytes to text by media type, in Arrow batches, with bounds in and out.

HTML, Markdown and DOCX need parsers, hence Arrow UDFs; plain text is decoded natively. PDF and
images depend on libraries and services, which are given as functions from bytes to text; without
one such content is reported as failed, never skipped.
"""

from __future__ import annotations

import html
import io
import re
import zipfile
import zlib
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.media import DOCX
from tidemark.functions.pieces import string_udf

#: Bounds: bytes that are read, characters that come out; for recognition of images, bytes.
MOST_BYTES, MOST_CHARS, MOST_IMAGE_BYTES = 128 << 20, 1_000_000, 10 << 20
IMAGES = ("image/jpeg", "image/png", "image/tiff")

_HIDDEN = {"script", "style", "template", "noscript"}
_BLOCKS = {
    "address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "option", "title",
}


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in _HIDDEN
        if tag in _BLOCKS:
            self.out.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag in _BLOCKS:
            self.out.append(" ")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data)


def visible_text(page: str | None) -> str | None:
    """Text that a page shows, with single spaces."""
    if page is None:
        return None
    parser = _Visible()
    parser.feed(page)
    parser.close()
    return re.sub(r"\s+", " ", "".join(parser.out)).strip()


def markdown_plain(source: str | None) -> str | None:
    """Markdown without its marks: headings, emphasis, code, links, images, lists, quotes, rules and raw HTML."""
    if source is None:
        return None
    out, fenced = [], False
    for line in source.splitlines():
        if re.match(r"\s{0,3}(```|~~~)", line):
            fenced = not fenced
            continue
        if fenced:
            out.append(line)
            continue
        if re.match(r"\s{0,3}([-*_])(\s*\1){2,}\s*$|\s{0,3}(=+|-+)\s*$|\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|?\s*$", line):
            continue
        line = re.sub(r"^\s{0,3}(>\s?)+", "", line)
        line = re.sub(r"^\s*([-*+]|\d+[.)])\s+", "", line)
        line = re.sub(r"^\s{0,3}#{1,6}\s+(.*?)\s*#*\s*$", r"\1", line)
        codes: list[str] = []
        line = re.sub(r"(`+)(.+?)\1", lambda m: codes.append(m[2].strip()) or f"\0{len(codes) - 1}\0", line)
        line = re.sub(r"!?\[([^\]]*)\]\([^)]*\)|!?\[([^\]]*)\]\[[^\]]*\]", lambda m: m[1] if m[1] is not None else m[2], line)
        line = re.sub(r"<(https?:[^>\s]+|[^@>\s]+@[^>\s]+)>", r"\1", line)
        line = re.sub(r"</?[A-Za-z][^>]*>", "", line)
        for mark in (r"\*\*\*", r"\*\*", r"\*", "~~"):
            line = re.sub(rf"{mark}(?=\S)(.+?)(?<=\S){mark}", r"\1", line)
        line = re.sub(r"(?<!\w)(_{1,3})(?=\S)(.+?)(?<=\S)\1(?!\w)", r"\2", line)
        line = re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", line)
        out.append(re.sub("\0(\\d+)\0", lambda m: codes[int(m[1])], html.unescape(line)))
    return re.sub(r"\n{2,}", "\n", "\n".join(out)).strip()


def docx_plain(data: bytes | None, most_chars: int = MOST_CHARS) -> str | None:
    """Paragraphs of a DOCX document, one on each line; null if it can't be read or unpacks to more than 64 bytes for each character allowed."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            with z.open("word/document.xml") as part:
                xml = part.read(64 * most_chars + 1)
        if len(xml) > 64 * most_chars:
            return None
        tree = ElementTree.fromstring(xml)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, zlib.error, EOFError, NotImplementedError, RuntimeError):
        return None
    text = {f"{w}t": lambda e: e.text or "", f"{w}tab": lambda _: "\t", f"{w}br": lambda _: "\n"}
    return "\n".join("".join(text[e.tag](e) for e in p.iter() if e.tag in text) for p in tree.iter(f"{w}p")).strip()


html_text = string_udf(visible_text)
markdown_text = string_udf(markdown_plain)
docx_text = string_udf(docx_plain)


def lines_of(blocks: Column, most: int = MOST_CHARS) -> Column:
    """Recognised lines of an image, from blocks (type, text), joined by newlines; null if that is longer than `most`.

    Lengths are added up before anything is joined, so a text beyond the bound is never built.
    """
    lines = F.filter(blocks, lambda b: (b["type"] == "LINE") & b["text"].isNotNull())
    length = F.aggregate(lines, F.lit(-1).cast("long"), lambda n, b: n + 1 + F.length(b["text"]))
    return F.when(length <= most, F.array_join(F.transform(lines, lambda b: b["text"]), "\n"))


def extracted(rows: DataFrame, *, content_col: str = "content", type_col: str = "media_type", pdf: Callable[[bytes], str] | None = None, ocr: Callable[[bytes], str] | None = None, most_bytes: int = MOST_BYTES, most_chars: int = MOST_CHARS) -> DataFrame:
    """Adds `extracted` and `failure`, exactly one of them null. Each type's UDF gets only its own rows' bytes. A text of white space alone is a failure."""
    content, kind = F.col(content_col), F.col(type_col)

    def only(condition: Column) -> Column:
        return F.when(condition, content)

    def plug(fn: Callable[[bytes], str] | None, condition: Column) -> Column:
        if fn is None:
            return F.lit(None).cast("string")
        return string_udf(lambda b: None if b is None else fn(b))(only(condition))

    image = kind.isin(*IMAGES) & (F.length(content) <= MOST_IMAGE_BYTES)
    fits = F.length(content) <= most_bytes
    is_text = kind.startswith("text/")
    utf8 = only(fits & is_text).cast("string")
    text = (
        F.when(~fits, F.lit(None))
        .when(kind == "application/pdf", plug(pdf, fits & (kind == "application/pdf")))
        .when(kind == DOCX, docx_text(only(fits & (kind == DOCX))))
        .when(kind == "text/markdown", markdown_text(F.when(kind == "text/markdown", utf8)))
        .when(kind == "text/html", html_text(F.when(kind == "text/html", utf8)))
        .when(is_text & F.is_valid_utf8(utf8), utf8)
        .when(image, plug(ocr, fits & image))
    )
    out = rows.withColumn("extracted", text)
    long = F.length("extracted") > most_chars
    failure = F.when(~fits, "INPUT_TOO_LARGE").when(F.col("extracted").isNull(), "EXTRACTION_FAILED").when(long, "OUTPUT_TOO_LARGE").when(F.regexp_replace("extracted", r"(?U)\s", "") == "", "BLANK_TEXT")
    return out.withColumn("failure", failure).withColumn("extracted", F.when(F.col("failure").isNull(), F.col("extracted")))
