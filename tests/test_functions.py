from __future__ import annotations

import io
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions import keys, media, redaction, text, times, vectors


def one(spark, column, **values):
    schema = ", ".join(f"{k} {v[0]}" for k, v in values.items())
    return spark.createDataFrame([tuple(v[1] for v in values.values())], schema).select(column.alias("x")).first()["x"]


def windows(words: list[str], size: int, overlap: int) -> list[str]:
    out, at = [], 0
    while words:
        out.append(" ".join(words[at : at + size]))
        if at + size >= len(words):
            break
        at += size - overlap
    return out


@pytest.mark.parametrize("value", [None, "", " \t\n", "a", "a b c d e", "\x01 a  b\x0bc \x02", "a b c", " ".join(map(str, range(23)))])
@pytest.mark.parametrize(("size", "overlap"), [(5, 0), (5, 4), (5, 2), (1, 0)])
def test_chunks(spark, value, size, overlap):
    words = [w for w in "".join(" " if c in " \t\n\x0b\f\r" else c for c in value or "").strip("".join(map(chr, range(33)))).split(" ") if w]
    assert one(spark, text.chunks(F.col("t"), size, overlap), t=("string", value)) == windows(words, size, overlap)


def test_chunks_refuse_an_overlap_that_never_ends():
    with pytest.raises(ValueError):
        text.chunks(F.col("t"), 5, 5)


@pytest.mark.parametrize(("value", "expected"), [("", 1), ("abcd", 1), ("abcde", 2), ("\U0001f600abc", 2), ("é" * 8, 2)])
def test_token_estimate(spark, value, expected):
    assert one(spark, text.token_estimate(F.col("t")), t=("string", value)) == expected


@pytest.mark.parametrize(("name", "expected"), [("../unsafe.txt", "__unsafe.txt"), (None, "artifact"), ("  ", "artifact"), ("..", "_"), (".", "artifact"), ("a​b\x00.txt", "a_b_.txt"), ("ﬁle.txt", "file.txt"), ("x" * 300, "x" * 255), ("a\\b...c", "a_b_c")])
def test_safe_filename(spark, name, expected):
    assert one(spark, text.safe_filename(F.col("t")), t=("string", name)) == expected


def test_tags(spark):
    assert one(spark, text.tags_csv(F.col("t")), t=("string", " prod ,b,,b, a")) == "a,b,prod"
    have = F.array(F.lit("production"), F.lit("a"))
    assert not one(spark, text.has_all_tags(have, ["prod"]), t=("int", 1))
    assert one(spark, text.has_all_tags(have, [" production ", "a"]), t=("int", 1))
    for bad in (["a,b"], [" "]):
        with pytest.raises(ValueError):
            text.has_all_tags(have, bad)


def test_cosine(spark):
    def cosine(a, b):
        return one(spark, vectors.cosine(F.col("a"), F.col("b")), a=("array<float>", a), b=("array<float>", b))

    assert cosine([0.0, 0.0], [1.0, 0.0]) == 0
    assert math.isclose(cosine([1.0, 2.0], [1.0, 2.0]), 1)
    assert cosine([1.0, 0.0], [0.0, 3.0]) == 0
    with pytest.raises(Exception, match="dimensions differ"):
        cosine([1.0], [1.0, 2.0])


@pytest.mark.parametrize(("value", "good"), [([1.0], True), ([], False), (None, False), ([math.nan], False), ([math.inf], False), ([0.0] * 2001, False)])
def test_valid_vectors(spark, value, good):
    assert one(spark, vectors.valid(F.col("a")), a=("array<float>", value)) is good


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>{body}</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


@pytest.mark.parametrize(
    ("content", "declared", "expected"),
    [
        (b"RIFF\0\0\0\0WEBPVP8 ", None, "image/webp"),
        (b"\x89PNG\r\n", None, "image/png"),
        (b"\xff\xd8\xff\xe0", None, "image/jpeg"),
        (b"%PDF-1.7", "image/png", "application/pdf"),
        (docx("x"), None, media.DOCX),
        (b"PK\x03\x04 no archive\x00", None, None),
        (b"  <!DOCTYPE html><p>", None, "text/html"),
        (b"# x", "text/markdown; charset=utf-8", "text/markdown"),
        (b"x\x00y", None, None),
        (b"\xff\xfe", None, None),
        (b"a" * 8192 + b"\x00", None, "text/plain"),
        (b"a" * 8191 + "é".encode() + b"z", None, "text/plain"),
        (b"", None, "text/plain"),
        (None, None, None),
    ],
)
def test_detected(spark, content, declared, expected):
    assert one(spark, media.detected(F.col("c"), F.col("d")), c=("binary", content), d=("string", declared)) == expected


def test_compatible(spark):
    def ok(a, b):
        return one(spark, media.compatible(F.col("a"), F.col("b")), a=("string", a), b=("string", b))

    assert ok("text/plain", "text/html") and ok("text/markdown", "text/plain") and ok("image/png", "image/png")
    assert not ok("text/html", "text/plain") and not ok("image/png", "application/pdf") and not ok(None, "text/plain")


@pytest.mark.parametrize(("path", "expected"), [("/a/./b//c/../d", "/a/b/d"), ("a/../../b", "../b"), ("/", "/"), ("x/..", "")])
def test_normal_path(spark, path, expected):
    assert one(spark, keys.normal_path(F.col("p")), p=("string", path)) == expected


def test_retry_delay(spark):
    def delay(n, draw=None):
        return one(spark, times.retry_delay_ms(F.col("n"), None if draw is None else F.lit(draw)), n=("int", n))

    assert [delay(n) for n in (0, 1, 2, 3, 30)] == [1000, 1000, 2000, 4000, 120_000]
    assert delay(1, 0.0) == 800 and delay(1, 0.75) == 1100


def test_safe_details(spark):
    jwt = ".".join(["a" * 20] * 3)
    details = {"accessToken": "secret-value", "status": "served", "auth": "Bearer x", "sig": jwt, "none": None, "k" * 65: "v", "tab": "a\tb", "line": "a\nb"}
    safe = one(spark, redaction.safe_details(F.col("m")), m=("map<string,string>", details))
    shown = "[REDACTED]"
    assert safe == {"accessToken": shown, "status": "served", "auth": shown, "sig": shown, "none": "", "k" * 64: "v", "tab": "a\tb", "line": "a_b"}
    many = one(spark, redaction.safe_details(F.col("m")), m=("map<string,string>", {str(i): "x" for i in range(51)}))
    assert len(many) == 50
    assert one(spark, redaction.safe_details(F.col("m")), m=("map<string,string>", None)) == {}


def test_a_string_udf_holds_one_piece_as_objects(spark):
    import tracemalloc

    import pyarrow as pa

    from tidemark.functions import pieces
    from tidemark.sources import extract

    values = ["<p>a</p>" * n for n in (1, 0, 3)] * 50 + [None, "<b>x" * (1 << 19), "<i>y"]
    for rows, most in ((1, 1), (7, 100), (64, 1 << 20), (1000, 1 << 30)):
        found = list(pieces.pieces(pa.array(values), rows, most))
        assert [x for part in found for x in part.to_pylist()] == values and all(len(part) <= rows and (len(part) == 1 or part.nbytes <= most) for part in found)
    assert list(pieces.pieces(pa.array([], pa.string()))) == []
    rows = spark.createDataFrame(list(enumerate(values)), "i int, html string").coalesce(1)
    assert [r["t"] for r in rows.orderBy("i").select(extract.html_text("html").alias("t")).collect()] == [extract.visible_text(v) for v in values]
    pages = pa.array([f"<p>{i} " + "text " * 4000 for i in range(400)])  # 8 MB
    tracemalloc.start()
    shown = extract.html_text.func(pages)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(shown) == 400 and shown[7].as_py() == extract.visible_text(pages[7].as_py()) and most < 4 << 20
