"""Fill-in-middle transformation: texts cut at two unit boundaries and put into another order.

The texts of a batch are one run of bytes. A packed bitvector marks the last byte of each unit, a
second one the first byte of each character; block popcount directories answer rank and select on
them (`bits.Bits`). The units of a text are the difference of the ranks at its ends, a cut after k
of its units is the byte after the set bit of rank k there, and characters between two cuts are a
difference of ranks again. No text is split into units and no text is decoded.

What becomes of a text is decided by its id and a seed alone, so that reruns and any partitioning
give the same output.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bits import Bits
from tidemark.llm.common import map_batches, table

#: Marks before the prefix, the suffix and the middle. A text that holds one stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Per cent of texts that are transformed, and of those the share whose suffix comes first.
RATE, SPM = 100, 50


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row (null: none) and where each begins, the end included."""
    texts = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def boundaries(data: np.ndarray, at: np.ndarray, unit: str) -> tuple[Bits, Bits]:
    """Bitvectors of the last bytes of units and of the first bytes of characters."""
    first = (data & 0xC0) != 0x80
    last = data == 10 if unit == "line" else np.append(first[1:], True)[: len(data)]
    last[at[1:][at[1:] > at[:-1]] - 1] = True
    return Bits.of(last), Bits.of(first)


def draws(seed: int, key: object) -> list[int]:
    """Four numbers below 2^32 from the seed and an id (null: the empty string)."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def _transformed(batch: pa.RecordBatch, seed: int, rate: int, spm: int, unit: str) -> pa.RecordBatch:
    data, at = flat(batch.column(1))
    units, chars = boundaries(data, at, unit)
    ranks = units.rank(at)
    n = np.diff(ranks)
    h = np.array([draws(seed, key) for key in batch.column(0).to_pylist()], np.int64).reshape(-1, 4)
    two = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    cuts = np.tile(at[:-1, None], 2)
    inner = two > 0
    cuts[inner] = units.select((ranks[:-1, None] + two)[inner] - 1) + 1
    begin, end, left, right = chars.rank(at[:-1]), chars.rank(at[1:]), chars.rank(cuts[:, 0]), chars.rank(cuts[:, 1])
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    forms, outputs = [], []
    whole = data.tobytes()
    for i in range(batch.num_rows):
        a, b, c, d = int(at[i]), int(cuts[i, 0]), int(cuts[i, 1]), int(at[i + 1])
        text = whole[a:d]
        if not text or any(m in text for m in marks) or h[i, 2] % 100 >= rate:
            forms.append("plain")
            outputs.append(text)
        elif h[i, 3] % 100 < spm:
            forms.append("spm")
            outputs.append(b"".join((marks[1], whole[c:d], marks[0], whole[a:b], marks[2], whole[b:c])))
        else:
            forms.append("psm")
            outputs.append(b"".join((marks[0], whole[a:b], marks[1], whole[c:d], marks[2], whole[b:c])))
    plain = np.array([f == "plain" for f in forms], bool)
    columns = [pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(left - begin, pa.int64(), mask=plain), pa.array(right - left, pa.int64(), mask=plain), pa.array(end - right, pa.int64(), mask=plain)]
    output = pa.array(outputs, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([batch.column(0), *columns, output], ["id", "n", "form", "prefix_chars", "middle_chars", "suffix_chars", "output"])


def transform(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM, unit: str = "line") -> DataFrame:
    """Id, n, form, prefix_chars, middle_chars, suffix_chars and output of each whole text.

    Units are lines with their line feed, or characters (`unit="character"`). Of an id's four numbers
    the first two choose the cuts among the n + 1 boundaries, the third whether the text is
    transformed at all (`rate` per cent are) and the fourth its form: `psm` is prefix, suffix, middle,
    `spm` suffix, prefix, middle. A null text counts as empty; empty texts and those that hold a mark
    stay `plain`, with null lengths. A null id draws as the empty string; repeated rows give equal
    rows; no rows give none. Other columns are not read.
    """
    if unit not in ("line", "character"):
        raise ValueError(f"unit is line or character, not {unit}")
    kind = docs.schema[id_col].dataType.simpleString()
    columns = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, suffix_chars long, output string"
    return map_batches(columns, lambda batch: _transformed(batch, seed, rate, spm, unit), schema).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Marks can't arise where parts meet, as each begins with `<` and ends with `>`."""
    before = lambda c, mark: F.substring_index(c, mark, 1)
    after = lambda c, mark: F.substring_index(c, mark, -1)
    middle = after(output, MIDDLE)
    head = before(output, MIDDLE)
    psm = F.concat(after(before(head, SUFFIX), PREFIX), middle, after(head, SUFFIX))
    spm = F.concat(after(head, PREFIX), middle, after(before(head, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digests = [F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return transform(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS units, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
  ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""
