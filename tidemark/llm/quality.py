"""Quality rules: cutoffs whose false rejections are bounded.

Each rule is a feature of a text and a direction. Which cutoff it gets is decided on labelled
documents, one stratum (language) at a time. Exact binomial tests, at level `DELTA` divided by the
number of all cutoffs of all rules and strata (Bonferroni), bound the share of good documents that a
cutoff rejects; cutoffs may stand together only if their bounds add up to `LIMIT` at most, so a
stratum's rules reject no more than that between them. Of those that may stand the one that rejects
most bad documents is taken, a good one counting as `WORTH` bad ones, then the best one of another
rule that fits into what is left. A stratum with too few labels for any proof rejects nothing.

Every language with labels enough is a stratum. The labels needed are counts by stratum, rule and
cutoff. Features are computed once for each whole text, in Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table

#: Share of good documents that may be rejected by all rules of a stratum, and the chance of being wrong about any of them.
LIMIT, DELTA = 0.01, 0.05
#: Bad documents that a cutoff must reject for each good one.
WORTH = 10

SYMBOLS, CAPITALS = b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5
#: Base limits: fewer words, or a greater percentage of repeated words, fail.
LEAST_WORDS, MOST_REPEATED = 10, 20

#: Rules in thousandths: share of symbols among word characters, of lines that repeat, of repeated words, of the bytes A to Z, and the mean length of words.
RULES = ("symbols", "dup_lines", "repeated", "capitals", "word_length")
#: Cutoffs that are tried for each rule: a document is rejected above one. All are fixed beforehand.
CUTOFFS = {
    "symbols": tuple(range(5, 101, 5)),
    "dup_lines": tuple(range(100, 1000, 50)),
    "repeated": tuple(range(50, 200, 10)),
    "capitals": tuple(range(50, 501, 25)),
    "word_length": tuple(range(5500, 9001, 125)),
}

FEATURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_capitals long"


def repeated_words(ids: np.ndarray, mix: np.ndarray) -> int:
    """How many words lie in a window of WINDOW words that occurs twice or more in `ids`; `mix` has 64 random bits for each word."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    bits = mix[ids]
    keys = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + bits[k : k + n]
    order = np.argsort(keys, kind="stable")
    found = keys[order]
    same = found[1:] == found[:-1]
    if not same.any():
        return 0
    a, b = order[:-1][same], order[1:][same]
    for k in range(WINDOW):
        if (ids[a + k] != ids[b + k]).any():  # two windows share 64 bits by chance: compare the words themselves
            _, which, times = np.unique(np.lib.stride_tricks.sliding_window_view(ids, WINDOW), axis=0, return_inverse=True, return_counts=True)
            a = b = np.flatnonzero(times[which] > 1)
            break
    starts = np.zeros(len(ids) + 1, np.int64)
    hit = np.unique(np.concatenate([a, b]))
    np.add.at(starts, hit, 1)
    np.add.at(starts, hit + WINDOW, -1)
    return int((np.cumsum(starts) > 0).sum())


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return len(self) - 1


def without(raw: bytes, these: bytes) -> int:
    """How many of these bytes there are."""
    return len(raw) - len(raw.translate(None, these))


def describe(texts: pa.Array) -> pa.StructArray:
    """The features of whole texts; null is an empty one."""
    rows, words = [], _Words()
    mix = np.random.default_rng(7).integers(1, 1 << 63, 1 << 16, np.uint64)
    for text in texts:
        raw = text.as_buffer().to_pybytes() if text.is_valid else b""
        found = raw.split()
        if len(words) > 100_000:
            words.clear()
        ids = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
        while len(mix) < len(words):
            mix = np.concatenate([mix, np.random.default_rng(len(mix)).integers(1, 1 << 63, len(mix), np.uint64)])
        joined = b"".join(found)
        lines = [x for x in raw.split(b"\n") if x.split()]
        rows.append((len(found), len(joined.decode()), without(joined, SYMBOLS), len(lines), len(lines) - len(set(lines)), repeated_words(ids, mix), without(joined, CAPITALS)))
    names = [x.split()[0] for x in FEATURES.split(", ")]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names)


def features(text: Column) -> Column:
    """A struct of FEATURES for each whole text."""

    @F.arrow_udf(FEATURES)
    def of(texts: pa.Array) -> pa.Array:
        return describe(texts)

    return of(text.cast("string"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def rule(name: str) -> Column:
    """A rule's value in whole thousandths; 0 for a text of no words."""

    def share(a: str, b: str) -> Column:
        return F.coalesce((1000 * F.col(a) / F.nullif(F.col(b), F.lit(0))).cast("long"), F.lit(0))

    pairs = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeated": ("n_repeat_words", "n_words"), "capitals": ("n_capitals", "word_chars"), "word_length": ("word_chars", "n_words")}
    return share(*pairs[name])


def stratum(lang: Column) -> Column:
    """The language; those without one are a stratum too."""
    return F.coalesce(lang.cast("string"), F.lit(""))


def binomial_tail(n: int, k: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly summed."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def most_rejected(n: int, k: int, level: float) -> float:
    """The share that k of n shows, at that level, not to be exceeded."""
    low, high = k / n, 1.0
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (low, middle) if binomial_tail(n, k, middle) <= level else (middle, high)
    return high


def least_good(limit: float = LIMIT, delta: float = DELTA) -> int:
    """Good documents without which no cutoff of a stratum can be proven."""
    return math.ceil(math.log(delta / sum(map(len, CUTOFFS.values()))) / math.log1p(-limit))


def choose(counts: dict[tuple[str, str], dict[int, tuple[int, int]]], good: dict[str, int], limit: float = LIMIT, delta: float = DELTA) -> dict[tuple[str, str], int]:
    """The cutoffs of each stratum that may reject together: admissible, and of most gain.

    counts: for (stratum, rule) the good and bad documents in each cell, cell i being values above
    just the first i cutoffs. good: good documents of each stratum.
    """
    level = delta / (sum(map(len, CUTOFFS.values())) * max(1, len(good)))
    out = {}
    for where, n in good.items():
        left = limit
        tries = []  # the loosest first, so that equal gains reject least
        for name in RULES:
            cells = counts.get((where, name), {})
            for i, at in reversed(list(enumerate(CUTOFFS[name], 1))):
                above = [v for cell, v in cells.items() if cell >= i]
                falsely, rightly = sum(x[0] for x in above), sum(x[1] for x in above)
                tries.append((rightly - WORTH * falsely, name, at, falsely))
        for gain, name, at, falsely in sorted(tries, key=lambda x: -x[0]):
            # a share at or above what is left can't pass, so its sum is spared
            if gain > 0 and (where, name) not in out and falsely < left * n and binomial_tail(n, falsely, left) <= level:
                out[where, name] = at
                left -= most_rejected(n, falsely, level)
    return out


def fit(described: DataFrame, labels: DataFrame) -> dict[tuple[str, str], int]:
    """Cutoffs from rows with doc_id, stratum and features, and labels with doc_id and quality.

    Base failures are left out, since the rules only judge what passes them. A document whose labels
    contradict each other counts as good.
    """
    quality = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    held = described.where(~base_failed()).join(quality, "doc_id")
    enough = held.where("quality > 0").groupBy("stratum").count().where(F.col("count") >= least_good())
    held = held.join(F.broadcast(enough.select("stratum")), "stratum", "left_semi")
    cells = []
    for name in RULES:
        cell = sum((rule(name) > c).cast("int") for c in CUTOFFS[name])
        cells.append(F.struct(F.lit(name).alias("rule"), cell.alias("cell")))
    rows = held.select("stratum", "quality", F.explode(F.array(*cells)).alias("x")).groupBy("stratum", "x.rule", "x.cell")
    counts: dict[tuple[str, str], dict[int, tuple[int, int]]] = {}
    good: dict[str, int] = {}
    for r in rows.agg(F.count(F.when(F.col("quality") > 0, 1)).alias("good"), F.count(F.when(F.col("quality") <= 0, 1)).alias("bad")).collect():  # a row for each stratum and cutoff at most
        counts.setdefault((r["stratum"], r["rule"]), {})[r["cell"]] = (r["good"], r["bad"])
        if r["rule"] == RULES[0]:
            good[r["stratum"]] = good.get(r["stratum"], 0) + r["good"]
    return choose(counts, good)


def rejected(cutoffs: dict[tuple[str, str], int]) -> Column:
    """True where a cutoff of the row's stratum is exceeded."""
    out = F.lit(False)
    for (where, name), at in sorted(cutoffs.items()):
        out = out | ((F.col("stratum") == where) & (rule(name) > at))
    return out


def described(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and features of each document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), stratum(F.col("lang")).alias("stratum"), features(F.col("text")).alias("f")).select("doc_id", "stratum", "f.*")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Features and verdict of each document.

    A null or empty text has no words and fails; rows of a null language are a stratum.
    Ids may be null (then unlabelled) or repeat; equal rows get equal verdicts. Without labels only
    the base rules reject. No rows give no rows. The columns doc_id, text and lang are read.
    """
    rows = cut(described(docs))
    failed = base_failed()
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~rejected(fit(rows, labels)))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their columns as they were. The texts are read twice and never shuffled."""
    cutoffs = fit(cut(described(docs)), labels)
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    rows = docs.select(row, stratum(F.col("lang")).alias("stratum"), features(F.col("text")).alias("f")).select("row", "stratum", "f.*")
    return rows.where(~base_failed() & ~rejected(cutoffs)).select(*[F.col("row")[c].alias(c) for c in names])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
