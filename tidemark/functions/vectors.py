"""Vectors: cosine similarity and validation of arrays of floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_DIMENSIONS = 2000


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)).cast("float") for x in vector])


def _products(a: Column, b: Column) -> Column:
    """Sum in double of products in single precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of floats; 0 if either has no length, an error if dimensions differ."""
    aa, bb = _products(a, a), _products(b, b)
    value = F.when((aa == 0) | (bb == 0), F.lit(0.0)).otherwise(_products(a, b) / (F.sqrt(aa) * F.sqrt(bb)))
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vector dimensions differ")).cast("double"))


def valid(c: Column, dimensions: int | None = None) -> Column:
    """1 to 2000 finite numbers (exactly `dimensions` if given)."""
    size = F.size(c) == dimensions if dimensions else F.size(c).between(1, MOST_DIMENSIONS)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(c.isNotNull() & size & finite, F.lit(False))


def parsed(text: Column) -> Column:
    """An array of floats from its text form [a,b]."""
    return F.from_json(text, "array<float>")


def written(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("]"))
