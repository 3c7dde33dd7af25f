"""Batches in pieces, for Python that must not hold all of a batch as objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values of a piece at most, and bytes (but for one value that is longer).
ROWS, BYTES = 64, 1 << 20


def pieces(of: pa.Array, rows: int = ROWS, most: int = BYTES) -> Iterator[pa.Array]:
    """Slices of an array, in order, none of them empty."""
    if len(of) > rows or len(of) > 1 and of.nbytes > most:
        half = len(of) // 2
        yield from pieces(of.slice(0, half), rows, most)
        yield from pieces(of.slice(half), rows, most)
    elif len(of):
        yield of


def string_udf(fn: Callable[[str | bytes | None], str | None]) -> Callable:
    """A column function from one value to a string; a worker holds a batch and its results in Arrow, and as Python's objects one piece."""

    def run(column: pa.Array) -> pa.Array:
        found = pa.concat_arrays([pa.array([], pa.string()), *(pa.array([fn(x) for x in part.to_pylist()], pa.string()) for part in pieces(column))])
        pa.default_memory_pool().release_unused()
        return found

    return F.arrow_udf(run, T.StringType())
