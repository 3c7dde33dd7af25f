"""Values bound once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` computed once; an expression that is merely repeated, or used in a lambda, is computed each time."""
    return F.element_at(F.transform(F.array(value), body), 1)
