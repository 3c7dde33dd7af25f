"""Retry delays and leases. The present is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed defaults: attempts, first delay and longest delay in milliseconds, factor, jitter.
ATTEMPTS, FIRST_MS, LONGEST_MS, FACTOR, JITTER = 5, 1000, 120_000, 2.0, 0.2


def retry_delay_ms(attempts: Column, draw: Column | None = None, first: int = FIRST_MS, longest: int = LONGEST_MS, factor: float = FACTOR, jitter: float = JITTER) -> Column:
    """first * factor ** (attempts - 1), off by up to `jitter` as `draw` in [0, 1) says (exact without it), between 0 and `longest`."""
    base = F.lit(float(first)) * F.pow(F.lit(float(factor)), F.greatest(F.lit(0), attempts - 1))
    if draw is not None and jitter > 0:
        base = base * (1 + (2 * draw - 1) * jitter)
    return F.least(F.lit(float(longest)), F.greatest(F.lit(0.0), base)).cast("long")


def due(status: Column, next_attempt: Column, now: Column) -> Column:
    return status.isin("PENDING", "RETRY_PENDING") & (next_attempt.isNull() | (next_attempt <= now))


def lease_expired(status: Column, expires: Column, now: Column) -> Column:
    """A claim that nobody may complete any more."""
    return (status == "CLAIMED") & (expires <= now)


def owns_lease(status: Column, owner: Column, expires: Column, who: str, now: Column) -> Column:
    return F.coalesce((status == "CLAIMED") & (owner == who) & (expires > now), F.lit(False))
