"""A leased job queue as keyed state: commands come in as a stream, and each job's record is its state.

Commands are rows (job_id, seq, at, command, owner, lease_seconds, error). A job's commands are
applied in the order of `seq`; time is what the command says, so runs repeat exactly. The stream of
results has a row for each command: whether it was accepted and what the record became. The rules of
one step are in `applied`, which the batch form and the stateful form share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.times import ATTEMPTS, FACTOR, FIRST_MS, LONGEST_MS

COMMAND = "job_id string, seq long, at timestamp, command string, owner string, lease_seconds long, error string"
RESULT = "job_id string, seq long, command string, accepted boolean, status string, attempts long, owner string, expires_ms long, next_ms long, error string"
STATE = "status string, attempts long, owner string, expires_ms long, next_ms long, error string"


@dataclass(frozen=True)
class Record:
    status: str
    attempts: int = 0
    owner: str | None = None
    expires_ms: int | None = None
    next_ms: int | None = None
    error: str | None = None


def applied(r: Record | None, command: str, at: int, owner: str | None, lease_ms: int, error: str | None, most: int = ATTEMPTS) -> tuple[bool, Record | None]:
    """Whether a command is accepted, and the record after it. Times are milliseconds.

    enqueue: the first one counts. claim: due, one attempt more. renew, complete, fail: only for the
    owner of a lease that has not run out; a failure waits for another try, or is a dead letter after
    the last. recover: a lease that has run out is due again at once.
    """
    if command == "enqueue":
        return (True, Record("PENDING")) if r is None else (False, r)
    if r is None:
        return False, None
    holds = r.status == "CLAIMED" and r.owner == owner and (r.expires_ms or 0) > at
    if command == "claim" and r.status in ("PENDING", "RETRY_PENDING") and (r.next_ms is None or r.next_ms <= at):
        return True, Record("CLAIMED", r.attempts + 1, owner, at + lease_ms, r.next_ms, r.error)
    if command == "renew" and holds:
        return True, Record(r.status, r.attempts, owner, at + lease_ms, r.next_ms, r.error)
    if command == "complete" and holds:
        return True, Record("COMPLETED", r.attempts, error=r.error)
    if command == "fail" and holds:
        if r.attempts >= most:
            return True, Record("DEAD_LETTER", r.attempts, error=error)
        return True, Record("RETRY_PENDING", r.attempts, next_ms=at + int(min(LONGEST_MS, FIRST_MS * FACTOR ** (r.attempts - 1))), error=error)
    if command == "recover" and r.status == "CLAIMED" and (r.expires_ms or 0) <= at:
        return True, Record("RETRY_PENDING", r.attempts, next_ms=at, error="lease expired")
    return False, r


def _millis(x: datetime | pd.Timestamp) -> int:
    """Whole milliseconds, exactly; a time without a zone is UTC."""
    return pd.Timestamp(x).value // 1_000_000


def lease_stream(commands: DataFrame, most: int = ATTEMPTS) -> DataFrame:
    """Results of a stream of commands, each job's record being kept as state."""
    names = [f.name for f in fields(Record)]

    def known(x: object) -> object:
        return None if x is None or x is pd.NA or x != x else x

    def step(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        record = Record(*map(known, state.get)) if state.exists else None
        frame = pd.concat(list(frames)).sort_values("seq")  # commands of one job in one micro-batch
        out = []
        for c in frame.itertuples(index=False):
            ok, record = applied(record, c.command, _millis(c.at), known(c.owner), 1000 * int(known(c.lease_seconds) or 0), known(c.error), most)
            out.append({"job_id": key[0], "seq": c.seq, "command": c.command, "accepted": ok} | (asdict(record) if record else dict.fromkeys(names)))
        if record:
            state.update(tuple(getattr(record, n) for n in names))
        result = pd.DataFrame(out, columns=[x.split()[0] for x in RESULT.split(", ")])
        yield result.astype({"attempts": "Int64", "expires_ms": "Int64", "next_ms": "Int64"})

    return commands.groupBy("job_id").applyInPandasWithState(step, RESULT, STATE, "append", GroupStateTimeout.NoTimeout)
