"""Candidates and units of work as keyed state with timers: what is put off comes back by itself, without a rewrite of all state.

Each key has one value of state. A row says what happened to it: it was seen, put off until a time, started, failed or done. A timer
brings it back: a put-off candidate is queued again when its time has come, a failed unit is due again base * 2 ** attempts minutes
after it failed, until its attempts run out. Keys that nothing happens to for `keep` are forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What goes in: key, kind (seen, deferred, start, failed, done), at, and next_at for what is put off.
INPUT = "key string, kind string, at timestamp, next_at timestamp"
#: What comes out: each change of a key's state.
OUTPUT = "key string, state string, why string, attempts int, next_at timestamp"
STATE = "state string, attempts int, next_at timestamp"
KINDS = {"seen": "queued", "deferred": "deferred", "start": "running", "failed": "failed", "done": "done"}


class Candidates(StatefulProcessor):
    def __init__(self, most_attempts: int = 5, base: timedelta = timedelta(minutes=10), keep: timedelta = timedelta(days=60)) -> None:
        self.most_attempts, self.base, self.keep = most_attempts, base, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.own = handle.getValueState("own", STATE, int(self.keep.total_seconds() * 1000))

    def _put(self, key: str, state: str, why: str, attempts: int, next_at: datetime | None) -> tuple:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if next_at is not None:
            self.handle.registerTimer(int(next_at.replace(tzinfo=timezone.utc).timestamp() * 1000))
        self.own.update((state, attempts, next_at))
        return key, state, why, attempts, next_at

    @staticmethod
    def _rows(rows: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=["key", "state", "why", "attempts", "next_at"])
        return made.astype({"attempts": "int32", "next_at": "datetime64[ns]"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, attempts, _ = self.own.get() if self.own.exists() else (None, 0, None)
        before, out = (state, attempts), []
        given = pd.concat(list(rows), ignore_index=True).sort_values("at", kind="stable")
        for r in given.itertuples():
            next_at = None
            if r.kind == "seen" and state not in (None, "deferred", "gone"):
                continue  # known already
            if r.kind == "deferred":
                next_at = r.next_at.to_pydatetime() if not pd.isna(r.next_at) else None
            attempts += r.kind == "start"
            if r.kind == "failed" and attempts < self.most_attempts:
                next_at = r.at.to_pydatetime() + self.base * 2 ** min(attempts, self.most_attempts)
            state = KINDS.get(r.kind)
            if state is None:
                continue
            out = [self._put(key[0], state, r.kind, attempts, next_at)]
        if out and (out[-1][1], out[-1][3]) != before:
            yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.own.exists():
            state, attempts, _ = self.own.get()
            if state in ("deferred", "failed"):
                yield self._rows([self._put(key[0], "queued", "time" if state == "deferred" else "retry", attempts, None)])

    def close(self) -> None:
        pass


def followed(rows: DataFrame, **settings) -> DataFrame:
    """The changes of state (OUTPUT) of a stream of INPUT rows, with timers by the clock. Needs the RocksDB state store."""
    return rows.groupBy("key").transformWithStateInPandas(Candidates(**settings), OUTPUT, "Update", "ProcessingTime")
