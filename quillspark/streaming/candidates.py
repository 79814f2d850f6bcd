"""Candidates that come up again, as a stream: a state a candidate and an event-time timer for its rest.

The rules are those of operators/candidates.py, and a replay of all outcomes gives the rows of come_up_again() whose time
the watermark has passed. State and timers live in the state store, so a lost executor or a restart goes on from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from quillspark.operators.candidates import COUNTED, REST_HOURS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "attempts long, due_ms long, outcome string"


class Rests(StatefulProcessor):
    """A candidate's attempts and the rest it is in; rows (key, due_ms, outcome, attempts) when a rest is over."""

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("candidate", STATE)

    def _rows(self, key, found: list[tuple]) -> Iterator[pd.DataFrame]:
        if found:
            yield pd.DataFrame([(key[0], *r) for r in found], columns=["candidate", "due_ms", "outcome", "attempts"])

    def _rest(self, attempts: int, due: int | None, outcome: str | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due is not None:
            self.handle.registerTimer(due)
        self.state.update((attempts, due, outcome))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempts, due, outcome = self.state.get() if self.state.exists() else (0, None, None)
        found = []
        for r in pd.concat(list(rows)).sort_values(["ms", "nth"]).itertuples():
            if due is not None and due <= r.ms:  # it was over before this outcome
                found.append((due, outcome, attempts))
            attempts += r.outcome in COUNTED
            due, outcome = (r.ms + REST_HOURS[r.outcome] * 3_600_000, r.outcome) if r.outcome in REST_HOURS else (None, None)
        self._rest(attempts, None if due is None else int(due), outcome)
        yield from self._rows(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempts, due, outcome = self.state.get()
        self.state.update((attempts, None, None))
        yield from self._rows(key, [] if due is None else [(due, outcome, attempts)])

    def close(self) -> None:
        pass


def come_up_again(outcomes: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(candidate, due, outcome, attempts) of a stream of outcomes (candidate string, ts, nth, outcome), each once its time is
    past the watermark. Times are taken to the millisecond. The session's state store has to be RocksDB.
    """
    rows = outcomes.where(F.col("outcome") != "blocked").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select("candidate", "ts", F.unix_millis("ts").alias("ms"), F.col("nth").cast("long").alias("nth"), "outcome")
    out = rows.groupBy("candidate").transformWithStateInPandas(Rests(), "candidate string, due_ms long, outcome string, attempts long", "Append", "EventTime")
    return out.select("candidate", F.timestamp_millis("due_ms").alias("due"), "outcome", "attempts")
