"""Job states in a stream: legal transitions only, and a timer that fails jobs which fall silent.

The state of a job is a value in Spark's state store (``transformWithState``); nothing about jobs is kept anywhere else.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

FINAL = ("succeeded", "failed", "cancelled")
ORDER = ("pending", "loading", "aligning", "drizzling", "saving")
OUT = "job long, ts timestamp, before string, status string, verdict string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def legal(before: str | None, status: str) -> bool:
    """A job begins anywhere; it goes on to later steps and ends once, in one of the final states, from which nothing leads."""
    if before in FINAL:
        return False
    if status in FINAL:
        return True
    return status in ORDER and (before is None or ORDER.index(status) > ORDER.index(before))


class JobStates(StatefulProcessor):
    """Rows (OUT) of each event that comes in time: ``moved`` where the transition is legal, else ``refused``; and ``silent`` where a job is failed by its timer."""

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, at long")

    def _time(self, ms: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if ms is not None:
            self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows, timerValues):
        (job,) = key
        held = self.state.get() if self.state.exists() else None
        before, at = (held[0], held[1]) if held else (None, 0)
        out = []
        events = pd.concat(list(rows)).sort_values(["ts", "status"])
        for ts, status in zip(events["ts"], events["status"]):
            ms = int(pd.Timestamp(ts).value // 1_000_000)
            good = legal(before, status)
            out.append((job, ts, before, status, "moved" if good else "refused"))
            if good:
                before, at = status, max(at, ms)
        if before is not None:
            self.state.update((before, at))
            self._time(None if before in FINAL else at + self.silence_ms)
        yield pd.DataFrame(out, columns=["job", "ts", "before", "status", "verdict"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        (job,) = key
        before, at = self.state.get()
        ms = expiredTimerInfo.getExpiryTimeInMs()
        if before not in FINAL:
            self.state.update(("failed", ms))
            yield pd.DataFrame([(job, pd.Timestamp(ms, unit="ms"), before, "failed", "silent")], columns=["job", "ts", "before", "status", "verdict"])

    def close(self) -> None:
        pass


def job_states(events: DataFrame, late: str = "10 minutes", silence: str = "1 hour", mode: str = "append") -> DataFrame:
    """Verdicts (OUT) on a stream of events (job, ts, status). Events behind the watermark are dropped before they reach a state; a job that says nothing for ``silence`` fails when
    the watermark passes that. The session's state store must be RocksDB (``use_rocksdb``)."""
    ms = int(pd.Timedelta(silence).total_seconds() * 1000)
    rows = events.select(F.col("job").cast("long").alias("job"), "ts", "status").withWatermark("ts", late)
    in_time = rows.groupBy("job").transformWithStateInPandas(JobStates(ms), OUT, outputMode=mode, timeMode="EventTime")
    return in_time


def use_rocksdb(spark):
    """Make RocksDB the state store of queries that start from now on; gives the setting before."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    return before
