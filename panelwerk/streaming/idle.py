"""States that begin because nothing happens: a worker goes down, an upload goes stale and is abandoned.

``idle_states`` follows a stream with a timer for each key, so that a state is told when its time has come, without any further event of the key. By
processing time it is told by the clock, as long as the stream runs; by event time it is told when the watermark passes it, which is right
for replays. ``idle_states_until`` is the batch twin: every change of state up to a given time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from ..plans.session import python_workers
from .activity import ABANDONED_SECONDS, HEARTBEAT_SECONDS, STALE_SECONDS

#: After how many seconds without an event which state begins, beside the state while there are events.
Steps = list[tuple[int, str]]
UPLOADS: Steps = [(STALE_SECONDS, "stale"), (ABANDONED_SECONDS, "abandoned")]
WORKERS: Steps = [(HEARTBEAT_SECONDS, "down")]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Idle(StatefulProcessor):
    """State of a key: its last event (milliseconds) and how many steps are behind it."""

    def __init__(self, key: str, steps: Steps, active: str):
        self.key, self.steps, self.active = key, steps, active

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "last long, step int")

    def _wait(self, last: int, step: int) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.held.update((last, step))
        if step < len(self.steps):
            self.handle.registerTimer(last + 1000 * self.steps[step][0] + 1)  # later than that many seconds

    def _row(self, key, state: str, at: int) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "state": [state], "since": [pd.Timestamp(at, unit="ms")]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(int(t.value // 1_000_000) for batch in rows for t in batch["ts"])
        last, step = self.held.get() if self.held.exists() else (None, len(self.steps))
        for at in times:
            if last is not None and at <= last:
                continue
            if last is None:
                yield self._row(key, self.active, at)
                last, step = at, 0
                continue
            while step < len(self.steps) and at > last + 1000 * self.steps[step][0]:  # passed by before its timer was seen
                yield self._row(key, self.steps[step][1], last + 1000 * self.steps[step][0])
                step += 1
            if step:
                yield self._row(key, self.active, at)
            last, step = at, 0
        self._wait(last, step)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, step = self.held.get()
        seconds, state = self.steps[step]
        yield self._row(key, state, last + 1000 * seconds)
        self._wait(last, step + 1)

    def close(self) -> None:
        pass


def idle_states(events: DataFrame, key: str, steps: Steps, active: str = "active", by_clock: bool = True) -> DataFrame:
    """(key, state, since): each change of state of a stream of events (key, ts), in update mode.

    ``by_clock``: by processing time; else by event time, for which the stream needs a watermark. State is kept in the store that Spark has for timers.
    """
    spark: SparkSession = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    python_workers(spark)
    kind = events.schema[key].dataType.simpleString()
    schema = StructType.fromDDL(f"{key} {kind}, state string, since timestamp")
    found = events.select(key, "ts").groupBy(key)
    return found.transformWithStateInPandas(_Idle(key, steps, active), schema, "Update", "ProcessingTime" if by_clock else "EventTime")


def idle_states_until(events: DataFrame, key: str, steps: Steps, now: Column, active: str = "active") -> DataFrame:
    """The batch twin: each change of state up to ``now``; events of one time count once."""
    turn = Window.partitionBy(key).orderBy("ts")
    rows = events.select(key, F.col("ts").cast("timestamp").alias("ts")).distinct()
    rows = rows.withColumns({"before": F.lag("ts").over(turn), "until": F.coalesce(F.lead("ts").over(turn), now.cast("timestamp"))})
    after = lambda seconds: F.timestamp_micros(F.unix_micros("ts") + F.lit(seconds * 1_000_000))
    idle = lambda a, b, seconds: F.unix_micros(b) - F.unix_micros(a) > seconds * 1_000_000
    begins = F.col("before").isNull() | idle(F.col("before"), F.col("ts"), steps[0][0])
    changes = [F.when(begins, F.struct(F.lit(active).alias("state"), F.col("ts").alias("since")))]
    changes += [F.when(idle(F.col("ts"), F.col("until"), s), F.struct(F.lit(name).alias("state"), after(s).alias("since"))) for s, name in steps]
    return rows.select(key, F.explode(F.filter(F.array(*changes), lambda c: c.isNotNull())).alias("c")).select(key, "c.state", "c.since")
