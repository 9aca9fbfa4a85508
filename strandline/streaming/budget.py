"""Budgets by recipient, as state that expires."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HOUR_MS = 3_600_000


@contextmanager
def rocksdb(spark: SparkSession):
    """State of queries that start within is kept in RocksDB, which state variables and timers need."""
    key, value = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


class HourlyBudget(StatefulProcessor):
    """Lets per_hour rows of a key and hour through. State: how many each hour has let through, at most one entry an hour.

    A batch's rows are cut to the first per_hour of each hour while their chunks come, so neither memory nor outcome depends on
    how Arrow cuts them. An hour goes once the watermark is idle_hours past it; a key with no row for idle_hours of event time goes
    whole, by a timer.
    """

    def __init__(self, per_hour: int, idle_hours: int):
        self.per_hour, self.idle = per_hour, idle_hours * HOUR_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.taken = handle.getMapState("taken", "hour long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        best = None
        for chunk in rows:
            both = chunk if best is None else pd.concat([best, chunk])
            best = both.sort_values(["ts", "event_id"]).groupby("hour").head(self.per_hour)
        if best is None:
            return
        watermark = timerValues.getCurrentWatermarkInMs()
        keep = []
        for hour, own in best.groupby("hour", sort=True):
            at = (int(hour),)
            n = self.taken.getValue(at)[0] if self.taken.containsKey(at) else 0
            keep.append(own.head(self.per_hour - n))
            if len(keep[-1]):
                self.taken.updateValue(at, (n + len(keep[-1]),))
        for (hour,) in list(self.taken.keys()):
            if (hour + 1) * HOUR_MS + self.idle <= watermark:
                self.taken.removeKey((hour,))
        timers = list(self.handle.listTimers())
        last = max([(int(best["hour"].max()) + 1) * HOUR_MS + self.idle, watermark + 1, *timers])
        for t in timers:
            if t != last:
                self.handle.deleteTimer(t)
        if last not in timers:
            self.handle.registerTimer(last)
        out = pd.concat(keep)
        if len(out):
            yield out[["event_id", "user_id", "ts"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        self.taken.clear()
        return iter(())

    def close(self) -> None:
        pass


def within_budget(events: DataFrame, per_hour: int = 3, idle_hours: int = 48, delay: str = "1 hour") -> DataFrame:
    """event_id, user_id, ts of the first per_hour events of each recipient (user_id) and hour: in order of batches, then of time.

    Rows later than delay are dropped. The query must start within rocksdb(); see HourlyBudget for its state.
    """
    rows = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    rows = rows.withColumn("hour", F.floor(F.unix_timestamp("ts") / 3600))
    return rows.groupBy("user_id").transformWithStateInPandas(HourlyBudget(per_hour, idle_hours), "event_id long, user_id long, ts timestamp", "append", "eventTime")
