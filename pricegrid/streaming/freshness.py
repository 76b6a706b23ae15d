"""Whether a feed is live or stale, kept as streaming state: a feed turns stale by a timer, without a batch of its own."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pricegrid.sources import sinks

# The processor travels to the workers inside the query, so they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_SCHEMA = "feed string, status string, newest_ms bigint, decided_ms bigint"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
TIMER_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # the one that keeps timers


class Freshness(StatefulProcessor):
    """Per feed the newest time stamp; a row comes out when it moves on, and once when its age passes the limit."""

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "newest_ms bigint")

    def _row(self, feed: str, status: str, newest: int, now: int) -> pd.DataFrame:
        return pd.DataFrame({"feed": [feed], "status": [status], "newest_ms": [newest], "decided_ms": [now]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = max(int(batch["newest_ms"].max()) for batch in rows)
        known = self.newest.get()[0] if self.newest.exists() else None
        if known is not None and known >= seen:
            return
        self.newest.update((seen,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        now = timerValues.getCurrentProcessingTimeInMs()
        live = now - seen <= self.limit_ms
        if live:
            self.handle.registerTimer(seen + self.limit_ms + 1)
        yield self._row(key[0], "live" if live else "stale", seen, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key[0], "stale", self.newest.get()[0], timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def feed_states(snapshots: DataFrame, feed: Column, interval_seconds: int = 600) -> DataFrame:
    """Changes of the state of each feed of a stream of snapshots: ``feed, status, newest_ms, decided_ms``.

    A feed is live while the age of its newest snapshot is at most twice the poll interval. Rows without a feed or a
    readable time stamp take no part. Tasks reduce their batches to a row a feed first, so a feed with most of the rows
    sends few of them to its state.
    """

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.groupby("feed", as_index=False)["newest_ms"].max()

    # try_to_timestamp: a broken time stamp must not end the stream.
    stamps = snapshots.select(feed.cast("string").alias("feed"), F.unix_millis(F.try_to_timestamp("timestamp")).alias("newest_ms"))
    rows = stamps.where(F.col("feed").isNotNull() & F.col("newest_ms").isNotNull()).mapInPandas(reduced, "feed string, newest_ms bigint")
    return rows.groupBy("feed").transformWithStateInPandas(Freshness(2000 * interval_seconds), STATE_SCHEMA, "Update", "ProcessingTime")


def follow_feeds(
    states: DataFrame, path: str, checkpoint: str, once: bool = False, every_seconds: int = 10
) -> StreamingQuery:
    """Publish the newest state of every feed. A batch that is repeated writes the same states again.

    ``once`` takes what has landed and ends. Batches for timers alone would follow without end, so such a run judges
    feeds with new snapshots, and those whose time ran out by the time of its batches.
    """
    spark = states.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        changed = batch.persist()
        try:
            if not changed.isEmpty():
                every = read_states(batch.sparkSession, path).unionByName(changed)
                last = F.max_by(F.struct("status", "newest_ms", "decided_ms"), F.struct("decided_ms", "newest_ms", "status")).alias("s")
                sinks.publish(every.groupBy("feed").agg(last).select("feed", "s.*"), path)
        finally:
            changed.unpersist()

    # A streaming query keeps the settings it is started with; the session gets its own back.
    own = {STATE_STORE: TIMER_STORE, NO_DATA_BATCHES: str(not once).lower()}
    before = {name: spark.conf.get(name) for name in own}
    try:
        for name, value in own.items():
            spark.conf.set(name, value)
        writer = states.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{every_seconds} seconds")).start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return sinks.read_published(spark, path, STATE_SCHEMA)


def prefer_live_feed(live: DataFrame, stored: DataFrame, states: DataFrame, feed: str) -> DataFrame:
    """The live snapshot while its feed's state says so, else (also with no state yet) the stored one."""
    fresh = F.coalesce(states.where(F.col("feed") == feed).agg(F.max("status")).scalar() == "live", F.lit(False))
    columns = [c for c in live.columns if c in stored.columns]
    return live.select(*columns).where(fresh).unionByName(stored.select(*columns).where(~fresh))
