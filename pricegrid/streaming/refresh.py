"""Structured Streaming jobs that keep the live snapshot and the daily rollups current.

Both write inside ``foreachBatch`` in a way that can be repeated: a restarted batch writes the same thing again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pricegrid import schema as S
from pricegrid.operators.normalize import public_sale
from pricegrid.operators.trends import with_province_column
from pricegrid.plans import jobs
from pricegrid.sources import sinks
from pricegrid.sources.landing import LANDING_SCHEMA, read_snapshots

def landing_stream(spark: SparkSession, landing: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LANDING_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(landing)


def _start(stream: DataFrame, step, checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="600 seconds")).start()


def refresh_live_snapshot(
    spark: SparkSession, landing: str, live: str, checkpoint: str, min_rows: int = S.MIN_SNAPSHOT_ROWS, once: bool = False
) -> StreamingQuery:
    """Replace the live snapshot by the newest complete one of each batch.

    A snapshot under ``min_rows`` stations is refused, as is one that is not newer than the stored one, which then
    stays; so a lost checkpoint only makes the stream look at old files again. Each new snapshot is published as a
    version of its own: a failed write is never visible.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        sizes = batch.groupBy("timestamp").agg(F.count("*").alias("n")).where(F.col("n") >= min_rows)
        # One row per snapshot of the batch: only the newest time stamp comes to the driver.
        newest = sizes.agg(F.max("timestamp").alias("t")).first()["t"]
        if newest is None:
            return
        stored = sinks.published_path(spark, live)
        if stored is not None:
            seen = spark.read.schema(S.SNAPSHOT_SCHEMA).parquet(stored).agg(F.max("timestamp").alias("t")).first()["t"]
            if seen is not None and seen >= newest:
                return
        sinks.publish(public_sale(batch.where(F.col("timestamp") == newest)).drop("dt"), live)

    return _start(landing_stream(spark, landing), step, checkpoint, once)


def read_live_snapshot(spark: SparkSession, live: str) -> DataFrame:
    return sinks.read_published(spark, live, S.SNAPSHOT_SCHEMA)


def refresh_rollups(
    spark: SparkSession, landing: str, root: str, checkpoint: str, fuels=S.PRICE_COLUMNS, once: bool = False, max_files: int | None = None
) -> StreamingQuery:
    """Recompute the days a batch touches from all their landed files and replace exactly those days.

    Taking the whole day from the landing area makes the result independent of arrival order: a late file of a past
    day only wins if its snapshot is that day's newest.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        # One value per calendar day of the batch; as literals they prune the folders that are read.
        touched = [r["dt"] for r in batch.select("dt").distinct().collect()]
        if touched:
            days = read_snapshots(spark, landing, dated=True).where(F.col("dt").isin(touched)).drop("dt")
            jobs.write_daily_rollups(days, root, fuels)

    return _start(landing_stream(spark, landing, max_files), step, checkpoint, once)


def publish_if_valid(new: DataFrame | None, path: str) -> bool:
    """Publish a zip rollup only if it has rows and every column; else, and if its write fails, the last good one stays."""
    if new is None:
        return False
    candidate = with_province_column(new)
    if not set(S.ZIP_DAILY_COLUMNS) <= set(candidate.columns) or candidate.isEmpty():
        return False
    sinks.publish(candidate.select(*S.ZIP_DAILY_COLUMNS), path)
    return True
