"""Rollup tables: full overwrite, and idempotent per-day replacement with retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pricegrid.sources import versions
from pricegrid.sources.landing import path_exists


def merge_days(existing: DataFrame, new: DataFrame, retention_days: int | None = None, date: str = "date") -> DataFrame:
    """``existing`` without the days of ``new``, plus ``new``, pruned to the ``retention_days`` up to its latest day.

    Nothing new leaves ``existing`` as it is.
    """
    kept = existing.join(new.select(date).distinct(), date, "left_anti")
    if retention_days is not None:
        newest = new.agg(F.max(F.col(date).cast("date"))).scalar()
        alive = F.col(date).cast("date") >= F.date_sub(newest, retention_days - 1)
        kept = kept.where(F.coalesce(alive, F.lit(True)))
    return kept.unionByName(new)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def publish(df: DataFrame, path: str, keep: int = 2, notes: dict | None = None) -> int:
    """Write ``df`` as a new version of a whole table and return the rows written.

    Readers take the newest version, so a write that fails, or is under way, is never seen, and of two writers at a
    time each gets a version of its own. What all but the last ``keep`` versions hold is removed after a while.
    """
    rows = versions.commit(df, path, date=None, notes=notes)
    versions.vacuum(df.sparkSession, path, keep)
    return rows


def published_path(spark: SparkSession, path: str) -> str | None:
    """The folder of the newest version of a published table."""
    newest = versions.manifest(spark, path)
    return f"{path}/data/{newest.folders[versions.WHOLE]}" if newest else None


def read_published(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A published table; an empty one with ``schema`` where nothing has been published."""
    newest = published_path(spark, path)
    if newest is None:
        if schema is None:
            raise FileNotFoundError(f"nothing is published under {path}")
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(newest)


def replace_days(df: DataFrame, path: str, retention_days: int | None = None, date: str = "date") -> int:
    """Write ``df`` into a table partitioned by day, replacing exactly the days it holds.

    Re-running a day gives the same table, and an empty input changes nothing. Days older than the retention are
    dropped as whole partitions. Returns the rows written.
    """
    written = Observation()
    # Rebalancing by day gathers a day into few files and splits a day that is too big for one.
    gathered = df.hint("rebalance", date).observe(written, F.count(F.lit(1)).alias("n"))
    gathered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)
    if retention_days is not None:
        drop_expired_days(df.sparkSession, path, retention_days, date)
    return written.get["n"]


def _folders(spark: SparkSession, path: str, column: str) -> dict[str, object]:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath() for s in fs.listStatus(root) if s.isDirectory()]
    return {p.getName().split("=", 1)[1]: p for p in names if p.getName().startswith(f"{column}=")}


def _delete(spark: SparkSession, folder) -> None:
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_expired_days(spark: SparkSession, path: str, retention_days: int, date: str = "date") -> None:
    """Delete day partitions more than ``retention_days - 1`` days before the newest one. Lists folders, reads no data."""
    import datetime

    if not path_exists(spark, path):
        return
    folders = {k: p for k, p in _folders(spark, path, date).items() if k[:4].isdigit()}
    if not folders:
        return
    oldest = datetime.date.fromisoformat(max(folders)) - datetime.timedelta(days=retention_days - 1)
    for name, folder in folders.items():
        if datetime.date.fromisoformat(name) < oldest:
            _delete(spark, folder)
