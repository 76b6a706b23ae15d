"""Landed documents, CSV history and snapshot files.

Snapshot files sit under ``<root>/dt=YYYY-MM-DD/``; file names must not contain ``:`` (Hadoop paths forbid it).
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricegrid import schema as S
from pricegrid.operators.trends import day


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed JSON document."""
    return spark.read.schema(S.RAW_DOCUMENT_SCHEMA).option("multiLine", True).json(path)


def parse_documents(texts: DataFrame, column: str = "document") -> DataFrame:
    """The same from a table that holds the document text in a column; unreadable text gives a null status."""
    parsed = texts.withColumn("_d", F.from_json(column, S.RAW_DOCUMENT_SCHEMA))
    return parsed.select(*[c for c in texts.columns if c != column], "_d.*")


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed file with its text as it is: ``file, document``. Spark's readers list no file of no bytes."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("document"))


def read_csv_history(spark: SparkSession, path: str) -> DataFrame:
    """CSV snapshots with a header, matched to the contract by column name."""
    return spark.read.option("header", True).option("enforceSchema", False).schema(S.SNAPSHOT_SCHEMA).csv(path)


LANDING_SCHEMA = T.StructType([*S.SNAPSHOT_SCHEMA.fields, T.StructField("dt", T.DateType())])


def read_snapshots(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, dated: bool = False, merge: bool = False
) -> DataFrame:
    """All snapshot files by the table contract: columns that an older layout lacks are null, and no footer is opened
    to find the schema. ``dated`` adds the day of the folder; ``merge`` takes the union of all files' own columns.
    """
    if merge:
        rows = spark.read.option("mergeSchema", True).parquet(path)
    else:
        rows = spark.read.schema(LANDING_SCHEMA if dated else S.SNAPSHOT_SCHEMA).parquet(path)
    return rows.select(*columns) if columns else rows


def read_optional(spark: SparkSession, path: str, schema, columns: Sequence[str] | None = None) -> DataFrame:
    """A stored table, or an empty one with ``schema`` when nothing is stored yet."""
    rows = spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)
    return rows.select(*columns) if columns else rows


def read_days(spark: SparkSession, root: str, first=None, last=None) -> DataFrame:
    """Several days of snapshots; only the partitions in the range are listed and read."""
    rows = read_snapshots(spark, root, dated=True)
    if first is not None:
        rows = rows.where(F.col("dt") >= F.lit(str(first)).cast("date"))
    if last is not None:
        rows = rows.where(F.col("dt") <= F.lit(str(last)).cast("date"))
    return rows


def write_snapshot(snapshot: DataFrame, root: str) -> None:
    """Append a snapshot to its day's partition, Snappy-compressed; every run adds its own files."""
    dated = snapshot.withColumn("dt", F.to_date("timestamp"))
    dated.write.mode("append").option("compression", "snappy").partitionBy("dt").parquet(root)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


# -------------------------------------------------------------------------------------------- file catalogue


def list_files(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """The files under a folder: ``file_name, size_bytes, day`` (of a ``dt=`` folder). Lists them; reads no content."""
    return _described(spark, [root], pattern)


def _described(spark: SparkSession, folders: list[str], pattern: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folders)
    day_text = F.regexp_extract("path", "/dt=([0-9]{4}-[0-9]{2}-[0-9]{2})/", 1)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(name.alias("file_name"), F.col("length").alias("size_bytes"), F.try_to_date(day_text).alias("day"))


def day_folders(spark: SparkSession, root: str) -> list[str]:
    """Days that have a folder, newest first. One listing of the root: folder names come to the driver, no files."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/dt=*")
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target) or []
    days = (status.getPath().getName()[3:] for status in found if status.isDirectory())
    return sorted((d for d in days if len(d) == 10 and d[:4].isdigit()), reverse=True)


def list_days(spark: SparkSession, root: str, days: Sequence, pattern: str = "*.parquet") -> DataFrame:
    """``list_files`` of some days; no other day's folder is listed. A day without a folder has no files."""
    folders = [f"{root}/dt={d}" for d in sorted({str(d) for d in days})]
    folders = [f for f in folders if path_exists(spark, f)]
    if not folders:
        return spark.createDataFrame([], "file_name string, size_bytes bigint, day date")
    return _described(spark, folders, pattern)


def _has_files(spark: SparkSession, folder: str, pattern: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target))


def latest_stored_file(spark: SparkSession, root: str, as_of=None, lookback: int = 3, pattern: str = "*.parquet") -> DataFrame:
    """``latest_file`` of a landing area, looking into day folders newest first until one has a file.

    The look-back's days are asked for by name; only if none has a file is the root listed for other days.
    """
    last = datetime.date.fromisoformat(str(as_of)[:10]) if as_of else datetime.datetime.now(datetime.timezone.utc).date()
    recent = [str(last - datetime.timedelta(days=n)) for n in range(lookback)]
    held = next((d for d in recent if _has_files(spark, f"{root}/dt={d}", pattern)), None)
    if held is None:
        held = next((d for d in day_folders(spark, root) if _has_files(spark, f"{root}/dt={d}", pattern)), None)
    return latest_file(list_days(spark, root, [held] if held else [], pattern), as_of=last, lookback=lookback)


def recent_stored_files(spark: SparkSession, root: str, max_days: int, pattern: str = "*.parquet") -> DataFrame:
    """``most_recent_days`` of a landing area: only the newest folders that hold files are listed."""
    held: list[str] = []
    for folder in day_folders(spark, root):
        if len(held) == max_days:
            break
        if _has_files(spark, f"{root}/dt={folder}", pattern):
            held.append(folder)
    return list_days(spark, root, held, pattern)


def files_between(files: DataFrame, first=None, last=None, days_back: int | None = None, as_of=None) -> DataFrame:
    """Files of a range of days, both ends included; ``days_back`` counts from ``as_of``."""
    if first is None and days_back is not None:
        low = F.date_sub(day(as_of), days_back)
    else:
        low = F.lit(str(first)).cast("date") if first is not None else None
    high = day(last if last is not None else as_of)
    rows = files.where(F.col("day") <= high)
    return rows if low is None else rows.where(F.col("day") >= low)


def latest_file_per_day(files: DataFrame) -> DataFrame:
    """The last file name of every day."""
    return files.groupBy("day").agg(F.max_by(F.struct("file_name", "size_bytes"), "file_name").alias("f")).select(
        "day", "f.file_name", "f.size_bytes"
    )


def most_recent_days(files: DataFrame, max_days: int) -> DataFrame:
    """Files of the last ``max_days`` days that have any."""
    days = files.select("day").distinct().orderBy(F.col("day").desc()).limit(max_days)
    return files.join(days, "day", "left_semi")


def latest_file(files: DataFrame, as_of=None, lookback: int = 3) -> DataFrame:
    """The newest file of the last ``lookback`` days, else the newest of all."""
    recent = F.col("day").between(F.date_sub(day(as_of), lookback - 1), day(as_of))
    newest = F.max(F.struct(recent.alias("recent"), F.col("day"), "file_name", "size_bytes")).alias("f")
    return files.agg(newest).where(F.col("f").isNotNull()).select("f.day", "f.file_name", "f.size_bytes")


def latest_snapshot_per_day(snapshots: DataFrame, version: str | None = None) -> DataFrame:
    """Rows of each day's newest snapshot.

    A day's snapshots are ordered by their time stamp, or by a column ``version`` such as ``_metadata.file_name``. The
    per-day maximum is a small hash aggregate joined back, so a day with most of the rows is not gathered in one task.
    """
    order = F.to_timestamp("timestamp") if version is None else F.col(version)
    dated = snapshots.withColumn("date", F.to_date("timestamp")).withColumn("_version", order)
    newest = dated.groupBy("date").agg(F.max("_version").alias("_version"))
    return dated.join(newest, ["date", "_version"], "left_semi").drop("_version")


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Rows of the newest snapshot of all."""
    return snapshots.where(F.col("timestamp") == snapshots.agg(F.max("timestamp")).scalar())


def latest_timestamp(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(F.max("timestamp").alias("latest_timestamp"))


def prefer_live(live: DataFrame, stored: DataFrame, as_of_ts, interval_seconds: int = 600) -> DataFrame:
    """The live snapshot while its age is at most twice the poll interval, else the stored one."""
    newest = live.agg(F.max(F.to_timestamp("timestamp"))).scalar()
    age = F.unix_timestamp(F.lit(str(as_of_ts)).cast("timestamp")) - F.unix_timestamp(newest)
    fresh = F.coalesce(age <= 2 * interval_seconds, F.lit(False))
    columns = [c for c in live.columns if c in stored.columns]
    return live.select(*columns).where(fresh).unionByName(stored.select(*columns).where(~fresh))
