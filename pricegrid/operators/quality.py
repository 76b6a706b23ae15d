"""Quality gate, inventory, gaps and freshness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricegrid import schema as S
from pricegrid.operators.trends import day


def gate_report(snapshot: DataFrame) -> DataFrame:
    """Long report (check, column, value, severity) from one aggregation. Severities: error, warning, info, ok."""
    missing = [c for c in S.SNAPSHOT_COLUMNS if c not in snapshot.columns]
    counters = [F.count("*").alias("row_count")]

    def outside(column: str, low: float, high: float):
        c = F.col(column)
        return F.count_if((c < low) | ((c > high) & ~F.isnan(c))).alias(f"out_of_range:{column}")

    for c in S.FLOAT_COLUMNS:
        if c in missing:
            continue
        if c.endswith("_price"):
            counters.append(outside(c, *S.PRICE_RANGE))
            absent = F.avg((F.col(c).isNull() | F.isnan(c)).cast("double")) * 100
            counters.append(absent.alias(f"null_pct:{c}"))
        else:
            counters.append(outside(c, *(S.LATITUDE_RANGE if c == "latitude" else S.LONGITUDE_RANGE)))
    wide = snapshot.agg(*counters)
    wide = wide.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in wide.columns])
    wide = wide.withColumns({f"missing:{c}": F.lit(1.0) for c in missing})
    long = wide.unpivot([], [F.col(f"`{c}`") for c in wide.columns], "check", "value")
    name = F.split("check", ":")
    severity = (
        F.when(name[0] == "missing", "error")
        .when((name[0] == "row_count") & (F.col("value") == 0), "error")
        .when((name[0] == "row_count") & (F.col("value") < S.MIN_SNAPSHOT_ROWS), "warning")
        .when((name[0] == "out_of_range") & (F.col("value") > 0), "warning")
        .when((name[0] == "null_pct") & (F.col("value") > 0), "info")
        .otherwise("ok")
    )
    return long.select(
        name[0].alias("check"), F.try_element_at(name, F.lit(2)).alias("column"), F.coalesce("value", F.lit(0.0)).alias("value"), severity.alias("severity")
    )


def require_usable(snapshot: DataFrame) -> None:
    """Raise on the errors of the report: an empty snapshot or missing columns."""
    errors = [f"{r['check']} {r['column'] or ''}".strip() for r in gate_report(snapshot).where("severity = 'error'").collect()]
    if errors:
        raise ValueError(f"snapshot rejected: {errors}")


def data_inventory(ingestion_stats: DataFrame, files: DataFrame) -> DataFrame:
    """One row: days, months and years with data, first and last day, and the bytes stored over all files."""
    dates = ingestion_stats.where(F.col("record_count") > 0).select(F.col("date").cast("date").alias("d"))
    days = dates.agg(
        F.count_distinct("d").alias("num_days"),
        F.count_distinct(F.trunc("d", "month")).alias("num_months"),
        F.count_distinct(F.trunc("d", "year")).alias("num_years"),
        F.min("d").alias("min_date"),
        F.max("d").alias("max_date"),
    )
    size = files.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes")).scalar()
    return days.withColumn("total_size_bytes", size)


def available_dates(ingestion_stats: DataFrame) -> DataFrame:
    """The days with data, in order."""
    return ingestion_stats.where(F.col("record_count") > 0).select(F.col("date").cast("date").alias("date")).distinct().orderBy("date")


def missing_days(dates: DataFrame, first=None, last=None, keys: Sequence[str] = ()) -> DataFrame:
    """Calendar days without data between two days (by default the first and last with data), for each of ``keys``."""
    have = dates.select(*keys, F.col("date").cast("date").alias("date")).distinct()
    low = F.min("date") if first is None else F.lit(str(first)).cast("date")
    high = F.max("date") if last is None else F.lit(str(last)).cast("date")
    span = have.groupBy(*keys).agg(low.alias("low"), high.alias("high")).where(F.col("low") <= F.col("high"))
    calendar = span.select(*keys, F.explode(F.sequence("low", "high", F.expr("INTERVAL 1 DAY"))).alias("date"))
    return calendar.join(have, [*keys, "date"], "left_anti")


def latest_day_stats(ingestion_stats: DataFrame, max_date=None) -> DataFrame:
    """The counts of one day: the one asked for, else the latest there is."""
    wanted = [
        "unique_stations", "unique_provinces", "unique_communities", "unique_localities", "unique_fuel_types",
    ]
    rows = ingestion_stats.select(F.col("date").cast("date").alias("date"), *wanted)
    if max_date is not None:
        rows = rows.where(F.col("date") == F.lit(str(max_date)).cast("date"))
    latest = F.max_by(F.struct("date", *wanted), "date").alias("latest")
    return rows.agg(latest).where(F.col("latest").isNotNull()).select("latest.*")


def feed_freshness(files: DataFrame, snapshot: DataFrame, as_of=None, live_active: bool = False) -> DataFrame:
    """One row: ``ok`` when the live feed runs or today's file is there, ``stale`` when it is not, ``error`` without any."""
    newest = files.agg(F.max_by("file_name", F.struct("day", "file_name")).alias("latest_file"), F.max("day").alias("file_date"))
    stamp = snapshot.agg(F.max("timestamp").alias("t")).scalar()
    live = F.lit(bool(live_active))
    status = (
        F.when(live, "ok").when(F.col("latest_file").isNull(), "error").when(F.col("file_date") == day(as_of), "ok").otherwise("stale")
    )
    return newest.select(
        status.alias("status"),
        F.when(live, "realtime").otherwise("stored").alias("source"),
        "latest_file",
        "file_date",
        F.coalesce(stamp, F.col("file_date").cast("string")).alias("data_datetime"),
        day(as_of).alias("expected_date"),
    )
