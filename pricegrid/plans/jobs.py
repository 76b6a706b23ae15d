"""The daily rollup job, the brand analytics job and the full rebuild."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from pricegrid import schema as S
from pricegrid.operators import brands, distinct, rollups
from pricegrid.operators import trips as planner
from pricegrid.sources import sinks, versions
from pricegrid.sources.landing import latest_snapshot_per_day

JOB_SCHEMA = "task string, path string, output_rows bigint, status string, error string"


def rollup_tables(snapshots: DataFrame, fuels=S.PRICE_COLUMNS) -> dict[str, DataFrame]:
    """All rollups of a history in one go: each is a single job over all days, there is no loop over files."""
    province = rollups.province_daily_stats(snapshots, fuels)
    return {
        "province_daily_stats": province,
        "zip_code_daily_stats": rollups.zip_daily_stats(snapshots, fuels),
        "brand_daily_stats": rollups.brand_daily_stats(snapshots, fuels),
        "daily_ingestion_stats": rollups.daily_ingestion_stats(snapshots, fuels),
        "day_of_week_stats": rollups.weekday_stats_from_daily(province),
    }


def rebuild(snapshots: DataFrame, fuels=S.PRICE_COLUMNS) -> dict[str, DataFrame]:
    """Rollups over a whole history, taking each day's newest snapshot."""
    return rollup_tables(latest_snapshot_per_day(snapshots).drop("date"), fuels)


def _run(spark: SparkSession, tasks: list[tuple[str, Callable[[str], int]]], root: str) -> DataFrame:
    """Run writes one after the other; one that fails is reported and does not stop the rest. A write counts its rows."""
    report = []
    for name, write in tasks:
        path = f"{root}/{name}"
        try:
            report.append((name, path, write(path), "ok", None))
        except Exception as problem:  # noqa: BLE001 - reported, not hidden
            report.append((name, path, 0, "failed", str(problem)))
    return spark.createDataFrame(report, JOB_SCHEMA)


def run_daily_rollups(snapshots: DataFrame, root: str, fuels=S.PRICE_COLUMNS) -> DataFrame:
    """Write the days of ``snapshots`` into the rollup tables; returns a report with one row per table.

    The newest snapshots are read once and kept on the executors' disks for all tables; if they cannot be read whole,
    each table reads the columns it needs, so that a bad column fails no other table. A table's days are committed in
    one step. Weekday statistics come last: they follow the stored province rollup by the days that have changed.
    """
    spark = snapshots.sparkSession
    newest = latest_snapshot_per_day(snapshots).drop("date").persist(StorageLevel.DISK_ONLY)
    try:
        newest.count()
    except Exception:  # noqa: BLE001 - each table reports what it cannot read
        newest.unpersist()
    daily = rollup_tables(newest, fuels)

    def replace(name: str, retention: int | None = None):
        return name, lambda path: versions.commit(daily[name], path, retention_days=retention)

    def weekdays(path: str) -> int:
        return follow_weekdays(spark, f"{root}/province_daily_stats", path, daily["province_daily_stats"].schema)

    try:
        return _run(
            spark,
            [
                replace("province_daily_stats"),
                replace("zip_code_daily_stats", S.ZIP_RETENTION_DAYS),
                replace("brand_daily_stats"),
                replace("daily_ingestion_stats"),
                ("day_of_week_stats", weekdays),
            ],
            root,
        )
    finally:
        newest.unpersist()


def follow_weekdays(spark: SparkSession, daily_path: str, path: str, schema) -> int:
    """Bring stored weekday statistics up to the newest version of the stored province rollup.

    They note which version they were made of, so that only days whose rows have changed since are read, as they were
    and as they are; a run that is repeated, or that follows one that failed, finds the right difference. If the noted
    version is no longer kept, or nothing is stored, they are rebuilt.
    """
    noted = versions.manifest(spark, path)
    since = noted.notes.get("made_of") if noted else None
    found = versions.changed_days(spark, daily_path, since)
    now = versions.manifest(spark, daily_path)
    made_of = now.version if now else -1
    whole = versions.read(spark, daily_path, schema, made_of)
    if noted is None or since is None or found is None:
        return sinks.publish(rollups.weekday_stats_from_daily(whole), path, notes={"made_of": made_of})
    days, _ = found
    old = versions.read(spark, daily_path, schema, since, days)
    new = versions.read(spark, daily_path, schema, made_of, days)
    shape = rollups.weekday_stats_from_daily(whole).schema
    revised = rollups.revise_weekday_stats(sinks.read_published(spark, path, shape), old, new, whole)
    return sinks.publish(revised, path, notes={"made_of": made_of})


def write_daily_rollups(snapshots: DataFrame, root: str, fuels=S.PRICE_COLUMNS) -> None:
    """The same for a stream: a failed write fails the batch, which is then tried again."""
    failed = run_daily_rollups(snapshots, root, fuels).where("status <> 'ok'").collect()  # five rows at most
    if failed:
        raise RuntimeError(f"rollups not written: {[(r['task'], r['error']) for r in failed]}")


def stored_rollups(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The rollup tables as they are stored."""
    # A table that nothing has been written to yet is empty.
    shapes = rollup_tables(spark.createDataFrame([], S.SNAPSHOT_SCHEMA))
    weekdays = shapes.pop("day_of_week_stats").schema
    return {n: versions.read(spark, f"{root}/{n}", df.schema) for n, df in shapes.items()} | {
        "day_of_week_stats": sinks.read_published(spark, f"{root}/day_of_week_stats", weekdays)
    }


def plan_trips(
    trips: DataFrame, priced: DataFrame, root: str, tables: Sequence[str] = ("candidates", "stops", "summary")
) -> dict[str, DataFrame]:
    """Candidates, stops and summaries of all trips as written tables.

    Stops are planned in Python once; summaries and fuel curves then read the table instead of planning again. Stops and
    medians reduce the candidates where they are found and need no table of them, which grows with the product of trips
    and stations: without "candidates" in ``tables`` they come back as a table that is not written.
    """
    spark = trips.sparkSession

    def stored(name: str, df: DataFrame) -> DataFrame:
        if name not in tables:
            return df
        sinks.overwrite(df, f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    candidates = planner.trip_candidates(trips, priced)
    found = {"candidates": stored("candidates", candidates), "stops": stored("stops", planner.refuelling_stops(trips, candidates))}
    return found | {"summary": stored("summary", planner.trip_summary(trips, found["stops"], candidates))}


def brand_tables(market: DataFrame, wins: DataFrame, as_of) -> dict[str, DataFrame]:
    """The four brand reports from their two shared inputs."""
    return {
        "brand_competitiveness": brands.competitiveness_from(wins, as_of),
        "brand_competitiveness_monthly": brands.monthly_competitiveness_from(wins),
        "reports/brand_win_rate": brands.win_rate_from(market),
        "reports/brand_price_comparison": brands.price_comparison_from(market),
    }


def run_brand_analytics(snapshots: DataFrame, root: str, as_of) -> DataFrame:
    """Write the four brand reports; the two shared aggregates are computed once and kept on executor disks meanwhile."""
    spark = snapshots.sparkSession
    history = latest_snapshot_per_day(snapshots).persist(StorageLevel.DISK_ONLY)
    market = brands.market_days(history).persist(StorageLevel.MEMORY_AND_DISK)
    wins = brands.market_day_wins(history).persist(StorageLevel.MEMORY_AND_DISK)

    def put(name: str, df: DataFrame):
        return name, lambda path: sinks.publish(df, path)

    try:
        return _run(spark, [put(name, df) for name, df in brand_tables(market, wins, as_of).items()], root)
    finally:
        for kept in (market, wins, history):
            kept.unpersist()


def update_brand_analytics(new_days: DataFrame, root: str, as_of) -> DataFrame:
    """Bring the four brand reports up to date with some days' snapshots, new or landed again.

    The two inputs of the reports are kept as tables by day: what a day's markets hold for each brand. Only the days of
    ``new_days`` are aggregated from station rows and replaced there, in one step a table; the reports are then made of
    the kept tables, which have a row for each day, area, product and brand.
    """
    spark = new_days.sparkSession
    history = latest_snapshot_per_day(new_days).persist(StorageLevel.DISK_ONLY)
    inputs = {"market_days": brands.market_days(history), "market_day_wins": brands.market_day_wins(history)}
    try:
        for name, df in inputs.items():
            versions.commit(df, f"{root}/state/{name}", date="dt")
            versions.vacuum(spark, f"{root}/state/{name}")
    finally:
        history.unpersist()
    market, wins = [versions.read(spark, f"{root}/state/{name}", df.schema) for name, df in inputs.items()]
    put = lambda name, df: (name, lambda path: sinks.publish(df, path))
    return _run(spark, [put(name, df) for name, df in brand_tables(market, wins, as_of).items()], root)


STATE_SCHEMA = "date date, kind string, chain int, part int, bits binary"


def update_ingestion_states(snapshots: DataFrame, root: str) -> int:
    """Keep the entities of the days of ``snapshots`` as bitmaps by day; a day that comes again is replaced.

    The dictionary is published before the days that use its new places, so a run that fails between the two leaves
    places that nothing uses.
    """
    spark = snapshots.sparkSession
    entities = distinct.daily_entities(latest_snapshot_per_day(snapshots).drop("date")).persist(StorageLevel.DISK_ONLY)
    try:
        known = sinks.read_published(spark, f"{root}/dictionary", spark.createDataFrame([], distinct.DICTIONARY_SCHEMA).schema)
        sinks.publish(known.unionByName(distinct.extend_dictionary(known, entities)), f"{root}/dictionary")
        known = sinks.read_published(spark, f"{root}/dictionary", known.schema)
        return versions.commit(distinct.day_states(entities, known), f"{root}/days")
    finally:
        entities.unpersist()


def stored_states(spark: SparkSession, root: str) -> DataFrame:
    return versions.read(spark, f"{root}/days", spark.createDataFrame([], STATE_SCHEMA).schema)
