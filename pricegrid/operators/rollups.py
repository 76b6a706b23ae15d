"""Daily rollups and weekday statistics.

Every rollup is one unpivot and one aggregation for all days, keys and products; partial aggregation runs before the
shuffle, so a hot province, brand or day costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricegrid import schema as S
from pricegrid.functions.columns import brand_name, observed_on
from pricegrid.operators.melt import melt_prices


def daily_stats(rows: DataFrame, keys: Sequence[str], fuels: Sequence[str] = S.PRICE_COLUMNS) -> DataFrame:
    """Mean, minimum, maximum and count of positive prices per (date, keys, product); null keys are left out."""
    ids = ["date", *keys]
    dated = rows if "date" in rows.columns else rows.withColumn("date", observed_on())
    for key in keys:
        dated = dated.where(F.col(key).isNotNull())
    return (
        melt_prices(dated, ids, fuels)
        .groupBy(*ids, "fuel_type")
        .agg(
            F.round(F.avg("price"), 4).alias("avg_price"),
            F.round(F.min("price"), 4).alias("min_price"),
            F.round(F.max("price"), 4).alias("max_price"),
            F.count("*").alias("station_count"),
        )
    )


def province_daily_stats(snapshots: DataFrame, fuels: Sequence[str] = S.PRICE_COLUMNS) -> DataFrame:
    return daily_stats(snapshots, ["province"], fuels)


def zip_daily_stats(snapshots: DataFrame, fuels: Sequence[str] = S.PRICE_COLUMNS) -> DataFrame:
    """Empty, with the full column list, when the snapshots carry no zip code or province."""
    for key in ("zip_code", "province"):
        if key not in snapshots.columns:
            snapshots = snapshots.withColumn(key, F.lit(None).cast("string"))
    return daily_stats(snapshots.withColumn("zip_code", F.col("zip_code").cast("string")), ["zip_code", "province"], fuels)


def brand_daily_stats(
    snapshots: DataFrame, fuels: Sequence[str] = S.PRICE_COLUMNS, min_stations: int = S.MIN_BRAND_STATIONS
) -> DataFrame:
    """Per normalised brand; groups under ``min_stations`` are left out."""
    branded = snapshots.withColumn("brand", brand_name("label"))
    return daily_stats(branded, ["brand"], fuels).where(F.col("station_count") >= min_stations)


def daily_ingestion_stats(snapshots: DataFrame, fuels: Sequence[str] = S.PRICE_COLUMNS) -> DataFrame:
    """Row and distinct-entity counts per day, and how many products had any value."""
    locality = F.when(F.col("locality").isNotNull(), F.struct("province_id", "municipality_id", "locality"))
    active = [F.max(F.col(f).isNotNull() & ~F.isnan(f)).cast("int") for f in fuels if f in snapshots.columns]
    return (
        snapshots.withColumn("date", observed_on())
        .groupBy("date")
        .agg(
            F.count("*").alias("record_count"),
            F.count_distinct("eess_id").alias("unique_stations"),
            F.count_distinct("label").alias("unique_station_labels"),
            F.count_distinct("province").alias("unique_provinces"),
            F.count_distinct("municipality_id").alias("unique_municipalities"),
            F.count_distinct("municipality").alias("unique_municipality_names"),
            F.count_distinct(locality).alias("unique_localities"),
            F.count_distinct("locality").alias("unique_locality_names"),
            F.count_distinct("ccaa_id").alias("unique_communities"),
            sum(active, F.lit(0)).cast("bigint").alias("unique_fuel_types"),
        )
    )


def _per_weekday(days: DataFrame) -> DataFrame:
    """Days with ``(date, fuel_type, province, avg_price)`` -> mergeable statistics per weekday (Monday = 0)."""
    return (
        days.groupBy(F.weekday("date").alias("day_of_week"), "fuel_type", "province")
        .agg(
            F.round(F.sum("avg_price"), 6).alias("sum_price"),
            F.count_distinct("date").alias("count_days"),
            F.round(F.min("avg_price"), 4).alias("min_daily_avg"),
            F.round(F.max("avg_price"), 4).alias("max_daily_avg"),
        )
    )


def weekday_stats_from_snapshots(snapshots: DataFrame, fuels: Sequence[str] = S.PRICE_COLUMNS) -> DataFrame:
    """Province and national weekday statistics straight from station rows.

    Grouping sets give both levels in one pass; a missing province counts in the national figure only.
    """
    long = melt_prices(snapshots.withColumn("date", observed_on()), ["date", "province"], fuels)
    fuel, date, province = F.col("fuel_type"), F.col("date"), F.col("province")
    days = (
        long.groupingSets([[date, fuel, province], [date, fuel]], date, fuel, province)
        .agg(F.avg("price").alias("avg_price"), F.grouping("province").alias("all_provinces"))
        .where((F.col("all_provinces") == 1) | province.isNotNull())
        .withColumn("province", F.when(F.col("all_provinces") == 1, S.NATIONAL).otherwise(province))
    )
    return _per_weekday(days)


def weekday_stats_from_daily(province_daily: DataFrame) -> DataFrame:
    """The same statistics from the province rollup; the national day is weighted by station counts."""
    return _per_weekday(_with_national(province_daily))


def _with_national(province_daily: DataFrame) -> DataFrame:
    """``date, fuel_type, province, avg_price`` of the province rollup and of the nation."""
    days = province_daily.select("date", "fuel_type", "province", "avg_price", "station_count")
    national = (
        days.groupBy("date", "fuel_type")
        .agg(F.sum(F.col("avg_price") * F.col("station_count")).alias("weighted"), F.sum("station_count").alias("n"))
        .where(F.col("n") > 0)
        .select("date", "fuel_type", F.lit(S.NATIONAL).alias("province"), (F.col("weighted") / F.col("n")).alias("avg_price"))
    )
    return days.drop("station_count").unionByName(national)


WEEKDAY_KEYS = ["day_of_week", "fuel_type", "province"]


def revise_weekday_stats(stats: DataFrame, old_days: DataFrame, new_days: DataFrame, province_daily: DataFrame) -> DataFrame:
    """Running weekday statistics after some days have changed, without the days that have not.

    ``old_days`` are the province rollup's rows of these days as they stood when ``stats`` was made, ``new_days`` as
    they stand now (either may lack a day), ``province_daily`` the whole rollup as it stands now. Sums and counts take
    the difference of the two. A minimum or maximum only changes hands if the value taken away was it: then, and only
    for such keys, it is looked up in ``province_daily``, of which Spark reads those weekdays' products. A key that is
    left without days disappears.
    """
    signed = _with_national(new_days).withColumn("sign", F.lit(1)).unionByName(_with_national(old_days).withColumn("sign", F.lit(-1)))
    came, went = F.when(F.col("sign") > 0, F.col("avg_price")), F.when(F.col("sign") < 0, F.col("avg_price"))
    moved = signed.groupBy(F.weekday("date").alias("day_of_week"), "fuel_type", "province").agg(
        F.sum(F.col("sign") * F.col("avg_price")).alias("d_sum"),
        F.sum("sign").alias("d_days"),
        *[F.round(f(c), 4).alias(n) for n, f, c in (("low", F.min, came), ("high", F.max, came), ("old_low", F.min, went), ("old_high", F.max, went))],
    )
    both = stats.join(moved, WEEKDAY_KEYS, "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    lost = (F.col("old_low") <= F.col("min_daily_avg")) | (F.col("old_high") >= F.col("max_daily_avg"))
    summed = both.select(
        *WEEKDAY_KEYS,
        F.round(zero("sum_price") + zero("d_sum"), 6).alias("sum_price"),
        (zero("count_days") + zero("d_days")).alias("count_days"),
        F.least("min_daily_avg", "low").alias("min_daily_avg"),
        F.greatest("max_daily_avg", "high").alias("max_daily_avg"),
        F.coalesce(lost, F.lit(False)).alias("lost"),
    ).where("count_days > 0")
    keys = summed.where("lost").select(*WEEKDAY_KEYS)
    days = province_daily.withColumn("day_of_week", F.weekday("date")).join(keys.select("day_of_week", "fuel_type").distinct(), ["day_of_week", "fuel_type"], "left_semi")
    again = _per_weekday(_with_national(days)).join(keys, WEEKDAY_KEYS, "left_semi").select(*WEEKDAY_KEYS, F.col("min_daily_avg").alias("low"), F.col("max_daily_avg").alias("high"))
    return summed.join(again, WEEKDAY_KEYS, "left").select(
        *WEEKDAY_KEYS,
        "sum_price",
        "count_days",
        F.when(F.col("lost"), F.col("low")).otherwise(F.col("min_daily_avg")).alias("min_daily_avg"),
        F.when(F.col("lost"), F.col("high")).otherwise(F.col("max_daily_avg")).alias("max_daily_avg"),
    )


def merge_weekday_stats(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Add new weekday statistics to the running ones; either side may lack a key."""
    return (
        existing.unionByName(new)
        .groupBy("day_of_week", "fuel_type", "province")
        .agg(
            F.round(F.sum("sum_price"), 6).alias("sum_price"),
            F.sum("count_days").cast("bigint").alias("count_days"),
            F.round(F.min("min_daily_avg"), 4).alias("min_daily_avg"),
            F.round(F.max("max_daily_avg"), 4).alias("max_daily_avg"),
        )
    )
