"""Rankings, weekday patterns and volatility over the rollups; one row set per product."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricegrid import schema as S
from pricegrid.functions.columns import is_mainland
from pricegrid.operators.spatial import top_k
from pricegrid.operators.trends import trailing


def weekday_pattern(weekday_stats: DataFrame, province: str | None = None, exclude_provinces: Sequence[str] = ()) -> DataFrame:
    """Mean price per weekday and product: of one province, pooled without some provinces, or national."""
    if province or not exclude_provinces:
        return weekday_stats.where(F.col("province") == (province or S.NATIONAL)).select(
            "fuel_type",
            "day_of_week",
            F.try_divide("sum_price", "count_days").alias("avg_price"),
            "count_days",
            "min_daily_avg",
            "max_daily_avg",
        )
    return (
        weekday_stats.where(~F.col("province").isin([*exclude_provinces, S.NATIONAL]))
        .groupBy("fuel_type", "day_of_week")
        .agg(
            F.try_divide(F.sum("sum_price"), F.sum("count_days")).alias("avg_price"),
            F.max("count_days").alias("count_days"),
            F.min("min_daily_avg").alias("min_daily_avg"),
            F.max("max_daily_avg").alias("max_daily_avg"),
        )
    )


def province_ranking(province_daily: DataFrame, days_back: int, as_of=None) -> DataFrame:
    """Plain mean of the daily means per province."""
    return (
        trailing(province_daily, days_back, as_of)
        .groupBy("fuel_type", "province")
        .agg(
            F.avg("avg_price").alias("avg_price"),
            F.min("min_price").alias("min_price"),
            F.max("max_price").alias("max_price"),
            F.sum("station_count").cast("bigint").alias("total_observations"),
        )
    )


def brand_ranking(brand_daily: DataFrame, days_back: int, as_of=None, top_n: int = 15) -> DataFrame:
    """The ``top_n`` cheapest brands per product, weighted by station counts."""
    weighted = F.try_divide(F.sum(F.col("avg_price") * F.col("station_count")), F.sum("station_count"))
    ranked = (
        trailing(brand_daily, days_back, as_of)
        .groupBy("fuel_type", "brand")
        .agg(
            weighted.alias("avg_price"),
            F.min("min_price").alias("min_price"),
            F.max("max_price").alias("max_price"),
            F.sum("station_count").cast("bigint").alias("total_observations"),
        )
    )
    return top_k(ranked, ["fuel_type"], [F.col("avg_price").asc_nulls_last(), F.col("brand").asc()], top_n)


def zone_volatility(zip_daily: DataFrame, days_back: int, as_of=None, mainland_only: bool = True) -> DataFrame:
    """How much the daily mean of a zip code moves; needs enough days and three stations on average."""
    rows = trailing(zip_daily, days_back, as_of)
    if mainland_only:
        rows = rows.where(is_mainland("province"))
    mean, deviation = F.avg("avg_price"), F.stddev_samp("avg_price")
    return (
        rows.groupBy("fuel_type", "zip_code", "province")
        .agg(
            mean.alias("avg_price"),
            deviation.alias("std_dev_price"),
            F.try_divide(deviation, mean).alias("coefficient_of_variation"),
            F.try_divide(100 * deviation, mean).alias("volatility_pct"),
            F.min("avg_price").alias("min_price"),
            F.max("avg_price").alias("max_price"),
            (F.max("avg_price") - F.min("avg_price")).alias("price_range"),
            F.count("*").alias("observation_days"),
            F.avg("station_count").alias("avg_station_count"),
        )
        .where((F.col("observation_days") >= max(2, math.ceil(days_back * 0.7))) & (F.col("avg_station_count") >= 3))
    )


def ordered_by_volatility(zones: DataFrame) -> DataFrame:
    return zones.orderBy("coefficient_of_variation", "std_dev_price", "avg_price")
