"""Price trends over the rollups, with raw history as the fallback. ``as_of`` defaults to today."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricegrid import schema as S
from pricegrid.operators.melt import melt_prices
from pricegrid.functions.columns import observed_on


def day(as_of) -> Column:
    return F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")


def trailing(df: DataFrame, days_back: int, as_of=None, date: str = "date") -> DataFrame:
    """Rows from ``days_back`` days before ``as_of`` on: ``days_back + 1`` calendar days."""
    return df.where(F.col(date) >= F.date_sub(day(as_of), days_back))


def with_province_column(rollup: DataFrame) -> DataFrame:
    """Older zip rollups lack ``province``; give it as null so that both kinds can be read together."""
    if "province" in rollup.columns or not set(S.ZIP_DAILY_COLUMNS) - {"province"} <= set(rollup.columns):
        return rollup
    return rollup.withColumn("province", F.lit(None).cast("string"))


def zip_trend(
    rollup: DataFrame, days_back: int, as_of=None, zips: DataFrame | None = None, fuels: Sequence[str] | None = None
) -> DataFrame:
    """Daily prices per zip code and product; ``zips`` (a ``zip_code`` table) and ``fuels`` restrict them."""
    rows = trailing(rollup, days_back, as_of)
    if fuels:
        rows = rows.where(F.col("fuel_type").isin(list(fuels)))
    if zips is not None:
        rows = rows.join(zips.select("zip_code"), "zip_code", "left_semi")
    return rows.select("zip_code", "fuel_type", "date", "avg_price", "min_price", "max_price")


def zip_trend_from_history(snapshots: DataFrame, fuels: Sequence[str] = S.PRICE_COLUMNS) -> DataFrame:
    """The same daily prices computed from station rows, unrounded."""
    return (
        melt_prices(snapshots.withColumn("date", observed_on()), ["date", "zip_code"], fuels)
        .groupBy("zip_code", "fuel_type", "date")
        .agg(F.avg("price").alias("avg_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price"))
    )


def zip_trend_with_fallback(
    rollup: DataFrame, snapshots: DataFrame, days_back: int, as_of=None, fuels: Sequence[str] = S.PRICE_COLUMNS
) -> DataFrame:
    """Rollup rows where a (zip code, product) has any, raw history for the pairs that have none."""
    stored = zip_trend(rollup, days_back, as_of, fuels=fuels)
    known = rollup.select("zip_code", "fuel_type").distinct()
    recent = snapshots.where(observed_on() >= F.date_sub(day(as_of), days_back))
    rest = zip_trend_from_history(recent, fuels).join(known, ["zip_code", "fuel_type"], "left_anti")
    return stored.withColumn("source", F.lit("rollup")).unionByName(rest.withColumn("source", F.lit("raw_history")))


def area_trend(
    rollup: DataFrame, days_back: int, as_of=None, province: str | None = None, fuels: Sequence[str] | None = None
) -> DataFrame:
    """National (or one province's) daily trend per product: plain mean of the zip means, extremes of the extremes."""
    rows = trailing(rollup, days_back, as_of)
    if fuels:
        rows = rows.where(F.col("fuel_type").isin(list(fuels)))
    if province:
        rows = rows.where(F.col("province") == province)
    return rows.groupBy("fuel_type", "date").agg(
        F.avg("avg_price").alias("avg_price"), F.min("min_price").alias("min_price"), F.max("max_price").alias("max_price")
    )


def brand_trend(rollup: DataFrame, days_back: int, brands: Sequence[str], as_of=None, fuel: str | None = None) -> DataFrame:
    """Daily mean per brand asked for; no brands, no rows."""
    rows = trailing(rollup, days_back, as_of).where(F.col("brand").isin(list(brands)) if brands else F.lit(False))
    if fuel:
        rows = rows.where(F.col("fuel_type") == fuel)
    return rows.select("date", "brand", "fuel_type", "avg_price")


def in_order(trend: DataFrame) -> DataFrame:
    """A trend as it is shown: by product, then date; a brand trend by date, then brand. A range sort, for the last step."""
    order = ["date", "brand", "fuel_type"] if "brand" in trend.columns else ["fuel_type", "date", "zip_code"]
    return trend.orderBy(*[c for c in order if c in trend.columns])


def trend_kpis(trend: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Latest, lowest and highest daily mean of every trend, and its change from the first day in percent."""
    first, current = F.min_by("avg_price", "date"), F.max_by("avg_price", "date")
    return trend.groupBy(*keys).agg(
        current.alias("current_price"),
        F.min("avg_price").alias("lowest_price"),
        F.max("avg_price").alias("highest_price"),
        F.coalesce(F.try_divide((current - first) * 100, first), F.lit(0.0)).alias("change_pct"),
    )
