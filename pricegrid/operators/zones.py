"""Price maps by zip code, province and polygon, and the small catalogues behind the selectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricegrid.functions.columns import clean_text, is_mainland, is_priced, province_data_name, title_case
from pricegrid.operators.melt import melt_prices
from pricegrid.operators.spatial import assign_features, containment_join
from pricegrid import schema as S


def zone_prices(stations: DataFrame, by: Sequence[str] = ("province",), fuels: Sequence[str] = S.PRICE_COLUMNS) -> DataFrame:
    """Mean, minimum and count per zip code inside each ``by`` area and product; a missing zip code is a zone."""
    keys = list(dict.fromkeys([*by, "zip_code"]))
    return (
        melt_prices(stations, keys, fuels)
        .groupBy(*keys, "fuel_type")
        .agg(F.avg("price").alias("avg_price"), F.min("price").alias("min_price"), F.count("*").alias("station_count"))
    )


def zones_in(zones: DataFrame, zips: DataFrame) -> DataFrame:
    """Zones (or map features) whose ``zip_code`` is in ``zips``."""
    return zones.join(zips.select("zip_code"), "zip_code", "left_semi")


def province_prices(stations: DataFrame, fuels: Sequence[str] = S.PRICE_COLUMNS, mainland_only: bool = False) -> DataFrame:
    rows = melt_prices(stations, ["province"], fuels)
    if mainland_only:
        rows = rows.where(is_mainland(province_data_name("province")))
    return rows.groupBy("province", "fuel_type").agg(F.avg("price").alias("avg_price"), F.count("*").alias("station_count"))


def national_averages(stations: DataFrame, fuels: Sequence[str] = S.PRICE_COLUMNS) -> DataFrame:
    """Mean price and number of selling stations of every product, including products nobody sells."""
    aggregates = []
    for fuel in [f for f in fuels if f in stations.columns]:
        priced = F.when(is_priced(fuel), F.col(fuel))
        aggregates.append(F.struct(F.avg(priced).alias("avg_price"), F.count(priced).alias("station_count")).alias(fuel))
    wide = stations.agg(*aggregates)
    return wide.unpivot([], wide.columns, "fuel_type", "stats").select("fuel_type", "stats.*")


def map_with_prices(features: DataFrame, prices: DataFrame, name: str = "name") -> DataFrame:
    """Every map feature with its price, null and 0 where there is none. ``prices`` holds the same ``name`` column."""
    return features.join(prices.select(name, "avg_price", "station_count"), name, "left").withColumn(
        "station_count", F.coalesce("station_count", F.lit(0))
    )


def province_map(features: DataFrame, prices: DataFrame, mainland_only: bool = False) -> DataFrame:
    """Province features with prices; data and map spellings meet in the data's spelling."""
    keyed = features.withColumn("_key", province_data_name("name"))
    if mainland_only:
        keyed = keyed.where(is_mainland("_key"))
    priced = prices.select(clean_text("province").alias("_key"), "avg_price", "station_count")
    return map_with_prices(keyed, priced, "_key").drop("_key")


def polygon_prices(stations: DataFrame, polygons: DataFrame, fuel: str) -> DataFrame:
    """Mean price and count per polygon; a station counts in the first polygon that holds it."""
    priced = stations.where(is_priced(fuel)).withColumn("price", F.col(fuel))
    assigned = assign_features(priced, polygons, carry=["price"])
    return assigned.groupBy("feature_idx", "name").agg(F.avg("price").alias("avg_price"), F.count("*").alias("station_count"))


def zips_by_polygon(stations: DataFrame, polygons: DataFrame, fuel: str) -> DataFrame:
    """Zip codes with a selling station inside each polygon that is the first match of any station.

    Beyond that condition containment decides, also where polygons overlap.
    """
    pairs = containment_join(stations.where(is_priced(fuel)), polygons)
    matched = pairs.groupBy("station_id").agg(F.min("feature_idx").alias("feature_idx")).select("feature_idx").distinct()
    return pairs.join(matched, "feature_idx", "left_semi").select("feature_idx", "name", "zip_code").distinct()


def label_counts(stations: DataFrame, top_n: int = 0) -> DataFrame:
    """Labels with their display form, most frequent first."""
    counted = (
        stations.where(F.col("label") != "").groupBy("label").agg(F.count("*").alias("station_count"))
        .orderBy(F.col("station_count").desc(), F.col("label").asc())
    )
    shown = counted.limit(top_n) if top_n > 0 else counted
    return shown.withColumn("title", title_case("label"))


def province_names(stations: DataFrame) -> DataFrame:
    return stations.select("province").distinct().withColumn("title", title_case("province")).orderBy(F.col("province").asc_nulls_last())


def municipalities(stations: DataFrame) -> DataFrame:
    return stations.select("province", "municipality").distinct()
