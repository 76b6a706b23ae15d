"""Wide-to-long shaping of snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricegrid import schema as S
from pricegrid.functions.columns import is_priced


def present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def melt_prices(df: DataFrame, ids: Sequence[str], fuels: Sequence[str] = S.PRICE_COLUMNS, positive: bool = True) -> DataFrame:
    """One row per (observation, product) with columns ``fuel_type`` and ``price``.

    One pass over the wide rows for all products. ``positive=False`` keeps zero and negative prices and only
    drops nulls.
    """
    long = df.unpivot(list(ids), present(df, fuels), "fuel_type", "price")
    return long.where(is_priced("price") if positive else F.col("price").isNotNull())


def melt_geographies(df: DataFrame, ids: Sequence[str], geos: Sequence[str]) -> DataFrame:
    """One row per (observation, geography level); rows without a value at that level are dropped."""
    texts = df.select(*ids, *[F.col(g).cast("string").alias(g) for g in geos])
    return texts.unpivot(list(ids), list(geos), "geo_level", "geo_value").where(F.col("geo_value").isNotNull())
