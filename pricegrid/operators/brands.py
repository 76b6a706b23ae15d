"""Brand-versus-market reports.

The market of a (day, area, product) may hold any number of stations and brands, and one of them may hold a large
share of all rows. Everything is therefore aggregated per market with partial aggregation before the shuffle; no step
ever gathers a market's stations. All areas, products and directions are answered by one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricegrid import schema as S
from pricegrid.functions.columns import brand_name, confidence_band, is_priced, lookup, observed_on, report_fuel, weighted_mean
from pricegrid.operators.melt import melt_geographies, melt_prices

MARKET = ["dt", "geo_level", "geo_value", "fuel_type"]
DIRECTIONS = ("cheapest", "priciest")


MEASURES = ("total", "low", "high")

#: By how much of a mean two means may differ and still count as the same.
SAME_MEAN = 1e-9

#: Columns of the wide form, brands x products x measures, up to which it is chosen.
WIDE_COLUMNS = 400
_AGGREGATES = {"total": F.sum, "n": F.count, "low": F.min, "high": F.max}


def _labelled(snapshots: DataFrame, brands, fuels, geos, normalize: bool) -> DataFrame:
    """``dt``, ``brand`` (null outside the brands asked for), areas and prices of every row.

    The day is the landing partition ``dt`` where the input has it, else the date of the time stamp.
    """
    dt = F.col("dt") if "dt" in snapshots.columns else observed_on()
    label = brand_name("label") if normalize else F.lower(F.col("label").cast("string"))
    return snapshots.select(dt.alias("dt"), F.when(label.isin(list(brands)), label).alias("brand"), *geos, *fuels)


def _wide_market_days(rows: DataFrame, brands, fuels, measures) -> DataFrame:
    """One aggregate per (day, area) with a column per brand, product and measure, then one row per brand and product."""
    number = lookup("brand", {b: i for i, b in enumerate(brands)}).alias("b")
    prices = [F.when(is_priced(f), F.col(f)).alias(f"p{i}") for i, f in enumerate(fuels)]
    sql = {"total": "sum", "n": "count", "low": "min", "high": "max"}
    columns, entries = [], []
    for i in range(len(fuels)):
        columns += [f"{sql[m]}(p{i}) AS p{i}_{m}" for m in measures]
        for j in range(len(brands)):
            columns += [f"{sql[m]}(CASE WHEN b = {j} THEN p{i} END) AS p{i}_{j}_{m}" for m in measures]
            own = ", ".join(f"'{m}', p{i}_{j}_{m}, 'market_{m}', p{i}_{m}" for m in measures)
            entries.append(f"named_struct('fuel_no', {i}, 'brand_no', {j}, {own})")
    market = ["dt", "geo_level", "geo_value"]
    wide = rows.select(*market, number, *prices).groupBy(*market).agg(*[F.expr(c) for c in columns])
    found = wide.selectExpr(*market, f"inline(array({', '.join(entries)}))").where("n > 0")
    name = lambda names, no: F.array(*[F.lit(n) for n in names])[F.col(no)]
    both = [prefix + m for m in measures for prefix in ("", "market_")]
    return found.select(*market, name(fuels, "fuel_no").alias("fuel_type"), name(brands, "brand_no").alias("brand"), *both)


def _long_market_days(rows: DataFrame, fuels, measures) -> DataFrame:
    """The same for many brands: one row per market and brand, the rest of the market folded into a single row.

    After the aggregate a market has at most one row per brand asked for plus one, so the window over it stays small.
    """
    by_brand = (
        melt_prices(rows, ["dt", "geo_level", "geo_value", "brand"], fuels)
        .groupBy(*MARKET, "brand")
        .agg(*[_AGGREGATES[m]("price").alias(m) for m in measures])
    )
    whole = Window.partitionBy(*MARKET)
    over_market = {f"market_{m}": (F.sum if m == "n" else _AGGREGATES[m])(m).over(whole) for m in measures}
    return by_brand.withColumns(over_market).where(F.col("brand").isNotNull())


def market_days(
    snapshots: DataFrame,
    brands: Sequence[str] = S.REPORT_BRANDS,
    fuels: Sequence[str] = S.REPORT_FUELS,
    geos: Sequence[str] = S.REPORT_GEOS,
    normalize: bool = False,
    measures: Sequence[str] = MEASURES,
    wide: bool | None = None,
) -> DataFrame:
    """Shared input of the comparison and win-rate reports.

    One row per market (day, area, product) and brand with the brand's ``n`` and ``measures`` of its positive prices,
    and the whole market's as ``market_*``. ``wide`` makes one aggregate with a column for each brand, product and
    measure, which suits a few brands; without it a market has a row a brand and a window over them, which suits any
    number. Both give the same rows; if nothing is said, the number of columns decides.
    """
    needed = ["n", *measures]
    if wide is None:
        wide = len(brands) * len(fuels) * len(needed) <= WIDE_COLUMNS
    rows = melt_geographies(_labelled(snapshots, brands, fuels, geos, normalize), ["dt", "brand", *fuels], geos)
    if wide:
        return _wide_market_days(rows, list(brands), list(fuels), needed)
    return _long_market_days(rows, fuels, needed)


def price_comparison_from(market: DataFrame, min_appearances: int = S.MIN_APPEARANCES_COMPARISON) -> DataFrame:
    """Mean of a brand's daily difference from the market mean, and how often it is below."""
    brand_avg, market_avg = F.col("brand_avg"), F.col("market_avg")
    # Means of the same prices may differ in the last digit by the order of summation: that is not below.
    below = brand_avg < market_avg * (1 - SAME_MEAN)
    return (
        market.withColumn("market_avg", F.col("market_total") / F.col("market_n"))
        .withColumn("brand_avg", F.col("total") / F.col("n"))
        .groupBy("brand", "geo_level", "geo_value", report_fuel("fuel_type").alias("fuel_type"))
        .agg(
            F.round(F.avg(brand_avg), 4).alias("brand_avg_price"),
            F.round(F.avg(market_avg), 4).alias("market_avg_price"),
            F.round(F.avg(F.try_divide(brand_avg - market_avg, market_avg) * 100), 2).alias("price_delta_pct"),
            F.round(F.avg(below.cast("int")) * 100, 2).alias("days_below_market_pct"),
            F.count("*").alias("appearances"),
            confidence_band(F.count("*")).alias("confidence_level"),
            F.max("dt").cast("string").alias("last_updated"),
        )
        .where(F.col("appearances") >= min_appearances)
    )


def win_rate_from(
    market: DataFrame,
    directions: Sequence[str] = DIRECTIONS,
    min_appearances: int = S.MIN_APPEARANCES_WIN_RATE,
) -> DataFrame:
    """Share of brand-days at the market's lowest/highest price; ties split the day among the brands asked for."""
    unknown = set(directions) - set(DIRECTIONS)
    if unknown:
        raise ValueError(f"unknown directions: {sorted(unknown)}")
    hits = market.withColumn("cheapest", (F.col("low") == F.col("market_low")).cast("int")).withColumn(
        "priciest", (F.col("high") == F.col("market_high")).cast("int")
    )
    whole = Window.partitionBy(*MARKET)  # at most one row per brand asked for
    credits = [(F.try_divide(F.col(d).cast("double"), F.sum(d).over(whole))).alias(d) for d in directions]
    return (
        hits.select("brand", *MARKET, *credits)
        .unpivot(["brand", *MARKET], list(directions), "direction", "credit")
        .groupBy("brand", "direction", "geo_level", "geo_value", report_fuel("fuel_type").alias("fuel_type"))
        .agg(
            F.count("*").alias("appearances"),
            F.round(F.avg(F.coalesce("credit", F.lit(0.0))) * 100, 2).alias("win_rate_pct"),
            confidence_band(F.count("*")).alias("confidence_level"),
            F.max("dt").cast("string").alias("last_updated"),
        )
        .where(F.col("appearances") >= min_appearances)
    )


def brand_price_comparison(
    snapshots, brands=S.REPORT_BRANDS, fuels=S.REPORT_FUELS, geos=S.REPORT_GEOS,
    min_appearances: int = S.MIN_APPEARANCES_COMPARISON, normalize: bool = False, wide: bool | None = None,
) -> DataFrame:
    return price_comparison_from(market_days(snapshots, brands, fuels, geos, normalize, ["total"], wide), min_appearances)


def brand_win_rate(
    snapshots, brands=S.REPORT_BRANDS, fuels=S.REPORT_FUELS, geos=S.REPORT_GEOS, directions=DIRECTIONS,
    min_appearances: int = S.MIN_APPEARANCES_WIN_RATE, normalize: bool = False, wide: bool | None = None,
) -> DataFrame:
    return win_rate_from(market_days(snapshots, brands, fuels, geos, normalize, ["low", "high"], wide), directions, min_appearances)


def market_day_wins(
    snapshots: DataFrame,
    brands: Sequence[str] = S.COMPETITIVENESS_BRANDS,
    fuels: Sequence[str] = S.REPORT_FUELS,
    geos: Sequence[str] = S.REPORT_GEOS,
) -> DataFrame:
    """Per market and brand: station rows, and how many of them are at the day's lowest price.

    This older report counts station rows and takes zero prices as prices. A brand's rows are first counted per distinct
    price, so the count at its minimum needs no second look at the stations; the rest of the market only keeps its
    minimum.
    """
    priced = melt_prices(_labelled(snapshots, brands, fuels, geos, False), ["dt", "brand", *geos], fuels, positive=False)
    rows = melt_geographies(priced, ["dt", "brand", "fuel_type", "price"], geos)
    own_price = F.when(F.col("brand").isNotNull(), F.col("price")).alias("own_price")
    by_price = rows.groupBy(*MARKET, "brand", own_price).agg(F.count("*").alias("n"), F.min("price").alias("low"))
    by_brand = by_price.groupBy(*MARKET, "brand").agg(
        F.min("low").alias("low"), F.min_by("n", "low").alias("at_low"), F.sum("n").alias("n")
    )
    lowest = F.min("low").over(Window.partitionBy(*MARKET))
    return by_brand.withColumn("wins", F.when(F.col("low") == lowest, F.col("at_low")).otherwise(0)).where(
        F.col("brand").isNotNull()
    )


def _win_share():
    return F.round(F.sum("wins") / F.sum("n") * 100, 2).alias("win_rate_pct")


def competitiveness_from(wins: DataFrame, as_of, min_appearances: int = S.MIN_APPEARANCES_WIN_RATE) -> DataFrame:
    return (
        wins.groupBy("brand", "geo_level", "geo_value", report_fuel("fuel_type").alias("fuel_type"))
        .agg(F.sum("n").alias("appearances"), _win_share())
        .where(F.col("appearances") >= min_appearances)
        .withColumn("last_updated", F.lit(str(as_of)))
    )


def monthly_competitiveness_from(wins: DataFrame) -> DataFrame:
    return wins.groupBy(
        F.trunc("dt", "month").alias("year_month"), "brand", "geo_level", report_fuel("fuel_type").alias("fuel_type")
    ).agg(F.sum("n").alias("appearances"), _win_share())


# --------------------------------------------------------------------------------------- report summaries


def _for_fuel(report: DataFrame, fuel: str | None, brands, geo_level: str | None) -> DataFrame:
    if fuel:
        report = report.where(F.col("fuel_type") == report_fuel(F.lit(fuel)))
    if brands:
        report = report.where(F.col("brand").isin(list(brands)))
    return report.where(F.col("geo_level") == geo_level) if geo_level else report


def win_rate_summary(win_rate: DataFrame, fuel=None, brands=None, geo_level=None) -> DataFrame:
    """One row per brand, product and direction, weighted by appearances over all areas (and levels, unless one is named)."""
    return (
        _for_fuel(win_rate, fuel, brands, geo_level)
        .groupBy("brand", "fuel_type", "direction")
        .agg(F.round(weighted_mean("win_rate_pct", "appearances"), 2).alias("win_rate_pct"), F.sum("appearances").alias("appearances"))
        .where(F.col("win_rate_pct").isNotNull())
        .withColumn("confidence", confidence_band("appearances"))
    )


def price_comparison_summary(comparison: DataFrame, fuel=None, brands=None, geo_level=None) -> DataFrame:
    digits = {"price_delta_pct": 2, "days_below_market_pct": 2, "brand_avg_price": 4, "market_avg_price": 4}
    return (
        _for_fuel(comparison, fuel, brands, geo_level)
        .groupBy("brand", "fuel_type")
        .agg(
            *[F.round(weighted_mean(c, "appearances"), d).alias(c) for c, d in digits.items()],
            F.sum("appearances").alias("appearances"),
        )
        .dropna(subset=list(digits))
        .withColumn("confidence", confidence_band("appearances"))
    )


def brand_coverage(comparison: DataFrame, fuel=None, brands=None) -> DataFrame:
    """How many areas of each level a brand is seen in."""
    at = lambda level: F.count_distinct(F.when(F.col("geo_level") == level, F.col("geo_value")))
    return (
        _for_fuel(comparison, fuel, brands, None)
        .groupBy("brand", "fuel_type")
        .agg(
            at("zip_code").alias("zip_codes"),
            at("locality").alias("localities"),
            at("municipality").alias("municipalities"),
            F.sum("appearances").alias("total_observations"),
        )
    )


def annual_savings(summary: DataFrame, liters_per_fill: float, fills_per_month: float) -> DataFrame:
    """Yearly saving against the market price for a given refuelling habit."""
    per_liter = F.coalesce("market_avg_price", F.lit(0.0)) - F.coalesce("brand_avg_price", F.lit(0.0))
    return summary.withColumn("savings_per_liter", per_liter).withColumn(
        "eur_per_year", F.col("savings_per_liter") * float(liters_per_fill) * float(fills_per_month) * 12
    )
