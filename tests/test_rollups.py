"""Rollups, weekday statistics, trends and rankings with worked-out values."""

import datetime

import pytest
from pyspark.sql import functions as F

from pricegrid.operators import rankings, rollups, trends

SNAPSHOT = (
    "timestamp string, province string, zip_code string, label string, eess_id string, province_id string, municipality_id string, "
    "municipality string, locality string, ccaa_id string, diesel_a_price double, gasoline_95_e5_price double, hydrogen_price double"
)
T = "2026-03-22T05:48:06+00:00"


@pytest.fixture
def snapshot(frame):
    rows = [
        (T, "madrid", "28001", "a", "1", "28", "m1", "madrid", "l1", "13", 1.45, 1.55, None),
        (T, "madrid", "28001", "a", "2", "28", "m1", "madrid", "l1", "13", 1.50, 1.60, None),
        (T, "madrid", "28002", "b", "3", "28", "m2", "getafe", "l1", "13", 1.48, 1.58, None),
        (T, "barcelona", "08001", "b", "4", "8", "m3", "barcelona", "l2", "9", 1.42, 1.52, None),
        (T, "barcelona", "08001", "c", "5", "8", "m3", "barcelona", "l3", "9", 1.44, 1.54, None),
        (T, "barcelona", "08002", "c", "6", "8", "m4", "barcelona", "l3", "9", 1.46, 1.56, None),
    ]
    return frame(rows, SNAPSHOT)


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_province_rollup(snapshot):
    got = by(rollups.province_daily_stats(snapshot), "province", "fuel_type")
    assert len(got) == 4
    r = got[("madrid", "diesel_a_price")]
    assert (r.date, r.avg_price, r.min_price, r.max_price, r.station_count) == (datetime.date(2026, 3, 22), 1.4767, 1.45, 1.5, 3)


def test_zip_rollup(snapshot):
    got = by(rollups.zip_daily_stats(snapshot), "zip_code", "fuel_type")
    assert len(got) == 8
    assert (got[("28001", "diesel_a_price")].avg_price, got[("28001", "diesel_a_price")].station_count) == (1.475, 2)
    assert rollups.zip_daily_stats(snapshot.drop("province")).count() == 0
    void = snapshot.withColumn("diesel_a_price", F.when(F.col("eess_id") == "6", 0.0).when(F.col("eess_id") < "6", None))
    assert rollups.zip_daily_stats(void).where("fuel_type = 'diesel_a_price'").count() == 0


def test_brand_rollup_threshold(snapshot):
    many = snapshot.crossJoin(snapshot.sparkSession.range(5)).withColumn("label", F.when(F.col("label") == "a", "BP OIL").otherwise(F.col("label")))
    got = by(rollups.brand_daily_stats(many), "brand", "fuel_type")
    assert {b for b, _ in got} == {"bp", "b", "c"} and got[("bp", "diesel_a_price")].station_count == 10
    assert rollups.brand_daily_stats(many, min_stations=11).count() == 0


def test_ingestion_counts(snapshot):
    r = rollups.daily_ingestion_stats(snapshot).first().asDict()
    assert list(r.values())[1:] == [6, 6, 3, 2, 4, 3, 5, 3, 2, 2]  # five (province, municipality, locality) triples


def test_weekday_stats(frame, snapshot):
    daily = frame(
        [("2026-03-22", "madrid", "diesel_a_price", 1.4767, 3), ("2026-03-22", "barcelona", "diesel_a_price", 1.44, 3)],
        "date string, province string, fuel_type string, avg_price double, station_count bigint",
    ).withColumn("date", F.col("date").cast("date"))
    got = by(rollups.weekday_stats_from_daily(daily), "province")
    assert {r.day_of_week for r in got.values()} == {6}
    assert got[("madrid",)].sum_price == 1.4767 and got[("__national__",)].sum_price == 1.45835
    direct = by(rollups.weekday_stats_from_snapshots(snapshot), "province", "fuel_type")
    assert direct[("madrid", "diesel_a_price")].sum_price == 1.476667
    assert direct[("__national__", "diesel_a_price")].sum_price == 1.458333
    twice = rollups.weekday_stats_from_snapshots(snapshot)
    merged = by(rollups.merge_weekday_stats(twice, twice.where("province = 'madrid'")), "province", "fuel_type")
    assert (merged[("madrid", "diesel_a_price")].count_days, merged[("barcelona", "diesel_a_price")].count_days) == (2, 1)


DAILY = "date string, {key} string, fuel_type string, avg_price double, min_price double, max_price double, station_count bigint"


def test_weekday_pattern(frame):
    stats = frame(
        [(0, "f", "__national__", 3.0, 2, 1.4, 1.6), (0, "f", "madrid", 2.8, 2, 1.3, 1.5), (0, "f", "ceuta", 2.0, 2, 0.9, 1.1)],
        "day_of_week int, fuel_type string, province string, sum_price double, count_days bigint, min_daily_avg double, max_daily_avg double",
    )
    assert rankings.weekday_pattern(stats).first().avg_price == 1.5
    assert rankings.weekday_pattern(stats, "madrid").first().avg_price == 1.4
    assert rankings.weekday_pattern(stats, exclude_provinces=["ceuta"]).first().avg_price == 1.4
    assert rankings.weekday_pattern(stats, exclude_provinces=["none"]).first().avg_price == pytest.approx(1.2)


def test_brand_ranking_is_weighted(frame):
    rows = [("2024-01-01", "x", "f", 1.0, 1.0, 1.0, 1), ("2024-01-02", "x", "f", 2.0, 2.0, 2.0, 100), ("2024-01-02", "y", "f", 1.5, 1.5, 1.5, 4)]
    got = rankings.brand_ranking(frame(rows, DAILY.format(key="brand")), 30, "2024-01-31").orderBy("avg_price").collect()
    assert [r.brand for r in got] == ["y", "x"] and got[1].avg_price == pytest.approx(201 / 101)
    assert rankings.brand_ranking(frame(rows, DAILY.format(key="brand")), 30, "2024-01-31", top_n=1).count() == 1


def test_trailing_days_are_inclusive(frame):
    rows = [(f"2024-01-{d:02d}", "p", "f", float(d), 1.0, 1.0, 1) for d in range(1, 11)]
    got = rankings.province_ranking(frame(rows, DAILY.format(key="province")), 3, "2024-01-10").first()
    assert (got.avg_price, got.total_observations) == (8.5, 4)


def test_volatility(frame):
    def zone(zip_code, province, prices, stations=3):
        start = datetime.date(2024, 1, 1)
        return [(str(start + datetime.timedelta(days=i)), zip_code, province, "f", p, p, p, stations) for i, p in enumerate(prices)]

    steady, swinging = [1.5, 1.5001] * 5, [1.2, 1.8] * 5
    rows = zone("28001", "madrid", steady) + zone("41001", "sevilla", swinging) + zone("35001", "palmas (las)", steady)
    rows += zone("50001", "zaragoza", steady, 2) + zone("46001", "valencia", steady[:3])
    daily = frame(rows, "date string, zip_code string, province string, fuel_type string, avg_price double, min_price double, max_price double, station_count bigint")
    got = rankings.ordered_by_volatility(rankings.zone_volatility(daily, 10, "2024-01-10")).collect()
    assert [r.zip_code for r in got] == ["28001", "41001"]
    assert rankings.zone_volatility(daily, 10, "2024-01-10", mainland_only=False).count() == 3


def test_area_and_brand_trends(frame):
    zips = frame(
        [("2024-01-02", "1", "a", "f", 1.0, 0.9, 1.1, 9), ("2024-01-02", "2", "b", "f", 2.0, 1.9, 2.1, 1), ("2023-01-02", "2", "b", "f", 9.0, 9.0, 9.0, 1)],
        "date string, zip_code string, province string, fuel_type string, avg_price double, min_price double, max_price double, station_count bigint",
    )
    national = trends.area_trend(zips, 7, "2024-01-05").collect()
    assert [(r.avg_price, r.min_price, r.max_price) for r in national] == [(1.5, 0.9, 2.1)]
    assert trends.area_trend(zips, 7, "2024-01-05", province="a").first().avg_price == 1.0
    brands = frame([("2024-01-02", "x", "f", 1.0), ("2024-01-02", "y", "f", 1.0)], "date string, brand string, fuel_type string, avg_price double")
    assert trends.brand_trend(brands, 7, ["x"], "2024-01-05").count() == 1
    assert trends.brand_trend(brands, 7, [], "2024-01-05").count() == 0


def test_trend_fallback_is_per_pair(frame, snapshot):
    stored = rollups.zip_daily_stats(snapshot).where("zip_code = '28001'")
    got = by(trends.zip_trend_with_fallback(stored, snapshot, 7, "2026-03-25"), "zip_code", "fuel_type")
    assert len(got) == 8
    assert {k[0] for k, r in got.items() if r.source == "rollup"} == {"28001"}


def test_trend_kpis(frame):
    trend = frame([("k", "2024-01-01", 2.0), ("k", "2024-01-02", 1.0), ("k", "2024-01-03", 3.0)], "k string, date string, avg_price double")
    r = trends.trend_kpis(trend, ["k"]).first()
    assert (r.current_price, r.lowest_price, r.highest_price, r.change_pct) == (3.0, 1.0, 3.0, 50.0)
