"""Brand reports on hand-made markets."""

import pytest

from pricegrid.operators import brands as B

SCHEMA = "timestamp string, zip_code string, locality string, municipality string, label string, gasoline_95_e5_price double, diesel_a_price double"
FUEL, GEO = ["gasoline_95_e5_price"], ["zip_code"]


def market(frame, days):
    """``days``: one list of (label, price[, zip]) per day."""
    rows = []
    for i, stations in enumerate(days):
        stamp = f"20{26 + i // 336:02d}-{1 + (i // 28) % 12:02d}-{1 + i % 28:02d}T06:00:00+00:00"
        for label, price, *zip_code in stations:
            rows.append((stamp, (zip_code or ["28001"])[0], "madrid", "madrid", label, price, None))
    return frame(rows, SCHEMA)


def win_rates(frame, days, names, minimum=1, **kw):
    rows = B.brand_win_rate(market(frame, days), names, FUEL, GEO, min_appearances=minimum, **kw).collect()
    return {(r.brand, r.direction): r for r in rows}


def test_roles_flip(frame):
    days = [[("Ballenoil", 1.4), ("repsol", 1.6), ("other", 1.5)], [("ballenoil", 1.6), ("REPSOL", 1.4), ("other", 1.5)]]
    got = win_rates(frame, days, ["ballenoil", "repsol"])
    r = got[("ballenoil", "cheapest")]
    assert (r.win_rate_pct, r.appearances, r.last_updated, r.confidence_level) == (50.0, 2, "2026-01-02", "low")
    assert got[("ballenoil", "priciest")].win_rate_pct == 50.0


def test_ties_share_the_day(frame):
    got = win_rates(frame, [[("a", 1.4), ("b", 1.4), ("c", 1.6)]] * 5, ["a", "b"])
    assert [got[(b, "cheapest")].win_rate_pct for b in "ab"] == [50.0, 50.0]


def test_tie_with_an_unlisted_brand_is_not_shared(frame):
    assert win_rates(frame, [[("a", 1.4), ("b", 1.4)]], ["a"])[("a", "cheapest")].win_rate_pct == 100.0


def test_zero_prices_do_not_set_the_boundary(frame):
    assert win_rates(frame, [[("a", 1.4), ("b", 0.0), ("c", 1.6)]], ["a", "b"]).keys() == {("a", "cheapest"), ("a", "priciest")}
    assert win_rates(frame, [[("a", 1.4), ("b", 0.0), ("c", 1.6)]], ["a"])[("a", "cheapest")].win_rate_pct == 100.0


def test_many_stations_count_one_brand_day(frame):
    assert win_rates(frame, [[("a", 1.4), ("a", 1.5), ("a", 1.6)]] * 5, ["a"])[("a", "cheapest")].appearances == 5


def test_minimum_and_directions(frame):
    days = [[("a", 1.4)]] * 2
    assert win_rates(frame, days, ["a"], minimum=3) == {}
    assert win_rates(frame, days, ["a"], directions=["cheapest"]).keys() == {("a", "cheapest")}
    with pytest.raises(ValueError):
        win_rates(frame, days, ["a"], directions=["middle"])


def test_price_comparison(frame):
    days = [[("a", 1.4), ("b", 1.6)]] * 15
    got = {r.brand: r for r in B.brand_price_comparison(market(frame, days), ["a"], FUEL, GEO).collect()}
    r = got["a"]
    assert (r.price_delta_pct, r.days_below_market_pct, r.brand_avg_price, r.market_avg_price, r.appearances) == (-6.67, 100.0, 1.4, 1.5, 15)
    assert (r.fuel_type, r.geo_level, r.geo_value) == ("gasoline_95_e5", "zip_code", "28001")


@pytest.mark.parametrize("days, band", [(2, "low"), (150, "medium"), (400, "high")])
def test_confidence(frame, days, band):
    rows = market(frame, [[("a", 1.4), ("b", 1.6)]] * days)
    (r,) = B.brand_price_comparison(rows, ["a"], FUEL, GEO, min_appearances=1).collect()
    assert (r.appearances, r.confidence_level) == (days, band)


def test_all_levels_and_fuels_in_one_pass(frame):
    rows = market(frame, [[("a", 1.4), ("b", 1.6, "28002")]] * 2).selectExpr("* except (diesel_a_price)", "1.0D as diesel_a_price")
    got = B.brand_price_comparison(rows, ["a", "b"], min_appearances=1)
    assert got.count() == 2 * 3 * 2


def test_older_report_counts_rows_and_zero_prices(frame):
    rows = market(frame, [[("a", 1.4), ("a", 1.5), ("b", 0.0)], [("a", 1.4), ("a", 1.4), ("b", 1.6)]])
    wins = B.market_day_wins(rows, ["a", "b"], FUEL, GEO)
    got = {r.brand: r for r in B.competitiveness_from(wins, "2026-02-01", min_appearances=1).collect()}
    assert (got["a"].appearances, got["a"].win_rate_pct, got["a"].last_updated) == (4, 50.0, "2026-02-01")
    assert (got["b"].appearances, got["b"].win_rate_pct) == (2, 50.0)
    (month,) = B.monthly_competitiveness_from(wins).where("brand = 'a'").collect()
    assert (str(month.year_month), month.appearances, month.win_rate_pct) == ("2026-01-01", 4, 50.0)


def test_summaries(frame):
    report = frame(
        [("x", "cheapest", "zip_code", "1", "f", 100, 75.0), ("x", "cheapest", "locality", "2", "f", 50, 65.0), ("y", "cheapest", "zip_code", "1", "f", 10, None)],
        "brand string, direction string, geo_level string, geo_value string, fuel_type string, appearances bigint, win_rate_pct double",
    )
    (r,) = B.win_rate_summary(report, fuel="f_price").collect()
    assert (r.brand, r.win_rate_pct, r.appearances, r.confidence) == ("x", 71.67, 150, "medium")
    assert B.win_rate_summary(report, brands=["y"]).count() == 0
    assert B.win_rate_summary(report, geo_level="locality").first().win_rate_pct == 65.0
    comparison = frame(
        [
            ("x", "zip_code", "1", "f", 1.40, 1.50, -6.0, 90.0, 100),
            ("x", "zip_code", "2", "f", 1.40, 1.50, -4.0, 70.0, 100),
            ("x", "locality", "1", "f", None, None, None, None, 0),
            ("y", "municipality", "1", "f", 1.4, 1.5, None, 1.0, 5),
        ],
        "brand string, geo_level string, geo_value string, fuel_type string, brand_avg_price double, market_avg_price double, "
        "price_delta_pct double, days_below_market_pct double, appearances bigint",
    )
    (r,) = B.price_comparison_summary(comparison).collect()
    assert (r.brand, r.price_delta_pct, r.days_below_market_pct, r.appearances) == ("x", -5.0, 80.0, 200)
    saved = B.annual_savings(B.price_comparison_summary(comparison), 50, 2).first()
    assert saved.eur_per_year == pytest.approx(0.1 * 50 * 2 * 12)
    got = {r.brand: (r.zip_codes, r.localities, r.municipalities, r.total_observations) for r in B.brand_coverage(comparison).collect()}
    assert got == {"x": (2, 1, 0, 200), "y": (0, 0, 1, 5)}


def test_win_rates_never_exceed_the_whole(spark):
    from pricegrid.plans import adapters as A

    rows = A.observations(spark, "/root/testdata/sf0.001")
    rates = B.brand_win_rate(rows, ["repsol", "ballenoil", "bp oil", "shell recharge"], min_appearances=1)
    worst = rates.selectExpr("*", "win_rate_pct * appearances / 100 AS days").groupBy("direction", "geo_level", "geo_value", "fuel_type")
    days = rows.selectExpr("to_date(timestamp) AS d").distinct().count()
    assert max(r[0] for r in worst.agg({"days": "sum"}).select("sum(days)").collect()) <= days + 1e-6
