"""Regimes, transitions and the Markov measures."""

import datetime

import pytest
from pyspark.sql import functions as F

from pricegrid.operators import forecast as M

CYCLE = [1.50, 1.48, 1.46, 1.44, 1.42, 1.44, 1.46, 1.48, 1.50]
ZIP = "date string, zip_code string, province string, fuel_type string, avg_price double"


def history(days, zip_code="28001", province="madrid", fuel="f", start=datetime.date(2026, 1, 1)):
    return [(str(start + datetime.timedelta(days=i)), zip_code, province, fuel, CYCLE[i % 9]) for i in range(days)]


def provinces(frame, days, province="madrid"):
    return frame([(d, p, f, v) for d, _, p, f, v in history(days, province=province)], "date string, province string, fuel_type string, avg_price double")


def test_terciles(frame):
    rows = frame([(f"2026-01-0{i}", "k", float(i)) for i in range(1, 7)], "date string, key string, price double")
    got = [r.regime for r in M.with_regimes(rows, ["key"]).orderBy("date").collect()]
    assert got == ["cheap", "cheap", "normal", "normal", "expensive", "expensive"]
    flat = frame([(f"2026-01-0{i}", "k", 1.0) for i in range(1, 4)], "date string, key string, price double")
    assert {r.regime for r in M.with_regimes(flat, ["key"]).collect()} == {"cheap"}


def test_only_consecutive_days_count(frame):
    rows = frame([("2026-01-01", "k", 1.0, "cheap"), ("2026-01-02", "k", 2.0, "normal"), ("2026-01-04", "k", 1.0, "cheap")], "date string, key string, price double, regime string")
    r = M.transition_counts(rows.withColumn("date", F.col("date").cast("date")), ["key"]).first()
    assert (r.n_cheap_normal, r.n_normal_cheap, r.coverage_days, r.current_regime) == (1, 0, 3, "cheap")


def chain(frame, current, **p):
    cells = {f"p_{a}_{b}": float(a == b) for a in M.REGIMES for b in M.REGIMES} | p
    return frame([(current, *cells.values())], "current_regime string, " + ", ".join(f"{c} double" for c in cells))


def test_cheaper_within(frame):
    normal = chain(frame, "normal", p_normal_cheap=0.5, p_normal_normal=0.5)
    assert normal.select(M.cheaper_within(2)).first()[0] == 0.75
    dear = chain(frame, "expensive", p_expensive_normal=0.2, p_expensive_cheap=0.1, p_expensive_expensive=0.7)
    assert dear.select(M.cheaper_within(3)).first()[0] == pytest.approx(1 - 0.7**3)
    through = chain(frame, "normal", p_normal_normal=0.5, p_normal_expensive=0.5, p_expensive_normal=1.0, p_expensive_expensive=0.0)
    assert through.select(M.cheaper_within(5)).first()[0] == pytest.approx(0.0)
    assert chain(frame, "cheap").select(M.cheaper_within(7)).first()[0] == 0.0
    assert normal.select(M.cheaper_within(0)).first()[0] == 0.0


def test_expected_stay(frame):
    assert chain(frame, "cheap", p_cheap_cheap=0.75).select(M.expected_stay()).first()[0] == 4.0
    assert chain(frame, "cheap").select(M.expected_stay()).first()[0] is None


def test_recommendation(frame):
    rows = frame(
        [("cheap", 1.0, 1.0), ("expensive", 0.55, 0.0), ("expensive", 0.5, 0.75), ("expensive", 0.5, 0.7), ("normal", 0.6, 0.0), ("normal", 0.5, 0.9)],
        "r string, a double, b double",
    )
    got = [r[0] for r in rows.select(M.recommendation(F.col("r"), F.col("a"), F.col("b"))).collect()]
    assert got == [M.REFUEL_TODAY, M.CAN_WAIT, M.CAN_WAIT, M.REFUEL_TODAY, M.CAN_WAIT, M.REFUEL_TODAY]


def test_long_history_is_answered_by_its_own_zip(frame):
    r = M.forecast_with_fallback(frame(history(90), ZIP), provinces(frame, 90)).first()
    assert (r.insufficient_data, r.coverage_days, r.source, r.transition_observations) == (False, 90, "zip_code", 89)
    assert r.requested_zip == "28001" and r.recommendation in (M.REFUEL_TODAY, M.CAN_WAIT)
    for row in r.transition_matrix.values():
        assert sum(row.values()) == pytest.approx(1, abs=2e-4)
    assert r.next_day_probabilities == r.transition_matrix[r.current_regime]
    assert 0 <= r.cheaper_within_3d <= r.cheaper_within_7d <= 1
    assert r.explanation.startswith("El área Código postal 28001 está en un régimen caro.")


def test_thin_zip_falls_back(frame):
    zips = frame(history(10) + history(10, "28002", None) + history(10, "99001", "nowhere"), ZIP)
    got = {r.requested_zip: r for r in M.forecast_with_fallback(zips, provinces(frame, 90)).collect()}
    assert (got["28001"].source, got["28001"].geography_value, got["28001"].coverage_days) == ("province", "madrid", 90)
    assert (got["28002"].source, got["28002"].insufficient_data) == ("zip_code", True)
    assert (got["99001"].source, got["99001"].recommendation, got["99001"].explanation) == ("province", M.NO_HISTORY, M.NO_PROVINCE_HISTORY)


def test_history_preparation(frame):
    rows = frame(
        [("2026-01-01", "28001.0", "a", "f", 1.0), ("2026-01-01", "28001", "b", "f", 2.0), ("2026-01-05", "28001", "a", "f", None), ("2025-01-01", "28001", "a", "f", 9.0), (None, "28001", "a", "f", 9.0)],
        ZIP,
    ).withColumn("area", M.canonical_zip("zip_code"))
    got = M.daily_history(rows, ["area", "fuel_type"], 180, last_by="province").collect()
    assert [(str(r.date), r.price, r.province) for r in got] == [("2026-01-01", 2.0, "b")]


def test_flat_prices_are_not_modeled(frame):
    rows = frame([(d, z, p, f, 1.5) for d, z, p, f, _ in history(90)], ZIP)
    assert M.zip_forecast(rows).first().insufficient_data
