"""Price-regime forecast: a three-state Markov chain per (area, product), for all of them in one job.

A history has at most one row per calendar day once it is reduced to days, so the per-key windows are short. Their
partitioning by key also serves the final aggregation, which adds no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricegrid.functions.columns import as_col, canonical_zip, province_data_name

# States in price order, thresholds and texts of the report.
REGIMES = ("cheap", "normal", "expensive")
REGIME_WORDS = {"cheap": "barato", "normal": "normal", "expensive": "caro"}
AREA_WORDS = {"zip_code": "Código postal", "province": "Provincia"}
MIN_DAYS = 60
MIN_TRANSITIONS = 30
WINDOW_DAYS = 180
REFUEL_TODAY = "Reposta hoy"
CAN_WAIT = "Puedes esperar"
NO_HISTORY = "Sin suficiente historico"
TOO_THIN = "No hay suficiente historico diario consistente para construir una cadena de Markov util."
EXPLANATION = (
    "El área %s %s está en un régimen %s. La probabilidad de ver un régimen más barato en 3 días es del %.0f%% "
    "y en 7 días del %.0f%%."
)
DOUBT = " La confianza es baja por la variabilidad o escasez de transiciones."
NO_PROVINCE_HISTORY = "No hay historico agregado para la provincia seleccionada."


def daily_history(rollup: DataFrame, keys: Sequence[str], window_days: int = WINDOW_DAYS, last_by: str | None = None) -> DataFrame:
    """One price per key and day, over the ``window_days`` up to the key's own latest day.

    Where a day has several rows the greatest ``last_by`` wins (for zip codes: the last province in order).
    """
    tie = F.struct(F.coalesce(as_col(last_by).cast("string"), F.lit("")), F.col("avg_price")) if last_by else F.col("avg_price")
    price = F.col("avg_price").try_cast("double")
    carried = [F.max_by(last_by, F.when(F.col(last_by).isNotNull(), tie)).alias(last_by)] if last_by else []
    days = (
        rollup.withColumn("date", F.col("date").cast("date"))
        .where(F.col("date").isNotNull() & price.isNotNull() & ~F.isnan(price))
        .groupBy(*keys, "date")
        .agg(F.max_by(price, tie).alias("price"), *carried)
    )
    latest = F.max("date").over(Window.partitionBy(*keys))
    return days.withColumn("_latest", latest).where(F.col("date") >= F.date_sub("_latest", max(1, window_days) - 1)).drop("_latest")


def with_regimes(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Label each day by the terciles of its key's prices."""
    terciles = F.percentile("price", F.array(F.lit(1 / 3), F.lit(2 / 3))).over(Window.partitionBy(*keys))
    regime = (
        F.when(F.col("price") <= F.col("_t")[0], REGIMES[0]).when(F.col("price") >= F.col("_t")[1], REGIMES[2]).otherwise(REGIMES[1])
    )
    return history.withColumn("_t", terciles).withColumn("regime", regime).drop("_t")


def transition_counts(days: DataFrame, keys: Sequence[str], carry: Sequence[Column] = ()) -> DataFrame:
    """Per key: days, latest state, and the 3x3 counts of moves between consecutive calendar days (``n_<from>_<to>``)."""
    in_order = Window.partitionBy(*keys).orderBy("date")
    moves = days.withColumns(
        {"_next": F.lead("regime").over(in_order), "_gap": F.date_diff(F.lead("date").over(in_order), F.col("date"))}
    )
    cells = [f"count_if(_gap = 1 AND regime = '{a}' AND _next = '{b}') AS n_{a}_{b}" for a in REGIMES for b in REGIMES]
    states = " + ".join(f"max(CASE WHEN regime = '{r}' THEN 1 ELSE 0 END)" for r in REGIMES)
    return moves.groupBy(*keys).agg(
        F.count("*").alias("coverage_days"),
        F.expr(f"{states} AS distinct_states"),
        F.max("date").alias("current_date"),
        F.max_by("price", "date").alias("current_avg_price"),
        F.max_by("regime", "date").alias("current_regime"),
        *[F.expr(c) for c in cells],
        *carry,
    )


# The measures below read the count and probability columns by name, hence as SQL text.
_TOTAL = {a: "(" + " + ".join(f"n_{a}_{b}" for b in REGIMES) + ")" for a in REGIMES}
_ALL_MOVES = "(" + " + ".join(_TOTAL.values()) + ")"


def move_probability(a: str, b: str) -> Column:
    """Estimated probability of moving from ``a`` to ``b``; a state never left stays where it is."""
    return F.expr(f"CASE WHEN {_TOTAL[a]} > 0 THEN n_{a}_{b} / {_TOTAL[a]} ELSE {1 if a == b else 0}D END")


def cheaper_within(days: int) -> Column:
    """Probability of seeing a state cheaper than the current one within ``days`` days.

    Follows the probability mass that has not yet reached a cheaper state. From ``normal`` it may sit in normal or
    expensive; from ``expensive`` only in expensive, since normal already counts as cheaper. Reads ``p_<from>_<to>``.
    """
    if days <= 0:
        return F.lit(0.0)
    return F.expr(
        f"""CASE WHEN current_regime = 'cheap' THEN 0D ELSE greatest(0D, least(1D, 1D - aggregate(
              sequence(1, {days}),
              named_struct('normal', if(current_regime = 'normal', 1D, 0D), 'dear', if(current_regime = 'normal', 0D, 1D)),
              (mass, day) -> named_struct(
                'normal', if(current_regime = 'normal', mass.normal * p_normal_normal + mass.dear * p_expensive_normal, 0D),
                'dear', mass.normal * p_normal_expensive + mass.dear * p_expensive_expensive),
              mass -> mass.normal + mass.dear))) END"""
    )


def expected_stay() -> Column:
    """Expected days in the current state; null when it is practically never left."""
    stay = F.expr("CASE current_regime " + " ".join(f"WHEN '{r}' THEN p_{r}_{r}" for r in REGIMES) + " END")
    return F.when(stay < 0.9999, F.round(1.0 / F.greatest(F.lit(1e-6), 1.0 - stay), 1))


def confidence() -> Column:
    """60 % sample size (full at 90 moves), 40 % mean concentration of the rows that have moves."""
    peak = {a: "greatest(" + ", ".join(f"n_{a}_{b}" for b in REGIMES) + ")" for a in REGIMES}
    shares = " + ".join(f"if({_TOTAL[a]} > 0, {peak[a]} / {_TOTAL[a]}, 0D)" for a in REGIMES)
    rows = " + ".join(f"if({_TOTAL[a]} > 0, 1, 0)" for a in REGIMES)
    score = f"0.6D * least(1D, {_ALL_MOVES} / 90D) + 0.4D * ({shares}) / ({rows})"
    return F.expr(f"CASE WHEN {_ALL_MOVES} > 0 THEN round({score}, 3) ELSE 0D END")


def recommendation(regime: Column, in_3d: Column, in_7d: Column) -> Column:
    wait = ((regime == "expensive") & ((in_3d >= 0.55) | (in_7d >= 0.75))) | ((regime == "normal") & (in_3d >= 0.6))
    return F.when(wait, CAN_WAIT).otherwise(REFUEL_TODAY)


def explanation(area_type: str, area: Column, regime: Column, in_3d: Column, in_7d: Column, conf: Column) -> Column:
    word = F.coalesce(*[F.when(regime == r, w) for r, w in REGIME_WORDS.items()], regime)
    text = F.format_string(EXPLANATION, F.lit(AREA_WORDS.get(area_type, area_type)), area, word, in_3d * 100, in_7d * 100)
    return F.when(conf < 0.45, F.concat(text, F.lit(DOUBT))).otherwise(text)


def forecast(days: DataFrame, area: str, area_type: str, carry: Sequence[Column] = ()) -> DataFrame:
    """One row per (area, product) from :func:`daily_history`; thin histories come back with ``insufficient_data``."""
    keys = [area, "fuel_type"]
    counted = transition_counts(with_regimes(days, keys), keys, carry)
    total = F.expr(_ALL_MOVES)
    enough = (F.col("coverage_days") >= MIN_DAYS) & (F.col("distinct_states") >= 2) & (total >= MIN_TRANSITIONS)
    modeled = (
        counted.withColumns({f"p_{a}_{b}": move_probability(a, b) for a in REGIMES for b in REGIMES})
        .withColumns({"_in_3d": cheaper_within(3), "_in_7d": cheaper_within(7), "_conf": confidence(), "_ok": enough})
    )
    row = {a: "map(" + ", ".join(f"'{b}', round(p_{a}_{b}, 4)" for b in REGIMES) + ")" for a in REGIMES}
    matrix = F.expr("map(" + ", ".join(f"'{a}', {row[a]}" for a in REGIMES) + ")")
    regime, in_3d, in_7d, conf = F.col("current_regime"), F.col("_in_3d"), F.col("_in_7d"), F.col("_conf")
    ok = lambda c: F.when(F.col("_ok"), c)
    return modeled.select(
        F.lit(area_type).alias("geography_type"),
        F.col(area).cast("string").alias("geography_value"),
        "fuel_type",
        F.lit(area_type).alias("source"),
        ok(F.col("coverage_days")).alias("coverage_days"),
        ok(total).alias("transition_observations"),
        ok(F.col("current_date")).alias("current_date"),
        ok(F.round("current_avg_price", 4)).alias("current_avg_price"),
        ok(regime).alias("current_regime"),
        ok(F.try_element_at(matrix, regime)).alias("next_day_probabilities"),
        ok(F.round(in_3d, 4)).alias("cheaper_within_3d"),
        ok(F.round(in_7d, 4)).alias("cheaper_within_7d"),
        ok(expected_stay()).alias("expected_days_in_current_regime"),
        ok(conf).alias("confidence"),
        F.coalesce(ok(recommendation(regime, in_3d, in_7d)), F.lit(NO_HISTORY)).alias("recommendation"),
        F.coalesce(ok(explanation(area_type, F.col(area).cast("string"), regime, in_3d, in_7d, conf)), F.lit(TOO_THIN)).alias("explanation"),
        (~F.col("_ok")).alias("insufficient_data"),
        ok(matrix).alias("transition_matrix"),
        *[c for c in modeled.columns if c.startswith("carry_")],
    )


def province_forecast(province_rollup: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    named = province_rollup.withColumn("area", province_data_name("province"))
    return forecast(daily_history(named, ["area", "fuel_type"], window_days), "area", "province")


def zip_forecast(zip_rollup: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Zip-code forecasts with ``carry_province``, the province of the latest day that names one."""
    coded = zip_rollup.withColumn("area", canonical_zip("zip_code"))
    days = daily_history(coded, ["area", "fuel_type"], window_days, last_by="province")
    province = F.max_by("province", F.when(F.col("province").isNotNull(), F.col("date"))).alias("carry_province")
    return forecast(days, "area", "zip_code", carry=[province])


def forecast_with_fallback(zip_rollup: DataFrame, province_rollup: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Every zip code's own forecast where its history suffices, else its province's.

    ``requested_zip`` names the zip code a row answers; the geography columns say whose chain it is.
    """
    own = zip_forecast(zip_rollup, window_days)
    shared = [c for c in own.columns if c != "carry_province"]
    fallback = province_forecast(province_rollup, window_days)
    thin = F.col("z.insufficient_data") & F.col("z.carry_province").isNotNull()
    joined = own.alias("z").join(
        fallback.alias("p"),
        thin & (province_data_name("z.carry_province") == F.col("p.geography_value")) & (F.col("z.fuel_type") == F.col("p.fuel_type")),
        "left",
    )
    # A thin zip code whose province has no history at all is answered as an insufficient province.
    absent = {"geography_type": F.lit("province"), "source": F.lit("province"), "geography_value": F.col("z.carry_province"),
              "explanation": F.lit(NO_PROVINCE_HISTORY)}
    pick = []
    for c in shared:
        when_absent = absent.get(c, F.col(f"z.{c}"))
        found = F.col("p.geography_value").isNotNull()
        pick.append(F.when(thin & found, F.col(f"p.{c}")).when(thin, when_absent).otherwise(F.col(f"z.{c}")).alias(c))
    return joined.select(F.col("z.geography_value").alias("requested_zip"), *pick)
