"""The given tables seen as price observations, stations, query points and trips.

Column expressions are written in SQL that Spark and DuckDB read alike, so that each view exists once and the checking
SQL (``*_SQL``, as common table expressions) is built from the same text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrid.functions.columns import haversine_km


# Given explicitly, so that opening a table runs no job to look at its files.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder path in the shared folder of ``spark.checkpoint.dir``; a cluster must name one, as no machine's
    own folder is seen by the others. In local mode, where there is one machine, Spark's warehouse folder serves too."""
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base and conf.get("spark.master", "").startswith("local[") or not base and conf.get("spark.master") == "local":
        base = spark.conf.get("spark.sql.warehouse.dir")
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def _select(columns: dict[str, str]) -> list[str]:
    return [f"{expr} AS {name}" for name, expr in columns.items()]


def _sql(columns: dict[str, str]) -> str:
    return ", ".join(f'{expr} AS "{name}"' for name, expr in columns.items())


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"2 * 6371.0 * asin(sqrt(least(1.0, power(sin(radians({lat2} - {lat1}) / 2), 2) + "
        f"cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2))))"
    )


# ------------------------------------------------------------------ price observations: one event = one station row
# Prices are divided by a prime so that means do not fall on rounding ties, where engines may differ.
OBSERVATION = {
    "timestamp": "concat(substr(cast(ts as string), 1, 10), 'T', substr(cast(ts as string), 12, 2), ':00:00+00:00')",
    "eess_id": "cast(user_id as string)",
    "ccaa_id": "cast(user_id % 3 as string)",
    "province_id": "cast(user_id % 4 as string)",
    "municipality_id": "cast(user_id % 8 as string)",
    "sale_type": "case when event_id % 10 = 0 then 'r' else 'p' end",
    "label": "case event_type when 'click' then 'repsol' when 'view' then 'ballenoil' when 'signup' then 'bp oil' "
    "when 'error' then 'shell recharge' else 'nº 10.935' end",
    "province": "case user_id % 4 when 0 then 'madrid' when 1 then 'balears (illes)' when 2 then 'sevilla' end",
    "municipality": "concat('municipality ', cast(user_id % 5 as string))",
    "locality": "case when user_id % 11 > 0 then concat('locality ', cast(user_id % 10 as string)) end",
    "zip_code": "lpad(cast(28001 + user_id % 20 as string), 5, '0')",
    "latitude": "36 + cast((user_id * 7919) % 7000 as double) / 1000",
    "longitude": "-9 + cast((user_id * 104729) % 12000 as double) / 1000",
    "diesel_a_price": "value * 1000 / 104729",
    "gasoline_95_e5_price": "case when event_id % 7 = 0 then 0.0 when event_id % 11 = 0 then null "
    "else value * (1 + event_id % 3) * 1000 / 104729 end",
    "hydrogen_price": "cast(null as double)",
}
OBSERVATION_SQL = f"e AS (SELECT {_sql(OBSERVATION)}, cast(ts as date) AS dt FROM events)"
OBSERVED_FUELS = ["diesel_a_price", "gasoline_95_e5_price"]


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_select(OBSERVATION))


# ------------------------------------------------------------------ brand prices at volume: one line item = one row
BRAND_SALE = {
    "dt": "cast(l_shipdate as date)",
    "label": "lower(p_brand)",
    "zip_code": "n_name",
    "locality": "r_name",
    "municipality": "l_returnflag",
    "diesel_a_price": "l_extendedprice / l_quantity * 10 / 104729",
    "gasoline_95_e5_price": "l_tax * l_extendedprice / 104729",
}
BRAND_SALE_SQL = (
    f"b AS (SELECT {_sql(BRAND_SALE)} FROM lineitem JOIN part ON l_partkey = p_partkey "
    "JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
)
SALE_BRANDS = ["brand#1", "brand#7", "brand#12", "brand#19", "brand#25"]
SALE_GEOS = ["zip_code", "locality"]


def brand_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    return (
        t("lineitem")
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .selectExpr(*_select(BRAND_SALE))
    )


# ------------------------------------------------------------------ long daily histories from the orders
HISTORY_ZIP = "concat(cast(28000 + 100 * cast(substr(o_orderpriority, 1, 1) as int) + o_custkey % 2 as string), case when o_custkey % 2 = 1 then '.0' else '' end)"
HISTORY_PROVINCE = (
    "case substr(o_orderpriority, 1, 1) when '1' then 'madrid' when '2' then 'palmas (las)' when '3' then 'sevilla' "
    "when '4' then 'ceuta' else 'coruña (a)' end"
)
HISTORY_BRAND = "lower(concat('brand ', substr(o_orderpriority, 1, 1), o_orderstatus))"
HISTORY_FUEL = "case when o_orderkey % 5 = 0 then 'gasoline_95_e5_price' else 'diesel_a_price' end"
AS_OF = "2001-08-01"
_STATS = (
    "avg(o_totalprice / 104729) AS avg_price, min(o_totalprice / 104729) AS min_price, "
    "max(o_totalprice / 104729) AS max_price, count(*) AS station_count"
)


def _history(spark: SparkSession, sf_dir: str, keys: dict[str, str]) -> DataFrame:
    keyed = table(spark, sf_dir, "orders").selectExpr("cast(o_orderdate as date) AS date", *_select(keys), "o_totalprice")
    price = F.col("o_totalprice") / 104729
    return keyed.groupBy("date", *keys).agg(
        F.avg(price).alias("avg_price"), F.min(price).alias("min_price"), F.max(price).alias("max_price"), F.count("*").alias("station_count")
    )


_ZIP_KEYS = {"zip_code": HISTORY_ZIP, "province": HISTORY_PROVINCE, "fuel_type": HISTORY_FUEL}
_PROVINCE_KEYS = {"province": HISTORY_PROVINCE, "fuel_type": HISTORY_FUEL}
_BRAND_KEYS = {"brand": HISTORY_BRAND, "fuel_type": HISTORY_FUEL}
ZIP_HISTORY_SQL = f'hz AS (SELECT cast(o_orderdate as date) AS "date", {_sql(_ZIP_KEYS)}, {_STATS} FROM orders GROUP BY ALL)'
PROVINCE_HISTORY_SQL = f'hp AS (SELECT cast(o_orderdate as date) AS "date", {_sql(_PROVINCE_KEYS)}, {_STATS} FROM orders GROUP BY ALL)'
BRAND_HISTORY_SQL = f'hb AS (SELECT cast(o_orderdate as date) AS "date", {_sql(_BRAND_KEYS)}, {_STATS} FROM orders GROUP BY ALL)'


def zip_history(spark, sf_dir) -> DataFrame:
    return _history(spark, sf_dir, _ZIP_KEYS)


def province_history(spark, sf_dir) -> DataFrame:
    return _history(spark, sf_dir, _PROVINCE_KEYS)


def brand_history(spark, sf_dir) -> DataFrame:
    return _history(spark, sf_dir, _BRAND_KEYS)


# ------------------------------------------------------------------ stations (customers) and query points (suppliers)
STATION = {
    "station_id": "c_custkey",
    "label": "lower(c_mktsegment)",
    "address": "c_name",
    "municipality": "concat('m', cast(c_custkey % 7 as string))",
    "province": "case c_nationkey when 0 then 'madrid' when 1 then 'palmas (las)' when 2 then 'balears (illes)' when 3 then 'ceuta' "
    "when 4 then 'coruña (a)' when 5 then 'valencia / valència' else lower(n_name) end",
    "zip_code": "case when c_custkey % 97 = 0 then null else lpad(cast((c_custkey % 100) * 523 + 700 as string), 5, '0') end",
    "sale_type": "case when c_custkey % 10 = 0 then 'r' else 'p' end",
    "latitude": "36 + cast((c_custkey * 7919) % 7000 as double) / 1000",
    "longitude": "-9 + cast((c_custkey * 104729) % 12000 as double) / 1000",
    "diesel_a_price": "c_acctbal / 7919",
    "diesel_b_price": "case when c_custkey % 3 = 0 then null else c_acctbal / 9973 end",
    "diesel_premium_price": "case when c_custkey % 4 = 0 then 0.0 else c_acctbal / 6007 end",
}
STATION_SQL = f"s AS (SELECT {_sql(STATION)} FROM customer JOIN nation ON c_nationkey = n_nationkey)"
STATION_FUELS = ["diesel_a_price", "diesel_b_price", "diesel_premium_price"]
POINT = {
    "query_id": "s_suppkey",
    "query_lat": "36 + cast((s_suppkey * 7919 + 3501) % 7000 as double) / 1000",
    "query_lon": "-9 + cast((s_suppkey * 104729 + 6007) % 12000 as double) / 1000",
}
POINT_SQL = f"q AS (SELECT {_sql(POINT)} FROM supplier)"


def stations(spark, sf_dir) -> DataFrame:
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(*_select(STATION))


def points(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*_select(POINT))


# Road distances: longer than the great circle, with one station in 13 unreachable and one query in 5 not routed at all.
ROAD_KM = "distance_km * (1.1 + (station_id % 5) * 0.05)"


def routed_queries(points: DataFrame) -> DataFrame:
    return points.where("query_id % 5 <> 0")


def road_distances(pairs: DataFrame) -> DataFrame:
    return routed_queries(pairs).where("station_id % 13 <> 0").selectExpr("query_id", "station_id", f"{ROAD_KM} AS road_km")


# ------------------------------------------------------------------ polygons (nations) around the stations
_X0, _Y0 = "(-9 + (n_nationkey % 5) * 2.4e0)", "(36 + floor(n_nationkey / 5) * 1.4e0)"
_MAIN_RING = [(0.0, 0.0), (2.6, 0.2), (2.2, 1.7), (1.3, 0.9), (0.3, 1.5)]
_SIDE_RING = [(2.0, 1.9), (3.1, 2.0), (2.4, 2.8)]


def _vertex(dx: float, dy: float) -> tuple[str, str]:
    return f"{_X0} + {dx!r}e0", f"{_Y0} + {dy!r}e0"


def polygon_documents(spark, sf_dir) -> DataFrame:
    """One GeoJSON Feature text per nation; every fourth is a MultiPolygon with a second ring."""

    def ring(corners) -> str:
        return "array(" + ", ".join(f"array({x}, {y})" for x, y in (_vertex(*c) for c in corners)) + ")"

    props = "map('nombre', n_name)"
    one = f"to_json(struct('Feature' AS type, {props} AS properties, struct('Polygon' AS type, array({ring(_MAIN_RING)}) AS coordinates) AS geometry))"
    two = (
        f"to_json(struct('Feature' AS type, {props} AS properties, struct('MultiPolygon' AS type, "
        f"array(array({ring(_MAIN_RING)}), array({ring(_SIDE_RING)})) AS coordinates) AS geometry))"
    )
    return table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS feature_idx", f"case when n_nationkey % 4 = 0 then {two} else {one} end AS geojson"
    )


def _vertices_sql() -> str:
    parts = []
    for ring, (corners, where) in enumerate([(_MAIN_RING, "true"), (_SIDE_RING, "n_nationkey % 4 = 0")]):
        for i, corner in enumerate(corners):
            x, y = _vertex(*corner)
            after = _vertex(*corners[(i + 1) % len(corners)])
            parts.append(
                f"SELECT n_nationkey AS feature_idx, n_name AS name, {ring} AS ring, {x} AS x1, {y} AS y1, "
                f"{after[0]} AS x2, {after[1]} AS y2 FROM nation WHERE {where}"
            )
    return " UNION ALL ".join(parts)


POLYGON_SQL = (
    f"sides AS ({_vertices_sql()}), "
    "inside AS (SELECT station_id, feature_idx, name, ring FROM s CROSS JOIN sides "
    "WHERE (y1 > latitude) <> (y2 > latitude) AND longitude < (x1 - x2) * (latitude - y2) / (y1 - y2) + x2 "
    "GROUP BY ALL HAVING count(*) % 2 = 1)"
)

# ------------------------------------------------------------------ trips: each supplier drives past the next two
STEPS = 200
VEHICLE = {
    "tank_liters": "40.0e0 + trip_id % 3 * 10",
    "consumption": "6.0e0 + trip_id % 3",
    "fuel_pct": "30.0e0 + trip_id % 5 * 15",
    "floor_pct": "20.0e0 + trip_id % 2 * 30",
    # Most trips allow a few minutes; one in eleven allows 40, and none of the others may lose or gain by it.
    "max_detour_min": "case when trip_id % 11 = 0 then 40.0e0 else 6.0e0 + trip_id % 3 * 2 end",
}
_J = "j"
_LON = f"case when {_J} < {STEPS} then a_lon + ({_J} / {STEPS}e0) * (b_lon - a_lon) else b_lon + (({_J} - {STEPS}) / {STEPS}e0) * (c_lon - b_lon) end"
_LAT = _LON.replace("_lon", "_lat")


def trips(spark, sf_dir) -> DataFrame:
    q = points(spark, sf_dir)
    a = q.selectExpr("query_id AS trip_id", "query_lat AS a_lat", "query_lon AS a_lon")
    b = q.selectExpr("query_id - 1 AS trip_id", "query_lat AS b_lat", "query_lon AS b_lon")
    c = q.selectExpr("query_id - 2 AS trip_id", "query_lat AS c_lat", "query_lon AS c_lon")
    # Spread the short rows before the routes are built: walking a route is heavy work per row.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    legs = a.join(b, "trip_id").join(c, "trip_id").repartition(tasks, "trip_id")
    km = haversine_km("a_lat", "a_lon", "b_lat", "b_lon") + haversine_km("b_lat", "b_lon", "c_lat", "c_lon")
    return legs.withColumn("total_km", km).selectExpr(
        "trip_id", f"transform(sequence(0, {2 * STEPS}), j -> array({_LON}, {_LAT})) AS route", "total_km", *_select(VEHICLE)
    )


_HOP = haversine_sql("a_lat", "a_lon", "b_lat", "b_lon") + " + " + haversine_sql("b_lat", "b_lon", "c_lat", "c_lon")
_STEP_KM = haversine_sql("w.lat", "w.lon", "p.lat", "p.lon")
# Walk every route point by point, remembering the kilometre of the last waypoint kept.
TRIP_SQL = (
    f"legs AS (SELECT a.query_id AS trip_id, a.query_lat AS a_lat, a.query_lon AS a_lon, b.query_lat AS b_lat, b.query_lon AS b_lon, "
    "c.query_lat AS c_lat, c.query_lon AS c_lon FROM q a JOIN q b ON b.query_id = a.query_id + 1 JOIN q c ON c.query_id = a.query_id + 2), "
    f"trips AS (SELECT trip_id, {_HOP} AS total_km, {_sql(VEHICLE)} FROM legs), "
    f"pts AS (SELECT trip_id, j, {_LAT} AS lat, {_LON} AS lon FROM legs CROSS JOIN range({2 * STEPS + 1}) AS r(j)), "
    "walk AS (SELECT trip_id, j, lat, lon, 0.0e0 AS km, 0.0e0 AS kept_km, true AS kept FROM pts WHERE j = 0 UNION ALL "
    f"SELECT p.trip_id, p.j, p.lat, p.lon, w.km + {_STEP_KM}, "
    f"CASE WHEN w.km + {_STEP_KM} - w.kept_km >= 10 THEN round(w.km + {_STEP_KM}, 2) ELSE w.kept_km END, "
    f"w.km + {_STEP_KM} - w.kept_km >= 10 FROM walk w JOIN pts p ON p.trip_id = w.trip_id AND p.j = w.j + 1), "
    "wps AS MATERIALIZED (SELECT trip_id, lat, lon, round(km, 2) AS km, cast(row_number() OVER (PARTITION BY trip_id ORDER BY j) - 1 AS integer) AS wp_idx "
    f"FROM walk WHERE kept OR j = {2 * STEPS})"
)
