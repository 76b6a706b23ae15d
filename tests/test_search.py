"""Search, grid joins, zones and polygons; the joins are compared with brute force, skew included."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pricegrid.operators import search, spatial, zones

STATIONS = (
    "station_id int, label string, address string, municipality string, province string, zip_code string, latitude double, longitude double, "
    "diesel_a_price double, diesel_b_price double, diesel_premium_price double"
)


@pytest.fixture
def stations(frame):
    return frame(
        [
            (1, "station_a", "x", "madrid", "madrid", "28001", 40.4168, -3.7038, 1.45, None, None),
            (2, "station_b", "x", "madrid", "madrid", "28001", 40.4200, -3.7000, 1.50, 1.2, None),
            (3, "station_c", "x", "barcelona", "barcelona", "08001", 41.3851, 2.1734, 1.55, None, 1.3),
            (4, "station_d", "x", "barcelona", "barcelona", "08001", 41.3851, 2.1734, None, 1.1, 1.3),
            (5, "station_e", "x", "lost", None, None, None, None, 1.0, None, None),
        ],
        STATIONS,
    )


@pytest.fixture
def sol(frame):
    return frame([(7, 40.4168, -3.7038)], "query_id int, query_lat double, query_lon double")


def ids(df, *order):
    return [r.station_id for r in df.orderBy(*(order or ["station_id"])).collect()]


def test_cheapest_in_zip(stations, frame):
    priced = search.priced_stations(stations, "diesel_a_price")
    assert ids(search.cheapest_in_zip(priced, 3, frame([("28001",)], "zip_code string")), "price") == [1, 2]
    assert search.cheapest_in_zip(priced, 3, frame([("99999",)], "zip_code string")).count() == 0
    assert ids(search.cheapest_in_zip(priced, 1)) == [1, 3]
    assert ids(search.cheapest_in_zip(search.priced_stations(stations, "diesel_a_price", labels=["station_b"]))) == [2]
    assert ids(search.cheapest_in_zip(search.priced_stations(stations, "diesel_a_price", labels=[]))) == [1, 2, 3]
    with pytest.raises(ValueError):
        search.priced_stations(stations, "label")


def test_group_needs_its_primary_product(stations):
    got = {r.station_id: r.variant_prices for r in search.priced_stations(stations, group="diesel").collect()}
    assert got.keys() == {1, 2, 3, 5}
    assert got[3] == {"diesel_a_price": 1.55, "diesel_premium_price": 1.3}


def test_radius_and_nearest(stations, sol):
    priced = search.priced_stations(stations, "diesel_a_price")
    assert ids(search.within_radius(sol, priced, 5)) == [1, 2]
    assert ids(search.nearest(sol, priced, 2)) == [1, 2]
    assert ids(search.nearest(sol, priced, 50)) == [1, 2, 3]


def test_road_distances(stations, sol, frame):
    priced = search.priced_stations(stations, "diesel_a_price")
    road = frame([(7, 1, 9.0), (7, 2, 2.0), (7, 3, None)], "query_id int, station_id int, road_km double")
    assert ids(search.nearest(sol, priced, 5, road), "distance_km") == [2, 1]
    assert ids(search.cheapest_within_radius(sol, priced, 5, road=road)) == [2]
    other_query = road.withColumn("query_id", F.lit(8))
    assert ids(search.nearest(sol, priced, 5, other_query)) == [1, 2, 3]


def test_total_cost_ranking(frame, sol):
    rows = [(i, f"s{i}", "x", "m", "p", "28001", 40.4168 + 0.01 * i, -3.7038, 1.5 + 0.05 * i, None, None) for i in range(5)]
    priced = search.priced_stations(frame(rows, STATIONS), "diesel_a_price")
    got = search.best_total_cost(sol, priced, 10, 3, tank_liters=40).orderBy(F.desc("score")).collect()
    assert [r.station_id for r in got] == [0, 1, 2]
    assert got[0].score == 10.0 and got[0].estimated_total_cost == 60.0
    everything = search.best_total_cost(sol, priced, 10, 50).orderBy("score").collect()
    assert everything[0].score == 0.0 and len(everything) == 5
    assert search.best_total_cost(sol, priced.where("station_id = 3"), 10, 3).first().score == 10.0


def test_pct_vs_average_and_kpis(stations, sol):
    priced = search.priced_stations(stations, "diesel_a_price").where("station_id < 4")
    got = search.with_pct_vs_average(priced, stations.where("station_id < 4"), "diesel_a_price").orderBy("station_id").collect()
    assert [r.pct_vs_avg for r in got] == [-3.3, 0.0, 3.3]
    assert search.with_pct_vs_average(priced, stations.where("false"), "diesel_a_price").first().pct_vs_avg is None
    k = search.listing_kpis(search.within_radius(sol, priced, 5)).first()
    assert (k.cheapest_price, k.avg_price, k.nearest_km, k.results) == (1.45, 1.475, 0.0, 2)


def brute_km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1, h)))


@pytest.fixture(scope="module")
def globe():
    rng = random.Random(4)
    hot = lambda: (40 + rng.random() * 0.2, -3 + rng.random() * 0.2)  # noqa: E731 - a third of all rows in one spot
    wide = lambda: (rng.uniform(-90, 90), rng.uniform(-180, 180))
    edge = lambda: (rng.choice([89.9, -89.9, 10.0, 0.0, 90.0]), rng.choice([179.99, -179.99, 0.0, -180.0, 180.0]))
    make = lambda n: [(i, *(hot, wide, edge)[i % 3]()) for i in range(n)]
    return make(60), make(300) + [(1000 + i, 40.1, -2.9) for i in range(150)]


@pytest.mark.parametrize("radius", [0.3, 30, 2500, 20100])
def test_radius_join_is_exact_on_the_globe(frame, globe, radius):
    points, places = globe
    got = spatial.radius_join(
        frame(points, "query_id int, query_lat double, query_lon double"), frame(places, "station_id int, latitude double, longitude double"), radius
    ).collect()
    want = {(p[0], s[0]) for p in points for s in places if brute_km(*p[1:], *s[1:]) <= radius}
    assert len(got) == len(want) and {(r.query_id, r.station_id) for r in got} == want


@pytest.mark.parametrize("edge", [40.0, 900.0])
def test_radius_join_with_a_radius_of_its_own_for_each_point(frame, globe, edge):
    points, places = globe
    radius = lambda i: [None, 0.0, 3.0, 60.0, 2500.0, 20100.0, -1.0][i % 7]
    own = [(*p, radius(p[0])) for p in points]
    got = spatial.radius_join(
        frame(own, "query_id int, query_lat double, query_lon double, reach double"),
        frame(places, "station_id int, latitude double, longitude double"),
        "reach",
        edge_km=edge,
    ).collect()
    want = {(p[0], s[0]) for p in own for s in places if p[3] is not None and brute_km(*p[1:3], *s[1:]) <= p[3]}
    assert len(got) == len(want) and {(r.query_id, r.station_id) for r in got} == want


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_nearest_join_is_exact_on_the_globe(frame, globe, k):
    points, places = globe
    got = spatial.nearest_join(
        frame(points, "query_id int, query_lat double, query_lon double"), frame(places, "station_id int, latitude double, longitude double"), k
    ).collect()
    mine = {p[0]: sorted(r.distance_km for r in got if r.query_id == p[0]) for p in points}
    for p in points:
        want = sorted(brute_km(*p[1:], *s[1:]) for s in places)[:k]
        assert mine[p[0]] == pytest.approx(want, abs=1e-4)


def test_plans_have_no_nested_loop(spark, frame, globe):
    points, places = globe
    p, s = frame(points, "query_id int, query_lat double, query_lon double"), frame(places, "station_id int, latitude double, longitude double")
    for df in (spatial.radius_join(p, s, 10), spatial.nearest_join(p, s, 3)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


RECTANGLES = [
    (0, "Centro", [[-3.72, 40.40], [-3.72, 40.44], [-3.68, 40.44], [-3.68, 40.40], [-3.72, 40.40]]),
    (1, "Retiro", [[-3.68, 40.40], [-3.68, 40.44], [-3.64, 40.44], [-3.64, 40.40], [-3.68, 40.40]]),
    (2, "All", [[-4.0, 40.0], [-4.0, 41.0], [-3.0, 41.0], [-3.0, 40.0]]),
]


def test_polygons(frame):
    rings = frame(RECTANGLES, "feature_idx int, name string, ring array<array<double>>")
    rows = [(1, "28001", 40.42, -3.70, 1.5), (2, "28002", 40.42, -3.66, 1.7), (3, "28003", 40.9, -3.1, 1.9), (4, "28004", 10.0, 10.0, 2.0), (5, "28005", 40.42, -3.70, None)]
    places = frame(rows, "station_id int, zip_code string, latitude double, longitude double, diesel_a_price double")
    first = {r.station_id: r.name for r in spatial.assign_features(places, rings).collect()}
    assert first == {1: "Centro", 2: "Retiro", 3: "All", 5: "Centro"}
    prices = {r.name: (r.avg_price, r.station_count) for r in zones.polygon_prices(places, rings, "diesel_a_price").collect()}
    assert prices == {"Centro": (1.5, 1), "Retiro": (1.7, 1), "All": (1.9, 1)}
    zips = {(r.name, r.zip_code) for r in zones.zips_by_polygon(places, rings, "diesel_a_price").collect()}
    assert {z for n, z in zips if n == "All"} == {"28001", "28002", "28003"} and ("Centro", "28001") in zips
    shown = zones.map_with_prices(rings.select("name"), zones.polygon_prices(places.where("station_id = 1"), rings, "diesel_a_price"))
    assert {r.name: r.station_count for r in shown.collect()} == {"Centro": 1, "Retiro": 0, "All": 0}


def test_containment_matches_ray_casting(frame):
    rng = random.Random(9)
    corners = [(math.cos(a) * rng.uniform(0.5, 3), math.sin(a) * rng.uniform(0.5, 3)) for a in [i * math.pi / 10 for i in range(20)]]
    ring = [[-3 + x, 40 + y] for x, y in corners]
    pts = [(i, 40 + rng.uniform(-3, 3), -3 + rng.uniform(-3, 3)) for i in range(400)]

    def inside(lat, lon):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[-1:] + ring[:-1]):
            odd ^= (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
        return odd

    got = spatial.assign_features(frame(pts, "station_id int, latitude double, longitude double"), frame([(0, "star", ring)], "feature_idx int, name string, ring array<array<double>>"))
    assert {r.station_id for r in got.collect()} == {i for i, lat, lon in pts if inside(lat, lon)}


def test_zone_and_catalogue_queries(stations):
    got = {(r.province, r.zip_code): r for r in zones.zone_prices(stations, fuels=["diesel_a_price"]).collect()}
    assert got[("madrid", "28001")].station_count == 2 and (None, None) in got
    assert zones.national_averages(stations.where("false"), ["diesel_a_price"]).first().asDict() == {"fuel_type": "diesel_a_price", "avg_price": None, "station_count": 0}
    assert [r.title for r in zones.province_names(stations).collect()] == ["Barcelona", "Madrid", None]
    assert [r.label for r in zones.label_counts(stations, 2).collect()] == ["station_a", "station_b"]
    assert zones.municipalities(stations).count() == 3


def test_cells_inside_a_polygon_need_no_ray(spark):
    rng = random.Random(5)
    n = 10_000
    reach = lambda i: 1.5 + 0.4 * math.sin(9 * 2 * math.pi * i / n) + 0.01 * math.sin(i)
    star = [[-3.0 + reach(i) * math.cos(2 * math.pi * i / n), 40.0 + reach(i) * math.sin(2 * math.pi * i / n)] for i in range(n)]
    wrapped = [[179.0, 10.0], [181.5, 10.0], [181.5, 12.0], [179.0, 12.0]]
    rings = spark.createDataFrame([(0, "star", star), (1, "wrapped", wrapped)], "feature_idx int, name string, ring array<array<double>>")
    spots = [(i, rng.uniform(37.8, 42.2), rng.uniform(-5.2, -0.8)) for i in range(600)]
    spots += [(i, rng.uniform(9.5, 12.5), rng.uniform(178.5, 182)) for i in range(600, 800)]
    places = spark.createDataFrame(spots, "station_id long, latitude double, longitude double")

    def holds(ring, lat, lon):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[-1:] + ring[:-1]):
            if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                odd = not odd
        return odd

    found = {(r.station_id, r.name) for r in spatial.containment_join(places, rings).collect()}
    near = lambda ring, s: min(p[1] for p in ring) <= s[1] <= max(p[1] for p in ring)
    assert found == {(s[0], name) for name, ring in (("star", star), ("wrapped", wrapped)) for s in spots if near(ring, s) and holds(ring, *s[1:])}
    cells = spatial.polygon_cells(rings).selectExpr("name", "_whole", "size(_sides) AS n").collect()
    whole = [c.n for c in cells if c._whole]
    assert len(whole) > 50 and max(whole) == 0
    assert max(c.n for c in cells) < n / 4


def exchanges(df):
    """The plan as Spark starts out on it."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_covers_are_never_broadcast(spark, frame, globe, tmp_path):
    """Small files of points, as estimated, make large covers; neither side of a join on cells may be broadcast."""
    points, places = globe
    frame(points, "query_id int, query_lat double, query_lon double").write.parquet(f"{tmp_path}/p")
    frame(places, "station_id int, latitude double, longitude double").withColumn("price", F.lit(1.5)).write.parquet(f"{tmp_path}/s")
    p, s = spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/s")
    covers = spatial.circle_cells(F.col("query_lat"), F.col("query_lon"), F.lit(10.0), F.lit(5.0))
    cells = s.withColumn("_cell", spatial.cell_of(F.col("latitude"), F.col("longitude"), F.lit(5.0)))
    assert "Broadcast" not in exchanges(spatial.join_cells(p.withColumn("_cell", F.explode(covers)), cells))
    joined = spatial.radius_join(p, s, 10)
    assert "SortMergeJoin" in exchanges(joined)
    nearest = exchanges(spatial._search_radius(p, s, 3, "query_id", "latitude", "longitude"))
    assert nearest.count("SortMergeJoin") >= 1


def test_pairs_are_dealt_over_all_partitions(spark, frame):
    """One file of points and few bytes, yet many pairs: no task may get them all, not even those of one hot cell."""
    rng = random.Random(2)
    near = lambda n: [(i, 40 + rng.random() / 100, -3 + rng.random() / 100) for i in range(n)]
    p = frame(near(40), "query_id int, query_lat double, query_lon double").coalesce(1)
    s = frame(near(3 * spatial.HOT_CELL), "station_id int, latitude double, longitude double").coalesce(1)
    found = spatial.radius_join(p, s, 40).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert sum(r["count"] for r in found) == 120 * spatial.HOT_CELL
    assert len(found) > 1 and max(r["count"] for r in found) < 120 * spatial.HOT_CELL


@pytest.mark.parametrize("radius", [30.0, 2500.0])
def test_cheapest_and_lowest_cost_match_brute_force(frame, globe, radius):
    points, places = globe
    rng = random.Random(6)
    price = {s[0]: rng.choice([1.2, 1.3, 1.31, 1.4, round(rng.uniform(1, 2), 3)]) for s in places}
    p = frame(points, "query_id int, query_lat double, query_lon double")
    s = frame([(*x, price[x[0]]) for x in places], "station_id int, latitude double, longitude double, price double")
    cheap = {(r.query_id, r.station_id) for r in search.cheapest_within_radius(p, s, radius, 3).collect()}
    best = {}
    for r in search.best_total_cost(p, s, radius, 3).collect():
        best.setdefault(r.query_id, []).append((r.estimated_total_cost, r.score))
    for q in points:
        near = [(brute_km(*q[1:], *x[1:]), x[0]) for x in places]
        near = [(km, i) for km, i in near if km <= radius]
        want = sorted((price[i], round(km, 6), i) for km, i in near)[:3]
        assert sorted(price[i] for k, i in cheap if k == q[0]) == [w[0] for w in want]
        costs = sorted(price[i] * (30 + 2 * km * 7 / 100) for km, i in near)
        got = sorted(best.get(q[0], []))
        assert [c for c, _ in got] == pytest.approx(costs[:3], abs=0.0051)
        if got:
            spread = costs[-1] - costs[0]
            assert got[0][1] == 10.0 and got[-1][1] == pytest.approx(10 * (costs[-1] - costs[len(got) - 1]) / spread if spread > 0.01 else 10.0, abs=0.2)


def test_few_stations_are_met_however_many_are_in_reach(frame):
    rng = random.Random(8)
    p = frame([(i, 40 + rng.random() / 10, -3 + rng.random() / 10) for i in range(5)], "query_id int, query_lat double, query_lon double")
    rows = [(i, 40 + rng.uniform(-0.5, 0.5), -3 + rng.uniform(-0.5, 0.5), rng.uniform(1, 2)) for i in range(20_000)]
    s = frame(rows, "station_id int, latitude double, longitude double, price double")
    met = {r.query_id: r["count"] for r in spatial.radius_extremes(p, s, 40.0, 5, lambda price, km: price).groupBy("query_id").count().collect()}
    assert met.keys() == set(range(5)) and 5 <= min(met.values()) and max(met.values()) < 1000


def test_a_router_gives_what_a_table_of_roads_gives(frame):
    rng = random.Random(7)
    p = frame([(i, 40 + rng.random(), -3 + rng.random()) for i in range(1, 12)], "query_id int, query_lat double, query_lon double")
    rows = [(i, 40 + rng.random(), -3 + rng.random(), round(rng.uniform(1, 2), 2)) for i in range(900)]
    s = frame(rows, "station_id int, latitude double, longitude double, price double")

    def router(pairs):
        reachable = pairs.where("query_id % 5 <> 0 AND station_id % 3 <> 0")
        return reachable.selectExpr("query_id", "station_id", "distance_km * (1.1 + station_id % 4 * 0.2) AS road_km")

    table = router(search.within_radius(p, s, 20 * search.ROAD_RADIUS_FACTOR))
    plain = lambda df: sorted(map(tuple, df.select("query_id", "station_id", "distance_km", "price").collect()))
    asked = search.cheapest_within_radius(p, s, 20, 4, router, p.where("query_id % 5 <> 0"))
    assert plain(asked) == plain(search.cheapest_within_radius(p, s, 20, 4, table))


def test_a_pile_of_copies_costs_k_stations(frame):
    """Very many stations of one place and price: the lowest ids win, and no query meets the others."""
    p = frame([(i, 40 + i / 100, -3.0) for i in range(4)], "query_id int, query_lat double, query_lon double")
    rows = [(i, 40.1, -3.0, 1.1) for i in range(900)] + [(1000 + i, 40.0, -3.0 + i / 50, 1.2 + i / 10) for i in range(5)]
    s = frame(rows[::-1], "station_id int, latitude double, longitude double, price double")
    price = lambda price, km: price
    met = spatial.radius_extremes(p, s, 40.0, 3, price, ties="station_id").groupBy("query_id").count().collect()
    assert len(met) == 4 and max(r["count"] for r in met) <= 8
    for found in (search.cheapest_within_radius(p, s, 40.0, 3), search.best_total_cost(p, s, 40.0, 3)):
        assert sorted((r.query_id, r.station_id) for r in found.collect()) == [(q, i) for q in range(4) for i in range(3)]


def test_the_dearest_is_found_among_few(frame):
    """Cost grows outward, where no cell lies inside the circle: a cell's dearest station itself proves a limit there."""
    rng = random.Random(3)
    p = frame([(i, 40 + rng.random() / 10, -3 + rng.random() / 10) for i in range(5)], "query_id int, query_lat double, query_lon double")
    rows = [(i, 40 + rng.uniform(-0.5, 0.5), -3 + rng.uniform(-0.5, 0.5), rng.uniform(1, 2)) for i in range(20_000)]
    s = frame(rows, "station_id int, latitude double, longitude double, price double")
    cost = lambda price, km: price * (40 + 0.14 * km)
    met = spatial.radius_extremes(p, s, 40.0, 1, cost, highest=True, ties="station_id").withColumn("cost", cost(F.col("price"), F.col("distance_km")))
    got = {r.query_id: r for r in met.groupBy("query_id").agg(F.max("cost").alias("cost"), F.count("*").alias("n")).collect()}
    for q in p.collect():
        near = [(brute_km(q.query_lat, q.query_lon, *x[1:3]), x[3]) for x in rows]
        assert got[q.query_id].cost == pytest.approx(max(cost(price, km) for km, price in near if km <= 40.0), abs=1e-6)
        assert got[q.query_id].n < 60
