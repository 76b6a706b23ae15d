"""Distance and containment joins on a latitude/longitude grid.

A theta join on a distance would plan a nested loop. Here every point falls in one grid cell and every query covers
the few cells its circle touches, so all joins are equi-joins on a cell number followed by the exact test. Rows of
the grid have their own column count (cells stay about ``edge`` km wide at every latitude) and columns wrap at the
antimeridian, so the cover is complete anywhere on the globe. Covers are exploded rows, whose number no estimate of
Spark's knows; they are always shuffled, never broadcast. A cell holding very many places is cut into parts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from pricegrid.functions.columns import EARTH_RADIUS_KM, haversine_km

KM_PER_DEGREE = math.pi * EARTH_RADIUS_KM / 180
HALF_TURN_KM = math.pi * EARTH_RADIUS_KM
SLACK_DEGREES = 1e-6  # covers are widened by about 10 cm so that rounding never loses a boundary cell
MIN_EDGE_KM = 0.05
DEFAULT_EDGE_KM = 5.0
HOT_CELL = 5000  # places; a cell with more is joined in parts of about this many

# Cell edges for nearest-neighbour search, 8x apart; at the last one the whole globe is a single cell.
SEARCH_EDGES_KM = [0.05 * 8**level for level in range(8)]
# From this level on the globe has under 40,000 cells, a fixed bound that makes their counts safe to broadcast.
FIRST_COARSE_LEVEL = 4


def _step(edge_km: Column) -> Column:
    return edge_km / KM_PER_DEGREE


def _row(lat: Column, edge_km: Column) -> Column:
    return F.floor((lat + 90) / _step(edge_km))


def _columns_in_row(row: Column, edge_km: Column) -> Column:
    south = row * _step(edge_km) - 90
    poleward = F.least(F.lit(90.0), F.greatest(F.abs(south), F.abs(south + _step(edge_km))))
    return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(poleward)) / _step(edge_km)))


def _cell(row: Column, col: Column) -> Column:
    return F.shiftleft(row, 32) + col


def cell_of(lat: Column, lon: Column, edge_km: Column) -> Column:
    row = _row(lat, edge_km)
    count = _columns_in_row(row, edge_km)
    col = F.floor(F.pmod(lon + 180, F.lit(360.0)) / (360 / count))
    return _cell(row, F.least(col, count - 1))


def _box_cells(south: Column, north: Column, west: Column, east: Column, edge_km: Column) -> Column:
    """Cells touched by a box; ``west``/``east`` may lie beyond +-180 degrees."""
    rows = F.sequence(_row(F.greatest(south, F.lit(-90.0)), edge_km), _row(F.least(north, F.lit(90.0)), edge_km))

    def row_cells(row: Column) -> Column:
        count = _columns_in_row(row, edge_km)
        first = F.floor((west + 180) / (360 / count))
        last = F.least(F.floor((east + 180) / (360 / count)), first + count - 1)
        return F.transform(F.sequence(first, last), lambda c: _cell(row, F.pmod(c, count)))

    return F.flatten(F.transform(rows, row_cells))


def circle_cells(lat: Column, lon: Column, radius_km: Column, edge_km: Column) -> Column:
    """Array of the cells a circle touches."""
    reach = F.least(radius_km / EARTH_RADIUS_KM, F.lit(math.pi))
    half_height = F.degrees(reach) + SLACK_DEGREES
    # Widest longitude offset of a spherical circle; a circle around a pole spans every longitude.
    half_width = F.when(F.abs(lat) + half_height >= 90, F.lit(180.0)).otherwise(
        F.degrees(F.asin(F.least(F.lit(1.0), F.sin(reach) / F.cos(F.radians(lat))))) + SLACK_DEGREES
    )
    return _box_cells(lat - half_height, lat + half_height, lon - half_width, lon + half_width, edge_km)


def _suffix_free(df: DataFrame, names: Sequence[str]) -> None:
    clash = set(df.columns) & set(names)
    if clash:
        raise ValueError(f"reserved column names in input: {sorted(clash)}")


def _numbers(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def dealt(df: DataFrame) -> DataFrame:
    """Short rows over all shuffle partitions, before a cover is made of each."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *_numbers(df))


def join_cells(
    covered: DataFrame,
    located: DataFrame,
    keys: Sequence[str] = ("_cell",),
    parts: bool = False,
    packed: Callable[[DataFrame, list[str]], DataFrame] | None = None,
) -> DataFrame:
    """Inner join of covers with what the cells hold, dealt over all shuffle partitions.

    Both sides are shuffled: the rows of a cover come out of an explode, so their estimated size says nothing about
    what a broadcast of them would take, and merging partitions by bytes would leave few tasks for very many pairs.
    With ``parts`` a cell of more than ``HOT_CELL`` places is cut into parts that meet the covers on their own; there
    are few such cells, at most one for ``HOT_CELL`` places. ``packed`` may group the shuffled covers by the keys given
    to it and more before they are joined.
    """
    tasks = int(covered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = list(keys)
    if parts:
        held = located.groupBy(*keys).agg(F.count("*").alias("_held")).where(F.col("_held") > HOT_CELL)
        hot = F.broadcast(held.select(*keys, F.ceil(F.col("_held") / HOT_CELL).cast("int").alias("_parts")))
        number = F.coalesce("_parts", F.lit(1))
        spread = F.pmod(F.xxhash64(*_numbers(located)), number.cast("bigint"))
        covered = covered.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), number - 1))).drop("_parts")
        located = located.join(hot, keys, "left").withColumn("_part", spread.cast("int")).drop("_parts")
        keys.append("_part")
    shuffled = covered.repartition(tasks, *keys)
    joined = (packed(shuffled, keys) if packed else shuffled).hint("merge").join(located.repartition(tasks, *keys), keys)
    return joined.drop("_part") if parts else joined


def radius_join(
    points: DataFrame,
    places: DataFrame,
    radius_km: float | str,
    *,
    edge_km: float = DEFAULT_EDGE_KM,
    point_lat: str = "query_lat",
    point_lon: str = "query_lon",
    lat: str = "latitude",
    lon: str = "longitude",
    distance: str = "distance_km",
) -> DataFrame:
    """All (point, place) pairs at most ``radius_km`` apart, with their distance.

    The radius is a number, or the name of a column of ``points`` with one for each of them (null: no place). Cells
    are half as wide as a given number; with a column they are ``edge_km`` wide, and a point covers as many as it needs.
    """
    own = isinstance(radius_km, str)
    radius = F.col(radius_km) if own else F.lit(float(radius_km))
    edge = F.lit(float(max(edge_km if own else radius_km / 2, MIN_EDGE_KM)))
    _suffix_free(points, [distance, "_cell", "_part"])
    reaching = points.where(radius >= 0) if own else points
    covered = dealt(reaching).withColumn("_cell", F.explode(circle_cells(F.col(point_lat), F.col(point_lon), radius, edge)))
    located = places.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumn(
        "_cell", cell_of(F.col(lat), F.col(lon), edge)
    )
    return (
        join_cells(covered, located, parts=True)
        .where(F.abs(F.col(lat) - F.col(point_lat)) <= radius / KM_PER_DEGREE + SLACK_DEGREES)
        .withColumn(distance, haversine_km(point_lat, point_lon, lat, lon))
        .where(F.col(distance) <= radius)
        .drop("_cell")
    )


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key. Spark plans a group limit before the shuffle, so a hot key sends at most ``k`` rows
    per task."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def _levels(edges: Sequence[float]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("level"), F.lit(float(e)).alias("edge")) for i, e in enumerate(edges)])


def _box_of(lat: str, lon: str) -> list[Column]:
    return [F.min(lat).alias("s"), F.max(lat).alias("t"), F.min(lon).alias("w"), F.max(lon).alias("e")]


def _box_km(q_lat: Column, q_lon: Column) -> tuple[Column, Column]:
    """Kilometres between which every place of the box in columns ``s, t, w, e`` lies from a point."""
    south, north, west, east = (F.col(c) for c in "stwe")
    # Longitude offsets: the shorter way round to the middle of the box, less or plus half its width.
    to_middle = F.abs(F.pmod((west + east) / 2 - q_lon + 180, F.lit(360.0)) - 180)
    half_width = (east - west) / 2
    cosines = F.cos(F.radians(south)), F.cos(F.radians(north))

    def km(dlat: Column, dlon: Column, cos_box: Column) -> Column:
        half_chord = F.pow(F.sin(F.radians(dlat) / 2), 2) + F.cos(F.radians(q_lat)) * cos_box * F.pow(F.sin(F.radians(dlon) / 2), 2)
        return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), half_chord)))

    # Largest cosine of latitude inside the box: at its side nearest the equator, or 1 if it straddles it.
    widest = F.when((south <= 0) & (north >= 0), F.lit(1.0)).otherwise(F.greatest(*cosines))
    near = km(F.greatest(F.lit(0.0), south - q_lat, q_lat - north), F.greatest(F.lit(0.0), to_middle - half_width), F.least(*cosines))
    far = km(F.greatest(F.abs(north - q_lat), F.abs(south - q_lat)), F.least(F.lit(180.0), to_middle + half_width), widest)
    return F.greatest(F.lit(0.0), near - 1e-6), far + 1e-6


def _search_radius(points: DataFrame, located: DataFrame, k: int, key: str, lat: str, lon: str) -> DataFrame:
    """Per point, a radius that provably holds its ``k`` nearest places, and the grid level to search it on.

    Counts per cell at every level but the last come with the box of the places inside, which bounds how far any of
    them can be from a point. Taking cells nearest-bound first until they hold ``k`` places gives a valid radius;
    the smallest over all levels wins. Points no level serves search the whole globe.
    """
    top = len(SEARCH_EDGES_KM) - 1
    levels = F.explode(_levels(SEARCH_EDGES_KM[:top]))
    counts = (
        located.select(F.col(lat).alias("y"), F.col(lon).alias("x"), levels.alias("l"))
        .groupBy(F.col("l.level").alias("level"), cell_of(F.col("y"), F.col("x"), F.col("l.edge")).alias("_cell"))
        .agg(F.count("*").alias("n"), *_box_of("y", "x"))
    )
    probes = dealt(points).select(key, "query_lat", "query_lon", levels.alias("l")).select(
        key,
        "query_lat",
        "query_lon",
        F.col("l.level").alias("level"),
        F.explode(circle_cells(F.col("query_lat"), F.col("query_lon"), F.col("l.edge"), F.col("l.edge"))).alias("_cell"),
    )
    is_fine = F.col("level") < FIRST_COARSE_LEVEL
    fine = join_cells(probes.where(is_fine), counts.where(is_fine), ["level", "_cell"])
    coarse = probes.where(F.col("level") >= FIRST_COARSE_LEVEL).join(
        F.broadcast(counts.where(F.col("level") >= FIRST_COARSE_LEVEL)), ["level", "_cell"]
    )
    nearest_first = Window.partitionBy(key, "level").orderBy("bound", "_cell").rowsBetween(Window.unboundedPreceding, 0)
    served = (
        fine.unionByName(coarse)
        .withColumn("bound", _box_km(F.col("query_lat"), F.col("query_lon"))[1])
        .withColumn("held", F.sum("n").over(nearest_first))
        .where(F.col("held") >= k)
        .groupBy(key)
        .agg(F.min("bound").alias("radius"))
    )
    # Cells at least a quarter of the radius wide keep every cover under about a hundred cells.
    level = F.coalesce(
        *[F.when(F.col("radius") <= 4 * e, F.lit(i)) for i, e in enumerate(SEARCH_EDGES_KM)], F.lit(top)
    )
    edge_of = F.element_at(F.array(*[F.lit(float(e)) for e in SEARCH_EDGES_KM]), F.col("level") + 1)
    return (
        points.join(served, key, "left")
        .withColumn("radius", F.coalesce("radius", F.lit(HALF_TURN_KM + 1.0)))
        .withColumn("level", level)
        .withColumn("edge", edge_of)
    )


def nearest_join(
    points: DataFrame,
    places: DataFrame,
    k: int,
    *,
    key: str = "query_id",
    place_id: str = "station_id",
    lat: str = "latitude",
    lon: str = "longitude",
    distance: str = "distance_km",
) -> DataFrame:
    """The ``k`` nearest places of every point (ties by ``place_id``), exact and without comparing all pairs.

    ``points`` needs ``query_lat``/``query_lon`` and a unique ``key``. Places that share one coordinate are thinned to
    the ``k`` that can win the tie before anything is joined, so a pile of copies costs ``k`` rows.
    """
    located = places.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(place_id, lat, lon)
    located = top_k(located, [lat, lon], [F.col(place_id).asc()], k)
    targets = _search_radius(points.select(key, "query_lat", "query_lon"), located, k, key, lat, lon)
    covered = dealt(targets).withColumn(
        "_cell", F.explode(circle_cells(F.col("query_lat"), F.col("query_lon"), F.col("radius"), F.col("edge")))
    )
    wanted = covered.select("level", "_cell").distinct()
    leveled = (
        located.withColumn("_l", F.explode(_levels(SEARCH_EDGES_KM)))
        .select(place_id, lat, lon, F.col("_l.level").alias("level"), cell_of(F.col(lat), F.col(lon), F.col("_l.edge")).alias("_cell"))
        .hint("merge")
        .join(wanted, ["level", "_cell"], "left_semi")
    )
    pairs = (
        join_cells(covered, leveled, ["level", "_cell"])
        .withColumn(distance, haversine_km("query_lat", "query_lon", lat, lon))
        .where(F.col(distance) <= F.col("radius"))
        .select(key, place_id, distance)
    )
    found = top_k(pairs, [key], [F.col(distance).asc(), F.col(place_id).asc()], k)
    return points.join(found, key).join(places, place_id).select(*points.columns, *places.columns, distance)


def radius_extremes(
    points: DataFrame,
    places: DataFrame,
    radius_km: float,
    k: int,
    value: Callable[[Column, Column], Column],
    *,
    highest: bool = False,
    limits: DataFrame | None = None,
    ties: str | None = None,
    key: str = "query_id",
    price: str = "price",
    lat: str = "latitude",
    lon: str = "longitude",
    distance: str = "distance_km",
) -> DataFrame:
    """Of the pairs of ``radius_join``, those that may be among the ``k`` of lowest (highest) value per ``key``, ties included.

    ``value(price, distance)`` must not fall as either grows. Each cell ranks its places by price in blocks of 1, 2, 4, ...
    A cell that lies wholly inside the circle and holds ``k`` places proves a limit that the ``k``-th value cannot pass;
    the best over all such cells says from which blocks places can still matter, and no others are joined. So a query
    meets some multiple of ``k`` places, however many its circle holds. ``limits`` (``key``, ``_limit``) gives the limits
    instead; a query without one meets its whole circle.

    For the highest of all (``k`` 1), a cell proves the value of its dearest place too, if that is in the circle: the value
    grows outward, where cells reach over the circle's edge. ``ties`` names the column whose lowest ``k`` win among
    places of one coordinate and price; others there are left out, so a pile of copies costs ``k`` rows.
    """
    edge = F.lit(float(max(radius_km / 4, MIN_EDGE_KM)))
    _suffix_free(points, [distance, "_cell", "_limit"])
    block = lambda rank: F.floor(F.log2(rank)).cast("int")
    first = Window.partitionBy("_cell").orderBy(F.col(price).desc() if highest else F.col(price).asc())
    located = places.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    if ties:
        located = top_k(located, [lat, lon, price], [F.col(ties).asc()], k)
    ranked = (
        located.withColumn("_cell", cell_of(F.col(lat), F.col(lon), edge))
        .withColumn("_rank", F.row_number().over(first))
        .withColumn("_block", block(F.col("_rank")))
    )
    leads = (F.col("_rank") == 1) | (block(F.col("_rank") - 1) < F.col("_block"))
    cells = ranked.groupBy("_cell").agg(
        *_box_of(lat, lon),
        F.min(F.when(F.col("_rank") == k, F.col(price))).alias("_kth"),
        (F.max if highest else F.min)(price).alias("_best"),
        *[F.min(F.when(F.col("_rank") == 1, F.col(c))).alias(f"_top_{c}") for c in (lat, lon)],
        F.collect_list(F.when(leads, F.struct(F.col("_block").alias("block"), F.col(price).alias("price")))).alias("_blocks"),
    )
    covered = dealt(points).withColumn(
        "_cell", F.explode(circle_cells(F.col("query_lat"), F.col("query_lon"), F.lit(float(radius_km)), edge))
    )
    near, far = _box_km(F.col("query_lat"), F.col("query_lon"))
    probes = (
        join_cells(covered, cells)
        .withColumns({"_near": near, "_far": far})
        .where(F.col("_near") <= radius_km)
        .drop("s", "t", "w", "e")
    )
    if limits is not None:
        limited = probes.join(limits.select(key, "_limit"), key, "left")
    else:
        inside = F.when(F.col("_far") <= radius_km, value(F.col("_kth"), F.col("_near" if highest else "_far")))
        if highest and k == 1:
            top_km = haversine_km("query_lat", "query_lon", f"_top_{lat}", f"_top_{lon}")
            inside = F.greatest(inside, F.when(top_km <= radius_km - 1e-6, value(F.col("_kth"), F.greatest(F.lit(0.0), top_km - 1e-6))))
        limited = probes.withColumn("_limit", (F.max if highest else F.min)(inside).over(Window.partitionBy(key)))
    within = lambda v: F.col("_limit").isNull() | (v >= F.col("_limit") if highest else v <= F.col("_limit"))
    best_km = F.least(F.col("_far"), F.lit(float(radius_km))) if highest else F.col("_near")
    # The cell's best price alone rules out most cells, before any look at blocks.
    wanted = limited.withColumn("_best_km", best_km).where(within(value(F.col("_best"), F.col("_best_km")))).select(
        *points.columns,
        "_cell",
        "_limit",
        F.explode(F.filter("_blocks", lambda b: within(value(b["price"], F.col("_best_km"))))["block"]).alias("_block"),
    )
    return (
        join_cells(wanted, ranked.drop("_rank"), ["_cell", "_block"], parts=True)
        .where(F.abs(F.col(lat) - F.col("query_lat")) <= radius_km / KM_PER_DEGREE + SLACK_DEGREES)
        .withColumn(distance, haversine_km("query_lat", "query_lon", lat, lon))
        .where((F.col(distance) <= radius_km) & within(value(F.col(price), F.col(distance))))
        .select(*points.columns, *places.columns, distance)
    )


# ------------------------------------------------------------------------------------------------- polygons


def ring_sides(ring: Column) -> Column:
    """``[[lon, lat], ...]`` -> array of sides, each vertex with the one before it (the first with the last)."""
    size = F.size(ring)
    previous = F.concat(F.slice(ring, size, 1), F.slice(ring, 1, F.greatest(size - 1, F.lit(0))))
    return F.zip_with(
        ring,
        previous,
        lambda p, q: F.struct(p[0].alias("x1"), p[1].alias("y1"), q[0].alias("x2"), q[1].alias("y2")),
    )


def _reaches_row(side: Column, row: Column, edge_km: Column) -> Column:
    south = row * _step(edge_km) - 90
    low, high = F.least(side["y1"], side["y2"]), F.greatest(side["y1"], side["y2"])
    return (low <= south + _step(edge_km) + SLACK_DEGREES) & (high >= south - SLACK_DEGREES)


def inside_ring(lat: Column, lon: Column, sides: Column) -> Column:
    """Even-odd rule: a ray to the east crosses the boundary an odd number of times."""

    def crosses(s: Column) -> Column:
        straddles = (s["y1"] > lat) != (s["y2"] > lat)
        at = (s["x2"] - s["x1"]) * (lat - s["y1"]) / (s["y2"] - s["y1"]) + s["x1"]
        return F.when(straddles, lon < at).otherwise(False)

    return F.aggregate(sides, F.lit(False), lambda odd, s: odd != crosses(s))


def polygon_cells(polygons: DataFrame, edge_km: float = 25.0) -> DataFrame:
    """Polygons cut by grid cell: one row per ring and cell that holds any of it, without the ring.

    ``_whole`` marks cells that no side comes near and that lie inside; they need no test of their places, and cells
    outside that no side comes near are left out. All others keep the sides that a ray to the east from a place of
    theirs can meet: those that reach into the grid row and do not lie wholly west of the cell.
    """
    edge = F.lit(float(edge_km))
    xs = F.transform("ring", lambda p: p[0])
    ys = F.transform("ring", lambda p: p[1])

    def placed(cell: Column) -> Column:
        row = F.shiftright(cell, 32)
        width = 360 / _columns_in_row(row, edge)
        west = cell.bitwiseAND(F.lit(2**32 - 1)) * width - 180
        return F.struct(cell.alias("cell"), row.alias("row"), west.alias("west"), (west + width).alias("east"))

    # Exploding makes columns of the bounds, which the functions over sides would else work out again for every side.
    cut = (
        polygons.withColumns(
            {
                "_sides": ring_sides(F.col("ring")),
                "_south": F.array_min(ys),
                "_north": F.array_max(ys),
                "_west": F.array_min(xs),
                "_east": F.array_max(xs),
            }
        )
        .drop("ring")
        .withColumn(
            "_at", F.explode(F.transform(_box_cells(F.col("_south"), F.col("_north"), F.col("_west"), F.col("_east"), edge), placed))
        )
        .withColumn("_sides", F.filter("_sides", lambda s: _reaches_row(s, F.col("_at.row"), edge)))
    )
    # Rings beyond +-180 degrees reach a cell from both ends of the map; their cells are all tested.
    plain = (F.col("_west") >= -180) & (F.col("_east") <= 180)
    not_west = lambda s: F.greatest(s["x1"], s["x2"]) >= F.col("_at.west") - SLACK_DEGREES
    near = F.exists("_sides", lambda s: not_west(s) & (F.least(s["x1"], s["x2"]) <= F.col("_at.east") + SLACK_DEGREES))
    inside = inside_ring((F.col("_at.row") + 0.5) * _step(edge) - 90, (F.col("_at.west") + F.col("_at.east")) / 2, F.col("_sides"))
    kept = (
        F.when(~plain, F.array(F.struct(F.lit(False).alias("whole"), F.col("_sides").alias("sides"))))
        .when(near, F.array(F.struct(F.lit(False).alias("whole"), F.filter("_sides", not_west).alias("sides"))))
        .when(inside, F.array(F.struct(F.lit(True).alias("whole"), F.slice("_sides", 1, 0).alias("sides"))))
    )
    columns = [c for c in cut.columns if c not in ("_sides", "_at")]
    return cut.withColumn("_kept", F.explode(kept)).select(
        *columns, F.col("_at.cell").alias("_cell"), F.col("_kept.whole").alias("_whole"), F.col("_kept.sides").alias("_sides")
    )


def containment_join(
    places: DataFrame,
    polygons: DataFrame,
    *,
    edge_km: float = 25.0,
    lat: str = "latitude",
    lon: str = "longitude",
) -> DataFrame:
    """All (place, feature) pairs where an outer ring of the feature holds the place; holes are not looked at.

    ``polygons`` has one row per outer ring: ``feature_idx``, ``name``, ``ring``. A place inside several rings of one
    feature comes once per ring. Rays are cast in cells on a boundary alone.
    """
    shapes = polygon_cells(polygons.select("feature_idx", "name", "ring"), edge_km)
    located = places.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumn(
        "_cell", cell_of(F.col(lat), F.col(lon), F.lit(float(edge_km)))
    )
    in_box = F.col(lat).between(F.col("_south"), F.col("_north")) & F.col(lon).between(F.col("_west"), F.col("_east"))
    return (
        located.join(shapes, "_cell")
        .where(in_box & (F.col("_whole") | inside_ring(F.col(lat), F.col(lon), F.col("_sides"))))
        .drop("_cell", "_sides", "_whole", "_south", "_north", "_west", "_east")
    )


def assign_features(places: DataFrame, polygons: DataFrame, place_id: str = "station_id", carry: Sequence[str] = ()) -> DataFrame:
    """Every contained place with the first feature (lowest ``feature_idx``) that holds it."""
    pairs = containment_join(places, polygons)
    first = F.min(F.struct("feature_idx", "name", *carry)).alias("_first")
    return pairs.groupBy(place_id).agg(first).select(place_id, "_first.*")
