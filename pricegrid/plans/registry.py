"""Every operator as a runnable query over the given tables, with the checking SQL where one can be written.

The SQL is written from the definitions of the measures, in the plain one-combination-at-a-time form, not derived from
the Spark plans. Fractions that an operator leaves unrounded are rounded for comparison; the tiny offset moves
exact rounding ties to the same side on both engines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrid import schema as S
from pricegrid.functions import columns as C
from pricegrid.operators import brands, distinct, forecast, normalize, quality, rankings, rollups, search, spatial, trends, trips, zones
from pricegrid.operators.melt import melt_prices
from pricegrid.plans import adapters as A
from pricegrid.plans import jobs
from pricegrid.sources import geojson, landing, sinks, versions
from pricegrid.streaming import freshness, refresh

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + 1e-9, d) for c, d in digits.items()})


def rnd(expr: str, digits: int = 6) -> str:
    return f"round({expr} + 1e-9, {digits})"


TREND_DIGITS = {"avg_price": 6, "min_price": 6, "max_price": 6}
FUELS = A.OBSERVED_FUELS
GEOS = ["zip_code", "locality", "municipality"]
BRANDS = ["repsol", "ballenoil", "shell recharge"]


def with_ctes(*ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} {body}"


def melt_sql(source: str, ids: str, fuels, where: str = "price > 0", price: str = "{f}") -> str:
    one = [f"SELECT {ids}, '{f}' AS fuel_type, {f} AS price FROM {source}" for f in fuels]
    return f"(SELECT * FROM ({' UNION ALL '.join(one)}) WHERE {where})"


def stats_sql(source: str, keys: str, fuels=FUELS, not_null: str = "true", having: str = "true") -> str:
    return (
        f'SELECT dt AS "date", {keys}, fuel_type, round(avg(price), 4) AS avg_price, round(min(price), 4) AS min_price, '
        f"round(max(price), 4) AS max_price, count(*) AS station_count FROM {melt_sql(source, 'dt, ' + keys, fuels)} "
        f"WHERE {not_null} GROUP BY ALL HAVING {having}"
    )


NORMAL_BRAND = (
    "CASE WHEN regexp_matches(label, '^(n\\.?[ºo°.]?\\s*\\d|\\d{3,}|estacion\\s+n|e\\.?\\s*s\\.?\\s*\\d)', 'i') THEN NULL "
    "WHEN label = 'bp oil' THEN 'bp' WHEN label = 'shell recharge' THEN 'shell' ELSE label END"
)
PROVINCE_STATS = stats_sql("e", "province", not_null="province IS NOT NULL")
ZIP_STATS = stats_sql("e", "zip_code, province", not_null="province IS NOT NULL AND zip_code IS NOT NULL")
BRAND_STATS = stats_sql(
    f"(SELECT *, {NORMAL_BRAND} AS brand FROM e)", "brand", not_null="brand IS NOT NULL", having="count(*) >= 10"
)

# ================================================================================== ingest
# A landed document per 100 stations; some are rejected. Local times turn into UTC by the summer-time rule.
_DOC = "c_custkey // 100"
_DOC_SPARK = "floor(c_custkey / 100)"


def _document_texts(spark, sf_dir) -> DataFrame:
    fields = {
        "C.P.": "lpad(cast(c_custkey % 100 as string), 5, '0')",
        "IDEESS": "cast(c_custkey as string)",
        "Rótulo": "concat('  ', c_mktsegment, ' ')",
        "Latitud": "replace(cast(cast(c_custkey % 50 as double) / 2 as string), '.', ',')",
        "Precio Gasoleo A": "case when c_custkey % 9 = 0 then '' when c_custkey % 9 = 1 then 'n/a' else replace(cast(c_acctbal as string), '.', ',') end",
        "Horario": "'L-D: 24H'",
    }
    station = F.struct(*[F.expr(e).alias(k) for k, e in fields.items()]).alias("station")
    rows = A.table(spark, sf_dir, "customer").select(F.expr(_DOC_SPARK).alias("doc_id"), station)
    docs = rows.groupBy("doc_id").agg(F.collect_list("station").alias("ListaEESSPrecio"))  # 100 stations at most, by construction
    local = (
        "case when doc_id % 7 = 5 then '2024-01-01' else concat(lpad(cast(1 + doc_id % 25 as string), 2, '0'), '/', "
        "lpad(cast(1 + doc_id % 12 as string), 2, '0'), '/2024 10:30:00') end"
    )
    status = F.expr("case when doc_id % 7 = 3 then 'ERROR' else 'OK' end")
    document = F.to_json(F.struct(status.alias("ResultadoConsulta"), F.expr(local).alias("Fecha"), "ListaEESSPrecio"))
    return docs.select("doc_id", document.alias("document"))


def _raw_documents(spark, sf_dir) -> DataFrame:
    return landing.parse_documents(_document_texts(spark, sf_dir))


@query(
    "raw_documents_normalized",
    f"""SELECT c_custkey // 100 AS doc_id,
  concat('2024-', lpad(cast(1 + {_DOC} % 12 as string), 2, '0'), '-', lpad(cast(1 + {_DOC} % 25 as string), 2, '0'),
         case when 1 + {_DOC} % 12 between 4 and 10 then 'T08:30:00+00:00' else 'T09:30:00+00:00' end) AS "timestamp",
  lpad(cast(c_custkey % 100 as string), 5, '0') AS zip_code, cast(c_custkey as string) AS eess_id, lower(c_mktsegment) AS label,
  cast(c_custkey % 50 as double) / 2 AS latitude,
  case when c_custkey % 9 < 2 then null else c_acctbal end AS diesel_a_price, cast(null as double) AS hydrogen_price
FROM customer WHERE {_DOC} % 7 NOT IN (3, 5)""",
)
def _(spark, sf_dir):
    rows = normalize.normalize_documents(_raw_documents(spark, sf_dir), keep=["doc_id"])
    return rows.select("doc_id", "timestamp", "zip_code", "eess_id", "label", "latitude", "diesel_a_price", "hydrogen_price")


@query(
    "document_files",
    f"""SELECT {_DOC} AS doc_id, count(*) AS stations, CAST(sum(c_custkey) AS BIGINT) AS ids FROM customer WHERE {_DOC} % 7 NOT IN (3, 5) GROUP BY ALL""",
)
def _(spark, sf_dir):
    """Documents as landed files, several to a file, read back."""
    root = A.scratch(spark, "documents")
    texts = _document_texts(spark, sf_dir)
    # Files of at most 50 documents, so that their number grows and not their size.
    merged = texts.groupBy(F.floor(F.col("doc_id") / 50).alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("document"), ","), F.lit("]")).alias("value"))
    merged.write.partitionBy("part").text(root)
    rows = normalize.normalize_documents(landing.read_documents(spark, f"{root}/part=*"))
    doc = F.floor(F.col("eess_id").cast("long") / 100)
    return rows.groupBy(doc.alias("doc_id")).agg(F.count("*").alias("stations"), F.sum(F.col("eess_id").cast("long")).alias("ids"))


@query(
    "rejected_documents",
    f"""SELECT DISTINCT {_DOC} AS doc_id, case when {_DOC} % 7 = 3 then 'status' else 'bad_time' end AS reason
FROM customer WHERE {_DOC} % 7 IN (3, 5)""",
)
def _(spark, sf_dir):
    return normalize.split_documents(_raw_documents(spark, sf_dir))[1].select("doc_id", "reason")


@query(
    "quarantined_documents",
    f"""SELECT doc_id, case when doc_id % 7 IN (1, 4) then 'unreadable' when doc_id % 7 = 3 then 'status' else 'bad_time' end AS reason,
  true AS text_kept, case when doc_id % 7 IN (1, 4) then n end AS stations
FROM (SELECT {_DOC} AS doc_id, count(*) AS n FROM customer GROUP BY ALL) WHERE doc_id % 7 IN (1, 3, 4, 5)""",
)
def _(spark, sf_dir):
    """Documents of which some are cut off or of wrong types: what is rejected, and its stations once the text is repaired."""
    whole = _document_texts(spark, sf_dir)
    cut = F.when(F.col("doc_id") % 7 == 1, F.expr("left(document, length(document) div 2)"))
    landed = whole.withColumn("document", cut.when(F.col("doc_id") % 7 == 4, '{"ResultadoConsulta": "OK", "ListaEESSPrecio": 5}').otherwise(F.col("document")))
    rejected = normalize.sort_out(landed)[1].withColumn("text_kept", F.length("document") > 0).drop("document")
    replayed, _ = normalize.sort_out(rejected.select("doc_id").join(whole, "doc_id"))
    repaired = replayed.select("doc_id", F.size("ListaEESSPrecio").cast("long").alias("stations"))
    return rejected.join(repaired, "doc_id", "left").select("doc_id", "reason", "text_kept", "stations")


@query("public_sale_stations", with_ctes(A.STATION_SQL, body="SELECT station_id, label FROM s WHERE sale_type = 'p'"))
def _(spark, sf_dir):
    return normalize.public_sale(A.stations(spark, sf_dir)).select("station_id", "label")


@query(
    "csv_history_to_parquet",
    with_ctes(
        A.OBSERVATION_SQL,
        body=f'SELECT "timestamp", label, province, {rnd("diesel_a_price", 9)} AS diesel_a_price, count(*) AS n FROM e GROUP BY ALL',
    ),
)
def _(spark, sf_dir):
    source, target = A.scratch(spark, "csv"), A.scratch(spark, "parquet")
    rows = A.observations(spark, sf_dir)
    full = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(S.SNAPSHOT_SCHEMA[c].dataType).alias(c) for c in S.SNAPSHOT_COLUMNS])
    full.write.option("header", True).csv(source)
    landing.read_csv_history(spark, source).write.parquet(target)
    return rounded(landing.read_snapshots(spark, target), diesel_a_price=9).groupBy("timestamp", "label", "province", "diesel_a_price").agg(
        F.count("*").alias("n")
    )


@query(
    "snapshot_store_range",
    with_ctes(
        A.OBSERVATION_SQL,
        body="SELECT dt, zip_code, count(*) AS n FROM e WHERE dt BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY ALL",
    ),
)
def _(spark, sf_dir):
    root = A.scratch(spark, "landing")
    landing.write_snapshot(A.observations(spark, sf_dir).drop("hydrogen_price"), root)
    return landing.read_days(spark, root, "2024-01-05", "2024-01-20").groupBy("dt", "zip_code").agg(F.count("*").alias("n"))


# The file catalogue of the landing area: one file per hourly snapshot.
_FILES_SQL = (
    "files AS (SELECT concat('snapshot_', replace(\"timestamp\", ':', '-'), '.parquet') AS file_name, count(*) AS size_bytes, "
    'dt AS "day" FROM e GROUP BY ALL)'
)


def _files(spark, sf_dir) -> DataFrame:
    named = F.concat(F.lit("snapshot_"), F.replace("timestamp", F.lit(":"), F.lit("-")), F.lit(".parquet"))
    rows = A.observations(spark, sf_dir)
    return rows.groupBy(named.alias("file_name"), F.to_date("timestamp").alias("day")).agg(F.count("*").alias("size_bytes"))


@query(
    "files_between",
    with_ctes(A.OBSERVATION_SQL, _FILES_SQL, body="SELECT * FROM files WHERE \"day\" BETWEEN DATE '2024-01-13' AND DATE '2024-01-20'"),
)
def _(spark, sf_dir):
    return landing.files_between(_files(spark, sf_dir), days_back=7, as_of="2024-01-20")


@query(
    "latest_file_per_day",
    with_ctes(
        A.OBSERVATION_SQL,
        _FILES_SQL,
        body='SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY "day" ORDER BY file_name DESC) = 1',
    ),
)
def _(spark, sf_dir):
    return landing.latest_file_per_day(_files(spark, sf_dir))


@query(
    "most_recent_days",
    with_ctes(A.OBSERVATION_SQL, _FILES_SQL, body='SELECT * FROM files QUALIFY dense_rank() OVER (ORDER BY "day" DESC) <= 5'),
)
def _(spark, sf_dir):
    return landing.most_recent_days(_files(spark, sf_dir), 5)


@query(
    "latest_file_lookback",
    with_ctes(
        A.OBSERVATION_SQL,
        _FILES_SQL,
        body="(SELECT 'recent' AS \"case\", * FROM files WHERE \"day\" BETWEEN DATE '2024-01-08' AND DATE '2024-01-10' ORDER BY file_name DESC LIMIT 1) "
        "UNION ALL (SELECT 'fallback' AS \"case\", * FROM files ORDER BY file_name DESC LIMIT 1)",
    ),
)
def _(spark, sf_dir):
    files = _files(spark, sf_dir)
    recent = landing.latest_file(files, as_of="2024-01-10").withColumn("case", F.lit("recent"))
    return recent.unionByName(landing.latest_file(files, as_of="2025-01-01").withColumn("case", F.lit("fallback")))


@query(
    "stored_files",
    with_ctes(A.OBSERVATION_SQL, body='SELECT dt AS "day", 1 AS files, true AS named, true AS sized FROM e GROUP BY dt'),
)
def _(spark, sf_dir):
    root = A.scratch(spark, "landing")
    # One file a day, each written by the task that gets the day.
    rows = A.observations(spark, sf_dir).drop("hydrogen_price")
    landing.write_snapshot(rows.repartition(F.to_date("timestamp")), root)
    listed = landing.list_files(spark, root)
    named, sized = F.bool_and(F.col("file_name").endswith(".snappy.parquet")), F.bool_and(F.col("size_bytes") > 0)
    return listed.groupBy("day").agg(F.count("*").cast("int").alias("files"), named.alias("named"), sized.alias("sized"))


@query(
    "stored_files_pruned",
    with_ctes(
        A.OBSERVATION_SQL,
        "d AS (SELECT DISTINCT dt FROM e)",
        body="SELECT 'recent' AS \"case\", dt AS \"day\", 1 AS files FROM d WHERE dt = (SELECT max(dt) FROM d WHERE dt BETWEEN DATE '2024-01-08' AND DATE '2024-01-10') "
        "UNION ALL SELECT 'fallback' AS \"case\", max(dt) AS \"day\", 1 AS files FROM d "
        "UNION ALL (SELECT 'last days' AS \"case\", dt AS \"day\", 1 AS files FROM d ORDER BY dt DESC LIMIT 4) "
        "UNION ALL SELECT 'asked' AS \"case\", dt AS \"day\", 1 AS files FROM d WHERE dt IN (DATE '2024-01-03', DATE '2024-01-05')",
    ),
)
def _(spark, sf_dir):
    """The newest stored file within a look-back and beyond it, the last days and days by name, by their folders alone."""
    root = A.scratch(spark, "landing")
    rows = A.observations(spark, sf_dir).drop("hydrogen_price")
    landing.write_snapshot(rows.repartition(F.to_date("timestamp")), root)
    cases = {
        "recent": landing.latest_stored_file(spark, root, as_of="2024-01-10"),
        "fallback": landing.latest_stored_file(spark, root, as_of="2025-01-01"),
        "last days": landing.recent_stored_files(spark, root, 4),
        "asked": landing.list_days(spark, root, ["2024-01-03", "2024-01-05", "2030-01-01"]),
    }
    counted = [f.groupBy("day").agg(F.count("*").cast("int").alias("files")).withColumn("case", F.lit(c)) for c, f in cases.items()]
    return reduce(DataFrame.unionByName, counted)


@query(
    "snapshots_of_two_layouts",
    with_ctes(
        A.OBSERVATION_SQL,
        body=f"SELECT zip_code, dt < DATE '2024-01-15' AS older, count(*) AS n, count(diesel_a_price) AS priced, "
        f"count(CASE WHEN dt >= DATE '2024-01-15' THEN label END) AS labelled FROM e GROUP BY ALL",
    ),
)
def _(spark, sf_dir):
    """History whose older files lack a column, joined by column name."""
    root = A.scratch(spark, "layouts")
    rows = A.observations(spark, sf_dir).select("timestamp", "zip_code", "label", "diesel_a_price")
    older = F.to_date("timestamp") < F.lit("2024-01-15").cast("date")
    rows.where(older).drop("label").write.parquet(f"{root}/layout=1")
    rows.where(~older).select("diesel_a_price", "label", "zip_code", "timestamp").write.parquet(f"{root}/layout=2")
    read = landing.read_snapshots(spark, f"{root}/layout=*", merge=True)
    return read.groupBy("zip_code", older.alias("older")).agg(
        F.count("*").alias("n"), F.count("diesel_a_price").alias("priced"), F.count("label").alias("labelled")
    )


@query(
    "latest_timestamp",
    with_ctes(A.OBSERVATION_SQL, body='SELECT max("timestamp") AS latest_timestamp FROM e'),
)
def _(spark, sf_dir):
    return landing.latest_timestamp(A.observations(spark, sf_dir))


@query(
    "prefer_live_snapshot",
    with_ctes(
        A.OBSERVATION_SQL,
        body="SELECT 'fresh' AS \"case\", 'live' AS source, zip_code, count(*) AS n FROM e WHERE dt = (SELECT max(dt) FROM e) GROUP BY ALL "
        "UNION ALL SELECT 'expired' AS \"case\", 'stored' AS source, zip_code, count(*) AS n FROM e WHERE dt < (SELECT max(dt) FROM e) GROUP BY ALL",
    ),
)
def _(spark, sf_dir):
    rows = A.observations(spark, sf_dir)
    last_day = rows.agg(F.max(F.to_date("timestamp"))).scalar()
    live = rows.where(F.to_date("timestamp") == last_day).withColumn("source", F.lit("live"))
    stored = rows.where(F.to_date("timestamp") < last_day).withColumn("source", F.lit("stored"))

    def case(name: str, as_of: str) -> DataFrame:
        chosen = landing.prefer_live(live, stored, as_of)
        return chosen.groupBy("source", "zip_code").agg(F.count("*").alias("n")).withColumn("case", F.lit(name))

    return case("fresh", "2024-01-30 23:15:00").unionByName(case("expired", "2024-02-01 00:00:00"))


@query(
    "legacy_zip_rollup_upcast",
    with_ctes(
        A.ZIP_HISTORY_SQL,
        body='SELECT "date", zip_code, cast(null as string) AS province, fuel_type, ' + rnd("avg_price") + " AS avg_price, station_count FROM hz",
    ),
)
def _(spark, sf_dir):
    legacy = A.zip_history(spark, sf_dir).drop("province")
    upcast = trends.with_province_column(legacy)
    return rounded(upcast.select("date", "zip_code", "province", "fuel_type", "avg_price", "station_count"), avg_price=6)


@query(
    "merge_days_with_retention",
    with_ctes(
        A.PROVINCE_HISTORY_SQL,
        body="SELECT \"date\", province, fuel_type, CASE WHEN \"date\" >= DATE '2001-05-21' THEN station_count * 2 ELSE station_count END AS station_count "
        "FROM hp WHERE \"date\" >= (SELECT max(\"date\") FROM hp) - 364",
    ),
)
def _(spark, sf_dir):
    history = A.province_history(spark, sf_dir).select("date", "province", "fuel_type", "station_count")
    existing = history.where("date <= '2001-05-25'")
    new = history.where("date >= '2001-05-21'").withColumn("station_count", F.col("station_count") * 2)
    return sinks.merge_days(existing, new, retention_days=365)


@query(
    "replace_days_sink",
    with_ctes(
        A.PROVINCE_HISTORY_SQL,
        body="SELECT \"date\", province, fuel_type, CASE WHEN \"date\" >= DATE '2001-07-01' THEN station_count * 2 ELSE station_count END AS station_count "
        "FROM hp WHERE \"date\" >= (SELECT max(\"date\") FROM hp) - 364",
    ),
)
def _(spark, sf_dir):
    path = A.scratch(spark, "rollup")
    history = A.province_history(spark, sf_dir).select("date", "province", "fuel_type", "station_count")
    sinks.replace_days(history, path)
    for _again in range(2):  # the second run must not change anything
        late = history.where("date >= '2001-07-01'").withColumn("station_count", F.col("station_count") * 2)
        sinks.replace_days(late, path, retention_days=365)
    return spark.read.parquet(path).select("date", "province", "fuel_type", "station_count")


@query(
    "versioned_days",
    with_ctes(
        A.PROVINCE_HISTORY_SQL,
        body="SELECT 'newest' AS \"version\", \"date\", province, fuel_type, CASE WHEN \"date\" >= DATE '2001-07-01' THEN station_count * 2 ELSE station_count END "
        "AS station_count FROM hp WHERE \"date\" >= (SELECT max(\"date\") FROM hp) - 364 "
        "UNION ALL SELECT 'first', \"date\", province, fuel_type, station_count FROM hp",
    ),
)
def _(spark, sf_dir):
    """Days replaced in one commit; the version before can still be read as it was."""
    path = A.scratch(spark, "versioned")
    history = A.province_history(spark, sf_dir).select("date", "province", "fuel_type", "station_count")
    versions.commit(history, path)
    late = history.where("date >= '2001-07-01'").withColumn("station_count", F.col("station_count") * 2)
    for _again in range(2):
        versions.commit(late, path, retention_days=365)
    versions.vacuum(spark, path, keep=3)
    read = lambda version, name: versions.read(spark, path, history.schema, version).withColumn("version", F.lit(name))
    return read(None, "newest").unionByName(read(0, "first"))


# ================================================================================== rollups


@query("province_daily_stats", with_ctes(A.OBSERVATION_SQL, body=PROVINCE_STATS))
def _(spark, sf_dir):
    return rollups.province_daily_stats(A.observations(spark, sf_dir))


@query("zip_daily_stats", with_ctes(A.OBSERVATION_SQL, body=ZIP_STATS))
def _(spark, sf_dir):
    return rollups.zip_daily_stats(A.observations(spark, sf_dir))


@query("brand_daily_stats", with_ctes(A.OBSERVATION_SQL, body=BRAND_STATS))
def _(spark, sf_dir):
    return rollups.brand_daily_stats(A.observations(spark, sf_dir))


_INGESTION_SQL = """SELECT dt AS "date", count(*) AS record_count, count(DISTINCT eess_id) AS unique_stations,
  count(DISTINCT label) AS unique_station_labels, count(DISTINCT province) AS unique_provinces,
  count(DISTINCT municipality_id) AS unique_municipalities, count(DISTINCT municipality) AS unique_municipality_names,
  count(DISTINCT CASE WHEN locality IS NOT NULL THEN concat_ws('|', province_id, municipality_id, locality) END) AS unique_localities,
  count(DISTINCT locality) AS unique_locality_names, count(DISTINCT ccaa_id) AS unique_communities,
  CAST(max(CASE WHEN diesel_a_price IS NOT NULL THEN 1 ELSE 0 END) + max(CASE WHEN gasoline_95_e5_price IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT)
    AS unique_fuel_types FROM e GROUP BY dt"""


@query("daily_ingestion_stats", with_ctes(A.OBSERVATION_SQL, body=_INGESTION_SQL))
def _(spark, sf_dir):
    return rollups.daily_ingestion_stats(A.observations(spark, sf_dir))


def _weekday_sql(days: str) -> str:
    return (
        'SELECT CAST(isodow("date") - 1 AS INTEGER) AS day_of_week, fuel_type, province, round(sum(avg_price), 6) AS sum_price, '
        'count(DISTINCT "date") AS count_days, round(min(avg_price), 4) AS min_daily_avg, round(max(avg_price), 4) AS max_daily_avg '
        f"FROM ({days}) GROUP BY ALL"
    )


def _weekday_from_rows(where: str = "true") -> str:
    long = melt_sql(f"(SELECT * FROM e WHERE {where})", "dt, province", FUELS)
    return _weekday_sql(
        f'SELECT dt AS "date", fuel_type, province, avg(price) AS avg_price FROM {long} WHERE province IS NOT NULL GROUP BY ALL '
        f"UNION ALL SELECT dt AS \"date\", fuel_type, '__national__', avg(price) FROM {long} GROUP BY ALL"
    )


_WEEKDAY_FROM_DAILY = _weekday_sql(
    'SELECT "date", fuel_type, province, avg_price FROM hp UNION ALL '
    "SELECT \"date\", fuel_type, '__national__', sum(avg_price * station_count) / sum(station_count) FROM hp GROUP BY ALL"
)


_FIRST_DAYS = _weekday_from_rows("dt <= DATE '2024-01-12'")
_OTHER_DAYS = _weekday_from_rows("dt > DATE '2024-01-12'")


@query("weekday_stats_from_snapshots", with_ctes(A.OBSERVATION_SQL, body=_weekday_from_rows()))
def _(spark, sf_dir):
    return rollups.weekday_stats_from_snapshots(A.observations(spark, sf_dir))


@query("weekday_stats_from_daily", with_ctes(A.PROVINCE_HISTORY_SQL, body=_WEEKDAY_FROM_DAILY))
def _(spark, sf_dir):
    return rollups.weekday_stats_from_daily(A.province_history(spark, sf_dir))


@query(
    "weekday_stats_merged",
    with_ctes(
        A.OBSERVATION_SQL,
        body="SELECT day_of_week, fuel_type, province, round(sum(sum_price), 6) AS sum_price, CAST(sum(count_days) AS BIGINT) AS count_days, "
        "min(min_daily_avg) AS min_daily_avg, max(max_daily_avg) AS max_daily_avg FROM "
        f"({_FIRST_DAYS} UNION ALL {_OTHER_DAYS}) GROUP BY ALL",
    ),
)
def _(spark, sf_dir):
    rows = A.observations(spark, sf_dir)
    parts = [rows.where(f"to_date(timestamp) {op} DATE'2024-01-12'") for op in ("<=", ">")]
    return rollups.merge_weekday_stats(*[rollups.weekday_stats_from_snapshots(p) for p in parts])


@query(
    "weekday_stats_revised",
    with_ctes(
        A.PROVINCE_HISTORY_SQL.replace("hp AS", "h AS", 1),
        "hp AS (SELECT \"date\", province, fuel_type, CASE WHEN \"date\" >= DATE '2001-05-21' THEN round(avg_price * 1.5, 4) ELSE avg_price END AS avg_price, "
        "station_count FROM (SELECT * REPLACE (round(avg_price, 4) AS avg_price) FROM h) WHERE \"date\" >= (SELECT max(\"date\") FROM h) - 1499)",
        body="SELECT day_of_week, fuel_type, province, round(sum_price, 4) AS sum_price, count_days, min_daily_avg, max_daily_avg FROM (" + _WEEKDAY_FROM_DAILY + ")",
    ),
)
def _(spark, sf_dir):
    """Weekday statistics that follow a rollup: late days, days that come again, and days that fall out of retention."""
    daily, path = A.scratch(spark, "daily"), A.scratch(spark, "weekdays")
    history = A.province_history(spark, sf_dir).select("date", "province", "fuel_type", F.round("avg_price", 4).alias("avg_price"), "station_count")
    early = history.where("date <= '2001-05-25'")
    late = history.where("date >= '2001-05-21'").withColumn("avg_price", F.round(F.col("avg_price") * 1.5, 4))
    for days, retention in ((early, None), (late, None), (late, 1500)):
        versions.commit(days, daily, retention_days=retention)
        jobs.follow_weekdays(spark, daily, path, history.schema)
    return sinks.read_published(spark, path).withColumn("sum_price", F.round("sum_price", 4))


_NEWEST = 'n AS (SELECT * FROM e QUALIFY "timestamp" = max("timestamp") OVER (PARTITION BY dt))'
_STATS_OF_N = {
    "province_daily_stats": ("province", stats_sql("n", "province", not_null="province IS NOT NULL")),
    "zip_code_daily_stats": ("concat_ws('|', zip_code, province)", stats_sql("n", "zip_code, province", not_null="province IS NOT NULL AND zip_code IS NOT NULL")),
    "brand_daily_stats": ("brand", BRAND_STATS.replace("FROM e)", "FROM n)")),
}
_ALL_ROLLUPS_SQL = (
    " UNION ALL ".join(
        f"SELECT '{task}' AS task, CAST(\"date\" AS VARCHAR) AS \"day\", {key} AS area, fuel_type, avg_price, min_price, max_price, station_count AS n FROM ({sql})"
        for task, (key, sql) in _STATS_OF_N.items()
    )
    + " UNION ALL SELECT 'daily_ingestion_stats', CAST(\"date\" AS VARCHAR), NULL, NULL, unique_stations, unique_provinces, unique_localities, record_count FROM ("
    + _INGESTION_SQL.replace("FROM e GROUP", "FROM n GROUP")
    + ") UNION ALL SELECT 'day_of_week_stats', CAST(isodow(\"date\") - 1 AS VARCHAR), province, fuel_type, "
    + "round(sum(avg_price), 4), NULL, NULL, count(*) FROM p GROUP BY ALL "
    + "UNION ALL SELECT 'day_of_week_stats', CAST(isodow(\"date\") - 1 AS VARCHAR), '__national__', fuel_type, round(sum(a), 4), NULL, NULL, count(*) FROM "
    + "(SELECT \"date\", fuel_type, sum(avg_price * station_count) / sum(station_count) AS a FROM p GROUP BY ALL) GROUP BY ALL"
)
_ROLLUP_CTES = (A.OBSERVATION_SQL, _NEWEST, f"p AS ({_STATS_OF_N['province_daily_stats'][1]})")


def _all_rollups(tables: dict[str, DataFrame]) -> DataFrame:
    """The five rollup tables in one shape, to be compared as a whole."""
    null = F.lit(None)
    shape = ["area", "fuel_type", "avg_price", "min_price", "max_price", "n"]

    def rows(task: str, day, *values) -> DataFrame:
        kinds = ["string", "string", "double", "double", "double", "long"]
        cells = [v.cast(k).alias(c) for v, k, c in zip(values, kinds, shape)]
        return tables[task].select(F.lit(task).alias("task"), day.cast("string").alias("day"), *cells)

    date, fuel, prices = F.col("date"), F.col("fuel_type"), [F.col(c) for c in ("avg_price", "min_price", "max_price", "station_count")]
    weekday = rows("day_of_week_stats", F.col("day_of_week"), F.col("province"), fuel, F.round("sum_price", 4), null, null, F.col("count_days"))
    counts = [F.col(c) for c in ("unique_stations", "unique_provinces", "unique_localities", "record_count")]
    return (
        rows("province_daily_stats", date, F.col("province"), fuel, *prices)
        .union(rows("zip_code_daily_stats", date, F.concat_ws("|", "zip_code", "province"), fuel, *prices))
        .union(rows("brand_daily_stats", date, F.col("brand"), fuel, *prices))
        .union(rows("daily_ingestion_stats", date, null, null, *counts))
        .union(weekday)
    )


@query("rollups_rebuilt_from_history", with_ctes(*_ROLLUP_CTES, body=_ALL_ROLLUPS_SQL))
def _(spark, sf_dir):
    return _all_rollups(jobs.rebuild(A.observations(spark, sf_dir)))


@query("daily_rollup_job", with_ctes(*_ROLLUP_CTES, body=_ALL_ROLLUPS_SQL))
def _(spark, sf_dir):
    root = A.scratch(spark, "rollups")
    jobs.run_daily_rollups(A.observations(spark, sf_dir), root)
    return _all_rollups(jobs.stored_rollups(spark, root))


_MONTHLY_ENTITIES_SQL = _INGESTION_SQL.replace("dt AS \"date\", count(*) AS record_count", "date_trunc('month', dt)::DATE AS period").replace("FROM e GROUP BY dt", "FROM n GROUP BY ALL")


@query(
    "monthly_entity_counts",
    with_ctes(A.OBSERVATION_SQL, _NEWEST, body=f"SELECT * EXCLUDE (unique_fuel_types) FROM ({_MONTHLY_ENTITIES_SQL})"),
)
def _(spark, sf_dir):
    """Distinct counts of months from the stored bitmaps of days, which have come in two parts, some days twice."""
    root, rows = A.scratch(spark, "entities"), A.observations(spark, sf_dir)
    for part in ("to_date(timestamp) <= DATE'2024-01-12'", "to_date(timestamp) >= DATE'2024-01-10'"):
        jobs.update_ingestion_states(rows.where(part), root)
    return distinct.counts_from_states(jobs.stored_states(spark, root), F.trunc("date", "month"))


# ================================================================================== brand reports


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _band(n: str = "count(*)") -> str:
    return f"CASE WHEN {n} >= 384 THEN 'high' WHEN {n} >= 100 THEN 'medium' ELSE 'low' END"


def comparison_sql(src: str, names, geos, fuels=FUELS, minimum: int = 10) -> str:
    parts = []
    for geo in geos:
        for fuel in fuels:
            base = f"(SELECT dt, {geo} AS g, label, {fuel} AS p FROM {src} WHERE {fuel} > 0)"
            parts.append(
                f"SELECT b.label AS brand, '{geo}' AS geo_level, b.g AS geo_value, '{fuel.removesuffix('_price')}' AS fuel_type, "
                "round(avg(b.p), 4) AS brand_avg_price, round(avg(m.p), 4) AS market_avg_price, "
                "round(avg((b.p - m.p) / nullif(m.p, 0) * 100), 2) AS price_delta_pct, "
                "round(avg(CAST(b.p < m.p * (1 - 1e-9) AS INT)) * 100.0, 2) AS days_below_market_pct, count(*) AS appearances, "
                f"{_band()} AS confidence_level, CAST(max(b.dt) AS VARCHAR) AS last_updated FROM "
                f"(SELECT dt, g, label, avg(p) AS p FROM {base} WHERE label IN {_in(names)} GROUP BY ALL) b "
                f"JOIN (SELECT dt, g, avg(p) AS p FROM {base} GROUP BY ALL) m ON b.dt = m.dt AND b.g = m.g "
                f"GROUP BY ALL HAVING count(*) >= {minimum}"
            )
    return " UNION ALL ".join(parts)


def win_rate_sql(src: str, names, geos, fuels=FUELS, minimum: int = 30) -> str:
    parts = []
    for direction, agg in (("cheapest", "min"), ("priciest", "max")):
        for geo in geos:
            for fuel in fuels:
                base = f"(SELECT dt, {geo} AS g, label, {fuel} AS p FROM {src} WHERE {fuel} > 0)"
                parts.append(
                    f"SELECT brand, '{direction}' AS direction, '{geo}' AS geo_level, g AS geo_value, '{fuel.removesuffix('_price')}' AS fuel_type, "
                    "count(*) AS appearances, round(avg(CASE WHEN hit = 1 THEN 1.0e0 / ties ELSE 0e0 END) * 100, 2) AS win_rate_pct, "
                    f"{_band()} AS confidence_level, CAST(max(dt) AS VARCHAR) AS last_updated FROM "
                    f"(SELECT dt, g, brand, hit, sum(hit) OVER (PARTITION BY dt, g) AS ties FROM "
                    f"(SELECT b.dt, b.g, b.label AS brand, max(CAST(b.p = m.p AS INT)) AS hit FROM {base} b "
                    f"JOIN (SELECT dt, g, {agg}(p) AS p FROM {base} GROUP BY ALL) m ON b.dt = m.dt AND b.g = m.g "
                    f"WHERE b.label IN {_in(names)} GROUP BY ALL)) GROUP BY ALL HAVING count(*) >= {minimum}"
                )
    return " UNION ALL ".join(parts)


def wins_sql(src: str, names, geos, select: str, having: str, fuels=FUELS) -> str:
    parts = []
    for geo in geos:
        for fuel in fuels:
            base = f"(SELECT dt, {geo} AS g, label, {fuel} AS p FROM {src} WHERE {fuel} IS NOT NULL)"
            parts.append(
                f"SELECT {select.format(geo=geo, fuel=fuel.removesuffix('_price'))}, count(*) AS appearances, "
                f"round(avg(CAST(m.p = b.p AS INT)) * 100, 2) AS win_rate_pct FROM {base} b "
                f"JOIN (SELECT dt, g, min(p) AS p FROM {base} GROUP BY ALL) m ON b.dt = m.dt AND b.g = m.g "
                f"WHERE b.label IN {_in(names)} GROUP BY ALL HAVING {having}"
            )
    return " UNION ALL ".join(parts)


EVENT_COMPARISON = comparison_sql("e", BRANDS, GEOS)
EVENT_WIN_RATE = win_rate_sql("e", BRANDS, GEOS, minimum=20)


@query("brand_price_comparison", with_ctes(A.OBSERVATION_SQL, body=EVENT_COMPARISON))
def brand_price_comparison(spark, sf_dir):
    return brands.brand_price_comparison(A.observations(spark, sf_dir), BRANDS, FUELS, GEOS)


@query("brand_win_rate", with_ctes(A.OBSERVATION_SQL, body=EVENT_WIN_RATE))
def brand_win_rate(spark, sf_dir):
    return brands.brand_win_rate(A.observations(spark, sf_dir), BRANDS, FUELS, GEOS, min_appearances=20)


@query("brand_price_comparison_sales", with_ctes(A.BRAND_SALE_SQL, body=comparison_sql("b", A.SALE_BRANDS, A.SALE_GEOS)))
def _(spark, sf_dir):
    return brands.brand_price_comparison(A.brand_sales(spark, sf_dir), A.SALE_BRANDS, FUELS, A.SALE_GEOS)


@query("brand_win_rate_sales", with_ctes(A.BRAND_SALE_SQL, body=win_rate_sql("b", A.SALE_BRANDS, A.SALE_GEOS)))
def _(spark, sf_dir):
    return brands.brand_win_rate(A.brand_sales(spark, sf_dir), A.SALE_BRANDS, FUELS, A.SALE_GEOS)


ALL_BRANDS = [f"brand#{i}" for i in range(1, 26)]


@query("brand_price_comparison_all", with_ctes(A.BRAND_SALE_SQL, body=comparison_sql("b", ALL_BRANDS, A.SALE_GEOS)))
def _(spark, sf_dir):
    return brands.brand_price_comparison(A.brand_sales(spark, sf_dir), ALL_BRANDS, FUELS, A.SALE_GEOS, wide=False)


@query("brand_win_rate_all", with_ctes(A.BRAND_SALE_SQL, body=win_rate_sql("b", ALL_BRANDS, A.SALE_GEOS)))
def _(spark, sf_dir):
    return brands.brand_win_rate(A.brand_sales(spark, sf_dir), ALL_BRANDS, FUELS, A.SALE_GEOS, wide=False)


@query(
    "brand_competitiveness",
    with_ctes(
        A.OBSERVATION_SQL,
        body="SELECT *, '2024-01-31' AS last_updated FROM ("
        + wins_sql(
            "e", BRANDS, GEOS, "b.label AS brand, '{geo}' AS geo_level, b.g AS geo_value, '{fuel}' AS fuel_type", "count(*) >= 30"
        )
        + ")",
    ),
)
def _(spark, sf_dir):
    return brands.competitiveness_from(brands.market_day_wins(A.observations(spark, sf_dir), BRANDS, FUELS, GEOS), "2024-01-31")


@query(
    "brand_competitiveness_monthly",
    with_ctes(
        A.BRAND_SALE_SQL,
        body=wins_sql(
            "b",
            A.SALE_BRANDS,
            A.SALE_GEOS,
            "CAST(date_trunc('month', b.dt) AS DATE) AS year_month, b.label AS brand, '{geo}' AS geo_level, '{fuel}' AS fuel_type",
            "true",
        ),
    ),
)
def _(spark, sf_dir):
    return brands.monthly_competitiveness_from(brands.market_day_wins(A.brand_sales(spark, sf_dir), A.SALE_BRANDS, FUELS, A.SALE_GEOS))


def _weighted(c: str) -> str:
    return f"sum({c} * appearances) / nullif(sum(CASE WHEN {c} IS NOT NULL THEN appearances END), 0)"


@query(
    "win_rate_summary",
    with_ctes(
        A.OBSERVATION_SQL,
        f"r AS ({EVENT_WIN_RATE})",
        body=f"SELECT brand, fuel_type, direction, round({_weighted('win_rate_pct')}, 2) AS win_rate_pct, CAST(sum(appearances) AS BIGINT) AS appearances, "
        f"{_band('sum(appearances)')} AS confidence FROM r GROUP BY ALL",
    ),
)
def _(spark, sf_dir):
    return brands.win_rate_summary(brand_win_rate(spark, sf_dir))


_SUMMARY_SQL = (
    f"SELECT brand, fuel_type, round({_weighted('price_delta_pct')}, 2) AS price_delta_pct, round({_weighted('days_below_market_pct')}, 2) AS days_below_market_pct, "
    f"round({_weighted('brand_avg_price')}, 4) AS brand_avg_price, round({_weighted('market_avg_price')}, 4) AS market_avg_price, "
    f"CAST(sum(appearances) AS BIGINT) AS appearances, {_band('sum(appearances)')} AS confidence FROM r GROUP BY ALL"
)


@query("price_comparison_summary", with_ctes(A.OBSERVATION_SQL, f"r AS ({EVENT_COMPARISON})", body=_SUMMARY_SQL))
def _(spark, sf_dir):
    return brands.price_comparison_summary(brand_price_comparison(spark, sf_dir))


@query(
    "annual_savings",
    with_ctes(
        A.OBSERVATION_SQL,
        f"r AS ({EVENT_COMPARISON})",
        f"z AS ({_SUMMARY_SQL})",
        body=f"SELECT brand, fuel_type, {rnd('market_avg_price - brand_avg_price')} AS savings_per_liter, "
        f"{rnd('(market_avg_price - brand_avg_price) * 45 * 3 * 12', 4)} AS eur_per_year FROM z",
    ),
)
def _(spark, sf_dir):
    saved = brands.annual_savings(brands.price_comparison_summary(brand_price_comparison(spark, sf_dir)), 45, 3)
    return rounded(saved.select("brand", "fuel_type", "savings_per_liter", "eur_per_year"), savings_per_liter=6, eur_per_year=4)


@query(
    "brand_coverage",
    with_ctes(
        A.OBSERVATION_SQL,
        f"r AS ({EVENT_COMPARISON})",
        body="SELECT brand, fuel_type, count(DISTINCT CASE WHEN geo_level = 'zip_code' THEN geo_value END) AS zip_codes, "
        "count(DISTINCT CASE WHEN geo_level = 'locality' THEN geo_value END) AS localities, "
        "count(DISTINCT CASE WHEN geo_level = 'municipality' THEN geo_value END) AS municipalities, "
        "CAST(sum(appearances) AS BIGINT) AS total_observations FROM r GROUP BY ALL",
    ),
)
def _(spark, sf_dir):
    return brands.brand_coverage(brand_price_comparison(spark, sf_dir))


@query(
    "loyalty_prices",
    with_ctes(
        A.OBSERVATION_SQL,
        f"l AS (SELECT label, fuel_type, price, {NORMAL_BRAND} AS brand FROM {melt_sql('e', 'label', FUELS)})",
        body="SELECT label, fuel_type, program, count(*) AS n, " + rnd("sum(price)", 4) + " AS list_total, " + rnd("sum(loyal)", 3) + " AS loyalty_total FROM "
        "(SELECT label, fuel_type, price, CASE brand WHEN 'repsol' THEN 'Waylet' WHEN 'bp' THEN 'Mi BP' WHEN 'shell' THEN 'Shell' END AS program, "
        "CASE brand WHEN 'repsol' THEN round(price - 0.03e0, 3) WHEN 'bp' THEN round(price - 0.03e0, 3) WHEN 'shell' THEN round(price - 0.05e0, 3) END AS loyal FROM l) "
        "GROUP BY ALL",
    ),
)
def _(spark, sf_dir):
    priced = melt_prices(A.observations(spark, sf_dir), ["label"], FUELS)
    rows = priced.withColumns({"program": C.loyalty_program("label"), "loyal": C.loyalty_price("label", "price")})
    total = rows.groupBy("label", "fuel_type", "program").agg(
        F.count("*").alias("n"), F.sum("price").alias("list_total"), F.sum("loyal").alias("loyalty_total")
    )
    return rounded(total, list_total=4, loyalty_total=3)


_HISTORY_ONLY_NEWEST = 'n AS (SELECT * FROM e QUALIFY "timestamp" = max("timestamp") OVER (PARTITION BY dt))'


_BRAND_JOB_SQL = (
    "SELECT 'brand_competitiveness' AS task, brand, gl AS geo_level, gv AS geo_value, f AS fuel_type, NULL AS detail, win_rate_pct AS value, appearances AS n FROM ("
    + wins_sql("n", S.COMPETITIVENESS_BRANDS, GEOS, "b.label AS brand, '{geo}' AS gl, b.g AS gv, '{fuel}' AS f", "count(*) >= 30")
    + ") UNION ALL SELECT 'brand_competitiveness_monthly', brand, gl, NULL, f, CAST(CAST(m AS DATE) AS VARCHAR), win_rate_pct, appearances FROM ("
    + wins_sql("n", S.COMPETITIVENESS_BRANDS, GEOS, "date_trunc('month', b.dt) AS m, b.label AS brand, '{geo}' AS gl, '{fuel}' AS f", "true")
    + ") UNION ALL SELECT 'reports/brand_win_rate', brand, geo_level, geo_value, fuel_type, direction, win_rate_pct, appearances FROM ("
    + win_rate_sql("n", S.REPORT_BRANDS, GEOS)
    + ") UNION ALL SELECT 'reports/brand_price_comparison', brand, geo_level, geo_value, fuel_type, NULL, price_delta_pct, appearances FROM ("
    + comparison_sql("n", S.REPORT_BRANDS, GEOS)
    + ")"
)


def _brand_reports(spark, root: str) -> DataFrame:
    """The four stored brand reports in one shape."""
    null = F.lit(None).cast("string")

    def rows(task: str, area, detail, value: str) -> DataFrame:
        stored = sinks.read_published(spark, f"{root}/{task}")
        return stored.select(
            F.lit(task).alias("task"), "brand", "geo_level", area.alias("geo_value"), "fuel_type", detail.alias("detail"), F.col(value).alias("value"), F.col("appearances").alias("n")
        )

    area = F.col("geo_value")
    return (
        rows("brand_competitiveness", area, null, "win_rate_pct")
        .union(rows("brand_competitiveness_monthly", null, F.col("year_month").cast("string"), "win_rate_pct"))
        .union(rows("reports/brand_win_rate", area, F.col("direction"), "win_rate_pct"))
        .union(rows("reports/brand_price_comparison", area, null, "price_delta_pct"))
    )


@query("brand_analytics_job", with_ctes(A.OBSERVATION_SQL, _HISTORY_ONLY_NEWEST, body=_BRAND_JOB_SQL))
def _(spark, sf_dir):
    root = A.scratch(spark, "brands")
    jobs.run_brand_analytics(A.observations(spark, sf_dir), root, "2024-01-31")
    return _brand_reports(spark, root)


@query("brand_analytics_by_day", with_ctes(A.OBSERVATION_SQL, _HISTORY_ONLY_NEWEST, body=_BRAND_JOB_SQL))
def _(spark, sf_dir):
    """The same reports from kept market days, brought up to date twice with days that overlap."""
    root, rows = A.scratch(spark, "brands"), A.observations(spark, sf_dir)
    for part in ("to_date(timestamp) <= DATE'2024-01-20'", "to_date(timestamp) >= DATE'2024-01-18'"):
        jobs.update_brand_analytics(rows.where(part), root, "2024-01-31")
    return _brand_reports(spark, root)


# ================================================================================== trends and rankings
_TREND = ", ".join(f"{rnd(c)} AS {c}" for c in TREND_DIGITS)


@query(
    "zip_trend",
    with_ctes(
        A.ZIP_HISTORY_SQL,
        body=f"SELECT zip_code, fuel_type, \"date\", {_TREND} FROM hz WHERE \"date\" >= DATE '{A.AS_OF}' - 365 AND fuel_type IN ('diesel_a_price', 'gasoline_95_e5_price') ORDER BY fuel_type, \"date\", zip_code",
    ),
)
def _(spark, sf_dir):
    trend = trends.zip_trend(A.zip_history(spark, sf_dir), S.PERIOD_DAYS["year"], A.AS_OF, fuels=FUELS)
    return trends.in_order(rounded(trend, **TREND_DIGITS))


_RAW_TREND = (
    'SELECT zip_code, fuel_type, dt AS "date", '
    f"{rnd('avg(price)')} AS avg_price, {rnd('min(price)')} AS min_price, {rnd('max(price)')} AS max_price "
    f"FROM {melt_sql('e', 'dt, zip_code', FUELS)}"
)


@query("zip_trend_from_history", with_ctes(A.OBSERVATION_SQL, body=_RAW_TREND + " GROUP BY ALL"))
def _(spark, sf_dir):
    return rounded(trends.zip_trend_from_history(A.observations(spark, sf_dir)), **TREND_DIGITS)


@query(
    "zip_trend_with_fallback",
    with_ctes(
        A.OBSERVATION_SQL,
        f"z AS ({ZIP_STATS})",
        body=f"SELECT zip_code, fuel_type, \"date\", {_TREND}, 'rollup' AS source FROM z WHERE zip_code < '28011' AND \"date\" >= DATE '2024-01-16' "
        f"UNION ALL SELECT *, 'raw_history' AS source FROM ({_RAW_TREND} WHERE dt >= DATE '2024-01-16' "
        "AND (zip_code, fuel_type) NOT IN (SELECT (zip_code, fuel_type) FROM z WHERE zip_code < '28011') GROUP BY ALL)",
    ),
)
def _(spark, sf_dir):
    rows = A.observations(spark, sf_dir)
    stored = rollups.zip_daily_stats(rows).where("zip_code < '28011'")
    return rounded(trends.zip_trend_with_fallback(stored, rows, 14, "2024-01-30"), **TREND_DIGITS)


def _area_sql(where: str) -> str:
    return (
        f"SELECT fuel_type, \"date\", {rnd('avg(avg_price)')} AS avg_price, {rnd('min(min_price)')} AS min_price, {rnd('max(max_price)')} AS max_price "
        f"FROM hz WHERE \"date\" >= DATE '{A.AS_OF}' - 180 AND {where} GROUP BY ALL"
    )


@query("national_trend", with_ctes(A.ZIP_HISTORY_SQL, body=_area_sql("true")))
def _(spark, sf_dir):
    return rounded(trends.area_trend(A.zip_history(spark, sf_dir), 180, A.AS_OF), **TREND_DIGITS)


@query("province_trend", with_ctes(A.ZIP_HISTORY_SQL, body=_area_sql("province = 'madrid' AND fuel_type = 'diesel_a_price'")))
def _(spark, sf_dir):
    return rounded(trends.area_trend(A.zip_history(spark, sf_dir), 180, A.AS_OF, "madrid", ["diesel_a_price"]), **TREND_DIGITS)


@query(
    "brand_trend",
    with_ctes(
        A.BRAND_HISTORY_SQL,
        body=f"SELECT \"date\", brand, fuel_type, {rnd('avg_price')} AS avg_price FROM hb WHERE \"date\" >= DATE '{A.AS_OF}' - 90 AND brand IN ('brand 1o', 'brand 3f')",
    ),
)
def _(spark, sf_dir):
    return rounded(trends.brand_trend(A.brand_history(spark, sf_dir), 90, ["brand 1o", "brand 3f"], A.AS_OF), avg_price=6)


@query(
    "trend_kpis",
    with_ctes(
        A.ZIP_HISTORY_SQL,
        f"t AS (SELECT * FROM hz WHERE \"date\" >= DATE '{A.AS_OF}' - 365)",
        body="SELECT zip_code, fuel_type, "
        + rnd('arg_max(avg_price, "date")')
        + " AS current_price, "
        + f"{rnd('min(avg_price)')} AS lowest_price, {rnd('max(avg_price)')} AS highest_price, "
        + rnd('(arg_max(avg_price, "date") - arg_min(avg_price, "date")) * 100 / arg_min(avg_price, "date")', 4)
        + " AS change_pct FROM t GROUP BY ALL",
    ),
)
def _(spark, sf_dir):
    trend = trends.zip_trend(A.zip_history(spark, sf_dir), 365, A.AS_OF)
    kpis = trends.trend_kpis(trend, ["zip_code", "fuel_type"])
    return rounded(kpis, current_price=6, lowest_price=6, highest_price=6, change_pct=4)


@query(
    "province_ranking",
    with_ctes(
        A.PROVINCE_HISTORY_SQL,
        body=f"SELECT fuel_type, province, {rnd('avg(avg_price)')} AS avg_price, {rnd('min(min_price)')} AS min_price, {rnd('max(max_price)')} AS max_price, "
        f"CAST(sum(station_count) AS BIGINT) AS total_observations FROM hp WHERE \"date\" >= DATE '{A.AS_OF}' - 180 GROUP BY ALL",
    ),
)
def _(spark, sf_dir):
    return rounded(rankings.province_ranking(A.province_history(spark, sf_dir), 180, A.AS_OF), **TREND_DIGITS)


@query(
    "brand_ranking",
    with_ctes(
        A.BRAND_HISTORY_SQL,
        f"r AS (SELECT fuel_type, brand, sum(avg_price * station_count) / sum(station_count) AS p, min(min_price) AS lo, max(max_price) AS hi, "
        f"CAST(sum(station_count) AS BIGINT) AS total_observations FROM hb WHERE \"date\" >= DATE '{A.AS_OF}' - 365 GROUP BY ALL)",
        body=f"SELECT fuel_type, brand, {rnd('p')} AS avg_price, {rnd('lo')} AS min_price, {rnd('hi')} AS max_price, total_observations FROM r "
        "QUALIFY row_number() OVER (PARTITION BY fuel_type ORDER BY p, brand) <= 10",
    ),
)
def _(spark, sf_dir):
    return rounded(rankings.brand_ranking(A.brand_history(spark, sf_dir), 365, A.AS_OF, top_n=10), **TREND_DIGITS)


def _volatility_sql(where: str) -> str:
    return (
        f"SELECT fuel_type, zip_code, province, {rnd('avg(avg_price)')} AS avg_price, {rnd('stddev_samp(avg_price)')} AS std_dev_price, "
        f"{rnd('stddev_samp(avg_price) / nullif(avg(avg_price), 0)')} AS coefficient_of_variation, "
        f"{rnd('100 * stddev_samp(avg_price) / nullif(avg(avg_price), 0)')} AS volatility_pct, {rnd('min(avg_price)')} AS min_price, "
        f"{rnd('max(avg_price)')} AS max_price, {rnd('max(avg_price) - min(avg_price)')} AS price_range, count(*) AS observation_days, "
        f"{rnd('avg(station_count)')} AS avg_station_count FROM z WHERE \"date\" >= DATE '2024-01-30' - 28 AND {where} GROUP BY ALL "
        "HAVING count(*) >= 20 AND avg(station_count) >= 3"
    )


_VOLATILITY_DIGITS = {
    c: 6
    for c in "avg_price std_dev_price coefficient_of_variation volatility_pct min_price max_price price_range avg_station_count".split()
}


@query(
    "zone_volatility_mainland",
    with_ctes(A.OBSERVATION_SQL, f"z AS ({ZIP_STATS})", body=_volatility_sql("province NOT IN ('palmas (las)', 'santa cruz de tenerife', 'balears (illes)', 'ceuta', 'melilla')")),
)
def _(spark, sf_dir):
    daily = rollups.zip_daily_stats(A.observations(spark, sf_dir))
    return rounded(rankings.zone_volatility(daily, 28, "2024-01-30"), **_VOLATILITY_DIGITS)


@query("zone_volatility_everywhere", with_ctes(A.OBSERVATION_SQL, f"z AS ({ZIP_STATS})", body=_volatility_sql("true")))
def _(spark, sf_dir):
    daily = rollups.zip_daily_stats(A.observations(spark, sf_dir))
    return rounded(rankings.zone_volatility(daily, 28, "2024-01-30", mainland_only=False), **_VOLATILITY_DIGITS)


def _pattern_sql(where: str) -> str:
    return (
        f"SELECT fuel_type, day_of_week, {rnd('sum(sum_price) / sum(count_days)')} AS avg_price, max(count_days) AS count_days, "
        f"min(min_daily_avg) AS min_daily_avg, max(max_daily_avg) AS max_daily_avg FROM w WHERE {where} GROUP BY ALL"
    )


for _name, _where, _args in [
    ("weekday_pattern_national", "province = '__national__'", {}),
    ("weekday_pattern_province", "province = 'madrid'", {"province": "madrid"}),
    ("weekday_pattern_mainland", "province NOT IN ('palmas (las)', 'ceuta', '__national__')", {"exclude_provinces": S.OFF_MAINLAND}),
]:

    @query(_name, with_ctes(A.PROVINCE_HISTORY_SQL, f"w AS ({_WEEKDAY_FROM_DAILY})", body=_pattern_sql(_where)))
    def _(spark, sf_dir, args=_args):
        stats = rollups.weekday_stats_from_daily(A.province_history(spark, sf_dir))
        return rounded(rankings.weekday_pattern(stats, **args), avg_price=6)


# ================================================================================== search
_HAV = A.haversine_sql("query_lat", "query_lon", "latitude", "longitude")
_PRICED = "p AS (SELECT * EXCLUDE (diesel_a_price), diesel_a_price AS price FROM s WHERE diesel_a_price > 0)"
_PAIRS = f"pairs AS (SELECT query_id, p.*, {_HAV} AS distance_km FROM q CROSS JOIN p)"
_ROADS = (
    f"road AS (SELECT query_id, station_id, {A.ROAD_KM} AS road_km FROM pairs WHERE query_id % 5 <> 0 AND station_id % 13 <> 0), "
    "routed AS (SELECT pairs.* EXCLUDE (distance_km), CASE WHEN query_id % 5 = 0 THEN distance_km ELSE road_km END AS distance_km FROM pairs "
    "LEFT JOIN road USING (query_id, station_id) WHERE query_id % 5 = 0 OR road_km IS NOT NULL)"
)
RADIUS_KM = 40.0


def _priced(spark, sf_dir, **kw) -> DataFrame:
    return search.priced_stations(A.stations(spark, sf_dir), **(kw or {"fuel": "diesel_a_price"}))


_ZIP_OK = "regexp_full_match(zip_code, '\\d{5}') AND CAST(zip_code AS INT) BETWEEN 1000 AND 52999"


@query(
    "cheapest_in_zip",
    with_ctes(
        A.STATION_SQL,
        _PRICED,
        body=f"SELECT zip_code, station_id, {rnd('price')} AS price, "
        f"{rnd('(price - (SELECT avg(price) FROM p)) / (SELECT avg(price) FROM p) * 100', 1)} AS pct_vs_avg FROM p WHERE {_ZIP_OK} "
        "QUALIFY row_number() OVER (PARTITION BY zip_code ORDER BY price, station_id) <= 5",
    ),
)
def _(spark, sf_dir):
    found = search.cheapest_in_zip(_priced(spark, sf_dir), 5)
    found = search.with_pct_vs_average(found, A.stations(spark, sf_dir), "diesel_a_price")
    return rounded(found.select("zip_code", "station_id", "price", "pct_vs_avg"), price=6)


@query(
    "cheapest_in_zip_group",
    with_ctes(
        A.STATION_SQL,
        body=f"SELECT zip_code, station_id, {rnd('diesel_a_price')} AS price, {rnd('CASE WHEN diesel_b_price > 0 THEN diesel_b_price END')} AS diesel_b, "
        f"{rnd('CASE WHEN diesel_premium_price > 0 THEN diesel_premium_price END')} AS diesel_premium, "
        "1 + CAST(coalesce(diesel_b_price, 0) > 0 AS INT) + CAST(coalesce(diesel_premium_price, 0) > 0 AS INT) AS variants FROM s "
        f"WHERE diesel_a_price > 0 AND {_ZIP_OK} AND label IN ('building', 'furniture') QUALIFY row_number() OVER (PARTITION BY zip_code ORDER BY diesel_a_price, station_id) <= 3",
    ),
)
def _(spark, sf_dir):
    found = search.cheapest_in_zip(_priced(spark, sf_dir, group="diesel", labels=["building", "furniture"]), 3)
    shown = found.select(
        "zip_code",
        "station_id",
        "price",
        F.try_element_at("variant_prices", F.lit("diesel_b_price")).alias("diesel_b"),
        F.try_element_at("variant_prices", F.lit("diesel_premium_price")).alias("diesel_premium"),
        F.size("variant_prices").alias("variants"),
    )
    return rounded(shown, price=6, diesel_b=6, diesel_premium=6)


@query(
    "stations_within_radius",
    with_ctes(A.STATION_SQL, A.POINT_SQL, _PRICED, _PAIRS, body=f"SELECT query_id, station_id, {rnd('distance_km')} AS distance_km FROM pairs WHERE distance_km <= {RADIUS_KM}"),
)
def _(spark, sf_dir):
    found = search.within_radius(A.points(spark, sf_dir), _priced(spark, sf_dir), RADIUS_KM)
    return rounded(found.select("query_id", "station_id", "distance_km"), distance_km=6)


def _top_sql(source: str, order: str, k: int, where: str = "true", extra: str = "") -> str:
    return (
        f"SELECT query_id, station_id, {rnd('distance_km')} AS distance_km, {rnd('price')} AS price{extra} FROM {source} WHERE {where} "
        f"QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {order}) <= {k}"
    )


_SEARCH_CTES = (A.STATION_SQL, A.POINT_SQL, _PRICED, _PAIRS)
_SHOWN = ("query_id", "station_id", "distance_km", "price")


@query("nearest_stations", with_ctes(*_SEARCH_CTES, body=_top_sql("pairs", "distance_km, station_id", 5)))
def _(spark, sf_dir):
    found = search.nearest(A.points(spark, sf_dir), _priced(spark, sf_dir), 5)
    return rounded(found.select(*_SHOWN), distance_km=6, price=6)


@query(
    "nearest_stations_group",
    with_ctes(*_SEARCH_CTES, body=_top_sql("pairs", "distance_km, station_id", 3, "true", ", 1 + CAST(coalesce(diesel_b_price, 0) > 0 AS INT) + CAST(coalesce(diesel_premium_price, 0) > 0 AS INT) AS variants")),
)
def _(spark, sf_dir):
    found = search.nearest(A.points(spark, sf_dir), _priced(spark, sf_dir, group="diesel"), 3)
    return rounded(found.select(*_SHOWN, F.size("variant_prices").alias("variants")), distance_km=6, price=6)


@query(
    "nearest_stations_by_road",
    with_ctes(
        *_SEARCH_CTES,
        _ROADS,
        "near AS (SELECT query_id, station_id FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance_km, station_id) <= 15)",
        body=_top_sql("(SELECT routed.* FROM routed JOIN near USING (query_id, station_id))", "distance_km, station_id", 5),
    ),
)
def _(spark, sf_dir):
    near = search.nearest(A.points(spark, sf_dir), _priced(spark, sf_dir), 5 * search.ROAD_OVERSAMPLING)
    road = A.road_distances(near)
    found = search.nearest(A.points(spark, sf_dir), _priced(spark, sf_dir), 5, road)
    return rounded(found.select(*_SHOWN), distance_km=6, price=6)


@query(
    "cheapest_within_radius",
    with_ctes(*_SEARCH_CTES, body=_top_sql("pairs", "price, distance_km, station_id", 5, f"distance_km <= {RADIUS_KM}")),
)
def _(spark, sf_dir):
    found = search.cheapest_within_radius(A.points(spark, sf_dir), _priced(spark, sf_dir), RADIUS_KM, 5)
    return rounded(found.select(*_SHOWN), distance_km=6, price=6)


@query(
    "cheapest_within_radius_by_road",
    with_ctes(*_SEARCH_CTES, _ROADS, body=_top_sql("routed", "price, distance_km, station_id", 5, f"distance_km <= {RADIUS_KM}")),
)
def _(spark, sf_dir):
    points = A.points(spark, sf_dir)
    found = search.cheapest_within_radius(points, _priced(spark, sf_dir), RADIUS_KM, 5, A.road_distances, A.routed_queries(points))
    return rounded(found.select(*_SHOWN), distance_km=6, price=6)


_COST_SQL = (
    f"c AS (SELECT *, round(price * (40e0 + 2e0 * distance_km * 7e0 / 100e0), 2) AS cost FROM pairs WHERE distance_km <= {RADIUS_KM}), "
    "d AS (SELECT *, max(cost) OVER w AS hi, min(cost) OVER w AS lo, row_number() OVER (PARTITION BY query_id ORDER BY cost, distance_km, station_id) AS rn "
    "FROM c WINDOW w AS (PARTITION BY query_id))"
)


@query(
    "best_total_cost",
    with_ctes(
        *_SEARCH_CTES,
        _COST_SQL,
        body=f"SELECT query_id, station_id, cost AS estimated_total_cost, CASE WHEN hi > lo THEN {rnd('(hi - cost) / (hi - lo) * 10', 1)} ELSE 10e0 END AS score FROM d WHERE rn <= 5",
    ),
)
def _(spark, sf_dir):
    found = search.best_total_cost(A.points(spark, sf_dir), _priced(spark, sf_dir), RADIUS_KM, 5, tank_liters=40)
    return found.select("query_id", "station_id", "estimated_total_cost", "score")


@query(
    "cheapest_within_radius_group",
    with_ctes(*_SEARCH_CTES, body=_top_sql("pairs", "price, distance_km, station_id", 3, f"distance_km <= {RADIUS_KM}", ", coalesce(diesel_premium_price, 0) > 0 AS premium")),
)
def _(spark, sf_dir):
    found = search.cheapest_within_radius(A.points(spark, sf_dir), _priced(spark, sf_dir, group="diesel"), RADIUS_KM, 3)
    premium = F.try_element_at("variant_prices", F.lit("diesel_premium_price")).isNotNull().alias("premium")
    return rounded(found.select(*_SHOWN, premium), distance_km=6, price=6)


@query(
    "best_total_cost_group",
    with_ctes(*_SEARCH_CTES, _COST_SQL, body="SELECT query_id, station_id, cost AS estimated_total_cost, coalesce(diesel_b_price, 0) > 0 AS heating FROM d WHERE rn <= 3"),
)
def _(spark, sf_dir):
    found = search.best_total_cost(A.points(spark, sf_dir), _priced(spark, sf_dir, group="diesel"), RADIUS_KM, 3, tank_liters=40)
    heating = F.try_element_at("variant_prices", F.lit("diesel_b_price")).isNotNull().alias("heating")
    return found.select("query_id", "station_id", "estimated_total_cost", heating)


@query(
    "listing_kpis",
    with_ctes(
        *_SEARCH_CTES,
        body=f"SELECT query_id, {rnd('min(price)')} AS cheapest_price, {rnd('avg(price)')} AS avg_price, {rnd('min(distance_km)')} AS nearest_km, count(*) AS results "
        f"FROM pairs WHERE distance_km <= {RADIUS_KM} GROUP BY ALL",
    ),
)
def _(spark, sf_dir):
    found = search.within_radius(A.points(spark, sf_dir), _priced(spark, sf_dir), RADIUS_KM)
    return rounded(search.listing_kpis(found), cheapest_price=6, avg_price=6, nearest_km=6)


@query(
    "coordinate_text",
    with_ctes(
        A.POINT_SQL,
        body="SELECT query_id, CASE WHEN query_id % 3 = 2 THEN NULL ELSE query_lat END AS lat, CASE WHEN query_id % 3 = 2 THEN NULL ELSE query_lon END AS lon FROM q",
    ),
)
def _(spark, sf_dir):
    text = "case query_id % 3 when 0 then concat(query_lat, ',', query_lon) when 1 then concat('  ', query_lat, ' , ', query_lon, ' ') else concat(query_lon, 'x') end"
    typed = A.points(spark, sf_dir).select("query_id", C.parse_coordinates(F.expr(text)).alias("c"))
    return typed.select("query_id", "c.lat", "c.lon")


# ================================================================================== zones


@query("polygon_files", with_ctes(A.STATION_SQL, A.POLYGON_SQL, body="SELECT DISTINCT station_id, name FROM inside"))
def _(spark, sf_dir):
    """Polygons as gzipped files, read back, and the stations inside them."""
    root = A.scratch(spark, "polygons")
    texts = A.polygon_documents(spark, sf_dir)
    collected = F.array_join(F.collect_list("geojson"), ",")
    files = texts.groupBy(F.floor(F.col("feature_idx") / 8).alias("part")).agg(
        F.concat(F.lit('{"type": "FeatureCollection", "features": ['), collected, F.lit("]}")).alias("value")
    )
    files.write.option("compression", "gzip").partitionBy("part").text(root)
    features = geojson.read_features(spark, f"{root}/part=*")
    rings = geojson.outer_rings(features, "nombre")
    return spatial.containment_join(A.stations(spark, sf_dir), rings).select("station_id", "name").distinct()


@query(
    "zip_features",
    "WITH f AS (SELECT n_nationkey AS feature_idx, lpad(CAST(n_nationkey % 9 AS VARCHAR), 5, '0') AS zip_code FROM nation WHERE n_nationkey % 4 > 0) "
    "SELECT zip_code, max(feature_idx) AS feature_idx FROM f WHERE zip_code IN (SELECT lpad(CAST(r_regionkey * 2 AS VARCHAR), 5, '0') FROM region) GROUP BY zip_code",
)
def _(spark, sf_dir):
    """Postal-code features, the last of a repeated code, of the zip codes asked for."""
    code = "case when n_nationkey % 4 = 0 then ' ' else lpad(cast(n_nationkey % 9 as string), 5, '0') end"
    square = "array(array(array(0.0, 0.0), array(0.0, 1.0), array(1.0, 1.0)))"
    feature = f"to_json(struct(map('COD_POSTAL', {code}) AS properties, struct('Polygon' AS type, {square} AS coordinates) AS geometry))"
    texts = A.table(spark, sf_dir, "nation").selectExpr("n_nationkey AS feature_idx", f"{feature} AS geojson")
    asked = A.table(spark, sf_dir, "region").selectExpr("lpad(cast(r_regionkey * 2 as string), 5, '0') AS zip_code")
    features = geojson.zip_features(geojson.parse_features(texts))
    return features.join(asked, "zip_code", "left_semi").select("zip_code", "feature_idx")


_LONG_S = melt_sql("s", "station_id, province, municipality, zip_code, latitude, longitude", A.STATION_FUELS)


@query(
    "zone_prices",
    with_ctes(
        A.STATION_SQL,
        body=f"SELECT province, zip_code, fuel_type, {rnd('avg(price)')} AS avg_price, {rnd('min(price)')} AS min_price, count(*) AS station_count FROM {_LONG_S} GROUP BY ALL",
    ),
)
def _(spark, sf_dir):
    return rounded(zones.zone_prices(A.stations(spark, sf_dir)), avg_price=6, min_price=6)


@query(
    "zone_prices_by_municipality",
    with_ctes(
        A.STATION_SQL,
        body=f"SELECT province, municipality, zip_code, fuel_type, {rnd('avg(price)')} AS avg_price, {rnd('min(price)')} AS min_price, count(*) AS station_count FROM {_LONG_S} GROUP BY ALL",
    ),
)
def _(spark, sf_dir):
    return rounded(zones.zone_prices(A.stations(spark, sf_dir), ["province", "municipality"]), avg_price=6, min_price=6)


@query(
    "province_prices_mainland",
    with_ctes(
        A.STATION_SQL,
        body=f"SELECT province, fuel_type, {rnd('avg(price)')} AS avg_price, count(*) AS station_count FROM {_LONG_S} "
        "WHERE province NOT IN ('palmas (las)', 'balears (illes)', 'ceuta') GROUP BY ALL",
    ),
)
def _(spark, sf_dir):
    return rounded(zones.province_prices(A.stations(spark, sf_dir), mainland_only=True), avg_price=6)


@query(
    "national_averages",
    with_ctes(
        A.STATION_SQL,
        body=" UNION ALL ".join(
            f"SELECT '{f}' AS fuel_type, {rnd(f'avg(CASE WHEN {f} > 0 THEN {f} END)')} AS avg_price, count(CASE WHEN {f} > 0 THEN 1 END) AS station_count FROM s"
            for f in A.STATION_FUELS
        ),
    ),
)
def _(spark, sf_dir):
    return rounded(zones.national_averages(A.stations(spark, sf_dir)), avg_price=6)


def _polygons(spark, sf_dir) -> DataFrame:
    return geojson.outer_rings(geojson.parse_features(A.polygon_documents(spark, sf_dir)), "nombre")


@query(
    "stations_in_polygons",
    with_ctes(A.STATION_SQL, A.POLYGON_SQL, body="SELECT station_id, min(feature_idx) AS feature_idx, arg_min(name, feature_idx) AS name FROM inside GROUP BY ALL"),
)
def _(spark, sf_dir):
    return spatial.assign_features(A.stations(spark, sf_dir), _polygons(spark, sf_dir))


_POLYGON_PRICES = (
    "first AS (SELECT station_id, min(feature_idx) AS feature_idx FROM inside GROUP BY ALL), "
    "pp AS (SELECT feature_idx, avg(diesel_a_price) AS avg_price, count(*) AS station_count FROM first JOIN s USING (station_id) WHERE diesel_a_price > 0 GROUP BY ALL)"
)


@query(
    "polygon_price_map",
    with_ctes(
        A.STATION_SQL,
        A.POLYGON_SQL,
        _POLYGON_PRICES,
        body=f"SELECT n_nationkey AS feature_idx, n_name AS name, {rnd('avg_price')} AS avg_price, coalesce(station_count, 0) AS station_count "
        "FROM nation LEFT JOIN pp ON feature_idx = n_nationkey",
    ),
)
def _(spark, sf_dir):
    rings = _polygons(spark, sf_dir)
    prices = zones.polygon_prices(A.stations(spark, sf_dir), rings, "diesel_a_price")
    shown = zones.map_with_prices(rings.select("feature_idx", "name").distinct(), prices)
    return rounded(shown, avg_price=6)


@query(
    "zips_by_polygon",
    with_ctes(
        A.STATION_SQL,
        A.POLYGON_SQL,
        body="SELECT DISTINCT feature_idx, name, zip_code FROM inside JOIN s USING (station_id) WHERE diesel_a_price > 0 AND feature_idx IN "
        "(SELECT min(feature_idx) FROM inside JOIN s USING (station_id) WHERE diesel_a_price > 0 GROUP BY station_id)",
    ),
)
def _(spark, sf_dir):
    return zones.zips_by_polygon(A.stations(spark, sf_dir), _polygons(spark, sf_dir), "diesel_a_price")


@query(
    "zone_prices_in_polygon",
    with_ctes(
        A.STATION_SQL,
        A.POLYGON_SQL,
        body=f"SELECT zip_code, {rnd('avg(price)')} AS avg_price, {rnd('min(price)')} AS min_price, count(*) AS station_count FROM {_LONG_S} "
        "WHERE fuel_type = 'diesel_a_price' AND province = 'nation_7' AND zip_code IN (SELECT zip_code FROM inside JOIN s USING (station_id) WHERE name = 'NATION_6' AND diesel_a_price > 0) "
        "GROUP BY ALL",
    ),
)
def _(spark, sf_dir):
    stations = A.stations(spark, sf_dir)
    inside = zones.zips_by_polygon(stations, _polygons(spark, sf_dir), "diesel_a_price").where("name = 'NATION_6'")
    found = zones.zones_in(zones.zone_prices(stations.where("province = 'nation_7'"), fuels=["diesel_a_price"]), inside)
    return rounded(found.select("zip_code", "avg_price", "min_price", "station_count"), avg_price=6, min_price=6)


_MAP_NAME = "CASE n_nationkey WHEN 0 THEN 'Madrid' WHEN 1 THEN 'Las Palmas' WHEN 2 THEN 'Illes Balears' WHEN 3 THEN 'Ceuta' WHEN 4 THEN 'A Coruña' WHEN 5 THEN 'València/Valencia' ELSE n_name END"


@query(
    "province_price_map",
    with_ctes(
        A.STATION_SQL,
        f"f AS (SELECT {_MAP_NAME} AS name, CASE n_nationkey WHEN 4 THEN 'coruña (a)' WHEN 5 THEN 'valencia / valència' ELSE lower({_MAP_NAME}) END AS k "
        "FROM nation WHERE n_nationkey NOT IN (1, 2, 3))",
        f"pr AS (SELECT province, avg(diesel_a_price) AS avg_price, count(*) AS station_count FROM s WHERE diesel_a_price > 0 GROUP BY ALL)",
        body=f"SELECT name, {rnd('avg_price')} AS avg_price, coalesce(station_count, 0) AS station_count FROM f LEFT JOIN pr ON province = k",
    ),
)
def _(spark, sf_dir):
    features = A.table(spark, sf_dir, "nation").selectExpr(f"{_MAP_NAME} AS name")
    prices = zones.province_prices(A.stations(spark, sf_dir), ["diesel_a_price"])
    return rounded(zones.province_map(features, prices, mainland_only=True), avg_price=6)


_TITLE = "list_aggregate(list_transform(regexp_extract_all({c}, '\\p{{L}}+|[^\\p{{L}}]+'), lambda r: upper(r[1]) || lower(r[2:])), 'string_agg', '')"


@query(
    "label_counts",
    with_ctes(
        A.STATION_SQL,
        body=f"SELECT label, count(*) AS station_count, {_TITLE.format(c='label')} AS title FROM s WHERE label <> '' GROUP BY label ORDER BY station_count DESC, label LIMIT 3",
    ),
)
def _(spark, sf_dir):
    return zones.label_counts(A.stations(spark, sf_dir), top_n=3)


@query(
    "province_names",
    with_ctes(A.STATION_SQL, body=f"SELECT DISTINCT province, {_TITLE.format(c='province')} AS title FROM s"),
)
def _(spark, sf_dir):
    return zones.province_names(A.stations(spark, sf_dir))


@query("municipalities", with_ctes(A.STATION_SQL, body="SELECT DISTINCT province, municipality FROM s"))
def _(spark, sf_dir):
    return zones.municipalities(A.stations(spark, sf_dir))


@query(
    "zip_codes_canonical",
    with_ctes(
        A.ZIP_HISTORY_SQL,
        body="SELECT zip_code, lpad(split_part(zip_code, '.', 1), 5, '0') AS canonical, regexp_full_match(zip_code, '\\d{5}') AS is_valid, count(*) AS n FROM hz GROUP BY ALL",
    ),
)
def _(spark, sf_dir):
    rows = A.zip_history(spark, sf_dir)
    return rows.groupBy("zip_code", C.canonical_zip("zip_code").alias("canonical"), F.coalesce(C.is_zip_code("zip_code"), F.lit(False)).alias("is_valid")).agg(
        F.count("*").alias("n")
    )


# ================================================================================== quality
def _gate_sql() -> str:
    have = list(A.OBSERVATION)
    parts = ["SELECT 'row_count' AS \"check\", NULL AS \"column\", CAST(count(*) AS DOUBLE) AS value, CASE WHEN count(*) < 5000 THEN 'warning' ELSE 'ok' END AS severity FROM e"]
    for c in S.SNAPSHOT_COLUMNS:
        if c not in have:
            parts.append(f"SELECT 'missing', '{c}', 1e0, 'error'")
        elif c in S.FLOAT_COLUMNS:
            low, high = S.PRICE_RANGE if c.endswith("_price") else S.LATITUDE_RANGE if c == "latitude" else S.LONGITUDE_RANGE
            out = f"coalesce(sum(CASE WHEN {c} < {low} OR {c} > {high} THEN 1 ELSE 0 END), 0)"
            parts.append(f"SELECT 'out_of_range', '{c}', CAST({out} AS DOUBLE), CASE WHEN {out} > 0 THEN 'warning' ELSE 'ok' END FROM e")
            if c.endswith("_price"):
                absent = f"avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END) * 100"
                parts.append(f"SELECT 'null_pct', '{c}', {rnd(absent)}, CASE WHEN {absent} > 0 THEN 'info' ELSE 'ok' END FROM e")
    return f'SELECT "check", "column", {rnd("value")} AS value, severity FROM ({" UNION ALL ".join(parts)})'


@query("quality_gate_report", with_ctes(A.OBSERVATION_SQL, body=_gate_sql()))
def _(spark, sf_dir):
    return rounded(quality.gate_report(A.observations(spark, sf_dir)), value=6)


@query(
    "data_inventory",
    with_ctes(
        A.OBSERVATION_SQL,
        _FILES_SQL,
        body="SELECT count(DISTINCT o_orderdate) AS num_days, count(DISTINCT date_trunc('month', o_orderdate)) AS num_months, count(DISTINCT year(o_orderdate)) AS num_years, "
        "CAST(min(o_orderdate) AS DATE) AS min_date, CAST(max(o_orderdate) AS DATE) AS max_date, (SELECT CAST(sum(size_bytes) AS BIGINT) FROM files) AS total_size_bytes FROM orders",
    ),
)
def _(spark, sf_dir):
    stats = A.province_history(spark, sf_dir).select("date", F.col("station_count").alias("record_count"))
    return quality.data_inventory(stats, _files(spark, sf_dir))


@query(
    "missing_days",
    with_ctes(
        A.BRAND_HISTORY_SQL,
        "k AS (SELECT brand, fuel_type, min(\"date\") AS lo, max(\"date\") AS hi FROM hb GROUP BY ALL)",
        body="SELECT brand, fuel_type, CAST(d AS DATE) AS \"date\" FROM (SELECT brand, fuel_type, unnest(range(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d FROM k) "
        "EXCEPT ALL SELECT brand, fuel_type, \"date\" FROM hb",
    ),
)
def _(spark, sf_dir):
    return quality.missing_days(A.brand_history(spark, sf_dir), keys=["brand", "fuel_type"])


@query("available_dates", 'SELECT DISTINCT CAST(o_orderdate AS DATE) AS "date" FROM orders ORDER BY 1')
def _(spark, sf_dir):
    return quality.available_dates(A.province_history(spark, sf_dir).select("date", F.col("station_count").alias("record_count")))


@query(
    "latest_day_stats",
    with_ctes(
        A.OBSERVATION_SQL,
        f"i AS ({_INGESTION_SQL})",
        body='SELECT "date", unique_stations, unique_provinces, unique_communities, unique_localities, unique_fuel_types FROM i ORDER BY "date" DESC LIMIT 1',
    ),
)
def _(spark, sf_dir):
    return quality.latest_day_stats(rollups.daily_ingestion_stats(A.observations(spark, sf_dir)))


@query(
    "feed_freshness",
    with_ctes(
        A.OBSERVATION_SQL,
        _FILES_SQL,
        body="SELECT CASE WHEN max(\"day\") = DATE '2024-01-30' THEN 'ok' ELSE 'stale' END AS status, 'stored' AS source, max(file_name) AS latest_file, max(\"day\") AS file_date, "
        "(SELECT max(\"timestamp\") FROM e) AS data_datetime, DATE '2024-01-30' AS expected_date FROM files",
    ),
)
def _(spark, sf_dir):
    return quality.feed_freshness(_files(spark, sf_dir), A.observations(spark, sf_dir), "2024-01-30")


# ================================================================================== forecast
_CELLS = [(a, b) for a in forecast.REGIMES for b in forecast.REGIMES]


def _forecast_sql(prefix: str, days: str, area_type: str) -> list[str]:
    """Common table expressions ending in ``<prefix>_f``, from ``days`` (area, fuel_type, date, price, carried)."""
    p = prefix
    steps = []
    for i in range(1, 8):
        steps.append(
            f"{p}_m{i} AS (SELECT *, CASE WHEN current_regime = 'normal' THEN a{i - 1} * p_normal_normal + x{i - 1} * p_expensive_normal ELSE 0e0 END AS a{i}, "
            f"a{i - 1} * p_normal_expensive + x{i - 1} * p_expensive_expensive AS x{i} FROM {p}_m{i - 1})"
        )
    counts = ", ".join(f"count(*) FILTER (gap = 1 AND regime = '{a}' AND nxt = '{b}') AS n_{a}_{b}" for a, b in _CELLS)
    total = {a: "(" + " + ".join(f"n_{a}_{b}" for b in forecast.REGIMES) + ")" for a in forecast.REGIMES}
    probs = ", ".join(f"CASE WHEN {total[a]} > 0 THEN n_{a}_{b} / CAST({total[a]} AS DOUBLE) ELSE {1.0 if a == b else 0.0}e0 END AS p_{a}_{b}" for a, b in _CELLS)
    moves = " + ".join(total.values())
    peaks = " + ".join(
        f"CASE WHEN {total[a]} > 0 THEN greatest({', '.join(f'n_{a}_{b}' for b in forecast.REGIMES)}) / CAST({total[a]} AS DOUBLE) ELSE 0 END" for a in forecast.REGIMES
    )
    rows = " + ".join(f"CAST({total[a]} > 0 AS INT)" for a in forecast.REGIMES)
    stay = "CASE current_regime " + " ".join(f"WHEN '{r}' THEN p_{r}_{r}" for r in forecast.REGIMES) + " END"
    nxt = ", ".join("CASE current_regime " + " ".join(f"WHEN '{a}' THEN p_{a}_{b}" for a in forecast.REGIMES) + f" END AS next_{b}" for b in forecast.REGIMES)
    return [
        f"{p}_d AS ({days})",
        f"{p}_w AS (SELECT * FROM {p}_d QUALIFY \"date\" >= max(\"date\") OVER (PARTITION BY area, fuel_type) - 179)",
        f"{p}_q AS (SELECT area, fuel_type, quantile_cont(price, 1/3e0) AS lo, quantile_cont(price, 2/3e0) AS hi FROM {p}_w GROUP BY ALL)",
        f"{p}_r AS (SELECT {p}_w.*, CASE WHEN price <= lo THEN 'cheap' WHEN price >= hi THEN 'expensive' ELSE 'normal' END AS regime FROM {p}_w JOIN {p}_q USING (area, fuel_type))",
        f"{p}_n AS (SELECT *, lead(regime) OVER k AS nxt, lead(\"date\") OVER k - \"date\" AS gap FROM {p}_r WINDOW k AS (PARTITION BY area, fuel_type ORDER BY \"date\"))",
        f"{p}_c AS (SELECT area, fuel_type, count(*) AS coverage_days, count(DISTINCT regime) AS states, max(\"date\") AS \"current_date\", arg_max(price, \"date\") AS current_avg_price, "
        f"arg_max(regime, \"date\") AS current_regime, arg_max(carried, \"date\") FILTER (carried IS NOT NULL) AS carried, {counts} FROM {p}_n GROUP BY ALL)",
        f"{p}_m0 AS (SELECT *, {moves} AS moves, {probs}, CASE WHEN current_regime = 'normal' THEN 1e0 ELSE 0e0 END AS a0, CASE WHEN current_regime = 'normal' THEN 0e0 ELSE 1e0 END AS x0, "
        f"CASE WHEN {moves} > 0 THEN round(0.6e0 * least(1e0, ({moves}) / 90e0) + 0.4e0 * ({peaks}) / ({rows}), 3) ELSE 0e0 END AS confidence FROM {p}_c)",
        *steps,
        f"{p}_o AS (SELECT *, coverage_days >= 60 AND states >= 2 AND moves >= 30 AS good, "
        "CASE WHEN current_regime = 'cheap' THEN 0e0 ELSE greatest(0e0, least(1e0, 1 - (a3 + x3))) END AS in3, "
        f"CASE WHEN current_regime = 'cheap' THEN 0e0 ELSE greatest(0e0, least(1e0, 1 - (a7 + x7))) END AS in7, {stay} AS stay, {nxt} FROM {p}_m7)",
        f"{p}_f AS (SELECT '{area_type}' AS geography_type, area AS geography_value, fuel_type, '{area_type}' AS source, CASE WHEN good THEN coverage_days END AS coverage_days, "
        "CASE WHEN good THEN moves END AS transition_observations, CASE WHEN good THEN \"current_date\" END AS \"current_date\", CASE WHEN good THEN round(current_avg_price, 4) END AS current_avg_price, "
        "CASE WHEN good THEN current_regime END AS current_regime, CASE WHEN good THEN round(next_cheap, 4) END AS next_cheap, CASE WHEN good THEN round(next_normal, 4) END AS next_normal, "
        "CASE WHEN good THEN round(next_expensive, 4) END AS next_expensive, CASE WHEN good THEN round(in3, 4) END AS cheaper_within_3d, CASE WHEN good THEN round(in7, 4) END AS cheaper_within_7d, "
        "CASE WHEN good AND stay < 0.9999 THEN round(1 / greatest(1e-6, 1 - stay), 1) END AS expected_days_in_current_regime, CASE WHEN good THEN confidence END AS confidence, "
        f"CASE WHEN NOT good THEN '{forecast.NO_HISTORY}' WHEN current_regime = 'expensive' AND (in3 >= 0.55 OR in7 >= 0.75) THEN '{forecast.CAN_WAIT}' "
        f"WHEN current_regime = 'normal' AND in3 >= 0.6 THEN '{forecast.CAN_WAIT}' ELSE '{forecast.REFUEL_TODAY}' END AS recommendation, "
        f"CASE WHEN NOT good THEN '{forecast.TOO_THIN}' ELSE printf('El área {forecast.AREA_WORDS[area_type]} %s está en un régimen %s. La probabilidad de ver un régimen más barato en 3 días es del %.0f%% "
        "y en 7 días del %.0f%%.', area, CASE current_regime WHEN 'cheap' THEN 'barato' WHEN 'expensive' THEN 'caro' ELSE 'normal' END, in3 * 100, in7 * 100) || "
        "CASE WHEN confidence < 0.45 THEN ' La confianza es baja por la variabilidad o escasez de transiciones.' ELSE '' END END AS explanation, NOT good AS insufficient_data, "
        "CASE WHEN good THEN round(p_cheap_expensive, 4) END AS cheap_to_expensive, CASE WHEN good THEN round(p_expensive_cheap, 4) END AS expensive_to_cheap, carried "
        f"FROM {p}_o)",
    ]


_FORECAST_COLUMNS = (
    "geography_type geography_value fuel_type source coverage_days transition_observations current_date current_avg_price current_regime next_cheap next_normal "
    "next_expensive cheaper_within_3d cheaper_within_7d expected_days_in_current_regime confidence recommendation explanation insufficient_data cheap_to_expensive expensive_to_cheap"
).split()
_ZIP_DAYS = (
    "SELECT lpad(split_part(zip_code, '.', 1), 5, '0') AS area, fuel_type, \"date\", arg_max(avg_price, province) AS price, max(province) AS carried FROM hz GROUP BY ALL"
)
_PROVINCE_DAYS = 'SELECT province AS area, fuel_type, "date", avg_price AS price, province AS carried FROM hp'


def _flat(f: DataFrame) -> DataFrame:
    nxt = {f"next_{r}": F.try_element_at("next_day_probabilities", F.lit(r)) for r in forecast.REGIMES}
    cell = lambda a, b: F.try_element_at(F.try_element_at("transition_matrix", F.lit(a)), F.lit(b))
    return f.withColumns({**nxt, "cheap_to_expensive": cell("cheap", "expensive"), "expensive_to_cheap": cell("expensive", "cheap")})


_QUOTED = ", ".join(f'"{c}"' for c in _FORECAST_COLUMNS)


@query("province_forecast", with_ctes(A.PROVINCE_HISTORY_SQL, *_forecast_sql("v", _PROVINCE_DAYS, "province"), body=f"SELECT {_QUOTED} FROM v_f"))
def _(spark, sf_dir):
    return _flat(forecast.province_forecast(A.province_history(spark, sf_dir))).select(*_FORECAST_COLUMNS)


@query(
    "zip_forecast_with_fallback",
    with_ctes(
        A.ZIP_HISTORY_SQL,
        A.PROVINCE_HISTORY_SQL,
        *_forecast_sql("z", _ZIP_DAYS, "zip_code"),
        *_forecast_sql("v", _PROVINCE_DAYS, "province"),
        body="SELECT z_f.geography_value AS requested_zip, "
        + ", ".join(f'CASE WHEN z_f.insufficient_data THEN v_f."{c}" ELSE z_f."{c}" END AS "{c}"' for c in _FORECAST_COLUMNS)
        + " FROM z_f LEFT JOIN v_f ON v_f.geography_value = z_f.carried AND v_f.fuel_type = z_f.fuel_type",
    ),
)
def _(spark, sf_dir):
    found = forecast.forecast_with_fallback(A.zip_history(spark, sf_dir), A.province_history(spark, sf_dir))
    return _flat(found).select("requested_zip", *_FORECAST_COLUMNS)


@query(
    "daily_regimes",
    with_ctes(A.ZIP_HISTORY_SQL, *_forecast_sql("z", _ZIP_DAYS, "zip_code")[:4], body='SELECT area, fuel_type, "date", regime FROM z_r'),
)
def _(spark, sf_dir):
    rows = A.zip_history(spark, sf_dir).withColumn("area", C.canonical_zip("zip_code"))
    keys = ["area", "fuel_type"]
    return forecast.with_regimes(forecast.daily_history(rows, keys, last_by="province"), keys).select("area", "fuel_type", "date", "regime")


# ================================================================================== trips
_TRIP_CTES = (A.STATION_SQL, A.POINT_SQL, _PRICED, A.TRIP_SQL)
_WP_KM = A.haversine_sql("wps.lat", "wps.lon", "p.latitude", "p.longitude")


_DETOUR = A.VEHICLE["max_detour_min"]


def _corridor_ctes(limit: str) -> str:
    return (
        f"dist AS (SELECT trip_id, wp_idx, km, station_id, price, {_WP_KM} AS d FROM wps CROSS JOIN p "
        f"WHERE abs(wps.lat - p.latitude) <= ({limit}) / 111.0), "
        "near AS MATERIALIZED (SELECT trip_id, station_id, price, round(min(d), 2) AS min_distance_km, arg_min(wp_idx, (d, wp_idx)) AS closest_waypoint_idx, "
        f"arg_min(km, (d, wp_idx)) AS route_km FROM dist WHERE d <= {limit} GROUP BY ALL), "
        f"cand AS (SELECT *, round(min_distance_km * 2, 1) AS detour_minutes FROM near WHERE round(min_distance_km * 2, 1) <= {_DETOUR})"
    )


@query("route_waypoints", with_ctes(A.POINT_SQL, A.TRIP_SQL, recursive=True, body="SELECT trip_id, wp_idx, round(lat, 6) AS query_lat, round(lon, 6) AS query_lon, km AS route_km FROM wps"))
def _(spark, sf_dir):
    return rounded(trips.route_waypoints(A.trips(spark, sf_dir)), query_lat=6, query_lon=6)


@query(
    "corridor_stations",
    with_ctes(*_TRIP_CTES, _corridor_ctes("15.0"), recursive=True, body="SELECT trip_id, station_id, min_distance_km, closest_waypoint_idx, route_km FROM near"),
)
def _(spark, sf_dir):
    waypoints = trips.route_waypoints(A.trips(spark, sf_dir))
    found = trips.corridor_stations(waypoints, _priced(spark, sf_dir).select("station_id", "latitude", "longitude"), 15.0)
    return found.select("trip_id", "station_id", "min_distance_km", "closest_waypoint_idx", "route_km")


@query(
    "waypoint_lookup",
    with_ctes(
        A.POINT_SQL,
        A.TRIP_SQL,
        "asked AS (SELECT DISTINCT trip_id, wp_idx * 2 AS closest_waypoint_idx FROM wps)",
        recursive=True,
        body="SELECT a.trip_id, a.closest_waypoint_idx, w.km AS route_km FROM asked a JOIN wps w ON w.trip_id = a.trip_id "
        "AND w.wp_idx = least(a.closest_waypoint_idx, (SELECT max(m.wp_idx) FROM wps m WHERE m.trip_id = a.trip_id))",
    ),
)
def _(spark, sf_dir):
    waypoints = trips.route_waypoints(A.trips(spark, sf_dir))
    asked = waypoints.select("trip_id", (F.col("wp_idx") * 2).alias("closest_waypoint_idx"))
    return trips.waypoint_km(asked, waypoints).select("trip_id", "closest_waypoint_idx", "route_km")


def _candidates(spark, sf_dir) -> DataFrame:
    return trips.trip_candidates(A.trips(spark, sf_dir), _priced(spark, sf_dir))


@query(
    "trip_candidates",
    with_ctes(
        *_TRIP_CTES,
        _corridor_ctes(f"({_DETOUR}) * 1.5"),
        recursive=True,
        body=f"SELECT trip_id, station_id, {rnd('price')} AS price, min_distance_km, detour_minutes, route_km FROM cand",
    ),
)
def _(spark, sf_dir):
    # No columns of stations that nobody asks for go through the search.
    found = trips.trip_candidates(A.trips(spark, sf_dir), _priced(spark, sf_dir).select("station_id", "latitude", "longitude", "price"))
    return rounded(found.select("trip_id", "station_id", "price", "min_distance_km", "detour_minutes", "route_km"), price=6)


@query(
    "candidate_median_price",
    with_ctes(
        *_TRIP_CTES,
        _corridor_ctes(f"({_DETOUR}) * 1.5"),
        recursive=True,
        body=f"SELECT trip_id, {rnd('price')} AS median_price FROM cand QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY price) = count(*) OVER (PARTITION BY trip_id) // 2 + 1",
    ),
)
def _(spark, sf_dir):
    return rounded(trips.candidate_median(_candidates(spark, sf_dir)), median_price=6)


def _planned(spark, sf_dir) -> dict[str, DataFrame]:
    return jobs.plan_trips(A.trips(spark, sf_dir), _priced(spark, sf_dir), A.scratch(spark, "trips"), ["stops", "summary"])


# The stop rules as recursive tables: drive from stop to stop, secure the arrival level, leave out needless stops.
_STOP = "STRUCT(km DOUBLE, id BIGINT, price DOUBLE, detour DOUBLE, label VARCHAR, why VARCHAR)"


def _arrival_sql(stops: str) -> str:
    """Level at the destination after a list of stops."""
    after = f"tank_liters - greatest(0e0, total_km - list_extract({stops}, -1).km) * consumption / 100"
    nonstop = "tank_liters * (fuel_pct / 100) - total_km * consumption / 100"
    return f"round(greatest(0e0, CASE WHEN len({stops}) > 0 THEN {after} ELSE {nonstop} END / tank_liters * 100), 1)"


def _why_sql(texts: dict[str, str]) -> str:
    return "CASE strategy " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in texts.items()) + " END"


_WHY = {k: v.replace("{n}", "%d").replace("{a:.0f}", "%.0f").replace("{b:.0f}", "%.0f") for k, v in trips.STOP_TEXT.items()}
_FLOOR_WHY = trips.FLOOR_TEXT.replace("%", "%%").replace("{floor:.0f}", "%.0f").replace("{a:.0f}", "%.0f").replace("{b:.0f}", "%.0f")
_USABLE = "CASE WHEN reach > margin_km THEN reach - margin_km ELSE reach * 0.9e0 END"
_OTHERS = "list_filter(stops, lambda x, j: j <> i)"
_KMS = f"list_concat([0e0], list_transform({_OTHERS}, lambda x: x.km), [total_km])"
_DRIVABLE = (
    f"list_bool_and(list_transform(range(1, len({_KMS})), lambda j: {_KMS}[j + 1] - {_KMS}[j] <= "
    "CASE WHEN j = 1 THEN start_km ELSE full_km END - margin_km))"
)
_PLAN_CTES = (
    *_TRIP_CTES,
    _corridor_ctes(f"({_DETOUR}) * 1.5"),
    "cn AS MATERIALIZED (SELECT c.trip_id, c.station_id, c.price, c.route_km, c.min_distance_km, c.detour_minutes, p.label FROM cand c JOIN p USING (station_id))",
    "v AS MATERIALIZED (SELECT trip_id, total_km, tank_liters, consumption, fuel_pct, floor_pct, strategy, tank_liters / consumption * 100 AS full_km, "
    "tank_liters / consumption * 100 * 0.15e0 AS margin_km, tank_liters / consumption * 100 * (fuel_pct / 100) AS start_km "
    f"FROM trips CROSS JOIN (SELECT unnest({list(trips.STRATEGIES)!r}) AS strategy))",
    f"drive AS (SELECT trip_id, strategy, 0e0 AS at_km, start_km AS reach, CAST([] AS {_STOP}[]) AS stops, 0 AS n FROM v UNION ALL "
    "SELECT trip_id, strategy, b.km, full_km, list_append(stops, {'km': b.km, 'id': b.id, 'price': b.price, 'detour': b.detour, 'label': b.label, "
    f"'why': printf({_why_sql(_WHY)}, CAST(k AS INTEGER), at_km, at_km + usable)}}), n + 1 FROM ("
    "SELECT trip_id, strategy, at_km, stops, n, full_km, usable, count(*) AS k, min({'first': CASE strategy WHEN 'least_detour' THEN detour_minutes "
    "WHEN 'fewest_stops' THEN CAST(route_km < at_km + usable * 2 / 3 AS DOUBLE) ELSE 0e0 END, 'price': price, 'km': route_km, 'd': min_distance_km, "
    "'id': station_id, 'detour': detour_minutes, 'label': label}) AS b FROM ("
    f"SELECT d.*, v.full_km, {_USABLE} AS usable FROM drive d JOIN v USING (trip_id, strategy) WHERE at_km + reach < total_km) JOIN cn USING (trip_id) "
    "WHERE route_km > at_km AND route_km <= at_km + usable AND NOT list_contains(list_transform(stops, lambda x: x.label), label) GROUP BY ALL))",
    "driven AS (SELECT * FROM drive JOIN v USING (trip_id, strategy) QUALIFY row_number() OVER (PARTITION BY trip_id, strategy ORDER BY n DESC) = 1)",
    "late AS (SELECT trip_id, strategy, at_km, least(at_km + reach - margin_km, total_km) AS lim, floor_pct, "
    "min({'first': -route_km, 'price': price, 'd': min_distance_km, 'id': station_id, 'km': route_km, 'detour': detour_minutes, 'label': label}) AS b "
    f"FROM driven JOIN cn USING (trip_id) WHERE {_arrival_sql('stops')} < floor_pct AND route_km > at_km AND route_km <= least(at_km + reach - margin_km, total_km) "
    "AND total_km - route_km <= full_km * (1 - floor_pct / 100) AND NOT list_contains(list_transform(stops, lambda x: x.label), label) GROUP BY ALL)",
    "secured AS (SELECT d.* REPLACE (CASE WHEN l.b IS NULL THEN d.stops ELSE list_append(d.stops, {'km': l.b.km, 'id': l.b.id, 'price': l.b.price, 'detour': l.b.detour, "
    f"'label': l.b.label, 'why': printf('{_FLOOR_WHY}', l.floor_pct, l.at_km, l.lim)}}) END AS stops) FROM driven d LEFT JOIN late l USING (trip_id, strategy))",
    "prune AS (SELECT trip_id, strategy, stops, len(stops) AS i FROM secured UNION ALL "
    f"SELECT trip_id, strategy, CASE WHEN {_DRIVABLE} AND {_arrival_sql(_OTHERS)} >= floor_pct THEN {_OTHERS} ELSE stops END, i - 1 "
    "FROM prune JOIN v USING (trip_id, strategy) WHERE i > 0)",
    "planned AS MATERIALIZED (SELECT p.stops, v.* FROM prune p JOIN v USING (trip_id, strategy) WHERE i = 0)",
    "legs_of AS (SELECT *, unnest(stops) AS s, generate_subscripts(stops, 1) AS no FROM planned)",
    "left_of AS (SELECT *, CASE WHEN no = 1 THEN start_km ELSE full_km END / full_km * tank_liters - (s.km - CASE WHEN no = 1 THEN 0e0 ELSE stops[no - 1].km END) * consumption / 100 AS rest FROM legs_of)",
    "st AS MATERIALIZED (SELECT trip_id, strategy, CAST(no - 1 AS INTEGER) AS stop_idx, s.id AS station_id, s.label AS label, s.km AS route_km, s.detour AS detour_minutes, "
    "round(greatest(0e0, rest / tank_liters * 100), 1) AS fuel_at_arrival_pct, round(greatest(0e0, tank_liters - rest), 1) AS liters_to_fill, "
    "round(round(greatest(0e0, tank_liters - rest), 1) * s.price, 2) AS cost_eur, s.why AS reasoning FROM left_of)",
)
_STOP_OUT = ["trip_id", "strategy", "stop_idx", "station_id", "label", "route_km", "detour_minutes", "fuel_at_arrival_pct", "liters_to_fill", "cost_eur", "reasoning"]


@query("refuelling_stops", with_ctes(*_PLAN_CTES, recursive=True, body=f"SELECT {', '.join(_STOP_OUT)} FROM st"))
def _(spark, sf_dir):
    return trips.refuelling_stops(A.trips(spark, sf_dir), _candidates(spark, sf_dir)).select(*_STOP_OUT)


_MEDIAN_CTE = (
    "med AS (SELECT trip_id, price AS median_price FROM cand QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY price) = count(*) OVER (PARTITION BY trip_id) // 2 + 1)"
)
_SUMMARY_CTE = (
    "sums AS (SELECT trip_id, strategy, count(*) AS k, sum(cost_eur) AS cost, sum(liters_to_fill) AS litres, sum(detour_minutes) AS detour, list_sort(list(DISTINCT label)) AS labels FROM st GROUP BY ALL), "
    "summary AS (SELECT trip_id, strategy, coalesce(k, 0) AS n_stops, round(coalesce(cost, 0), 2) AS total_fuel_cost, round(coalesce(litres, 0), 1) AS total_fuel_liters, "
    "round(coalesce(detour, 0), 1) AS total_detour_minutes, CASE WHEN strategy = 'cheapest' THEN coalesce(greatest(0e0, round(coalesce(litres, 0) * median_price - coalesce(cost, 0), 2)), 0e0) END AS savings_eur, "
    f"{_arrival_sql('stops')} AS fuel_at_destination_pct, {_arrival_sql('stops')} + 0.05e0 < floor_pct AS floor_unmet, "
    "strategy = 'cheapest' OR coalesce(labels, []) <> coalesce(max(CASE WHEN strategy = 'cheapest' THEN labels END) OVER (PARTITION BY trip_id), []) AS shown "
    "FROM planned LEFT JOIN sums USING (trip_id, strategy) LEFT JOIN med USING (trip_id))"
)


@query("trip_summary", with_ctes(*_PLAN_CTES, _MEDIAN_CTE, _SUMMARY_CTE, recursive=True, body="SELECT * FROM summary"))
def _(spark, sf_dir):
    return _planned(spark, sf_dir)["summary"]


@query(
    "fuel_curve",
    with_ctes(
        *_PLAN_CTES,
        _MEDIAN_CTE,
        _SUMMARY_CTE,
        "ends AS (SELECT trip_id, stop_idx AS leg, route_km AS to_km, greatest(0e0, least(100e0, fuel_at_arrival_pct)) AS to_pct FROM st WHERE strategy = 'cheapest' UNION ALL "
        "SELECT trip_id, 1000000, total_km, greatest(0e0, least(100e0, fuel_at_destination_pct)) FROM trips JOIN summary USING (trip_id) WHERE strategy = 'cheapest')",
        "lg AS (SELECT e.*, t.total_km, coalesce(lag(to_km) OVER w, 0e0) AS from_km, CASE WHEN lag(to_km) OVER w IS NULL THEN greatest(0e0, least(100e0, fuel_pct)) ELSE 100e0 END AS from_pct "
        "FROM ends e JOIN trips t USING (trip_id) WHERE total_km > 0 WINDOW w AS (PARTITION BY trip_id ORDER BY leg))",
        "sm AS (SELECT *, bucket * (total_km / 24) AS here FROM lg CROSS JOIN range(25) AS r(bucket))",
        recursive=True,
        body="SELECT trip_id, CAST(bucket AS INTEGER) AS bucket, round(here + 1e-9, 6) AS km, round(coalesce(greatest(0e0, least(100e0, arg_min(from_pct + (here - from_km) / (to_km - from_km) * (to_pct - from_pct), leg) "
        "FILTER (to_km > from_km AND here <= to_km))), arg_max(to_pct, leg)) + 1e-9, 6) AS pct FROM sm GROUP BY trip_id, bucket, here",
    ),
)
def _(spark, sf_dir):
    tables = _planned(spark, sf_dir)
    return rounded(trips.fuel_curve(A.trips(spark, sf_dir), tables["stops"], tables["summary"]), km=6, pct=6)


# ================================================================================== streaming


@query(
    "live_snapshot_stream",
    with_ctes(
        A.OBSERVATION_SQL,
        "n AS (SELECT * FROM e QUALIFY dense_rank() OVER (ORDER BY dt DESC) = 1)",
        body=f"SELECT eess_id, zip_code, {rnd('diesel_a_price')} AS diesel_a_price FROM n WHERE sale_type = 'p'",
    ),
)
def _(spark, sf_dir):
    landed, live, checkpoint = (A.scratch(spark, n) for n in ("landing", "live", "checkpoint"))
    daily = F.concat(F.left("timestamp", F.lit(10)), F.lit("T12:00:00+00:00"))
    landing.write_snapshot(A.observations(spark, sf_dir).withColumn("timestamp", daily).drop("hydrogen_price"), landed)
    refresh.refresh_live_snapshot(spark, landed, live, checkpoint, min_rows=10, once=True).awaitTermination()
    return rounded(refresh.read_live_snapshot(spark, live).select("eess_id", "zip_code", "diesel_a_price"), diesel_a_price=6)


@query(
    "feed_states_stream",
    with_ctes(
        A.OBSERVATION_SQL,
        body="SELECT zip_code AS feed, \"case\", CASE WHEN \"case\" = 'short' THEN 'stale' ELSE 'live' END AS status, "
        "CAST(epoch_ms(max(CAST(\"timestamp\" AS TIMESTAMPTZ))) AS BIGINT) AS newest_ms FROM e CROSS JOIN (VALUES ('short'), ('long')) AS c(\"case\") "
        "WHERE zip_code IS NOT NULL GROUP BY ALL",
    ),
)
def _(spark, sf_dir):
    """State of every zip code's feed, under a poll interval of ten minutes and under one of a thousand years."""
    landed = A.scratch(spark, "landing")
    landing.write_snapshot(A.observations(spark, sf_dir).drop("hydrogen_price"), landed)
    found = []
    for case, seconds in (("short", 600), ("long", 1000 * 365 * 86400)):
        states, checkpoint = A.scratch(spark, "feeds"), A.scratch(spark, "checkpoint")
        changes = freshness.feed_states(refresh.landing_stream(spark, landed), F.col("zip_code"), seconds)
        freshness.follow_feeds(changes, states, checkpoint, once=True).awaitTermination()
        found.append(freshness.read_states(spark, states).drop("decided_ms").withColumn("case", F.lit(case)))
    return found[0].unionByName(found[1])


@query("rollup_stream", with_ctes(*_ROLLUP_CTES, body=_ALL_ROLLUPS_SQL))
def _(spark, sf_dir):
    landed, root, checkpoint = (A.scratch(spark, n) for n in ("landing", "rollups", "checkpoint"))
    landing.write_snapshot(A.observations(spark, sf_dir).drop("hydrogen_price"), landed)
    refresh.refresh_rollups(spark, landed, root, checkpoint, once=True).awaitTermination()
    return _all_rollups(jobs.stored_rollups(spark, root))


@query(
    "publish_valid_rollup",
    with_ctes(A.ZIP_HISTORY_SQL, body='SELECT "date", zip_code, province, fuel_type, station_count FROM hz'),
)
def _(spark, sf_dir):
    path = A.scratch(spark, "published")
    good = A.zip_history(spark, sf_dir)
    refresh.publish_if_valid(good, path)
    for bad in (None, good.where("false"), good.drop("avg_price")):
        refresh.publish_if_valid(bad, path)
    return sinks.read_published(spark, path).select("date", "zip_code", "province", "fuel_type", "station_count")
