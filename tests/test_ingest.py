"""Documents, snapshot files, file choice and the sinks."""

import json

import pytest
from pyspark.sql import functions as F

from pricegrid import schema as S
from pricegrid.operators import normalize, quality
from pricegrid.sources import geojson, landing, sinks

STATION = {src: "" for src in S.SOURCE_FIELDS} | {
    "C.P.": "02001",
    "IDEESS": "4375",
    "Rótulo": " REPSOL ",
    "Provincia": "ALBACETE",
    "Latitud": "39,211417",
    "Longitud (WGS84)": "-1,539167",
    "Precio Gasoleo A": "1,299",
    "Tipo Venta": "P",
    "Horario": "L-D: 24H",
}


def document(**changes):
    return {"ResultadoConsulta": "OK", "Fecha": "09/10/2024 20:12:15", "Nota": "", "ListaEESSPrecio": [STATION]} | changes


def test_documents_become_snapshot_rows(spark, tmp_path):
    for i, doc in enumerate([document(), document(ResultadoConsulta="ERROR"), document(ListaEESSPrecio=[]), document(Fecha=""), document(Fecha="2024-10-09")]):
        (tmp_path / f"d{i}.json").write_text(json.dumps(doc, indent=1), encoding="utf-8")
    docs = landing.read_documents(spark, str(tmp_path))
    usable, rejected = normalize.split_documents(docs)
    rows = normalize.normalize_stations(normalize.explode_documents(usable))
    assert rows.columns == S.SNAPSHOT_COLUMNS
    assert [f.dataType for f in rows.schema] == [f.dataType for f in S.SNAPSHOT_SCHEMA]
    (row,) = rows.collect()
    assert (row.timestamp, row.zip_code, row.label, row.province) == ("2024-10-09T18:12:15+00:00", "02001", "repsol", "albacete")
    assert (row.latitude, row.longitude, row.diesel_a_price, row.diesel_b_price) == (39.211417, -1.539167, 1.299, None)
    assert sorted(r.reason for r in rejected.collect()) == ["bad_time", "no_stations", "no_time", "status"]


def test_missing_station_list_is_rejected(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"ResultadoConsulta": "OK", "Fecha": "09/10/2024 20:12:15"}))
    _, rejected = normalize.split_documents(landing.read_documents(spark, str(tmp_path)))
    assert [r.reason for r in rejected.collect()] == ["no_stations"]


def test_rejected_documents_keep_their_text_and_can_be_replayed(spark, tmp_path):
    whole = json.dumps(document())
    texts = {
        "good": whole,
        "cut": whole[: len(whole) // 2],
        "blank": "  ",
        "types": json.dumps(document(ListaEESSPrecio="none")),
        "list": "[1, 2",
        "null": "null",
        "status": json.dumps(document(ResultadoConsulta="ERROR")),
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    usable, rejected = normalize.sort_out(landing.read_landed(spark, str(tmp_path)))
    assert [r.file.split("/")[-1] for r in usable.collect()] == ["good.json"]
    found = {r.file.split("/")[-1][:-5]: (r.reason, r.document) for r in rejected.collect()}
    assert found == {k: ("status" if k == "status" else "unreadable", t) for k, t in texts.items() if k != "good"}

    store = str(tmp_path / "quarantine")
    rejected.write.partitionBy("reason").parquet(store)
    repaired = spark.read.parquet(store).where("reason = 'unreadable'").drop("reason").withColumn("document", F.lit(whole))
    again, none = normalize.sort_out(repaired)
    assert none.count() == 0 and again.count() == 5
    assert normalize.normalize_stations(normalize.explode_documents(again)).count() == 5
    assert [x.count() for x in normalize.sort_out(repaired.where("file IS NULL"))] == [0, 0]


def test_public_sale_filter(frame):
    assert normalize.public_sale(frame([("p",), ("r",), (None,)], "sale_type string")).count() == 1
    assert normalize.public_sale(frame([(1,), (2,)], "x int")).count() == 2


def test_schema_evolution(spark, frame, tmp_path):
    frame([("a", "2024-01-01")], "label string, date string").write.parquet(str(tmp_path / "t" / "old"))
    frame([("b", 1.5)], "label string, diesel_a_price double").write.parquet(str(tmp_path / "t" / "new"))
    assert landing.read_snapshots(spark, f"{tmp_path}/t/*").columns == S.SNAPSHOT_COLUMNS  # older layouts lack columns
    rows = landing.read_snapshots(spark, f"{tmp_path}/t/*", merge=True)
    assert set(rows.columns) == {"label", "date", "diesel_a_price"}
    assert rows.count() == 2
    upcast = frame([("2024-01-01", "28001", "f", 1.0, 1.0, 1.0, 1)], "date string, zip_code string, fuel_type string, avg_price double, min_price double, max_price double, station_count int")
    from pricegrid.operators.trends import with_province_column

    assert with_province_column(upcast).first()["province"] is None


def test_csv_history(spark, tmp_path):
    header = ",".join(S.SNAPSHOT_COLUMNS)
    line = ",".join(["2024-10-09T18:12:15+00:00", "02001"] + [""] * 10 + ["39.2", "-1.5"] + [""] * 13 + ["1.3"])
    (tmp_path / "h.csv").write_text(f"{header}\n{line}\n")
    row = landing.read_csv_history(spark, str(tmp_path)).first()
    assert (row.zip_code, row.latitude, row.hydrogen_price, row.label) == ("02001", 39.2, 1.3, None)


FILES = [
    ("snapshot_2024-01-01T06-00.parquet", 10, "2024-01-01"),
    ("snapshot_2024-01-01T18-00.parquet", 11, "2024-01-01"),
    ("snapshot_2024-01-03T06-00.parquet", 12, "2024-01-03"),
    ("snapshot_2024-01-09T06-00.parquet", 13, "2024-01-09"),
]


@pytest.fixture
def files(frame):
    return frame(FILES, "file_name string, size_bytes bigint, day string").withColumn("day", F.col("day").cast("date"))


def test_file_choice(files):
    name = lambda df: sorted(r.file_name[9:22] for r in df.collect())
    assert name(landing.latest_file_per_day(files)) == ["2024-01-01T18", "2024-01-03T06", "2024-01-09T06"]
    assert name(landing.most_recent_days(files, 2)) == ["2024-01-03T06", "2024-01-09T06"]
    assert name(landing.latest_file(files, as_of="2024-01-05")) == ["2024-01-03T06"]
    assert name(landing.latest_file(files, as_of="2024-02-05")) == ["2024-01-09T06"]
    assert name(landing.latest_file(files.where("false"), as_of="2024-02-05")) == []
    assert name(landing.files_between(files, first="2024-01-02", last="2024-01-08")) == ["2024-01-03T06"]
    assert name(landing.files_between(files, last="2024-01-02")) == ["2024-01-01T06", "2024-01-01T18"]
    assert name(landing.files_between(files, days_back=6, as_of="2024-01-09")) == ["2024-01-03T06", "2024-01-09T06"]


def test_file_catalogue_of_a_landing_area(spark, frame, tmp_path):
    rows = frame([("2024-01-01T05:00:00+00:00", 1.0), ("2024-01-02T05:00:00+00:00", 1.0)], "timestamp string, diesel_a_price double")
    landing.write_snapshot(rows.coalesce(1), str(tmp_path / "l"))
    listed = landing.list_files(spark, str(tmp_path / "l")).collect()
    assert sorted(str(r.day) for r in listed) == ["2024-01-01", "2024-01-02"]
    assert all(r.size_bytes > 0 and r.file_name.endswith("snappy.parquet") for r in listed)
    assert landing.read_days(spark, str(tmp_path / "l"), first="2024-01-02").count() == 1


def test_optional_table(spark, frame, tmp_path):
    schema = "date string, value int"
    assert landing.read_optional(spark, str(tmp_path / "none"), schema, ["value"]).count() == 0
    frame([("2024-01-01", 1)], schema).write.parquet(str(tmp_path / "some"))
    assert landing.read_optional(spark, str(tmp_path / "some"), schema).count() == 1


def test_merge_days(frame):
    schema = "date string, value int"
    existing = frame([("2025-03-31", 1), ("2025-04-01", 2), ("2026-03-31", 3)], schema)
    new = frame([("2026-03-31", 9)], schema)
    merged = sinks.merge_days(existing, new, retention_days=365)
    assert sorted(map(tuple, merged.collect())) == [("2025-04-01", 2), ("2026-03-31", 9)]
    assert sorted(map(tuple, sinks.merge_days(merged, new, 365).collect())) == [("2025-04-01", 2), ("2026-03-31", 9)]
    assert sinks.merge_days(existing, new.where("false"), 365).count() == 3


def test_replace_days(spark, frame, tmp_path):
    path, schema = str(tmp_path / "r"), "date date, value int"
    day = lambda *rows: frame(rows, "d string, value int").selectExpr("cast(d as date) as date", "value")
    read = lambda: sorted((str(r.date), r.value) for r in spark.read.schema(schema).parquet(path).collect())
    sinks.replace_days(day(("2025-03-31", 1), ("2025-04-01", 2), ("2026-03-30", 3)), path)
    for _ in range(2):
        sinks.replace_days(day(("2026-03-31", 4)), path, retention_days=365)
        assert read() == [("2025-04-01", 2), ("2026-03-30", 3), ("2026-03-31", 4)]
    sinks.replace_days(day(("2026-03-30", 7)), path, retention_days=365)
    sinks.replace_days(day(("2026-03-30", 7)).where("false"), path, retention_days=365)
    assert read() == [("2025-04-01", 2), ("2026-03-30", 7), ("2026-03-31", 4)]


def test_quality_gate(spark, frame):
    good = frame([(1,)] * 3, "i int").select(
        *[(F.lit({"latitude": 40.0, "longitude": -3.5}.get(c, 1.5)) if c in S.FLOAT_COLUMNS else F.lit("x")).alias(c) for c in S.SNAPSHOT_COLUMNS]
    )
    severity = lambda df: {(r.check, r.column): (r.value, r.severity) for r in quality.gate_report(df).collect()}
    report = severity(good)
    assert report[("row_count", None)] == (3.0, "warning")
    assert {s for k, (_, s) in report.items() if k[0] != "row_count"} == {"ok"}
    quality.require_usable(good)
    bad = good.withColumn("diesel_a_price", F.lit(9.0)).withColumn("latitude", F.lit(60.0)).withColumn("hydrogen_price", F.lit(None).cast("double"))
    report = severity(bad)
    assert report[("out_of_range", "diesel_a_price")] == (3.0, "warning")
    assert report[("out_of_range", "latitude")] == (3.0, "warning")
    assert report[("null_pct", "hydrogen_price")] == (100.0, "info")
    quality.require_usable(bad)
    for broken in (good.drop("label"), good.where("false")):
        with pytest.raises(ValueError):
            quality.require_usable(broken)


def test_inventory_and_gaps(frame):
    stats = frame([("2024-01-01", 5), ("2024-01-03", 5), ("2024-02-01", 5), ("2024-03-01", 0)], "date string, record_count int")
    files = frame([("a", 1_100_000), ("b", 2_200_000)], "file_name string, size_bytes bigint")
    row = quality.data_inventory(stats, files).first()
    assert (row.num_days, row.num_months, row.num_years, row.total_size_bytes) == (3, 2, 1, 3_300_000)
    gaps = quality.missing_days(frame([("2024-01-01",), ("2024-01-03",), ("2024-01-05",)], "date string"))
    assert sorted(str(r.date) for r in gaps.collect()) == ["2024-01-02", "2024-01-04"]
    assert quality.missing_days(frame([], "date string")).count() == 0


def test_freshness(frame, files):
    snapshot = frame([("2024-01-09T06:00:00+00:00",)], "timestamp string")
    status = lambda f, **kw: tuple(quality.feed_freshness(f, snapshot, **kw).first())[:2]
    assert status(files, as_of="2024-01-09") == ("ok", "stored")
    assert status(files, as_of="2024-01-10") == ("stale", "stored")
    assert status(files, as_of="2024-01-10", live_active=True) == ("ok", "realtime")
    assert status(files.where("false"), as_of="2024-01-10") == ("error", "stored")


def test_geojson_files(spark, tmp_path):
    import gzip

    square = [[[0, 0], [0, 1], [1, 1], [1, 0], [0, 0]]]
    collection = {
        "type": "FeatureCollection",
        "features": [
            {"type": "Feature", "properties": {"COD_POSTAL": "28001", "name": "a"}, "geometry": {"type": "Polygon", "coordinates": square}},
            {"type": "Feature", "properties": {"COD_POSTAL": " ", "name": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [square, [[[5, 5], [5, 6], [6, 6]]]]}},
        ],
    }
    with gzip.open(tmp_path / "zips.geojson.gz", "wt") as f:
        json.dump(collection, f, indent=1)
    features = geojson.read_features(spark, str(tmp_path / "zips.geojson.gz"))
    rings = geojson.outer_rings(features, "name").collect()
    assert sorted((r.feature_idx, r.name, len(r.ring)) for r in rings) == [(0, "a", 5), (1, "b", 3), (1, "b", 5)]
    assert [r.zip_code for r in geojson.zip_features(features).collect()] == ["28001"]


def test_features_of_several_files_keep_apart(spark, tmp_path):
    ring = [[0, 0], [0, 1], [1, 1]]
    for name in ("a", "b"):
        feature = {"type": "Feature", "properties": {"COD_POSTAL": "28001", "name": name}, "geometry": {"type": "Polygon", "coordinates": [ring]}}
        (tmp_path / f"{name}.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature, feature]}))
    features = geojson.read_features(spark, str(tmp_path))
    assert len({r.feature_idx for r in features.collect()}) == 4
    last = geojson.outer_rings(features, "name").orderBy("feature_idx").collect()
    assert [r.name for r in last] == ["a", "a", "b", "b"]
    assert geojson.zip_features(features).first().feature_idx == last[-1].feature_idx


def test_only_day_folders_of_the_look_back_are_listed(spark, frame, tmp_path):
    root = tmp_path / "l"
    days = [f"2023-{m:02d}-{d:02d}" for m in range(1, 13) for d in range(1, 29)]
    for d in days:
        (root / f"dt={d}").mkdir(parents=True)
        (root / f"dt={d}" / f"s_{d}.parquet").write_bytes(b"x")
    (root / "dt=2023-12-30").mkdir()  # a folder without files
    (root / "dt=__HIVE_DEFAULT_PARTITION__").mkdir()
    root = str(root)
    name = lambda df: sorted(r.file_name for r in df.collect())
    assert landing.day_folders(spark, root) == ["2023-12-30", *reversed(days)]
    recent = landing.latest_stored_file(spark, root, as_of="2023-06-30")
    assert name(recent) == ["s_2023-06-28.parquet"]
    assert name(landing.latest_stored_file(spark, root, as_of="2024-06-30")) == ["s_2023-12-28.parquet"]
    assert name(landing.latest_stored_file(spark, str(tmp_path / "none"), as_of="2024-06-30")) == []
    assert name(landing.recent_stored_files(spark, root, 2)) == ["s_2023-12-27.parquet", "s_2023-12-28.parquet"]
    listed = landing.list_days(spark, root, ["2023-02-01", "2023-02-30"])
    assert len(listed.inputFiles()) == 1 and name(listed) == ["s_2023-02-01.parquet"]
