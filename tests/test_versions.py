"""Tables by versions: concurrent writers, readers, failed writes, retention; and what follows them by day."""

import itertools
import random
import threading

import pytest
from pyspark.sql import functions as F

from pricegrid.operators import brands, distinct, rollups
from pricegrid.plans import jobs
from pricegrid.sources import sinks, versions

SCHEMA = "date date, writer string, value int"


def days(spark, writer, numbers, value=0):
    return spark.createDataFrame([(f"2024-01-{n:02d}", writer, value) for n in numbers], "date string, writer string, value int").select(
        F.col("date").cast("date"), "writer", "value"
    )


def seen(spark, path, version=None):
    return sorted((r.date.day, r.writer, r.value) for r in versions.read(spark, path, days(spark, "", []).schema, version).collect())


def test_a_version_is_whole_and_stays_readable(spark, tmp_path):
    path = str(tmp_path / "table")
    assert seen(spark, path) == [] and versions.manifest(spark, path) is None
    assert versions.commit(days(spark, "a", range(1, 6)), path) == 5
    assert versions.commit(days(spark, "b", [5, 6]), path) == 2
    assert versions.commit(days(spark, "c", []), path) == 0  # nothing new is no version
    first, second = [(d, "a", 0) for d in range(1, 6)], [*[(d, "a", 0) for d in range(1, 5)], (5, "b", 0), (6, "b", 0)]
    assert seen(spark, path, 0) == first and seen(spark, path) == second
    assert versions.changed_days(spark, path, 0) == ({"2024-01-05", "2024-01-06"}, 1)
    assert versions.commit(days(spark, "d", [9]), path, retention_days=4) == 1
    assert seen(spark, path) == [(6, "b", 0), (9, "d", 0)]
    assert versions.vacuum(spark, path, keep=1, grace_seconds=3600) == 0  # too young
    assert versions.vacuum(spark, path, keep=1, grace_seconds=-5) > 0
    assert seen(spark, path) == [(6, "b", 0), (9, "d", 0)] and versions.versions(spark, path) == [2]
    assert versions.changed_days(spark, path, 0) is None


def test_a_failed_write_leaves_the_last_version(spark, tmp_path):
    path = str(tmp_path / "table")
    versions.commit(days(spark, "a", [1, 2]), path)
    broken = days(spark, "b", [2, 3]).withColumn("value", F.when(F.dayofmonth("date") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="no"):
        versions.commit(broken, path)
    assert seen(spark, path) == [(1, "a", 0), (2, "a", 0)]


def test_writers_at_a_time_each_get_a_version_and_none_is_mixed(spark, tmp_path):
    path, rounds = str(tmp_path / "table"), 4
    versions.commit(days(spark, "none", range(1, 9)), path)
    problems, found, over = [], [], threading.Event()

    def write(name, own):
        try:
            for k in range(rounds):
                versions.commit(days(spark, name, [*own, 3, 4], k), path)
        except Exception as problem:  # noqa: BLE001
            problems.append(problem)

    def read():
        while not over.is_set():
            found.append(seen(spark, path))

    writers = [threading.Thread(target=write, args=a) for a in (("a", [1, 2]), ("b", [5, 6]))]
    reader = threading.Thread(target=read)
    reader.start()
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    over.set()
    reader.join()
    assert not problems and versions.versions(spark, path) == list(range(2 * rounds + 1))
    for rows in [*found, *[seen(spark, path, v) for v in range(2 * rounds + 1)]]:
        by = {d: (w, k) for d, w, k in rows}
        assert sorted(by) == list(range(1, 9)) and len(rows) == 8  # every day once
        assert by[1] == by[2] and by[5] == by[6] and by[3] == by[4]  # a write is seen whole
        assert by[3] in (by[1], by[5])
    last = {d: (w, k) for d, w, k in seen(spark, path)}
    assert last[1] == ("a", rounds - 1) and last[5] == ("b", rounds - 1)  # no writer lost its days


def test_publishers_at_a_time(spark, tmp_path):
    path = str(tmp_path / "table")
    writers = [threading.Thread(target=lambda n=n: sinks.publish(days(spark, n, range(1, 4)), path)) for n in "abc"]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert versions.versions(spark, path)[-1] == 2
    assert len({r.writer for r in sinks.read_published(spark, path).collect()}) == 1


PROVINCE = "date date, fuel_type string, province string, avg_price double, station_count bigint"


def daily(spark, seed, numbers):
    r = random.Random(seed)
    rows = [(f"2024-01-{n:02d}", f, p, round(r.uniform(1, 2), 4), r.randrange(1, 9)) for n, f, p in itertools.product(numbers, ("a", "b"), ("x", "y", "z")) if r.random() < 0.8]
    return spark.createDataFrame(rows, PROVINCE.replace("date date", "date string")).withColumn("date", F.col("date").cast("date"))


def rows_of(df):
    return sorted((r.day_of_week, r.fuel_type, r.province, round(r.sum_price, 4), r.count_days, r.min_daily_avg, r.max_daily_avg) for r in df.collect())


def test_weekday_statistics_follow_late_repeated_and_lost_days(spark, tmp_path):
    table, path = str(tmp_path / "daily"), str(tmp_path / "weekdays")
    steps = [(1, [10, 11, 12], None), (2, [5, 6, 12], None), (2, [5, 6, 12], None), (3, range(1, 20), None), (4, [17, 24], 10), (5, [18], None)]
    for seed, numbers, retention in steps:
        versions.commit(daily(spark, seed, numbers), table, retention_days=retention)
        jobs.follow_weekdays(spark, table, path, daily(spark, 1, [1]).schema)
        whole = versions.read(spark, table, daily(spark, 1, [1]).schema)
        assert rows_of(sinks.read_published(spark, path)) == rows_of(rollups.weekday_stats_from_daily(whole))
    # Without the version that was noted, everything is made again.
    versions.commit(daily(spark, 9, [3]), table)
    versions.vacuum(spark, table, keep=1, grace_seconds=-5)
    jobs.follow_weekdays(spark, table, path, daily(spark, 1, [1]).schema)
    assert rows_of(sinks.read_published(spark, path)) == rows_of(rollups.weekday_stats_from_daily(versions.read(spark, table, daily(spark, 1, [1]).schema)))


ENTITY = "timestamp string, eess_id string, label string, province string, municipality_id string, municipality string, locality string, province_id string, ccaa_id string"


def visits(spark, seed, numbers, n=60):
    r = random.Random(seed)
    pick = lambda k: r.choice([None, *range(k)])
    rows = [(f"2024-{1 + m // 28:02d}-{1 + m % 28:02d}T06:00:00+00:00", *[None if (v := pick(k)) is None else str(v) for k in (90, 7, 5, 9, 9, 12, 4, 3)]) for m in numbers for _ in range(n)]
    return spark.createDataFrame(rows, ENTITY)


def test_counts_of_months_from_stored_days_are_those_of_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(distinct, "CHAINS", 2)
    root, everything = str(tmp_path / "states"), visits(spark, 1, range(20, 36))
    for low, high in ((28, 36), (20, 30), (20, 30)):
        part = everything.where((F.datediff(F.to_date("timestamp"), F.lit("2024-01-01").cast("date"))).between(low + (low >= 28) * 3, high + 9))
        jobs.update_ingestion_states(part, root)
    jobs.update_ingestion_states(everything, root)
    got = distinct.counts_from_states(jobs.stored_states(spark, root), F.trunc("date", "month"))
    month = F.trunc(F.to_date("timestamp"), "month").alias("period")
    place = F.when(F.col("locality").isNotNull(), F.struct("province_id", "municipality_id", "locality"))
    want = everything.groupBy(month).agg(
        *[F.count_distinct(place if name == "unique_localities" else c[0]).alias(name) for name, c in distinct.ENTITIES.items()]
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    places = sinks.read_published(spark, f"{root}/dictionary")
    assert places.count() == places.select("kind", "chain", "number").distinct().count() == places.select("kind", "value").distinct().count()
    assert "Expand" not in got._jdf.queryExecution().toString()


def test_equal_means_are_not_below_each_other(spark):
    prices = [0.1, 0.2, 0.3, 0.7, 1.1]
    market = spark.createDataFrame(
        [(f"2024-01-{d:02d}", "zip_code", "1", "diesel_a_price", "b", 5, sum(prices), 5, sum(reversed(prices)) + 1e-15 * d) for d in range(1, 20)],
        "dt string, geo_level string, geo_value string, fuel_type string, brand string, n int, total double, market_n int, market_total double",
    )
    assert brands.price_comparison_from(market).first().days_below_market_pct == 0.0
