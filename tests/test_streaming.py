"""Streaming refresh and the jobs: idempotence, late data, refusal of bad input."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from pricegrid.plans import jobs
from pricegrid.sources import landing, sinks
from pricegrid.streaming import freshness, refresh

ROW = "timestamp string, sale_type string, label string, province string, zip_code string, eess_id string, province_id string, municipality_id string, municipality string, locality string, ccaa_id string, diesel_a_price double"
FUELS = ["diesel_a_price"]


def snapshot(frame, stamp, price, n=12, private=2):
    return frame([(stamp, "r" if i < private else "p", "repsol", "madrid", "28001", str(i), "28", "1", "m", "l", "13", price) for i in range(n)], ROW)


@pytest.fixture
def folders(tmp_path):
    return [str(tmp_path / n) for n in ("landing", "out", "checkpoint")]


def test_live_snapshot(spark, frame, folders):
    landed, live, checkpoint = folders

    def run():
        refresh.refresh_live_snapshot(spark, landed, live, checkpoint, min_rows=10, once=True).awaitTermination()
        rows = refresh.read_live_snapshot(spark, live).collect()
        return {r.timestamp[:13] for r in rows}, len(rows)

    landing.write_snapshot(snapshot(frame, "2024-01-01T06:00:00+00:00", 1.5), landed)
    landing.write_snapshot(snapshot(frame, "2024-01-01T08:00:00+00:00", 1.5), landed)
    assert run() == ({"2024-01-01T08"}, 10)
    landing.write_snapshot(snapshot(frame, "2024-01-02T06:00:00+00:00", 1.5, n=5), landed)  # too small
    assert run() == ({"2024-01-01T08"}, 10)
    landing.write_snapshot(snapshot(frame, "2023-12-31T06:00:00+00:00", 1.5), landed)  # older than stored
    assert run() == ({"2024-01-01T08"}, 10)
    landing.write_snapshot(snapshot(frame, "2024-01-02T09:00:00+00:00", 1.5, n=15), landed)
    assert run() == ({"2024-01-02T09"}, 13)


def test_rollup_stream(spark, frame, folders):
    landed, root, checkpoint = folders

    def run():
        refresh.refresh_rollups(spark, landed, root, checkpoint, FUELS, once=True).awaitTermination()
        rows = jobs.stored_rollups(spark, root)["province_daily_stats"].collect()
        return sorted((str(r.date), r.avg_price, r.station_count) for r in rows)

    landing.write_snapshot(snapshot(frame, "2024-01-01T06:00:00+00:00", 1.5), landed)
    assert run() == [("2024-01-01", 1.5, 12)]
    landing.write_snapshot(snapshot(frame, "2024-01-02T06:00:00+00:00", 1.6), landed)
    landing.write_snapshot(snapshot(frame, "2024-01-01T18:00:00+00:00", 1.7), landed)  # newer snapshot of a past day
    assert run() == [("2024-01-01", 1.7, 12), ("2024-01-02", 1.6, 12)]
    landing.write_snapshot(snapshot(frame, "2024-01-01T03:00:00+00:00", 9.9), landed)  # late and outdated
    assert run() == [("2024-01-01", 1.7, 12), ("2024-01-02", 1.6, 12)]
    week = sinks.read_published(spark, f"{root}/day_of_week_stats").where("province = 'madrid'").collect()
    assert sorted((r.day_of_week, r.sum_price) for r in week) == [(0, 1.7), (1, 1.6)]


def test_daily_job_is_idempotent_and_reports_failures(spark, frame, folders):
    root = folders[1]
    rows = snapshot(frame, "2024-01-01T06:00:00+00:00", 1.5)
    first = jobs.run_daily_rollups(rows, root, FUELS).collect()
    again = jobs.run_daily_rollups(rows, root, FUELS).collect()
    assert first == again and {r.status for r in first} == {"ok"}
    assert [r.output_rows for r in first] == [1, 1, 1, 1, 2]
    broken = jobs.run_daily_rollups(rows.withColumn("label", F.raise_error(F.lit("no label"))), root, FUELS).collect()
    assert {r.task: r.status for r in broken} == {
        "province_daily_stats": "ok", "zip_code_daily_stats": "ok", "brand_daily_stats": "failed",
        "daily_ingestion_stats": "failed", "day_of_week_stats": "ok",
    }


def test_publish_keeps_the_last_good_rollup(spark, frame, folders, tmp_path):
    path = folders[1]
    good = frame([("2024-01-01", "28001", "f", 1.0, 1.0, 1.0, 1)], "date string, zip_code string, fuel_type string, avg_price double, min_price double, max_price double, station_count int")
    assert refresh.publish_if_valid(good, path)  # an older rollup without province is upcast
    assert not refresh.publish_if_valid(None, path)
    assert not refresh.publish_if_valid(good.where("false"), path)
    assert not refresh.publish_if_valid(good.drop("avg_price"), path)
    assert sinks.read_published(spark, path).count() == 1
    # A write that fails half-way leaves the last good rollup in place.
    failing = good.withColumn("avg_price", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        sinks.publish(failing, path)
    assert sinks.read_published(spark, path).first().avg_price == 1.0
    for price in (2.0, 3.0, 4.0):
        refresh.publish_if_valid(good.withColumn("avg_price", F.lit(price)), path)
    assert sinks.read_published(spark, path).first().avg_price == 4.0
    assert len(list((tmp_path / "out").iterdir())) <= 3


def test_a_lost_checkpoint_does_not_freeze_the_snapshot(spark, frame, folders):
    landed, live, checkpoint = folders
    for day, checkpoint_name in (("01", "a"), ("02", "a"), ("05", "b"), ("09", "c")):
        landing.write_snapshot(snapshot(frame, f"2024-01-{day}T06:00:00+00:00", 1.5), landed)
        refresh.refresh_live_snapshot(spark, landed, live, checkpoint + checkpoint_name, min_rows=10, once=True).awaitTermination()
        assert {r.timestamp[:10] for r in refresh.read_live_snapshot(spark, live).collect()} == {f"2024-01-{day}"}


def test_days_are_pruned_by_folder(spark, frame, folders):
    for day in ("01", "02", "03"):
        landing.write_snapshot(snapshot(frame, f"2024-01-{day}T06:00:00+00:00", 1.5), folders[0])
    rows = landing.read_days(spark, folders[0], "2024-01-02", "2024-01-02")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "2024-01-02" in plan.split("PartitionFilters")[1].split("]")[0] and rows.count() == 12


def test_live_or_stored(frame):
    live, stored = frame([("2024-01-01T10:00:00+00:00", "live")], "timestamp string, s string"), frame([("2024-01-01T05:00:00+00:00", "stored")], "timestamp string, s string")
    choose = lambda live, at: [r.s for r in landing.prefer_live(live, stored, at).collect()]
    assert choose(live, "2024-01-01 10:20:00") == ["live"]
    assert choose(live, "2024-01-01 10:20:01") == ["stored"]
    assert choose(live.where("false"), "2024-01-01 10:00:00") == ["stored"]


def test_feed_turns_stale_when_its_source_pauses(spark, frame, folders):
    landed, states, checkpoint = folders
    now = datetime.datetime.now(datetime.timezone.utc)
    stamp = lambda seconds: (now - datetime.timedelta(seconds=seconds)).isoformat(timespec="seconds")
    landing.write_snapshot(snapshot(frame, stamp(0), 1.5), landed)
    snapshot(frame, "broken", 1.5).write.parquet(f"{landed}/dt=2024-01-01")
    landing.write_snapshot(snapshot(frame, stamp(5000), 1.5).withColumn("label", F.lit("bp")), landed)
    changes = freshness.feed_states(refresh.landing_stream(spark, landed), F.col("label"), interval_seconds=20)
    running = freshness.follow_feeds(changes, states, checkpoint, every_seconds=1)

    def seen():
        return {r.feed: (r.status, r.newest_ms) for r in freshness.read_states(spark, states).collect()}

    def wait(status, limit=90):
        end = time.time() + limit
        while time.time() < end and seen().get("repsol", ("", 0))[0] != status:
            assert running.exception() is None
            time.sleep(0.5)
        return seen()

    ms = lambda seconds: int(now.timestamp() - seconds) * 1000
    try:
        first = wait("live")
        assert {f: s for f, (s, _) in first.items()} == {"repsol": "live", "bp": "stale"}
        live, stored = snapshot(frame, stamp(0), 1.5, n=3), snapshot(frame, stamp(9000), 1.5, n=5)
        choose = lambda: freshness.prefer_live_feed(live, stored, freshness.read_states(spark, states), "repsol").count()
        assert choose() == 3
        assert wait("stale")["repsol"] == ("stale", first["repsol"][1])  # nothing new came; the timer did it
        assert first["repsol"][1] in (ms(0), ms(0) + 1000) and choose() == 5
    finally:
        running.stop()
