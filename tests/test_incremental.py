"""Streamed events, revisions, rejects, choices of factors and the nearest peat."""

from __future__ import annotations

import math
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberframe.operators import events as ev
from emberframe.operators import graph, priority
from emberframe.operators import raster as rs
from emberframe.sources import readers, writers
from emberframe.streaming import incremental, live

OBS = "obs_id long, latitude double, longitude double, acq_date string, acq_time int, frp double, satellite string, instrument string, confidence string, ts timestamp"
START = datetime(2024, 1, 1)


def observation(i, lat, lon, hours):
    at = START + timedelta(hours=hours)
    return (i, lat, lon, at.strftime("%Y-%m-%d"), at.hour * 100 + at.minute, 1.0, "N", "VIIRS", "n", at)


def clusters(rows):
    return {frozenset(r.obs_id for r in rows if r.cluster == c): c for c in {r.cluster for r in rows}}


def test_batches_in_any_order_give_the_same_events(spark, tmp_path):
    rng = random.Random(6)
    rows = [observation(i, rng.uniform(0, 0.25), rng.uniform(0, 0.25), rng.uniform(0, 1500)) for i in range(400)]
    rng.shuffle(rows)
    # two wide cells and two periods meet in the middle of the data; the last batch repeats rows of the first
    batches = [rows[:150], rows[150:151], rows[151:300], rows[300:] + rows[:40], []]
    path = str(tmp_path / "store")
    assert incremental.events(spark, path) is None
    for nth, batch in enumerate(batches):
        df = spark.createDataFrame(batch, OBS)
        incremental.fold(df, nth, path, 0.1)
        if nth == 2:
            incremental.fold(df, nth, path, 0.1)  # run again after a failure
    want = ev.clustered(spark.createDataFrame(rows, OBS), ref_lat=0.1).collect()
    assert clusters(incremental.members(spark, path).collect()) == clusters(want)
    assert incremental.events(spark, path).count() == len({r.cluster for r in want})


def test_one_detection_joins_two_stored_events(spark, tmp_path):
    path = str(tmp_path / "store")
    a, b, link = observation(5, 0.0, 0.0, 0), observation(9, 0.0, 0.03, 0), observation(7, 0.0, 0.015, 1)
    for nth, row in enumerate((a, b, link)):
        incremental.fold(spark.createDataFrame([row], OBS), nth, path, 0.0)
    assert {(r.obs_id, r.cluster) for r in incremental.members(spark, path).collect()} == {(5, 5), (7, 5), (9, 5)}


def test_revised_windows(spark, tmp_path):
    path, windows = str(tmp_path / "w"), readers.date_windows(spark, "2024-01-01", "2024-01-12", days=9)
    rows = lambda n: spark.createDataFrame([(n, f"2024-01-{d:02d}") for d in range(1, 13)], "version int, acq_date string")
    assert windows.count() == 3  # of five days at most
    writers.refresh_windows(rows(1), windows, path, "2024-01-12")
    writers.refresh_windows(rows(2), windows, path, "2024-01-14")
    got = {(r.acq_date[-2:], r.version) for r in spark.read.parquet(path).collect()}
    assert got == {(f"{d:02d}", 1 if d <= 5 else 2) for d in range(1, 13)}


def test_ledger(spark):
    windows = readers.date_windows(spark, "2024-01-01", "2024-01-20")
    tries = [(date(2024, 1, 1), 1, 0, None), (date(2024, 1, 6), 1, None, "a"), (date(2024, 1, 6), 2, 4, None), *((date(2024, 1, 11), k, None, f"e{k}") for k in (1, 2, 3)), (date(2024, 1, 11), 4, 9, None)]
    got = {r.window_start.day: (r.attempts, r.status, r.rows, r.error, r.final) for r in readers.fetch_ledger(windows, spark.createDataFrame(tries, "window_start date, attempt int, rows long, error string"), "2024-01-17").collect()}
    assert got == {1: (1, "ok", 0, None, True), 6: (2, "ok", 4, None, True), 11: (3, "failed", 0, "e3", False), 16: (0, "pending", 0, None, False)}


def test_rejects(spark, tmp_path):
    good = "1.5,100.5,330,0.4,0.4,2024-01-01,130,N,VIIRS,n,2,290,1.5,D" + "," * (readers.HEADER.count(",") - 13)
    (tmp_path / "a.csv").write_text(f"{readers.HEADER}\n{good}\n1.5,100.5\n{good.replace('1.5,', '95,', 1)}\n{good.replace(',130,', ',2561,')}\n")
    (tmp_path / "b.csv").write_text("Invalid key\n<html>\n")
    (tmp_path / "c.csv").write_text("")
    rows, rejects = readers.checked_detections(spark, str(tmp_path))
    assert [(r.latitude, r.longitude, r.acq_time) for r in rows.collect()] == [(1.5, 100.5, 130)]
    assert sorted((r.file[-5:], r.reason) for r in rejects.collect()) == [("a.csv", "no coordinates"), ("a.csv", "unreadable time"), ("a.csv", "wrong number of fields"), ("b.csv", "not a table of detections"), ("b.csv", "not a table of detections")]


def test_snapshots_swap_whole(spark, tmp_path):
    path = str(tmp_path / "s")
    assert live.served(spark, path) is None
    rows = spark.createDataFrame([observation(1, 0.0, 0.0, 0), observation(2, 0.0, 0.0, 30)], OBS)
    live.refresh_snapshot(rows, path, "2024-01-01 12:00:00")
    assert {r.obs_id for r in live.served(spark, path).collect()} == {1, 2}
    rows.write.parquet(f"{path}/snapshots/left-behind")
    live.refresh_snapshot(rows.where("false"), path, "2024-01-02 12:00:00")
    assert {r.obs_id for r in live.served(spark, path).collect()} == {2}


def test_supplied_factors_beat_derived(spark):
    e = spark.createDataFrame([(1,), (2,)], "event long")
    factors = lambda *r: spark.createDataFrame(list(r), "event long, factor string, signal double, quality double")
    supplied, derived = factors((1, "peat", 0.1, 0.5), (2, "peat", None, 1.0)), factors((1, "peat_involvement", 0.9, 1.0), (2, "peat_involvement", 0.8, 0.7))
    got = {r.event: (r.signal, r.quality) for r in priority.components(e, supplied, derived).where("factor = 'peat_involvement'").collect()}
    assert got == {1: (0.1, 0.5), 2: (0.8, 0.7)}
    with pytest.raises(Exception, match="unknown factor"):
        priority.components(e, factors((1, "weather", 0.1, 0.5))).collect()
    label = lambda x: spark.range(1).select(priority.label_signal(F.lit("propagation_uncertainty"), F.lit(x)).alias("s")).first().s
    assert label(" weak ") == 0.7
    for bad in ("MAYBE", "NOT_EVALUATED"):
        with pytest.raises(Exception, match="unknown label"):
            label(bad)


def test_chosen_wind(spark):
    t = lambda *r: spark.createDataFrame(list(r), "event long, wind_from double")
    got = {r.event: (r.wind_from, r.wind_source) for r in graph.chosen_wind(t((1, 370.0), (2, None)), t((1, 5.0), (2, 6.0)), t((2, 7.0), (3, 8.0))).collect()}
    assert got == {1: (10.0, "explicit"), 2: (6.0, "result"), 3: (8.0, "samples")}


def test_membership_problems(spark):
    rows = [(e, *observation(10 * e + i, 0.1 * e, 0.1 * i, i)) for e in range(5) for i in range(3)]
    m = spark.createDataFrame(rows, f"event long, {OBS}")
    stored = ev.checksummed(m.where("event <> 4"))
    now = m.where("event <> 3 and obs_id <> 11").withColumn("latitude", F.when(F.col("obs_id") == 21, 9.0).otherwise(F.col("latitude")))
    assert {(r.event, r.problem, r.stored, r.found) for r in ev.membership_problems(stored, now).collect()} == {(1, "count", 3, 2), (2, "members", 3, 3), (3, "no_members", 3, 0), (4, "unknown_event", 0, 3)}


def test_nearest_peat_against_every_cell(spark):
    rng = random.Random(9)
    t = rs.Transform(10.0, 20.0, 0.01, 300, 300)
    peat = {(rng.randrange(300), rng.randrange(300)) for _ in range(25)}
    raster = spark.createDataFrame([(r, c, rng.choice(rs.PEAT)) for r, c in peat], "row long, col long, value int")
    points = [(i, rng.uniform(6.5, 10.5), rng.uniform(19.5, 23.5)) for i in range(60)] + [(60, None, 20.0)]

    def km(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(h))

    got = {r.event: r.peat_distance_km for r in rs.distance_to_peat(spark.createDataFrame(points, "event long, lat double, lon double"), raster, t).collect()}
    for i, lat, lon in points[:60]:
        on = (round((10.0 - lat) / 0.01), round((lon - 20.0) / 0.01)) in peat
        d = min(km(lat, lon, 10.0 - r * 0.01, 20.0 + c * 0.01) for r, c in peat)
        assert got[i] == (0.0 if on else None if d > rs.SEARCH_KM else pytest.approx(d, abs=0.006))
    assert got[60] is None and len(got) == 61
