"""Readers, writers and the live feed on small files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from emberframe.operators import events, priority, register, triage
from emberframe.sources import readers, writers
from emberframe.streaming import live

HEADER = "latitude,longitude,bright_ti4,scan,track,acq_date,acq_time,satellite,instrument,confidence,version,bright_ti5,frp,daynight,type\n"


def row(lat, lon, day, time, frp="1.5", conf="n"):
    return f"{lat},{lon},300,0.4,0.4,{day},{time},N,VIIRS,{conf},2,290,{frp},N,0\n"


def test_detections_and_ledger(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + row(-1.0, 100.0, "2024-01-01", 455) + row("x", 100.0, "2024-01-02", 1) + row(5.0, 120.0, "2024-01-03", 2359))
    d = readers.detections(spark, str(tmp_path / "a.csv"))
    assert sorted(str(r.ts) for r in d.collect()) == ["2024-01-01 04:55:00", "2024-01-03 23:59:00"]
    assert readers.detections(spark, str(tmp_path / "a.csv"), bbox=(99, -2, 101, 0), until="2024-01-02").count() == 1
    w = readers.date_windows(spark, "2024-01-01", "2024-01-07").collect()
    assert [(str(r[0]), str(r[1])) for r in w] == [("2024-01-01", "2024-01-05"), ("2024-01-06", "2024-01-07")]
    with pytest.raises(ValueError):
        readers.date_windows(spark, "2024-01-02", "2024-01-01")
    (tmp_path / "bad.csv").write_text("Invalid key\n")
    with pytest.raises(ValueError):
        readers.detections(spark, str(tmp_path / "bad.csv"))


def test_nested_json_readers(spark, tmp_path):
    (tmp_path / "day.json").write_text(json.dumps({"properties": {"parameter": {"T2M": {"20240101": 20.5, "20240102": -999}, "WS10M": {"20240101": 3}}}}))
    got = {str(r.date): (r.T2M, r.WS10M) for r in readers.daily_weather(spark, str(tmp_path / "day.json"), ["T2M", "WS10M"]).collect()}
    assert got == {"2024-01-01": (20.5, 3.0), "2024-01-02": (None, None)}
    (tmp_path / "hour.json").write_text(json.dumps({"grid_id": 1, "latitude": 1.0, "longitude": 2.0, "start": 0, "end": 7200, "interval": 3600, "rain": [0.5, 1.5, 9.0]}))
    assert [r.rain for r in readers.hourly_weather(spark, str(tmp_path / "hour.json"), ["rain"]).orderBy("ts").collect()] == [0.5, 1.5]
    page = {"features": [{"id": "s1", "properties": {"datetime": "2024-01-01T00:00:00Z", "eo:cloud_cover": 40, "sat:orbit_state": "asc"}, "bbox": [1, 2, 3, 4], "links": [{"rel": "self", "href": "h"}]}], "links": []}
    (tmp_path / "page.json").write_text(json.dumps(page))
    from emberframe.operators.scenes import scene_fields

    (s,) = scene_fields(readers.catalogue(spark, str(tmp_path / "page.json"))).collect()
    assert (s.scene_id, s.cloud, s.bbox, s.orbit_state, s.href) == ("s1", 40.0, [1.0, 2.0, 3.0, 4.0], "asc", "h")
    page["links"] = [{"rel": "next"}]
    (tmp_path / "page.json").write_text(json.dumps(page))
    with pytest.raises(Exception, match="cut off"):
        readers.catalogue(spark, str(tmp_path / "page.json")).collect()
    (tmp_path / "w.tfw").write_text("0,01\n0\n0\n-0,01\n115,0\n-2,4\n")
    assert readers.world_file(spark, str(tmp_path / "w.tfw")).first().lat == -2.4
    (tmp_path / "g.json").write_text(json.dumps({"2024-01-01": {"features": [{"geometry": {"coordinates": [100.0, -1.0]}, "properties": {"acq_datetime": "2024-01-01T04:55:00Z", "frp": 2.0, "confidence": "nominal"}}]}}))
    assert readers.geojson_by_date(spark, str(tmp_path / "g.json")).first().acq_time == 455


def test_idempotent_and_resumable_sinks(spark, tmp_path):
    e = spark.createDataFrame([(1, "weather", "E1"), (1, "peat", "E2"), (2, "weather", "E3")], "audit long, category string, evidence_id string")
    writers.write_evidence(e, str(tmp_path / "ev"))
    writers.write_evidence(e.where("audit = 1 and category = 'weather'").withColumn("evidence_id", F.lit("E9")), str(tmp_path / "ev"))
    assert sorted(r.evidence_id for r in spark.read.parquet(str(tmp_path / "ev")).collect()) == ["E2", "E3", "E9"]
    done = spark.createDataFrame([(1, "ok", None, 1), (2, "error", "x", 1), (2, "error", "y", 2)], "event long, status string, error string, tried_at long")
    keys = spark.createDataFrame([(1,), (2,), (3,)], "event long")
    assert sorted(r.event for r in writers.to_do(keys, done).collect()) == [2, 3]
    assert {r.event: r.error for r in writers.latest(done).collect()} == {1: None, 2: "y"}
    old = spark.createDataFrame([(1, "weather", "a"), (1, "peat", "b"), (2, "weather", "c")], "event long, category string, evidence_id string")
    new = spark.createDataFrame([(1, "weather", "z")], "event long, category string, evidence_id string")
    once = register.folded(old, new, ["weather"])
    assert sorted(r.evidence_id for r in once.collect()) == ["b", "c", "z"]
    assert sorted(r.evidence_id for r in register.folded(once, new, ["weather"]).collect()) == ["b", "c", "z"]
    files = spark.createDataFrame([("p1",)], "path string")
    side = spark.createDataFrame([(1, "a1", "p1"), (1, "a2", "p2")], "event long, asset_id string, path string")
    assert writers.image_manifest(side, files).first()[1:] == (["a1"], ["a2"])


def test_live_feed(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.csv").write_text(HEADER + row(-1.0, 100.0, "2024-01-01", 455) + row(-1.0, 100.0, "2024-01-01", 455) + row(95.0, 100.0, "2024-01-01", 500) + row(-1.0, 100.1, "2024-01-01", 600, frp="", conf=""))
    (src / "2.csv").write_text(HEADER + row(-1.0, 100.0, "2024-01-01", 455) + row(-1.2, 100.0, "2024-01-02", 1200))
    q = live.deduplicated(live.feed(spark, str(src))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 3 and got.where("confidence = 'unknown' and frp = 0").count() == 1
    assert live.within_day(got, "2024-01-02 06:00:00").count() == 2
    (src / "3.csv").write_text("Invalid MAP_KEY\n")
    q = live.feed(spark, str(src)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    with pytest.raises(Exception):
        q.awaitTermination()


def test_fold_into_events_tells_what_merged(spark):
    from tests.test_events import obs

    all_ = obs(spark, [(0.0, 100.0, "2024-01-01", 100, 1.0), (0.03, 100.0, "2024-01-01", 100, 1.0), (2.0, 100.0, "2024-01-01", 100, 1.0), (0.015, 100.0, "2024-01-01", 200, 1.0)])
    first = all_.where("obs_id < 3")
    known = first.join(events.clustered(first, ref_lat=1.0), "obs_id").join(events.reconstruct(first, ref_lat=1.0).select("cluster", "event_id"), "cluster").drop("cluster")
    after, moved = live.fold_into_events(all_.where("obs_id = 3"), known, 1.0)
    by = {r.obs_id: r.event_id for r in after.collect()}
    assert by[0] == by[1] == by[3] != by[2] and len(by) == 4
    assert {r.new_id for r in moved.collect()} == {by[0]} and moved.count() == 2


def test_folding_batches_equals_a_rebuild(spark):
    import random

    from tests.test_events import obs

    rng = random.Random(8)
    all_ = obs(spark, [(rng.uniform(0, 0.2), 100 + rng.uniform(0, 0.2), f"2024-01-0{rng.randint(1, 6)}", rng.randint(0, 23) * 100, 1.0) for _ in range(120)])
    known = all_.where("false").withColumn("event_id", F.lit("x"))
    for k in range(3):
        known, _ = live.fold_into_events(all_.where(F.col("obs_id") % 3 == k), known, 0.1)
        known = spark.createDataFrame(known.collect(), known.schema)
    whole = all_.join(events.clustered(all_, ref_lat=0.1), "obs_id").join(events.reconstruct(all_, ref_lat=0.1).select("cluster", "event_id"), "cluster")
    assert {(r.obs_id, r.event_id) for r in known.collect()} == {(r.obs_id, r.event_id) for r in whole.collect()}


def test_rules_and_bands(spark):
    facts = spark.createDataFrame([(1, 1.0, 25.0, 3.0), (2, None, None, None)], "event long, mean_confidence double, max_frp double, observation_count double")
    d = {r.event: r for r in triage.decisions(triage.rule_evaluations(facts)).collect()}
    assert (d[1].fire_score, d[1].state) == (6, "LIKELY_FIRE") and (d[2].state, len(d[2].missing_rules)) == ("AMBIGUOUS", 10)
    ev = spark.createDataFrame([(1,), (2,), (3,)], "event long")
    f = spark.createDataFrame([(1, "validity", 1.0, 1.0), (1, "sufficiency", 0.6, 1.0), (2, "validity", 0.5, 1.0), (2, "sufficiency", 0.6, 1.0)], "event long, factor string, signal double, quality double")
    p = {r.event: (r.score, r.priority) for r in priority.priorities(priority.components(ev, f)).collect()}
    assert p == {1: (21.0, "HIGH"), 2: (13.5, "MEDIUM"), 3: (0.0, "MEDIUM")}
    bad = spark.createDataFrame([(1, "company", 1.0, 1.0)], f.schema)
    with pytest.raises(Exception, match="not allowed"):
        priority.components(ev, bad).collect()
    with pytest.raises(ValueError):
        register.page(ev, "event", limit=0)


def test_many_pages_land_in_few_files(spark, tmp_path, monkeypatch):
    from emberframe.plans import register_queries

    monkeypatch.setattr(register_queries, "_folder", lambda _: str(tmp_path / "landed"))
    table = spark.range(3000).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size"))
    table.write.parquet(str(tmp_path / "part.parquet"))
    assert register_queries.landed_catalogue(spark, str(tmp_path)).count() > 0
    assert len(list((tmp_path / "landed").rglob("part-*"))) <= 8  # 300 pages
    rows = readers.catalogue(spark, str(tmp_path / "landed"), lines=True)
    assert rows.count() == 3000


def test_served_snapshot_lands_three_files_unsorted(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    from emberframe.plans import register_queries

    by, real = [], DataFrameWriter.partitionBy
    monkeypatch.setattr(register_queries, "_folder", lambda _: str(tmp_path))
    monkeypatch.setattr(DataFrameWriter, "partitionBy", lambda self, *c: (by.append(c), real(self, *c))[1])
    (got,) = register_queries.served_snapshot(spark, "/root/testdata/sf0.001").collect()
    assert got["rows"] > 0 and str(got["stored_at"]) == "2024-01-31 12:00:00" and got["fresh"] and not got["fresh_later"]
    assert len(list((tmp_path / "landed").rglob("*.parquet"))) == 3 and not by
