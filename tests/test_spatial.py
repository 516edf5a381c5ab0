"""Range joins: what goes to the cells around is never broadcast."""

import pytest
from pyspark.sql import functions as F

from emberframe.operators import triage
from emberframe.operators.spatial import near, pairs_within


def _plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def _points(spark, n=40):
    i = F.col("id")
    at = F.timestamp_seconds(F.lit(1704067200) + i * 7200)
    return spark.range(n).select(i.alias("obs_id"), (i % 7).alias("event"), (i % 5 * 0.07).alias("latitude"), (i % 3 * 0.06 + 10).alias("longitude"), (i * 0.3).alias("x_km"), (i % 4 * 0.5).alias("y_km"), at.alias("ts"))


def test_small_tables_are_not_broadcast_once_spread(spark):
    p = _points(spark)
    q = p.select(*(F.col(c).alias(f"{c}_2") for c in ("obs_id", "latitude", "longitude", "ts")))
    at = ("latitude", "longitude"), ("latitude_2", "longitude_2")
    plans = [near(p, q, 10.0, *at), near(p, q, 10.0, *at, hours=24.0, left_in=("ts", "ts"), right_in=("ts_2", "ts_2")), pairs_within(p, 2.0), pairs_within(p, 2.0, 72.0), pairs_within(p, 2.0, 72.0, of=p)]
    for rows in plans:
        assert "BroadcastHashJoin" not in _plan(rows) and "SortMergeJoin" in _plan(rows)


def test_nearby_detections_equal_all_pairs(spark):
    from emberframe.functions.geo import haversine_km

    p = _points(spark)
    e = p.groupBy("event").agg(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"), F.min("ts").alias("first"), (F.min("ts") + F.expr("INTERVAL 9 HOURS")).alias("last"))
    hour = F.expr("INTERVAL 24 HOURS")
    o = p.select(F.col("event").alias("other"), "latitude", "longitude", "ts")
    met = e.crossJoin(o).where((F.col("event") != F.col("other")) & F.col("ts").between(F.col("first") - hour, F.col("last") + hour) & (haversine_km(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude")) <= 10))
    want = {r["event"]: r["count"] for r in met.groupBy("event").count().collect()}
    got = {r["event"]: r["nearby_detection_count"] for r in triage.nearby_detections(e, p).collect()}
    assert got == {r["event"]: want.get(r["event"], 0) for r in e.collect()} and sum(got.values()) > 0


def test_scenes_are_not_broadcast_once_spread(spark, monkeypatch):
    from emberframe.operators import scenes

    plans, real = [], scenes.materialise

    def seen(rows):
        plans.append(_plan(rows))
        return real(rows)

    monkeypatch.setattr(scenes, "materialise", seen)
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600)
    box = F.struct(F.lit(9.0).alias("west"), F.lit(-1.0).alias("south"), F.lit(11.0).alias("east"), F.lit(1.0).alias("north"))
    held = spark.range(20).select(F.col("id").alias("scene_id"), F.lit("S1").alias("sensor"), at.alias("acquired"), F.lit(1.0).alias("cloud"), box.alias("box"), F.lit(None).cast("array<array<array<array<double>>>>").alias("polygons"))
    events = spark.range(5).select(F.col("id").alias("event"), F.lit(0.0).alias("lat"), F.lit(10.0).alias("lon"), at.alias("first"), at.alias("last"))
    assert scenes.select_scenes(events, held).count() == 10
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


@pytest.mark.parametrize(("spread", "lat", "group_rows"), [(0.3, 0.0, 1 << 18), (0.3, 0.0, 60), (0.5, 60.0, 1 << 18), (0.0, 10.0, 1 << 18), (0.05, 89.95, 1 << 18)])
def test_detections_around_equal_all_pairs(spark, monkeypatch, spread, lat, group_rows):
    from emberframe.functions.geo import haversine_km
    from emberframe.operators import blocks

    monkeypatch.setattr(blocks, "LEAF_ROWS", 8)
    i = F.col("obs_id")
    p = spark.range(900).select(F.col("id").alias("obs_id"), F.when(F.col("id") % 50 != 7, F.col("id") % 120).alias("event"), (F.pmod(F.col("id") * 7919, F.lit(997)) / 997.0 * spread + lat).alias("latitude"), (F.pmod(F.pmod(F.col("id") * 6101, F.lit(991)) / 991.0 * spread - spread / 2 + 360, F.lit(360.0)) - 180).alias("longitude"), F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("id") * 31, F.lit(400)) * 1800).alias("ts"))
    p = p.withColumns({"latitude": F.when(i != 5, F.col("latitude")), "ts": F.when(i != 6, F.col("ts"))})  # across the antimeridian; some are not known
    e = p.groupBy("event").agg(F.first("latitude").alias("lat"), F.first("longitude").alias("lon"), F.min("ts").alias("first"), F.min(F.col("ts") + F.expr("INTERVAL 9 HOURS")).alias("last"))
    hour = F.expr("INTERVAL 24 HOURS")
    o = p.select(F.col("event").alias("other"), "latitude", "longitude", "ts")
    met = e.crossJoin(o).where((F.col("event") != F.col("other")) & F.col("ts").between(F.col("first") - hour, F.col("last") + hour) & (haversine_km(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude")) <= 10))
    want = {r["event"]: r["count"] for r in met.groupBy("event").count().collect()}
    got = {r["event"]: r["n"] for r in blocks.seen_around(e, p, 10.0, 24.0, group_rows).collect()}
    assert got == want and max(got.values()) > 3


def test_nearby_detections_join_no_pairs(spark):
    p = _points(spark)
    e = p.groupBy("event").agg(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    plan = triage.nearby_detections(e, p)._jdf.queryExecution().optimizedPlan().toString()
    assert "of_event" not in plan and "FlatMapGroupsInArrow" in plan
