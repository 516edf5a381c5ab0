"""Reconstruction on small controlled sets."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from emberframe.functions.evidence import confidence_score, observed_at, plain_text
from emberframe.functions.geo import haversine_km
from emberframe.operators import blocks, components, events, graph, raster, register, spatial, triage, weather
from emberframe.operators.assess import finding_problems
from emberframe.plans import catalog

COLS = "obs_id long, latitude double, longitude double, acq_date string, acq_time int, satellite string, instrument string, confidence string, frp double"


def obs(spark, rows):
    rows = [(i, la, lo, d, t, "N", "VIIRS", "n", f) for i, (la, lo, d, t, f) in enumerate(rows)]
    df = spark.createDataFrame(rows, COLS)
    return df.withColumn("ts", observed_at(F.col("acq_date"), F.col("acq_time")))


def controlled(spark):
    """Five detections, three 3 km to the north, two ten days later."""
    rows = [(0.0 + 0.001 * i, 100.0, "2024-01-01", 100 + i, 1.0) for i in range(5)]
    rows += [(0.031 + 0.001 * i, 100.0, "2024-01-01", 200 + i, 2.0) for i in range(3)]
    rows += [(0.0 + 0.001 * i, 100.0, "2024-01-11", 100 + i, 3.0) for i in range(2)]
    return obs(spark, rows)


@pytest.mark.parametrize(("radius", "hours", "sizes"), [(2.0, 72.0, [2, 3, 5]), (4.0, 72.0, [2, 8]), (2.0, 300.0, [3, 7]), (4.0, 300.0, [10]), (0.1, 72.0, [1] * 10)])
def test_thresholds(spark, radius, hours, sizes):
    got = events.clustered(controlled(spark), radius, hours).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in got) == sizes


def test_sweep_matches_single_runs(spark):
    rows = {(r.radius_km, r.hours): (r.events, r.singletons, r.largest) for r in events.threshold_sweep(controlled(spark), (0.1, 2.0, 4.0), (72.0, 300.0)).collect()}
    assert rows[2.0, 72.0] == (3, 0, 5) and rows[4.0, 300.0] == (1, 0, 10) and rows[0.1, 72.0] == (10, 10, 1)


def test_known_event(spark):
    rows = [(-1.85468, 103.96087, "2019-09-04", 1822, 1.12), (-1.85403, 103.95961, "2019-09-05", 702, 12.62), (-1.85425, 103.9603, "2019-09-05", 1803, 0.82)]
    for order in (rows, rows[::-1]):
        (e,) = events.reconstruct(obs(spark, order)).collect()
        assert e.event_id == "FE-20190904-4904392c16"
        assert e.duration_hours == pytest.approx(23.683333333) and e.spatial_extent_km == pytest.approx(0.15758495297914177)
        assert (e.observation_count, e.max_frp, e.sensor_mix) == (3, 12.62, ["N/VIIRS"]) and e.mean_frp == pytest.approx(4.853333333)


def test_empty_and_bad_thresholds(spark):
    assert events.reconstruct(controlled(spark).where("false")).count() == 0
    for radius, hours in ((0, 1), (51, 1), (1, 0), (1, 721)):
        with pytest.raises(ValueError):
            events.accepted_pairs(controlled(spark), radius, hours)


def test_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.uniform(-0.05, 0.05), 100 + rng.uniform(-0.05, 0.05), "2024-01-0%d" % rng.randint(1, 6), rng.randint(0, 23) * 100, 1.0) for _ in range(150)]
    o = spatial.projected(obs(spark, rows))
    pts = [(r.obs_id, r.x_km, r.y_km, r.ts) for r in o.collect()]
    want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 4 and abs((a[3] - b[3]).total_seconds()) <= 48 * 3600}
    assert {(r.a, r.b) for r in spatial.pairs_within(o, 2.0, 48.0).collect()} == want
    plan = spatial.pairs_within(o, 2.0, 48.0)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin BuildRight, Inner, " not in plan


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(300)], [(0, i) for i in range(1, 300)], [(i, j) for i in range(12) for j in range(i)] + [(100, 101), (None, 5)]])
def test_components(spark, edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.vertex: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == set(root)
    groups = {}
    for v, r in got.items():
        groups.setdefault(r, set()).add(find(v))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({find(v) for v in root})


def test_small_functions(spark):
    one = spark.range(1)
    got = one.select(
        observed_at(F.lit("2024-01-01"), F.lit(455)).cast("string"), observed_at(F.lit("bad"), F.lit(1)), confidence_score(F.lit("H")), confidence_score(F.lit("85")), confidence_score(F.lit("250")), confidence_score(F.lit("?")),
        plain_text(F.lit("A  fire -- The wind — and 3—4 days - or so—long :, ")),
    ).first()
    assert tuple(got) == ("2024-01-01 04:55:00", None, 1.0, 0.85, 1.0, None, "A fire. The wind, and 3–4 days - or so: long")


def test_plain_prose_covers_all_documents(spark, tmp_path):
    texts = [(1, "smoke -- The  wind — and 3—4 days"), (2, "no dash"), (3, None), (4, "a – b")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.prose for r in catalog.queries()["plain_prose"](spark, str(tmp_path)).collect()}
    assert got == {1: "smoke. The wind, and 3–4 days", 2: "no dash", 3: None, 4: "a, b"}


def test_finding_problems_of_many_hypotheses(spark):
    none = spark.createDataFrame([], "role string, hypothesis string, score int, evidence_ids array<string>")
    found = none.union(spark.createDataFrame([("a", "0", 5, ["E1"])], none.schema))
    wanted = spark.range(1500).selectExpr("cast(id as string) as hypothesis")
    got = finding_problems(found, spark.createDataFrame([("E1",)], "evidence_id string"), wanted.union(wanted)).collect()
    assert len(got) == 1499 and {r.problem for r in got} == {"not found"}


def test_cells_wrap_and_reach_poles(spark):
    """Pairs across the antimeridian and around the poles are candidates like any other."""
    rng = random.Random(5)
    points = [(i, rng.choice([1, -1]) * rng.uniform(0, 90), rng.choice([rng.uniform(-180, 180), rng.choice([1, -1]) * (180 - rng.uniform(0, 0.5))])) for i in range(400)]
    points += [(1000, 0.0, 179.99), (1001, 0.0, -179.99), (1002, 89.9, 0.0), (1003, 89.9, 180.0), (1004, -89.99, 10.0), (1005, -89.99, -170.0), (1006, 0.0, 180.0), (1007, 0.0, -180.0)]
    df = spark.createDataFrame(points, "id long, lat double, lon double")
    a, b = (df.select(*(F.col(c).alias(f"{c}_{t}") for c in df.columns)) for t in "ab")
    d = haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    for km in (30.0, 400.0):
        got = [(r.id_a, r.id_b) for r in spatial.near(a, b, km, ("lat_a", "lon_a"), ("lat_b", "lon_b")).where(d <= km).collect()]
        want = [(r.id_a, r.id_b) for r in a.crossJoin(b).where(d <= km).collect()]
        assert len(got) == len(set(got)) and set(got) == set(want)


def test_time_axis_loses_no_pair(spark):
    rng = random.Random(6)
    rows = []
    for i in range(250):
        start = rng.uniform(0, 400)
        rows.append((i, rng.uniform(0, 0.5), rng.uniform(0, 0.5), start, start + rng.choice([0, 1, 30, 200])))
    df = spark.createDataFrame(rows, "event long, lat double, lon double, f double, l double").select("event", "lat", "lon", *(F.timestamp_micros((F.col(c) * 3600e6).cast("long")).alias(n) for c, n in (("f", "first"), ("l", "last"))), F.lit(1.0).alias("extent_km"))
    got = [(r.event_a, r.event_b) for r in graph.close_pairs(df, 20.0, 24.0).collect()]
    where = {r[0]: r for r in rows}
    km = lambda a, b: 2 * 6371.0088 * math.asin(math.sqrt(math.sin(math.radians(a[1] - b[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(a[2] - b[2]) / 2) ** 2))
    want = {(i, j) for i in where for j in where if i < j and km(where[i], where[j]) <= 20 and max(where[j][3] - where[i][4], where[i][3] - where[j][4], 0) <= 24}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_wide_events_overlap_at_any_distance(spark):
    rows = [(1, 0.0, 100.0, 3000.0), (2, 0.0, 110.0, 1.0), (3, 0.0, 120.0, 2.0), (4, 0.0, 100.05, 1.0), (5, 10.0, 100.0, 400.0)]
    df = spark.createDataFrame(rows, "event long, lat double, lon double, extent_km double").withColumns({"first": F.timestamp_seconds(F.col("event") * 10_000_000), "last": F.timestamp_seconds(F.col("event") * 10_000_000)})
    assert sorted((r.event_a, r.event_b) for r in graph.overlapping_pairs(df).collect()) == [(1, 2), (1, 4), (1, 5)]
    explicit = spark.createDataFrame([(3, 1), (9, 1)], "a long, b long")
    assert (1, 3) in {(r.event_a, r.event_b) for r in graph.event_pairs(df, explicit=explicit).collect()}


@pytest.mark.parametrize("n", [1, 40, 2000])
def test_nearest_grid_point(spark, n):
    rng = random.Random(n)
    grid = [(i, round(rng.uniform(-5, 5), 1), round(rng.uniform(100, 110), 1)) for i in range(n)]
    points = [(i, rng.uniform(-8, 8), rng.uniform(90, 120)) for i in range(60)] + [(60, 80.0, -170.0)]
    got = weather.nearest_grid(spark.createDataFrame(points, "event long, lat double, lon double"), spark.createDataFrame(grid, "grid_id long, grid_lat double, grid_lon double"))
    for r in got.collect():
        assert r.grid_id == min(grid, key=lambda g: ((g[1] - r.lat) ** 2 + (g[2] - r.lon) ** 2, g[1], g[2], g[0]))[0]


def test_peat_beyond_the_raster(spark):
    t = raster.Transform(0.0, 100.0, 0.01, 10, 10)
    cells = spark.createDataFrame([(r, c, 2 if c < 5 else 255) for r in range(10) for c in range(10)], "row long, col long, value int")
    box = "event long, west double, south double, east double, north double, lat double, lon double, extent_km double"
    e = spark.createDataFrame([(1, 110.0, 10.0, 110.1, 10.1, 10.05, 110.05, 1.0), (2, 100.0, -0.05, 100.02, -0.03, -0.04, 100.01, 1.0), (3, 100.0, -0.02, 100.09, -0.02, -0.02, 100.09, 9.0)], box)
    foot = {r.event: r for r in raster.footprint_fraction(e, cells, t).collect()}
    assert (foot[1].peat_fraction, foot[1].any_peat, foot[1].outside) == (None, False, foot[1].samples)
    assert (foot[2].peat_fraction, foot[2].any_peat) == (1.0, True) and 0 < foot[3].peat_fraction < 1
    assert {r.event: r.peat_distance_km for r in raster.distance_to_peat(e, cells, t).collect()} == {1: None, 2: 0.0, 3: 5.56}
    pairs = spark.createDataFrame([(1, 2, 0.0, 100.0, 0.0, 100.0297), (3, 4, 50.0, 0.0, 50.1, 0.0), (5, 6, -0.01, 100.08, -0.01, 100.12), (7, 8, 0.0, 100.0, 0.0, 100.0)], "source long, target long, lat1 double, lon1 double, lat2 double, lon2 double")
    got = {r.source: (r.samples, r.outside, r.peat_fraction) for r in raster.corridor_fraction(pairs, cells, t).collect()}
    assert got[1] == (5, 0, 1.0) and got[3][2] is None and got[3][0] == got[3][1] and 0 < got[5][1] < got[5][0] and got[5][2] == 0.0 and got[7] == (1, 0, 1.0)
    context = {r.event: r.limitations for r in raster.peat_context(e, cells, t).collect()}
    assert "footprint outside the raster" in context[1] and "event wider than its buffer" in context[3] and context[2][0] == raster.NO_INFERENCE


def test_values_out_of_range_fail(spark):
    for feature, bad in (("urban_fraction", 1.5), ("settlement_distance_km", -1.0), ("nearby_detection_count", 1.5), ("recent_rainfall_mm", float("nan"))):
        facts = spark.createDataFrame([(1, bad)], f"event long, {feature} double")
        with pytest.raises(Exception, match="out of range"):
            triage.rule_evaluations(facts).collect()
    facts = spark.createDataFrame([(7, 0.9)], "event long, mean_confidence double")
    assert "DERIVED_STAGE1_7_confidence" in {r.evidence_id for r in triage.rule_evaluations(facts).collect()}


def test_fold_keeps_other_categories(spark):
    schema = "event long, category string, evidence_id string"
    old = spark.createDataFrame([(1, "weather", "a"), (1, "peat", "a"), (1, "weather", None), (None, "weather", "x"), (1, None, "y")], schema)
    got = register.folded(old, spark.createDataFrame([(1, "weather", "new")], schema), ["weather"]).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, "peat", "a"), (None, "weather", "x"), (1, None, "y"), (1, "weather", "new")]))


def _sweep_by_hand(points, radii, hours, large):
    out = {}
    for r in radii:
        for h in hours:
            root, pairs = {p[0]: p[0] for p in points}, 0

            def find(v, root=root):
                while root[v] != v:
                    v = root[v]
                return v

            for a in points:
                for b in points:
                    if a[0] < b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= r * r and abs((a[3] - b[3]).total_seconds()) <= h * 3600:
                        pairs += 1
                        root[find(a[0])] = find(b[0])
            sizes = {}
            for v in root:
                sizes[find(v)] = sizes.get(find(v), 0) + 1
            n = list(sizes.values())
            out[r, h] = (len(n), n.count(1), sum(x >= large for x in n), max(n), pairs)
    return out


@pytest.mark.parametrize(("n", "spread", "group_rows"), [(250, 0.05, None), (250, 0.3, None), (150, 0.03, 20)])
def test_sweep_writes_no_pairs(spark, monkeypatch, n, spread, group_rows):
    rng = random.Random(n)
    rows = [(rng.uniform(-spread, spread), 100 + rng.uniform(-spread, spread), "2024-01-%02d" % rng.randint(1, 20), rng.randint(0, 23) * 100, 1.0) for _ in range(n)]
    rows += rows[:9] + [(None, 100.0, "2024-01-01", 0, 1.0)]
    o = obs(spark, rows)
    if group_rows:  # cells of more rows are taken apart
        real = blocks.linked_by_class
        monkeypatch.setattr(events, "linked_by_class", lambda *a, **k: real(*a, **k, group_rows=group_rows))
    monkeypatch.setattr(events, "pairs_within", None)
    got = {(r[0], r[1]): tuple(r)[2:] for r in events.threshold_sweep(o, (0.5, 1.0, 2.0), (12.0, 48.0, 72.0), large=5).collect()}
    points = [(r.obs_id, r.x_km, r.y_km, r.ts) for r in spatial.projected(o.where("latitude is not null")).collect()]
    want = {k: (v[0] + 1, v[1] + 1, *v[2:]) for k, v in _sweep_by_hand(points, (0.5, 1.0, 2.0), (12.0, 48.0, 72.0), 5).items()}
    assert got == want


def test_sweep_sends_links_not_pairs(spark):
    rows = [(0.0001 * (i % 20), 100.0 + 0.0001 * (i // 20), "2024-01-01", 100 + i % 50, 1.0) for i in range(400)]
    sent = blocks.linked_by_class(spatial.projected(obs(spark, rows)), [0.5, 2.0], [12.0, 72.0]).collect()
    links, counted = [r for r in sent if r.a is not None], [r for r in sent if r.a is None]
    assert len(links) < 4 * 8 * 400 and {sum(r.pairs for r in counted if (r.i, r.j) == c) for c in ((0, 0), (1, 1))} == {400 * 399 // 2}
