"""Relations between events against all pairs."""

import pytest
from pyspark.sql import functions as F

from emberframe.functions.evidence import interval_gap_hours
from emberframe.functions.geo import haversine_km
from emberframe.operators import blocks, graph


def _events(spark, n, spread):
    i = F.col("id")
    return spark.range(n).select(i.alias("event"), (F.pmod(i * 7919, F.lit(997)) / 997.0 * spread).alias("lat"), (F.pmod(i * 6101, F.lit(991)) / 991.0 * spread + 100).alias("lon"))


def _want(events, selected, km):
    s = events.join(selected, "event", "left_semi").select(F.col("event").alias("s"), F.col("lat").alias("a"), F.col("lon").alias("b"))
    met = events.join(selected, "event", "left_anti").crossJoin(s).withColumn("d", haversine_km(F.col("lat"), F.col("lon"), F.col("a"), F.col("b"))).where(F.col("d") <= km)
    return {r["event"]: (r["m"]["s"], r["m"]["d"]) for r in met.groupBy("event").agg(F.min(F.struct("d", "s")).alias("m")).collect()}


@pytest.mark.parametrize(("spread", "every"), [(2.0, 20), (0.001, 20), (9.0, 150), (0.0, 20), (2.0, 10**9)])
def test_context_of_selection_equals_all_pairs(spark, spread, every):
    events = _events(spark, 400, spread)
    if spread == 9.0:  # a crowd far from a few
        events = events.unionByName(_events(spark, 100, 0.001).withColumns({"event": F.col("event") + 1500, "lat": F.col("lat") + 4}))
    selected = events.where((F.col("event") % every == 0) & (F.col("event") >= int(every > 10**8))).select("event")
    got = {r["event"]: (r["nearest_selected"], r["distance_km"]) for r in graph.context_of_selection(events, selected).collect()}
    want = _want(events, selected, 50.0)
    assert got.keys() == want.keys() and bool(want) == (every < 10**8)
    assert all(g[0] == want[e][0] and g[1] == pytest.approx(want[e][1]) for e, g in got.items())


def test_context_looks_at_few_pairs(spark, monkeypatch):
    seen, real = [], graph.near
    monkeypatch.setattr(graph, "near", lambda *a, **k: (seen.append(real(*a, **k)), seen[-1])[1])
    events = _events(spark, 900, 0.4)
    selected = events.where("event % 3 = 0").select("event")
    assert graph.context_of_selection(events, selected).count() == 600
    assert sum(p.count() for p in seen) < 600 * 40  # all pairs: 180,000


def _above(plan, key):
    """Operators above each join over ``key`` in a plan's text."""
    path, found = [], []
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        path = [p for p in path if p[0] < depth] + [(depth, line[depth:])]
        if "Join" in line and key in line:
            found.append([p[1].split()[0] for p in path[:-1]])
    return found


def _pairing(spark):
    """Events on a line, an hour and some 11 km apart, with what ties some of them."""
    i = F.col("id")
    at = F.timestamp_seconds(F.lit(1704067200) + i * 3600)
    events = spark.range(30).select(i.alias("event"), (i * 0.1).alias("lat"), F.lit(100.0).alias("lon"), at.alias("first"), at.alias("last"), F.lit(1.0).alias("extent_km"))
    wind = events.where("event % 2 = 0").select("event", F.lit(90.0).alias("wind_from"))
    peat = spark.createDataFrame([(1, 2, 0.75), (2, 1, 0.25), (1, 29, 0.5), (7, 7, 1.0), (3, 99, 1.0)], "source long, target long, peat_fraction double")
    episodes = events.select("event", (F.col("event") % 2).alias("episode"))
    again = spark.createDataFrame([(2, 1, False), (1, 2, True), (0, 28, True), (5, 99, True), (9, None, True)], "a long, b long, recurrence boolean")
    return events, wind, peat, episodes, again


@pytest.mark.parametrize("known", [True, False])
def test_edges_have_what_is_told_of_events_and_pairs(spark, known):
    events, wind, peat, episodes, again = _pairing(spark)
    got = {(r.source, r.target): r for r in graph.edges(events, wind, peat, episodes, again if known else None).collect()}
    assert set(got) == {(a, b) for a in range(30) for b in range(a + 1, min(a + 5, 30))} | ({(0, 28)} if known else set())
    assert {k: r.peat_fraction for k, r in got.items() if r.peat_fraction is not None} == {(1, 2): 0.75}
    assert {k: r.recurrence for k, r in got.items() if r.recurrence is not None} == ({(1, 2): True, (0, 28): True} if known else {})
    assert all(r.shared_episode == ((a + b) % 2 == 0) and (r.heading is not None) == (a % 2 == 0) for (a, b), r in got.items())


def test_searched_pairs_are_not_shuffled(spark):
    e = graph.edges(*_pairing(spark)).select("source", "state")
    joins = _above(e._jdf.queryExecution().executedPlan().toString(), "_cx")
    assert joins and not any("Exchange" in op for above in joins for op in above)


@pytest.mark.parametrize(("n", "spread", "lat", "group_rows"), [(500, 0.1, 0.0, 1 << 17), (500, 0.1, 0.0, 60), (300, 0.4, 60.0, 1 << 17), (200, 0.0, 10.0, 1 << 17), (5, 0.05, 89.95, 1 << 17), (0, 0.1, 0.0, 1 << 17)])
def test_counts_around_equal_all_pairs(spark, n, spread, lat, group_rows):
    i = F.col("event")
    first = F.timestamp_seconds(F.lit(1704067200) + F.pmod(i * 7717, F.lit(600)) * 3600)
    events = _events(spark, n, spread).withColumns({"lat": F.col("lat") + lat, "first": first, "last": F.timestamp_seconds(F.unix_seconds(first) + F.pmod(i * 31, F.lit(90)) * 3600)})
    events = events.withColumns({"lon": F.pmod(F.col("lon") + 80 - spread / 2 + 180, F.lit(360.0)) - 180, "lat": F.when(i != 3, F.col("lat"))})  # across the antimeridian; one has no place
    got = {r[0]: tuple(r)[1:] for r in blocks.counted_around(events, 10.0, 72.0, 2.0, group_rows).collect()}
    a, b = (events.where("lat is not null").select(*(F.col(c).alias(f"{c}_{t}") for c in events.columns)) for t in "ab")
    d = haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    gap = interval_gap_hours(*(F.col(c) for c in ("first_a", "last_a", "first_b", "last_b")))
    near = F.count_if((F.col("event_a") != F.col("event_b")) & (d <= 10) & (gap <= 72)), F.count_if((d <= 2) & (F.col("last_b") < F.col("first_a")))
    want = {r[0]: tuple(r)[1:] for r in a.crossJoin(b).groupBy("event_a").agg(*near).collect()}
    assert got == want and (n < 100 or max(w[0] for w in want.values()) > 3)


def test_counts_around_join_no_pairs(spark):
    i = F.col("event")
    events = _events(spark, 40, 0.1).withColumns({"first": F.timestamp_seconds(i), "last": F.timestamp_seconds(i), "extent_km": F.lit(1.0)})
    plan = graph.nearby_and_recurrence(events)._jdf.queryExecution().optimizedPlan().toString()
    assert "last_b" not in plan and "distance_km" not in plan


def _tied(spark, n, spread, lat):
    """Events of three periods, some of them wide or months apart, with what ties them."""
    i = F.col("event")
    first = F.timestamp_seconds(F.lit(1704067200) + F.pmod(i * 7717, F.lit(700)) * 1800 + F.when(i % 13 == 0, 90 * 86400).otherwise(0))
    at = _events(spark, n, spread).withColumns({"lat": F.col("lat") + lat, "lon": F.pmod(F.col("lon") + 80 - spread / 2 + 180, F.lit(360.0)) - 180})  # across the antimeridian
    at = at.withColumns({"first": first, "last": F.timestamp_seconds(F.unix_seconds(first) + F.pmod(i * 31, F.lit(90)) * 1800), "extent_km": F.when(i % 97 == 5, 130.0).otherwise((i % 9).cast("double"))})
    wind = at.where("event % 4 <> 0").select("event", (F.pmod(i * 37, F.lit(24)) * 15).cast("double").alias("wind_from"), F.when(i % 3 != 0, (i % 5).cast("double")).alias("wind_kmh"))
    peat = at.where("event % 3 = 0").select(i.alias("source"), (i + 5).alias("target"), ((i % 10) / 10.0).alias("peat_fraction"))
    again = at.where("event % 7 = 0").select((i + 20).alias("a"), i.alias("b"), (i % 2 == 0).alias("recurrence"))
    return at, wind, peat, at.where("event % 5 <> 0").select("event", (i % 3).alias("episode")), again


@pytest.mark.parametrize(("n", "spread", "lat", "group_rows", "known"), [(300, 0.9, 0.0, 1 << 18, True), (300, 0.9, 0.0, 80, True), (300, 2.0, 50.0, 1 << 18, False), (120, 0.0, 10.0, 1 << 18, True), (0, 0.1, 0.0, 1 << 18, True)])
def test_counted_edges_equal_sums_of_edges(spark, monkeypatch, n, spread, lat, group_rows, known):
    real = graph.counted_edges
    monkeypatch.setattr(graph, "counted_edges", lambda *a: real(*a, group_rows=group_rows))
    events, wind, peat, episodes, again = _tied(spark, n, spread, lat)
    given = (events, wind, peat, episodes, again if known else None)
    e = graph.edges(*given).select("source", "target", "state", "inside").cache()
    ends = e.select(F.explode(F.array("source", "target")).alias("event"), "state").groupBy("event").agg(F.count("*"), F.count_if(F.col("state").isin("UNRESOLVED", "RELATED_POSSIBLE")))
    progress = {r["source"]: (r["evaluated"], r["outside"], r["result"]) for r in graph.progression(e).collect() if r["evaluated"]}
    counts = graph.edge_counts(*given, progress=True).cache()
    assert {r["event"]: (r["edges"], r["open"]) for r in counts.collect()} == {r[0]: (r[1], r[2]) for r in ends.collect()}
    assert {r["source"]: (r["evaluated"], r["outside"], r["result"]) for r in graph.progression_of_counts(counts).collect()} == progress
    assert n == 0 or (e.count() > n and len(progress) > n / 4)


def test_counted_edges_write_no_pairs(spark):
    plan = graph.edge_counts(*_pairing(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "_lx" not in plan and "FlatMapGroupsInArrow" in plan  # no join over cells


def test_selections_look_at_their_own_pairs(spark):
    events, wind, peat, episodes, _ = _pairing(spark)
    chosen = events.where("event % 9 = 0").select("event")
    given = (events, wind, peat, episodes, None)
    got = {(r["event"], r["source"], r["target"], r["outgoing"]) for r in graph.incident(graph.edges_touching(*given, chosen), chosen).collect()}
    pairs = [(a, b) for a in range(30) for b in range(a + 1, min(a + 5, 30))]
    assert got == {(e, a, b, e == a) for a, b in pairs for e in (a, b) if e % 9 == 0}
    one = graph.map_of_selections(*given, [chosen])[0]
    assert {(r["a"], r["b"], r["computed"]) for r in one.collect()} == {(min(e, s), max(e, s), True) for e in range(30) if e % 9 for s in (9 * ((e + 4) // 9),) if abs(e - s) < 5 and s < 30}
    assert "marked" in graph.edges_touching(*given, chosen)._jdf.queryExecution().optimizedPlan().toString()
