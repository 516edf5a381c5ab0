"""Registered queries and SQL: relations, complexity, priority, register, packs, assessments, images."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberframe.functions import geo
from emberframe.functions.evidence import plain_text
from emberframe.operators import assess, complexity, graph, pixels, priority, register
from emberframe.operators import events as ev
from emberframe.operators import raster as rs
from emberframe.operators.components import materialise
from emberframe.plans import context_queries, events_queries, lens
from emberframe.plans.lens import haversine_sql, with_views

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_GAP = "greatest(epoch_us(b.first - a.last) / 3600e6, epoch_us(a.first - b.last) / 3600e6, 0)"
_PAIRS = f""", pairs AS (
  SELECT a.event AS event_a, b.event AS event_b, {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS distance_km, {_GAP} AS gap_hours,
    CASE WHEN a.last < b.first THEN 'A_BEFORE_B' WHEN b.last < a.first THEN 'B_BEFORE_A' ELSE 'OVERLAPPING' END AS ordering, a.extent_km / 2 + b.extent_km / 2 + 4 AS reach
  FROM ev a JOIN ev b ON a.event < b.event WHERE abs(a.lat - b.lat) <= 0.5)"""


@query("event_pairs", with_views("obs", "members", "ev", body=_PAIRS + " SELECT event_a, event_b, round(distance_km, 6) AS distance_km, gap_hours, ordering, distance_km <= reach AS buffers_overlap FROM pairs WHERE distance_km <= 50 AND (gap_hours <= 720 OR distance_km <= reach)"))
def event_pairs(spark, sf_dir):
    return graph.event_pairs(lens.events(spark, sf_dir)).select("event_a", "event_b", F.round("distance_km", 6).alias("distance_km"), "gap_hours", "ordering", "buffers_overlap")


@query("neighbouring_events", with_views("obs", "members", "ev", body=_PAIRS + """, n AS (SELECT * FROM pairs WHERE distance_km <= 50 AND gap_hours <= 720)
SELECT event_a AS event, event_b AS neighbour, round(distance_km, 6) AS distance_km, gap_hours FROM n UNION ALL SELECT event_b, event_a, round(distance_km, 6), gap_hours FROM n"""))
def neighbouring_events(spark, sf_dir):
    return graph.neighbours(lens.events(spark, sf_dir)).withColumn("distance_km", F.round("distance_km", 6))


@query("nearby_and_recurrence", with_views("obs", "members", "ev", body=f"""
SELECT a.event, count(b.event) FILTER (WHERE {_GAP} <= 72) AS nearby_events, count(b.event) FILTER (WHERE b.last < a.first AND {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 2) AS recurrences
FROM ev a LEFT JOIN ev b ON a.event <> b.event AND abs(a.lat - b.lat) <= 0.1 AND {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 10 GROUP BY a.event"""))
def nearby_and_recurrence(spark, sf_dir):
    return graph.nearby_and_recurrence(lens.events(spark, sf_dir))


def wind(spark, sf_dir):
    e = F.col("event")
    return lens.events(spark, sf_dir).where(e % 5 != 0).select("event", ((e * 37) % 360).cast("double").alias("wind_from"), F.when(e % 7 != 0, ((e % 4) * 5).cast("double")).alias("wind_kmh"), F.array(F.concat(F.lit("ENV_WEATHER_"), e.cast("string"), F.lit("_wind"))).alias("wind_ids"))


def _episodes(spark, sf_dir):
    return lens.events(spark, sf_dir).where(F.col("event") % 3 != 0).select("event", (F.col("event") % 7).alias("episode"))


def _recurrence(spark, sf_dir):
    """Pairs that some record ties together or apart, one end of some of them unknown."""
    e = F.col("event")
    return lens.events(spark, sf_dir).where(e % 6 == 0).select((e + 20).alias("a"), e.alias("b"), (e % 12 == 0).alias("recurrence"))


def _related(spark, sf_dir):
    """What edges are made of."""
    e = lens.events(spark, sf_dir)
    peat = e.where(F.col("event") % 2 == 0).select(F.col("event").alias("source"), (F.col("event") + 10).alias("target"), ((F.col("event") % 10) / 10.0).alias("peat_fraction"), F.array(F.concat(F.lit("ENV_PEAT_"), F.col("event").cast("string"), F.lit("_corridor"))).alias("peat_ids"))
    return e, wind(spark, sf_dir), peat, _episodes(spark, sf_dir), _recurrence(spark, sf_dir)


def edges(spark, sf_dir):
    return graph.edges(*_related(spark, sf_dir))


def edges_touching(spark, sf_dir, marked):
    return graph.edges_touching(*_related(spark, sf_dir), marked)


def maps(spark, sf_dir, *selections):
    return graph.map_of_selections(*_related(spark, sf_dir), list(selections))


def edge_counts(spark, sf_dir, progress: bool = False):
    return graph.edge_counts(*_related(spark, sf_dir), progress=progress)


_SAID = ("GEOGRAPHIC_DISTANCE", "true"), ("ELAPSED_TIME", "true"), ("PROPAGATION_COMPATIBILITY", "CASE WHEN compatibility IN ('COMPATIBLE', 'WEAK') THEN true WHEN compatibility = 'INCOMPATIBLE' THEN false END"), ("EVENT_BUFFER_OVERLAP", "buffers_overlap"), ("WIND_ALIGNMENT", "alignment >= 0"), ("DIRECTIONAL_COMPATIBILITY", "downwind"), ("PEAT_CORRIDOR_FRACTION", "peat_fraction >= 0.5"), ("SHARED_ENVIRONMENTAL_EPISODE", "shared_episode"), ("HISTORICAL_RECURRENCE", "recurrence")


def _told(wanted: str) -> str:
    names = ", ".join(f"CASE WHEN ({c}) IS {wanted} THEN 'DERIVED_GRAPH_' || source || '_' || target || '_{k}' END" for k, c in _SAID)
    if wanted == "true":  # and the ids of the evidence behind wind and peat
        names += ", CASE WHEN wind_from IS NOT NULL THEN 'ENV_WEATHER_' || source || '_wind' END, CASE WHEN peat_fraction IS NOT NULL THEN 'ENV_PEAT_' || source || '_corridor' END"
    return f"array_to_string([x FOR x IN [{names}] IF x IS NOT NULL], ',')"


_EDGES = f""", rec AS (SELECT event + 20 AS a, event AS b, event % 12 = 0 AS recurrence FROM ev WHERE event % 6 = 0),
p AS (SELECT event_a, event_b FROM pairs WHERE (distance_km <= 50 AND gap_hours <= 720) OR distance_km <= reach UNION SELECT b, a FROM rec WHERE a IN (SELECT event FROM ev)),
o AS (SELECT CASE WHEN flip THEN event_b ELSE event_a END AS source, CASE WHEN flip THEN event_a ELSE event_b END AS target, recurrence
  FROM (SELECT p.*, b.last < a.first AS flip, recurrence FROM p JOIN ev a ON a.event = event_a JOIN ev b ON b.event = event_b LEFT JOIN rec ON rec.a = event_b AND rec.b = event_a)),
f AS (SELECT o.*, s.first AS f1, t.first AS f2, CASE WHEN s.last < t.first THEN 'A_BEFORE_B' ELSE 'OVERLAPPING' END AS ordering, {haversine_sql('s.lat', 's.lon', 't.lat', 't.lon')} AS distance_km, greatest(epoch_us(t.first - s.last) / 3600e6, 0) AS gap_hours, s.extent_km / 2 + t.extent_km / 2 + 4 AS reach,
  CASE WHEN source % 5 <> 0 THEN ((source * 37) % 360)::DOUBLE END AS wind_from, CASE WHEN source % 5 <> 0 AND source % 7 <> 0 THEN (source % 4) * 5 END AS wind_kmh, CASE WHEN source % 2 = 0 AND target = source + 10 THEN (source % 10) / 10.0::DOUBLE END AS peat_fraction,
  CASE WHEN source % 3 <> 0 AND target % 3 <> 0 THEN source % 7 = target % 7 END AS shared_episode,
  radians(t.lon - s.lon) AS dl, radians(s.lat) AS la, radians(t.lat) AS lb, radians(t.lon - s.lon) * 6371.0088::DOUBLE * cos(radians((s.lat + t.lat) / 2)) AS east, radians(t.lat - s.lat) * 6371.0088::DOUBLE AS north
  FROM o JOIN ev s ON s.event = source JOIN ev t ON t.event = target),
g AS (SELECT *, distance_km <= reach AS buffers_overlap, CASE WHEN gap_hours > 0 THEN distance_km / gap_hours END AS speed_kmh, (degrees(atan2(sin(dl) * cos(lb), cos(la) * sin(lb) - sin(la) * cos(lb) * cos(dl))) + 360) % 360 AS bearing, (wind_from + 180) % 360 AS down, CASE WHEN ordering <> 'OVERLAPPING' AND wind_from IS NOT NULL THEN epoch_us(f2 - f1) / 3600e6 END AS elapsed FROM f),
h AS (SELECT *, CASE WHEN ordering <> 'OVERLAPPING' THEN abs((bearing - down + 180 + 720) % 360 - 180) END AS angle, east * sin(radians(down)) + north * cos(radians(down)) - elapsed * 2 AS along, east * cos(radians(down)) - north * sin(radians(down)) AS across FROM g),
i AS (SELECT *, (along / (elapsed * 3)) * (along / (elapsed * 3)) + (across / (elapsed * 2.5)) * (across / (elapsed * 2.5)) <= 1 AS inside, round(cos(radians(angle)), 6) AS alignment, CASE WHEN wind_kmh IS NULL OR wind_kmh > 0 THEN angle <= 60 END AS downwind FROM h),
j AS (SELECT *, CASE WHEN inside THEN 'COMPATIBLE' WHEN NOT inside THEN 'INCOMPATIBLE' WHEN ordering = 'OVERLAPPING' THEN 'NOT_EVALUATED' WHEN speed_kmh <= 5 THEN 'COMPATIBLE' WHEN speed_kmh <= 20 THEN 'WEAK' ELSE 'INCOMPATIBLE' END AS compatibility,
  buffers_overlap OR coalesce(peat_fraction >= 0.5, false) OR coalesce(shared_episode, false) OR coalesce(recurrence, false) AS context, downwind IS false AS conflict, coalesce(alignment <= -0.5, false) AS upwind FROM i),
edges AS (SELECT *, CASE WHEN ordering = 'OVERLAPPING' AND NOT buffers_overlap AND NOT coalesce(shared_episode, false) THEN 'INDEPENDENT_PLAUSIBLE' WHEN ordering = 'OVERLAPPING' THEN 'UNRESOLVED'
  WHEN compatibility = 'COMPATIBLE' AND NOT conflict AND NOT upwind THEN 'PROPAGATION_COMPATIBLE' WHEN compatibility = 'WEAK' AND context AND NOT conflict THEN 'PROPAGATION_WEAK'
  WHEN compatibility = 'INCOMPATIBLE' AND (conflict OR upwind) THEN 'UNRESOLVED' WHEN compatibility = 'INCOMPATIBLE' AND context THEN 'RELATED_POSSIBLE' WHEN compatibility = 'INCOMPATIBLE' THEN 'INDEPENDENT_PLAUSIBLE'
  WHEN context THEN 'RELATED_POSSIBLE' ELSE 'UNRESOLVED' END AS state FROM j)"""


@query("event_edges", with_views("obs", "members", "ev", body=_PAIRS + _EDGES + f""" SELECT source, target, round(distance_km, 6) AS distance_km, gap_hours, ordering, round(bearing, 6) AS bearing, alignment, downwind, buffers_overlap, peat_fraction, shared_episode, recurrence, round(speed_kmh, 6) AS speed_kmh,
  CASE WHEN elapsed IS NOT NULL THEN down END AS heading, elapsed * 3 AS half_length, elapsed * 2.5 AS half_width, elapsed * 2 AS shift, inside, compatibility, state, {_told('true')} AS supporting, {_told('false')} AS contradicting FROM edges"""))
def event_edges(spark, sf_dir):
    e = edges(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("distance_km", "speed_kmh", "bearing")})
    return e.withColumns({"supporting": F.array_join("supporting", ","), "contradicting": F.array_join("contradicting", ",")})


@query("edge_explanations", with_views("obs", "members", "ev", body=_PAIRS + _EDGES + """ SELECT 'DERIVED_GRAPH_' || source || '_' || target AS evidence_id, source AS event, 'graph' AS category, state AS type, CASE state WHEN 'PROPAGATION_COMPATIBLE' THEN 'order and speed fit spread over the surface' WHEN 'PROPAGATION_WEAK' THEN 'spread is possible, the evidence for it weak'
  WHEN 'RELATED_POSSIBLE' THEN 'the events share surroundings, not a path' WHEN 'INDEPENDENT_PLAUSIBLE' THEN 'nothing ties the events together' ELSE 'what is known does not settle it' END AS observation, round(distance_km, 3) AS value FROM edges"""))
def edge_explanations(spark, sf_dir):
    return graph.explanations(edges(spark, sf_dir))


@query("incident_edges", with_views("obs", "members", "ev", body=_PAIRS + _EDGES + " SELECT source AS event, source, target, true AS outgoing FROM edges WHERE source % 20 = 0 UNION ALL SELECT target, source, target, false FROM edges WHERE target % 20 = 0"))
def incident_edges(spark, sf_dir):
    chosen = selection(spark, sf_dir)
    return graph.incident(edges_touching(spark, sf_dir, chosen), chosen)


@query("edges_by_source", with_views("obs", "members", "ev", body=_PAIRS + _EDGES + " SELECT source, count(*) AS n, string_agg(target::VARCHAR, ',' ORDER BY target) AS targets FROM edges GROUP BY source"))
def edges_by_source(spark, sf_dir):
    return graph.grouped_by_source(edges(spark, sf_dir)).withColumn("targets", F.array_join("targets", ","))


@query("unresolved_relationships", with_views("obs", "members", "ev", body=_PAIRS + _EDGES + """, ends AS (SELECT source AS event, state FROM edges UNION ALL SELECT target, state FROM edges)
SELECT ev.event, count(state) AS edges, count(*) FILTER (WHERE state IN ('UNRESOLVED', 'RELATED_POSSIBLE')) / greatest(count(state), 1) AS signal FROM ev LEFT JOIN ends USING (event) GROUP BY ev.event"""))
def unresolved_relationships(spark, sf_dir):
    return graph.signal_of_counts(edge_counts(spark, sf_dir), lens.events(spark, sf_dir))


@query("progression_results", with_views("obs", "members", "ev", body=_PAIRS + _EDGES + """ SELECT source, count(inside) AS evaluated, count(*) FILTER (WHERE NOT inside) AS outside, coalesce(string_agg(target::VARCHAR, ',' ORDER BY target) FILTER (WHERE NOT inside), '') AS outside_targets,
  CASE WHEN count(inside) = 0 THEN 'NOT_EVALUATED' WHEN count(*) FILTER (WHERE NOT inside) = 0 THEN 'COMPATIBLE' WHEN count(*) FILTER (WHERE NOT inside) < count(inside) THEN 'PARTIAL' ELSE 'INCOMPATIBLE' END AS result FROM edges GROUP BY source"""))
def progression_results(spark, sf_dir):
    return graph.progression(edges(spark, sf_dir)).withColumn("outside_targets", F.array_join("outside_targets", ","))


_CONTEXT = f""", sel AS (SELECT event, lat, lon FROM ev WHERE event % 20 = 0),
ctx AS (SELECT event, s AS nearest_selected, d AS distance_km FROM (SELECT e.event, s.event AS s, {haversine_sql('e.lat', 'e.lon', 's.lat', 's.lon')} AS d, row_number() OVER (PARTITION BY e.event ORDER BY {haversine_sql('e.lat', 'e.lon', 's.lat', 's.lon')}, s.event) AS k
  FROM ev e JOIN sel s ON abs(e.lat - s.lat) <= 0.5 WHERE e.event % 20 <> 0) WHERE k = 1 AND d <= 50)"""


def selection(spark, sf_dir):
    """The selection of an investigation map: the events of every other site's first period."""
    return lens.events(spark, sf_dir).where(F.col("event") % 20 == 0).select("event")


@query("selection_context", with_views("obs", "members", "ev", body=_CONTEXT + " SELECT event, nearest_selected, round(distance_km, 6) AS distance_km FROM ctx"))
def selection_context(spark, sf_dir):
    return graph.context_of_selection(lens.events(spark, sf_dir), selection(spark, sf_dir)).withColumn("distance_km", F.round("distance_km", 6))


@query("investigation_map", with_views("obs", "members", "ev", body=_PAIRS + _EDGES + _CONTEXT + """, real AS (SELECT least(source, target) AS a, greatest(source, target) AS b, distance_km AS r, state FROM edges)
SELECT a, b, round(r, 6) AS distance_km, state, true AS computed FROM real WHERE a % 20 = 0 AND b % 20 = 0
UNION ALL SELECT a, b, round(coalesce(r, distance_km), 6), coalesce(state, 'DISTANCE_ONLY'), state IS NOT NULL FROM (SELECT least(event, nearest_selected) AS a, greatest(event, nearest_selected) AS b, distance_km FROM ctx) LEFT JOIN real USING (a, b)"""))
def investigation_map(spark, sf_dir):
    return maps(spark, sf_dir, selection(spark, sf_dir))[0].withColumn("distance_km", F.round("distance_km", 6))


EDGES_SQL, CONTEXT_SQL = _PAIRS + _EDGES, _CONTEXT

# Movement and complexity.
_SEGMENTS = f""", steps AS (SELECT *, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon FROM members WINDOW w AS (PARTITION BY event ORDER BY ts, obs_id)),
seg AS (SELECT event, {haversine_sql('plat', 'plon', 'latitude', 'longitude')} AS d, atan2(sin(radians(longitude - plon)) * cos(radians(latitude)), cos(radians(plat)) * sin(radians(latitude)) - sin(radians(plat)) * cos(radians(latitude)) * cos(radians(longitude - plon))) AS th FROM steps WHERE plat IS NOT NULL),
ends AS (SELECT event, arg_min(latitude, (ts, obs_id)) AS la, arg_min(longitude, (ts, obs_id)) AS lo, arg_max(latitude, (ts, obs_id)) AS lb, arg_max(longitude, (ts, obs_id)) AS lp FROM members GROUP BY event),
moves AS (SELECT event, sum(d) AS path_km, CASE WHEN sum(d) > 0 THEN sqrt(pow(sum(d * sin(th)), 2) + pow(sum(d * cos(th)), 2)) / sum(d) END AS consistency, CASE WHEN sum(d) > 0 AND event % 5 <> 0 THEN sum(d * cos(th - radians(((event * 37) % 360 + 180) % 360))) / sum(d) END AS wind_alignment FROM seg GROUP BY event)"""


@query("event_movement", with_views("obs", "members", body=_SEGMENTS + f""" SELECT event, round(coalesce(path_km, 0), 5) AS path_km, round({haversine_sql('la', 'lo', 'lb', 'lp')}, 5) AS net_km, round(consistency, 5) AS consistency, round(wind_alignment, 5) AS wind_alignment FROM ends LEFT JOIN moves USING (event)"""))
def event_movement(spark, sf_dir):
    m = complexity.movement(lens.members(spark, sf_dir), wind(spark, sf_dir))
    return m.select("event", *(F.round(c, 5).alias(c) for c in ("path_km", "net_km", "consistency", "wind_alignment")))


@query("power_variation", with_views("obs", "members", body=" SELECT event, count(frp) AS readings, CASE WHEN count(frp) >= 2 THEN round(CASE WHEN avg(frp) = 0 THEN 0 ELSE stddev_pop(frp) / avg(frp) END, 6) END AS frp_cv FROM members GROUP BY event"))
def power_variation(spark, sf_dir):
    return complexity.power_variation(lens.members(spark, sf_dir)).withColumn("frp_cv", F.round("frp_cv", 6))


_UNEXPLAINED = """
, first_of AS (SELECT event, arg_min(latitude, (ts, obs_id)) AS olat, arg_min(longitude, (ts, obs_id)) AS olon, min(ts) AS ots, arg_min(obs_id, (ts, obs_id)) AS first_id FROM members GROUP BY event),
later AS (SELECT event, epoch_us(ts - ots) / 3600e6 AS t, ((event * 37) % 360 + 180) % 360 AS down, radians(longitude - olon) * 6371.0088::DOUBLE * cos(radians((olat + latitude) / 2)) AS east, radians(latitude - olat) * 6371.0088::DOUBLE AS north FROM members JOIN first_of USING (event) WHERE obs_id <> first_id AND event % 5 <> 0),
placed_later AS (SELECT event, CASE WHEN t <= 0 THEN east = 0 AND north = 0 ELSE pow((east * sin(radians(down)) + north * cos(radians(down)) - t * 2) / (t * 3), 2) + pow((east * cos(radians(down)) - north * sin(radians(down))) / (t * 2.5), 2) <= 1 END AS inside FROM later),
outside AS (SELECT m.event, count(inside) AS evaluated, count(*) FILTER (WHERE NOT inside) AS outside FROM (SELECT DISTINCT event FROM members) m LEFT JOIN placed_later USING (event) GROUP BY m.event)"""


@query("unexplained_detections", with_views("obs", "members", body=_UNEXPLAINED + " SELECT * FROM outside"))
def unexplained_detections(spark, sf_dir):
    return complexity.unexplained(lens.members(spark, sf_dir), wind(spark, sf_dir))


def _complexity(spark, sf_dir):
    m, e, blown = lens.members(spark, sf_dir), lens.events(spark, sf_dir), wind(spark, sf_dir)
    u, seen = complexity.unexplained(m, blown), F.col("evaluated") > 0
    facts = (
        e.select("event", F.col("hours").alias("duration"), F.col("n").alias("observation_count"), F.col("extent_km").alias("spatial_extent"))
        .join(complexity.movement(m, blown).select("event", F.col("net_km").alias("centroid_movement"), F.col("consistency").alias("directional_consistency"), "wind_alignment"), "event")
        .join(complexity.power_variation(m).select("event", F.col("frp_cv").alias("frp_variability")), "event")
        .join(ev.lobes(m).groupBy("event").agg(F.count("*").alias("distinct_thermal_lobes")), "event")
        .join(rs.footprint_fraction(e, lens.raster(spark), rs.TRANSFORM).select("event", F.coalesce("peat_fraction", F.when(F.col("any_peat"), 1.0)).alias("peat_overlap")), "event")
        .join(graph.nearby_and_recurrence(e).select("event", F.col("nearby_events").alias("nearby_event_count"), (F.col("recurrences") > 0).cast("int").alias("historical_recurrence")), "event")
        .join(u.select("event", F.when(seen, F.col("outside")).alias("unexplained_detections"), F.when(seen, F.col("outside") / F.col("evaluated")).alias("surface_propagation_mismatch")), "event")
    )
    return complexity.complexity_fields(facts)


_LOBES = """, lobe_ref AS (SELECT event, sum(round(latitude * 1e5)::BIGINT) / count(*) / 1e5 AS ref_lat FROM members GROUP BY event),
lobe_xy AS (SELECT m.*, radians(longitude) * 6371.0088::DOUBLE * cos(radians(ref_lat)) AS x, radians(latitude) * 6371.0088::DOUBLE AS y FROM members m JOIN lobe_ref USING (event)),
lobe_links AS (SELECT a.obs_id AS v, b.obs_id AS w FROM lobe_xy a JOIN lobe_xy b ON a.event = b.event AND a.obs_id <> b.obs_id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1),
lobe_reach(root, v) AS (SELECT obs_id, obs_id FROM members UNION SELECT r.root, e.w FROM lobe_reach r JOIN lobe_links e ON e.v = r.v WHERE r.root < e.w),
lobe_count AS (SELECT event, count(DISTINCT lobe) AS lobes FROM members JOIN (SELECT v AS obs_id, min(root) AS lobe FROM lobe_reach GROUP BY v) USING (obs_id) GROUP BY event)"""
LOBES_SQL = _LOBES
_NEAR = f""", around AS (SELECT a.event, count(b.event) FILTER (WHERE {_GAP} <= 72) AS nearby, count(b.event) FILTER (WHERE b.last < a.first AND {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 2) AS earlier
  FROM ev a LEFT JOIN ev b ON a.event <> b.event AND abs(a.lat - b.lat) <= 0.1 AND {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 10 GROUP BY a.event)"""
_VALUES = _SEGMENTS + _UNEXPLAINED + _LOBES + context_queries.FOOTPRINT_SQL + _NEAR + f""", power AS (SELECT event, CASE WHEN count(frp) >= 2 THEN CASE WHEN avg(frp) = 0 THEN 0 ELSE stddev_pop(frp) / avg(frp) END END AS cv FROM members GROUP BY event),
field_values AS (SELECT ev.event, hours AS duration, n::DOUBLE AS observation_count, extent_km AS spatial_extent, {haversine_sql('la', 'lo', 'lb', 'lp')} AS centroid_movement, consistency AS directional_consistency, wind_alignment, cv AS frp_variability, lobes::DOUBLE AS distinct_thermal_lobes,
    peat_fraction AS peat_overlap, nearby::DOUBLE AS nearby_event_count, (earlier > 0)::INTEGER::DOUBLE AS historical_recurrence, CASE WHEN evaluated > 0 THEN outside.outside END::DOUBLE AS unexplained_detections, CASE WHEN evaluated > 0 THEN outside.outside / evaluated END AS surface_propagation_mismatch
  FROM ev JOIN ends USING (event) LEFT JOIN moves USING (event) JOIN power USING (event) JOIN lobe_count USING (event) JOIN footprints USING (event) JOIN around USING (event) JOIN outside USING (event)),
fields AS (SELECT event, field, value FROM field_values UNPIVOT INCLUDE NULLS (value FOR field IN ({', '.join(complexity.FIELDS)})))"""
_VIEWS = ("obs", "members", "ev", "raster")


@query("complexity_fields", with_views(*_VIEWS, recursive=True, body=_VALUES + f""", names AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{f}')" for i, f in enumerate(complexity.FIELDS))}) t(nth, field))
SELECT event, nth, field, round(value, 5) AS value, CASE WHEN value IS NULL THEN 'NOT_EVALUATED' ELSE 'EVALUATED' END AS status, CASE WHEN value IS NULL THEN 0 WHEN field = 'peat_overlap' THEN 0.7 ELSE 0.82 END::DOUBLE AS quality, 'DERIVED_COMPLEXITY_' || event || '_' || field AS evidence_id FROM fields JOIN names USING (field)"""))
def complexity_fields(spark, sf_dir):
    return _complexity(spark, sf_dir).withColumn("value", F.round("value", 5))


_SIGNALS = """, signals AS (SELECT event, CASE field WHEN 'duration' THEN value / 72 WHEN 'observation_count' THEN value / 20 WHEN 'spatial_extent' THEN value / 10 WHEN 'centroid_movement' THEN value / 10 WHEN 'directional_consistency' THEN 1 - value WHEN 'wind_alignment' THEN 1 - (value + 1) / 2 WHEN 'frp_variability' THEN value
  WHEN 'distinct_thermal_lobes' THEN (value - 1) / 4 WHEN 'nearby_event_count' THEN value / 3 WHEN 'historical_recurrence' THEN value WHEN 'unexplained_detections' THEN value / 10 WHEN 'surface_propagation_mismatch' THEN value END AS s FROM fields)"""


@query("complexity_signal", with_views(*_VIEWS, recursive=True, body=_VALUES + _SIGNALS + " SELECT event, count(s) AS evaluated_fields, round(avg(CASE WHEN s IS NOT NULL THEN least(greatest(s, 0), 1) END), 5) AS complexity_signal FROM signals GROUP BY event"))
def complexity_signal(spark, sf_dir):
    return complexity.complexity_signal(_complexity(spark, sf_dir)).withColumn("complexity_signal", F.round("complexity_signal", 5))


# Priority: factors from the triage state, a sufficiency label, peat and relations.
def _factors(spark, sf_dir, d=None):
    d = materialise(events_queries.decided(spark, sf_dir).select("event", "state")) if d is None else d
    lab = lambda f, c: priority.label_signal(F.lit(f), c)
    suff = F.when(F.col("event") % 3 == 0, "SUFFICIENT").when(F.col("event") % 3 == 1, "PARTIAL").otherwise("INSUFFICIENT")
    one = d.select("event", F.lit("validity").alias("factor"), lab("event_validity", F.col("state")).alias("signal"), F.lit(1.0).alias("quality"))
    two = d.select("event", F.lit("evidence_sufficiency").alias("factor"), lab("evidence_sufficiency", suff).alias("signal"), F.lit(1.0).alias("quality"))
    three = d.where("event % 4 <> 0").select("event", F.lit("peat").alias("factor"), ((F.col("event") % 5) / 4.0).alias("signal"), F.lit(0.8).alias("quality"))
    four = graph.signal_of_counts(edge_counts(spark, sf_dir), lens.events(spark, sf_dir)).select("event", F.lit("unresolved_relationships").alias("factor"), "signal", F.lit(0.8).alias("quality"))
    return one.union(two).union(three).union(four)


_PRIORITY = events_queries.DECIDED_SQL + _PAIRS + _EDGES + """, ends AS (SELECT source AS event, state FROM edges UNION ALL SELECT target, state FROM edges),
rel AS (SELECT ev.event, count(*) FILTER (WHERE state IN ('UNRESOLVED', 'RELATED_POSSIBLE')) / greatest(count(state), 1) AS s FROM ev LEFT JOIN ends USING (event) GROUP BY ev.event),
suff AS (SELECT event, state, CASE event % 3 WHEN 0 THEN 'SUFFICIENT' WHEN 1 THEN 'PARTIAL' ELSE 'INSUFFICIENT' END AS sufficiency FROM decided),
have AS (SELECT event, 'event_validity' AS factor, CASE state WHEN 'LIKELY_FIRE' THEN 1.0 WHEN 'AMBIGUOUS' THEN 0.5 ELSE 0.0 END::DOUBLE AS signal, 1.0::DOUBLE AS quality FROM suff
  UNION ALL SELECT event, 'evidence_sufficiency', CASE sufficiency WHEN 'SUFFICIENT' THEN 0.0 WHEN 'PARTIAL' THEN 0.6 ELSE 1.0 END::DOUBLE, 1.0 FROM suff
  UNION ALL SELECT event, 'peat_involvement', (event % 5) / 4.0::DOUBLE, 0.8 FROM suff WHERE event % 4 <> 0 UNION ALL SELECT event, 'unresolved_event_relationships', s, 0.8 FROM rel),
dim AS (SELECT * FROM (VALUES """ + ", ".join(f"('{f}', {w}::DOUBLE)" for f, w in priority.WEIGHTS.items()) + """) t(factor, weight)),
parts AS (SELECT ev.event, d.factor, weight, signal, quality, coalesce(weight * signal * quality, 0) AS contribution, CASE WHEN signal IS NULL THEN 'NOT_EVALUATED' ELSE 'EVALUATED' END AS status FROM ev CROSS JOIN dim d LEFT JOIN have h ON h.event = ev.event AND h.factor = d.factor),
prio AS (SELECT event, sum(contribution) AS raw, sum(CASE WHEN status = 'EVALUATED' THEN weight ELSE 0 END) / 100 AS coverage FROM parts GROUP BY event),
banded AS (SELECT event, raw, coverage, CASE WHEN coverage = 0 THEN 'MEDIUM' WHEN raw >= 59.99995 THEN 'URGENT' WHEN raw >= 19.99995 THEN 'HIGH' WHEN raw >= 11.99995 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM prio),
routed AS (SELECT b.*, s.state, s.sufficiency, CASE WHEN priority IN ('HIGH', 'URGENT') THEN 'HUMAN_REVIEW' WHEN state = 'AMBIGUOUS' THEN 'REVIEW_RECOMMENDED' ELSE 'SCREENED' END AS route FROM banded b JOIN suff s USING (event))"""


PRIORITY_SQL = _PRIORITY


@query("priority_components", with_views("obs", "members", "ev", body=_PRIORITY + " SELECT event, factor, weight, signal, quality, contribution, status FROM parts"))
def priority_components(spark, sf_dir):
    return priority.components(lens.events(spark, sf_dir), _factors(spark, sf_dir))


def routed(spark, sf_dir):
    d = materialise(events_queries.decided(spark, sf_dir).select("event", "state"))
    p = priority.priorities(priority.components(lens.events(spark, sf_dir), _factors(spark, sf_dir, d)))
    suff = F.when(F.col("event") % 3 == 0, "SUFFICIENT").when(F.col("event") % 3 == 1, "PARTIAL").otherwise("INSUFFICIENT")
    return priority.routed(p.join(d, "event").withColumn("sufficiency", suff))


@query("review_routing", with_views("obs", "members", "ev", body=_PRIORITY + """ SELECT event, round_even(raw, 4) AS score, coverage, priority, state, sufficiency, route, CASE WHEN route = 'HUMAN_REVIEW' THEN 'priority ' || priority WHEN state = 'AMBIGUOUS' THEN 'ambiguous triage' ELSE 'no reason for review' END AS route_reason FROM routed"""))
def review_routing(spark, sf_dir):
    return routed(spark, sf_dir)


@query("routing_distributions", with_views("obs", "members", "ev", body=_PRIORITY + """, long AS (SELECT 'priority' AS measure, priority AS value FROM routed UNION ALL SELECT 'route', route FROM routed UNION ALL SELECT 'state', state FROM routed UNION ALL SELECT 'sufficiency', sufficiency FROM routed)
SELECT measure, value, count(*) AS events, round_even(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM routed), 2) AS percent FROM long GROUP BY measure, value"""))
def routing_distributions(spark, sf_dir):
    return priority.routing_distributions(routed(spark, sf_dir))


@query("factor_totals", with_views("obs", "members", "ev", body=_PRIORITY + " SELECT factor, count(signal) AS evaluated, round(sum(contribution), 3) AS contribution, round(sum(contribution) / (SELECT sum(contribution) FROM parts), 6) AS share FROM parts GROUP BY factor"))
def factor_totals(spark, sf_dir):
    return priority.component_totals(priority.components(lens.events(spark, sf_dir), _factors(spark, sf_dir))).select("factor", "evaluated", F.round("contribution", 3).alias("contribution"), "share")


# Register.
_RELATION = """, placed AS (SELECT audit, event, n, first, last, CASE WHEN e.lon >= s.west AND e.lon < s.east AND e.lat >= s.south AND e.lat < s.north THEN 'INSIDE_SCOPE'
    WHEN e.west <= s.east AND e.east >= s.west AND e.south <= s.north AND e.north >= s.south THEN 'BOUNDARY_INTERSECTING' ELSE 'EXTERNAL_CONTEXT' END AS relation,
    e.lon BETWEEN s.west - 10 / (111.32 * cos(radians((s.south + s.north) / 2))) AND s.east + 10 / (111.32 * cos(radians((s.south + s.north) / 2))) AND e.lat BETWEEN s.south - 10 / 111.32 AND s.north + 10 / 111.32 AS buffered FROM ev e, scopes s),
scoped AS (SELECT * FROM placed WHERE relation <> 'EXTERNAL_CONTEXT' OR buffered)"""


RELATION_SQL = _RELATION


@query("scope_relations", with_views("obs", "members", "ev", "scopes", body=_RELATION + " SELECT audit, event, relation FROM scoped"))
def scope_relations(spark, sf_dir):
    return register.in_scopes(lens.events(spark, sf_dir), lens.scopes(spark, sf_dir)).select("audit", "event", "relation")


@query("scope_summary", with_views("obs", "members", "ev", "scopes", body=_RELATION + """ SELECT audit, count(*) AS events, sum(n)::BIGINT AS observations, count(*) FILTER (WHERE relation = 'INSIDE_SCOPE') AS inside, count(*) FILTER (WHERE relation = 'BOUNDARY_INTERSECTING') AS intersecting,
  count(*) FILTER (WHERE relation = 'EXTERNAL_CONTEXT') AS external, min(first) AS first, max(last) AS last FROM scoped GROUP BY audit"""))
def scope_summary(spark, sf_dir):
    e = lens.events(spark, sf_dir)
    return register.scope_summary(register.in_scopes(e, lens.scopes(spark, sf_dir)), e)


@query("scope_bounds", with_views("scopes", body=" SELECT audit, west, south, east, north, round((east - west) * (north - south), 6) AS area FROM scopes"))
def scope_bounds(spark, sf_dir):
    return register.scope_bounds(lens.scopes(spark, sf_dir)).withColumn("area", F.round("area", 6))


@query("scope_problems", "SELECT r_regionkey::BIGINT AS audit, ring, 'not closed' AS problem FROM region, (VALUES (0), (1)) t(ring) WHERE r_regionkey % 2 = 0")
def scope_problems(spark, sf_dir):
    broken = lens.scopes(spark, sf_dir).withColumn("rings", F.when(F.col("audit") % 2 == 0, F.transform("rings", lambda r: F.slice(r, 1, 4))).otherwise(F.col("rings")))
    return register.scope_problems(broken)


@query("register_page", with_views("obs", "members", "ev", body=" SELECT event, first, last, n, max_frp, count(*) OVER () AS total FROM ev WHERE last >= TIMESTAMP '2024-01-06' AND first <= TIMESTAMP '2024-01-20' AND max_frp >= 50 ORDER BY max_frp DESC NULLS LAST, event LIMIT 500 OFFSET 10"))
def register_page(spark, sf_dir):
    rows = register.filtered(lens.events(spark, sf_dir), since="2024-01-06", until="2024-01-20", min_frp=50.0)
    return register.page(rows, "max_frp", descending=True, offset=10).select("event", "first", "last", "n", "max_frp", "total")


_PAGE_KEYS = {k: (c, i % 2 == 0) for i, (k, c) in enumerate(register.SORT_KEYS.items())}
_PAGE_SQL = " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{k}' AS key, event, row_number() OVER (ORDER BY {'lower(state)' if c == 'state' else c} {'DESC NULLS LAST' if down else 'ASC NULLS FIRST'}, event) AS place, count(*) OVER () AS total FROM listed) WHERE place BETWEEN 8 AND 27"""
    for k, (c, down) in _PAGE_KEYS.items()
)


@query("register_pages", with_views("obs", "members", "ev", body=events_queries.DECIDED_SQL + f", listed AS (SELECT ev.* REPLACE (CASE WHEN event % 7 <> 0 THEN max_frp END AS max_frp), state FROM ev JOIN decided USING (event)) {_PAGE_SQL}"))
def register_pages(spark, sf_dir):
    """A page by each sort key, up and down; every other one is cut out of the numbered order as pages far down are."""
    rows = materialise(lens.events(spark, sf_dir).withColumn("max_frp", F.when(F.col("event") % 7 != 0, F.col("max_frp"))).join(events_queries.decided(spark, sf_dir).select("event", "state"), "event"))
    out = None
    for nth, (key, (_, down)) in enumerate(_PAGE_KEYS.items()):
        one = register.page(rows, key, down, limit=20, offset=7, shallow=0 if nth % 2 else register.SHALLOW)
        place = F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) + 7  # a page of twenty rows
        one = one.select(F.lit(key).alias("key"), "event", place.cast("long").alias("place"), "total")
        out = one if out is None else out.unionByName(one)
    return out


@query("active_days", with_views("obs", "members", "ev", body=" SELECT d::DATE AS day, count(*) AS events, sum(n)::BIGINT AS observations FROM (SELECT n, unnest(generate_series(first::DATE::TIMESTAMP, last::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM ev) GROUP BY d"))
def active_days(spark, sf_dir):
    return register.active_days(lens.events(spark, sf_dir))


def _chain_sql(narrowed: bool) -> str:
    own = "own" + str(int(narrowed))
    return f"""SELECT {'NULL::BIGINT' if narrowed else '(SELECT count(*) FROM obs)'} AS raw, (SELECT {'sum(n)::BIGINT FROM ' + own if narrowed else 'count(*) FROM members'}) AS qualified, (SELECT count(*) FROM {own}) AS events,
  (SELECT count(DISTINCT event) FROM scoped WHERE event IN (SELECT event FROM {own})) AS in_scope, (SELECT count(*) FROM routed WHERE route = 'HUMAN_REVIEW' AND event IN (SELECT event FROM {own})) AS for_review, (SELECT count(DISTINCT event) FROM pack) AS selected, {narrowed} AS narrowed"""


@query("progression_chain", with_views("obs", "members", "ev", "scopes", body=_RELATION + _PRIORITY + f""", own0 AS (SELECT * FROM ev), own1 AS (SELECT * FROM ev WHERE first >= TIMESTAMP '2024-01-11'), pack AS (SELECT event FROM ev WHERE event % 9 = 0),
chain AS ({_chain_sql(False)} UNION ALL {_chain_sql(True)})
SELECT *, round_even(qualified / nullif(events, 0), 2) AS observations_per_event, round_even(events / nullif(in_scope, 0), 2) AS scope_compression FROM chain"""))
def progression_chain(spark, sf_dir):
    e, routes = lens.events(spark, sf_dir), materialise(routed(spark, sf_dir).select("event", "route"))
    chain = lambda events, narrowed: register.progression_chain(lens.observations(spark, sf_dir), events, register.in_scopes(e, lens.scopes(spark, sf_dir)), routes, e.where("event % 9 = 0"), narrowed)
    return chain(e, False).unionByName(chain(e.where(F.col("first") >= "2024-01-11"), True))


def _log(spark, sf_dir):
    """Pack actions: each turn of a conversation touches one event; every fifth removes it."""
    c = lens.table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("audit"), (F.col("turn") % 3).cast("long").alias("event"), F.col("turn").cast("long").alias("seq"), F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 60).alias("at"),
        F.when(F.col("turn") % 5 == 4, "remove").otherwise("add").alias("action"), F.substring("role", 1, 4).alias("note"),
    )


@query("pack_state", """WITH log AS (SELECT conv_id AS audit, (turn % 3)::BIGINT AS event, turn AS seq, make_timestamp((1704067200 + turn * 60) * 1000000) AS moment, turn % 5 = 4 AS gone, substr(role, 1, 4) AS note FROM conversations),
cut AS (SELECT audit, event, max(CASE WHEN gone THEN seq END) AS removed FROM log GROUP BY audit, event)
SELECT audit, event, min(moment) AS added_at, max(moment) AS updated_at, arg_max(note, seq) AS note FROM log JOIN cut USING (audit, event) WHERE NOT gone AND seq > coalesce(removed, -1) GROUP BY audit, event""")
def pack_state(spark, sf_dir):
    return register.pack_state(_log(spark, sf_dir))


# Assessments: findings from the conversations, evidence from the benchmark.
def _findings(spark, sf_dir):
    c = lens.table(spark, sf_dir, "conversations")
    h = F.col("conv_id") % 5
    ids = lambda m: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.lit("E"), ((F.col("turn") * m + i * 3) % 11).cast("string")))
    return c.select(F.col("role"), h.cast("string").alias("hypothesis"), F.col("turn").alias("nth"), (F.length("text") % 130).alias("score"), ids(2).alias("supporting"), ids(5).alias("contradicting")).withColumn("evidence_ids", F.array_union("supporting", "contradicting"))


@query("finding_problems", """WITH f AS (SELECT role, (conv_id % 5)::VARCHAR AS hypothesis, length(text) % 130 AS score, turn FROM conversations),
cited AS (SELECT DISTINCT role, hypothesis, 'E' || ((turn * m + i * 3) % 11) AS id FROM f, (VALUES (2), (5)) a(m), (VALUES (0), (1), (2)) b(i))
SELECT role, hypothesis, 'score out of range' AS problem FROM f WHERE score NOT BETWEEN 0 AND 100 UNION ALL SELECT role, hypothesis, 'unknown evidence ' || id FROM cited WHERE id = 'E10'
UNION ALL SELECT role, hypothesis, 'found twice' FROM f GROUP BY role, hypothesis HAVING count(*) > 1
UNION ALL SELECT r.role, h.h, 'not found' FROM (SELECT DISTINCT role FROM f) r, (VALUES ('0'), ('1'), ('2'), ('3'), ('4'), ('5')) h(h) WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.role = r.role AND f.hypothesis = h.h)""")
def finding_problems(spark, sf_dir):
    ids = lens.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("E"), (F.col("item_id") % 10).cast("string")).alias("evidence_id"))
    hyp = lens.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("hypothesis")).union(spark.sql("select '5'"))
    return assess.finding_problems(_findings(spark, sf_dir), ids, hyp)


_FINDINGS = """WITH f AS (SELECT role, (conv_id % 5)::VARCHAR AS hypothesis, turn, length(text) % 130 AS score, ['E' || ((turn * 2) % 11), 'E' || ((turn * 2 + 3) % 11), 'E' || ((turn * 2 + 6) % 11)] AS s, ['E' || ((turn * 5) % 11), 'E' || ((turn * 5 + 3) % 11), 'E' || ((turn * 5 + 6) % 11)] AS c FROM conversations)"""


@query("evidence_buckets", _FINDINGS + """ SELECT role, hypothesis, array_to_string(list_sort([x FOR x IN s IF NOT list_contains(c, x)]), ',') AS supporting, array_to_string(list_sort([x FOR x IN c IF NOT list_contains(s, x)]), ',') AS contradicting,
  array_to_string(list_sort([x FOR x IN s IF list_contains(c, x)]), ',') AS mixed FROM f""")
def evidence_buckets(spark, sf_dir):
    b = assess.evidence_buckets(_findings(spark, sf_dir))
    return b.select("role", "hypothesis", *(F.array_join(c, ",").alias(c) for c in ("supporting", "contradicting", "mixed")))


@query("top_disagreement", _FINDINGS + """, top AS (SELECT role, hypothesis, score FROM f WHERE role IN ('user', 'assistant') QUALIFY row_number() OVER (PARTITION BY role ORDER BY score DESC, turn, hypothesis) = 1)
SELECT a.hypothesis AS first_top, a.score AS first_score, b.hypothesis AS second_top, b.score AS second_score, CASE WHEN a.hypothesis = b.hypothesis THEN 'support differs' ELSE 'leading hypotheses differ' END AS question
FROM top a, top b WHERE a.role = 'user' AND b.role = 'assistant' AND (a.hypothesis <> b.hypothesis OR abs(a.score - b.score) >= 20)""")
def top_disagreement(spark, sf_dir):
    return assess.disagreement(_findings(spark, sf_dir), "user", "assistant").drop("evidence_ids")


@query("open_questions", _FINDINGS + """, q AS (SELECT 'what about ' || hypothesis AS question, array_to_string(list_sort(list_distinct(list_concat(s, c))), ',') AS evidence_ids, score < 100 AS settled FROM f)
SELECT question, evidence_ids, count(*) AS asked, CASE WHEN bool_and(settled) THEN 'CONVERGED' ELSE 'UNRESOLVED' END AS status FROM q GROUP BY question, evidence_ids""")
def open_questions(spark, sf_dir):
    f = _findings(spark, sf_dir)
    return assess.open_questions(f.select(F.concat(F.lit("what about "), "hypothesis").alias("question"), "evidence_ids", (F.col("score") < 100).alias("settled"))).withColumn("evidence_ids", F.array_join("evidence_ids", ","))


# Images: order lines as pixels of the order's image.
def _pixels(spark, sf_dir):
    l = lens.table(spark, sf_dir, "lineitem")
    return l.select(
        (F.col("l_orderkey") % 50).alias("image"), F.col("l_orderkey").alias("x"), F.col("l_linenumber").alias("y"), (F.col("l_quantity").cast("long") % 4).alias("grey"), (F.col("l_quantity").cast("long") % 2).alias("mask"),
        (F.col("l_quantity").cast("double") / 60).alias("b12"), (F.col("l_discount").cast("double") * 5).alias("b08"), (F.col("l_tax").cast("double") * 9).alias("b04"),
        (F.col("l_quantity").cast("double") / 100).alias("vv"), (F.col("l_quantity").cast("double") / 500).alias("vh"),
    )


_PIX = """WITH px AS (SELECT l_orderkey % 50 AS image, l_orderkey AS x, l_linenumber AS y, l_quantity::BIGINT % 4 AS grey, l_quantity::BIGINT % 2 AS mask, l_quantity::DOUBLE / 60 AS b12, l_discount::DOUBLE * 5 AS b08, l_tax::DOUBLE * 9 AS b04, l_quantity::DOUBLE / 100 AS vv, l_quantity::DOUBLE / 500 AS vh FROM lineitem)"""


@query("image_coverage", _PIX + " SELECT image, count(*) AS pixels, avg((grey > 0)::INTEGER) AS coverage, avg((grey > 0)::INTEGER) < 0.05 AS missing FROM px GROUP BY image")
def image_coverage(spark, sf_dir):
    return pixels.coverage(_pixels(spark, sf_dir))


@query("optical_composite", _PIX + " SELECT image, x, y, CASE WHEN mask = 0 THEN 0 ELSE greatest(least(b12 * 2.5::DOUBLE, 1), 0) END AS red, CASE WHEN mask = 0 THEN 0 ELSE greatest(least(b08 * 2.5::DOUBLE, 1), 0) END AS green, CASE WHEN mask = 0 THEN 0 ELSE greatest(least(b04 * 2.5::DOUBLE, 1), 0) END AS blue FROM px")
def optical_composite(spark, sf_dir):
    return pixels.optical_composite(_pixels(spark, sf_dir))


@query("radar_composite", _PIX + """, db AS (SELECT *, log10(greatest(vv, 1e-6)) * 10 AS a, log10(greatest(vh, 1e-6)) * 10 AS b FROM px)
SELECT image, x, y, round(CASE WHEN mask = 0 THEN 0 ELSE greatest(least((a + 20) / 20, 1), 0) END, 5) AS red, round(CASE WHEN mask = 0 THEN 0 ELSE greatest(least((b + 25) / 20, 1), 0) END, 5) AS green, round(CASE WHEN mask = 0 THEN 0 ELSE greatest(least((a - b) / 15, 1), 0) END, 5) AS blue FROM db""")
def radar_composite(spark, sf_dir):
    return pixels.radar_composite(_pixels(spark, sf_dir)).select("image", "x", "y", *(F.round(c, 5).alias(c) for c in ("red", "green", "blue")))


@query("display_stretch", _PIX + """, d AS (SELECT image, x, y, CASE WHEN vv > 0 THEN log10(vv) * 10 END AS db FROM px), e AS (SELECT image, quantile_cont(db, 0.02) AS lo, quantile_cont(db, 0.98) AS hi FROM d GROUP BY image)
SELECT image, x, y, CASE WHEN db IS NULL THEN 0 WHEN hi <= lo THEN 128 ELSE floor(greatest(least((db - lo) / (hi - lo), 1), 0) * 255)::INTEGER END AS display FROM d JOIN e USING (image)""")
def display_stretch(spark, sf_dir):
    return pixels.display_stretch(_pixels(spark, sf_dir))


def _burned(spark, sf_dir):
    """Detections as a raster: cells of a hundredth of a degree, peat class 1 where something burned, 2 where it did often."""
    cell = lambda c, o: F.floor((F.col(c) - o) * 100 + 1e-6).cast("long")
    return lens.observations(spark, sf_dir).groupBy(cell("latitude", -5.0).alias("row"), cell("longitude", 115.0).alias("col")).agg(F.when(F.count("*") > 3, 2).otherwise(1).alias("value"))


_BURNED = """, cells AS (SELECT floor((latitude + 5.0) * 100 + 1e-6)::BIGINT AS row, floor((longitude - 115.0) * 100 + 1e-6)::BIGINT AS col, CASE WHEN count(*) > 3 THEN 2 ELSE 1 END AS value FROM obs GROUP BY 1, 2)"""


@query("raster_rectangles", with_views("obs", body=_BURNED + """, b AS (SELECT row // 4 AS row, col // 4 AS col FROM cells GROUP BY 1, 2 HAVING bool_or(value IN (1, 2))),
i AS (SELECT row, col, col - row_number() OVER (PARTITION BY row ORDER BY col) AS g FROM b) SELECT row, min(col) AS from_col, max(col) AS to_col FROM i GROUP BY row, g"""))
def raster_rectangles(spark, sf_dir):
    return rs.rectangles(rs.downsampled(_burned(spark, sf_dir)))


@query("raster_crop", with_views("obs", body=_BURNED + " SELECT row - 60 AS row, col - 20 AS col, value FROM cells WHERE row BETWEEN 60 AND 120 AND col BETWEEN 20 AND 80"))
def raster_crop(spark, sf_dir):
    t = rs.Transform(0.0, 0.0, 1.0, 1000, 1000)  # cells counted southward and eastward from (0, 0)
    return rs.crop(_burned(spark, sf_dir), t, 30, -110, 70, -70, 10.0)[0]


@query("plain_prose", r"""WITH a AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\s(?:—|–|--)\s(\p{Lu})', '. \1', 'g'), '\s(?:—|–|--)\s', ', ', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(\d)—(\d)', '\1–\2', 'g'), '(\d)—(\d)', '\1–\2', 'g') AS t FROM b) SELECT doc_id, regexp_replace(trim(regexp_replace(replace(t, '—', ': '), '\s+', ' ', 'g')), '[ :,]+$', '') AS prose FROM c""")
def plain_prose(spark, sf_dir):
    d = lens.table(spark, sf_dir, "documents")
    return d.select("doc_id", plain_text(F.col("text")).alias("prose"))


@query("envelope_rings", with_views("obs", "members", "ev", body=""", r AS (SELECT event, (hours * 5 + hours) / 2 AS a, (hours * 5 - hours) / 2 AS shift FROM ev WHERE event % 5 <> 0), q AS (SELECT *, CASE WHEN a + shift > 5 THEN 5 / (a + shift) ELSE 1 END AS scale FROM r)
SELECT event, 49 AS positions, round(scale, 6) AS scale, round(a * scale, 6) AS half_length, 65 AS circle_positions FROM q"""))
def envelope_rings(spark, sf_dir):
    e = lens.events(spark, sf_dir).join(wind(spark, sf_dir), "event")
    shape = geo.envelope(F.col("lat"), F.col("lon"), F.col("hours"), F.col("wind_from"))
    small = geo.capped(shape)
    return e.select("event", F.size(geo.envelope_ring(shape)).alias("positions"), F.round(small["scale"], 6).alias("scale"), F.round(small["half_length"], 6).alias("half_length"), F.size(geo.circle(F.col("lat"), F.col("lon"), F.lit(10.0))).alias("circle_positions"))
