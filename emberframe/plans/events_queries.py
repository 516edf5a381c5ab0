"""Registered queries and SQL: reconstruction, diagnostics, triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe.operators import events as ev
from emberframe.operators import triage
from emberframe.plans import lens
from emberframe.plans.lens import haversine_sql, with_views

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_PAIRS = """, ok AS (SELECT * FROM obs WHERE confidence <> 'l'),
ref AS (SELECT sum(round(latitude * 1e5)::BIGINT) / count(*) / 1e5 AS ref_lat FROM ok),
xy AS (SELECT ok.*, radians(longitude) * 6371.0088::DOUBLE * cos(radians(ref_lat)) AS x, radians(latitude) * 6371.0088::DOUBLE AS y FROM ok, ref),
pairs AS (
  SELECT a.obs_id AS a, b.obs_id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance_km, abs(epoch_us(b.ts) - epoch_us(a.ts)) / 3600e6 AS gap_hours
  FROM xy a JOIN xy b ON a.obs_id < b.obs_id AND b.x BETWEEN a.x - 2.001 AND a.x + 2.001 AND b.y BETWEEN a.y - 2.001 AND a.y + 2.001
  WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4)"""
_CLUSTERS = _PAIRS + """, links AS (SELECT * FROM pairs WHERE gap_hours <= 72),
both_ways AS (SELECT a AS v, b AS w FROM links UNION ALL SELECT b, a FROM links),
reach(root, v) AS (SELECT obs_id, obs_id FROM ok UNION SELECT r.root, e.w FROM reach r JOIN both_ways e ON e.v = r.v WHERE r.root < e.w),
labels AS (SELECT v AS obs_id, min(root) AS cluster FROM reach GROUP BY v)"""
CLUSTERS_SQL = _CLUSTERS


def _qualified(spark, sf_dir):
    return ev.qualified(lens.observations(spark, sf_dir))


@query("event_reconstruction", with_views("obs", recursive=True, body=_CLUSTERS + f""", joined AS (SELECT * FROM ok JOIN labels USING (obs_id)),
summary AS (
  SELECT cluster, 'FE-' || strftime(min(ts), '%Y%m%d') || '-' || substr(sha1(string_agg(k, '|' ORDER BY k)), 1, 10) AS event_id, min(ts) AS first_detection, max(ts) AS last_detection, count(*) AS observation_count,
    sum(round(latitude * 1e5)::BIGINT) / count(*) / 1e5 AS lat, sum(round(longitude * 1e5)::BIGINT) / count(*) / 1e5 AS lon,
    min(longitude) AS west, min(latitude) AS south, max(longitude) AS east, max(latitude) AS north, max(frp) AS max_frp, sum(round(frp * 1e4)::BIGINT) / count(frp) / 1e4 AS mean_frp, string_agg(DISTINCT satellite || '/' || instrument, ',' ORDER BY satellite || '/' || instrument) AS sensors
  FROM (SELECT *, printf('%.5f', latitude) || ',' || printf('%.5f', longitude) || ',' || acq_date || ',' || acq_time AS k FROM joined) GROUP BY cluster),
stats AS (SELECT cluster, count(*) AS link_count, max(gap_hours) AS max_link_gap_hours, max(distance_km) AS max_link_distance_km FROM links JOIN labels ON a = obs_id GROUP BY cluster)
SELECT cluster, event_id, first_detection, last_detection, epoch_us(last_detection - first_detection) / 3600e6 AS duration_hours, observation_count, lat, lon, round({haversine_sql('south', 'west', 'north', 'east')}, 6) AS spatial_extent_km,
  max_frp, mean_frp, sensors, coalesce(link_count, 0) AS link_count, max_link_gap_hours, round(max_link_distance_km, 6) AS max_link_distance_km
FROM summary LEFT JOIN stats USING (cluster)"""))
def event_reconstruction(spark, sf_dir):
    out = ev.reconstruct(_qualified(spark, sf_dir))
    return out.select(
        "cluster", "event_id", "first_detection", "last_detection", "duration_hours", "observation_count", "lat", "lon", F.round("spatial_extent_km", 6).alias("spatial_extent_km"), "max_frp",
        "mean_frp", F.array_join("sensor_mix", ",").alias("sensors"), "link_count", "max_link_gap_hours", F.round("max_link_distance_km", 6).alias("max_link_distance_km"),
    )


@query("pair_totals", with_views("obs", body=_PAIRS + """
SELECT count(*) AS pairs_in_radius, count(*) FILTER (WHERE gap_hours <= 72) AS accepted, count(*) FILTER (WHERE gap_hours > 72) AS rejected_by_time,
  round(max(CASE WHEN gap_hours <= 72 THEN distance_km END), 6) AS widest_km, max(CASE WHEN gap_hours <= 72 THEN gap_hours END) AS longest_gap_hours FROM pairs"""))
def pair_totals(spark, sf_dir):
    return ev.run_totals(_qualified(spark, sf_dir)).withColumn("widest_km", F.round("widest_km", 6))


@query("event_members", with_views("obs", recursive=True, body=_CLUSTERS + " SELECT obs_id, cluster FROM labels"))
def event_members(spark, sf_dir):
    return ev.clustered(_qualified(spark, sf_dir))


@query("event_lobes", with_views("obs", "members", recursive=True, body=""", ref AS (SELECT event, sum(round(latitude * 1e5)::BIGINT) / count(*) / 1e5 AS ref_lat FROM members GROUP BY event),
xy AS (SELECT m.*, radians(longitude) * 6371.0088::DOUBLE * cos(radians(ref_lat)) AS x, radians(latitude) * 6371.0088::DOUBLE AS y FROM members m JOIN ref USING (event)),
links AS (SELECT a.obs_id AS v, b.obs_id AS w FROM xy a JOIN xy b ON a.event = b.event AND a.obs_id <> b.obs_id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1),
reach(root, v) AS (SELECT obs_id, obs_id FROM members UNION SELECT r.root, e.w FROM reach r JOIN links e ON e.v = r.v WHERE r.root < e.w),
labels AS (SELECT v AS obs_id, min(root) AS lobe FROM reach GROUP BY v)
SELECT event, lobe, count(*) AS observation_count, min(ts) AS first_detection, max(ts) AS last_detection, max(frp) AS max_frp, sum(round(latitude * 1e5)::BIGINT) / count(*) / 1e5 AS lat, sum(round(longitude * 1e5)::BIGINT) / count(*) / 1e5 AS lon,
  epoch_us(max(ts) - min(ts)) / 3600e6 AS duration_hours, round(""" + haversine_sql("min(latitude)", "min(longitude)", "max(latitude)", "max(longitude)") + """, 6) AS spatial_extent_km,
  row_number() OVER (PARTITION BY event ORDER BY count(*) DESC, min(ts), lobe) AS nth FROM members JOIN labels USING (obs_id) GROUP BY event, lobe"""))
def event_lobes(spark, sf_dir):
    return ev.lobes(lens.members(spark, sf_dir)).withColumn("spatial_extent_km", F.round("spatial_extent_km", 6))


RADII, HOURS = (0.5, 1.0, 1.5, 2.0), (12.0, 24.0, 48.0, 72.0)


def _sweep_sql() -> str:
    cells = [(r, h) for r in RADII for h in HOURS]
    parts = []
    for i, (r, h) in enumerate(cells):
        parts.append(f"""e{i} AS (SELECT a AS v, b AS w FROM pairs WHERE distance_km <= {r} AND gap_hours <= {h} UNION ALL SELECT b, a FROM pairs WHERE distance_km <= {r} AND gap_hours <= {h}),
r{i}(root, v) AS (SELECT obs_id, obs_id FROM ok UNION SELECT r.root, e.w FROM r{i} r JOIN e{i} e ON e.v = r.v WHERE r.root < e.w),
s{i} AS (SELECT count(*) AS n FROM (SELECT v, min(root) AS c FROM r{i} GROUP BY v) GROUP BY c)""")
    ends = " UNION ALL ".join(f"SELECT {r}::DOUBLE AS radius_km, {h}::DOUBLE AS hours, count(*) AS events, count(*) FILTER (WHERE n = 1) AS singletons, count(*) FILTER (WHERE n >= 12) AS large_events, max(n) AS largest, (SELECT count(*) // 2 FROM e{i})::BIGINT AS accepted_pairs FROM s{i}" for i, (r, h) in enumerate(cells))
    return with_views("obs", recursive=True, body=_PAIRS + ",\n" + ",\n".join(parts) + "\n" + ends)


@query("threshold_sweep", _sweep_sql())
def threshold_sweep(spark, sf_dir):
    return ev.threshold_sweep(_qualified(spark, sf_dir), RADII, HOURS, large=12)


@query("membership_problems", with_views("obs", "members", body=""", stored AS (SELECT event, count(*) AS n, list(obs_id ORDER BY obs_id) AS ids FROM members WHERE event % 29 <> 0 GROUP BY event),
held AS (SELECT event, count(*) AS n, list(obs_id ORDER BY obs_id) AS ids FROM (SELECT obs_id, CASE WHEN obs_id % 53 = 0 THEN event + 1 ELSE event END AS event FROM members WHERE obs_id % 31 <> 0 AND event % 37 <> 0) GROUP BY event),
told AS (SELECT coalesce(s.event, h.event) AS event, CASE WHEN s.event IS NULL THEN 'unknown_event' WHEN h.event IS NULL THEN 'no_members' WHEN s.n <> h.n THEN 'count' WHEN s.ids <> h.ids THEN 'members' END AS problem, coalesce(s.n, 0) AS stored, coalesce(h.n, 0) AS found FROM stored s FULL JOIN held h ON s.event = h.event)
SELECT * FROM told WHERE problem IS NOT NULL"""))
def membership_problems(spark, sf_dir):
    """Some members are lost, some moved to another event, some events' members are gone, some events are not stored."""
    m = lens.members(spark, sf_dir)
    held = m.where("obs_id % 31 <> 0 and event % 37 <> 0").withColumn("event", F.when(F.col("obs_id") % 53 == 0, F.col("event") + 1).otherwise(F.col("event")))
    return ev.membership_problems(ev.checksummed(m.where("event % 29 <> 0")), held)


_SPREAD = ", ".join(
    f"round(min({c}), 6) AS {n}_min, round(median({c}), 6) AS {n}_median, round(avg({c}), 6) AS {n}_mean, round(quantile_cont({c}, 0.9), 6) AS {n}_p90, round(max({c}), 6) AS {n}_max"
    for c, n in (("n", "observation_count"), ("hours", "duration_hours"), ("extent_km", "spatial_extent_km"))
)


@query("run_diagnostics", with_views("obs", "members", "ev", body=f"""
SELECT count(*) AS events, sum(n)::BIGINT AS observations, sum(n) / count(*) AS compression, count(*) FILTER (WHERE n = 1) AS singletons, count(*) FILTER (WHERE n >= 12) AS large_events,
  coalesce(sum(n) FILTER (WHERE n >= 12), 0) / sum(n) AS large_share, {_SPREAD} FROM ev"""))
def run_diagnostics(spark, sf_dir):
    events = lens.events(spark, sf_dir).select(F.col("n").alias("observation_count"), F.col("hours").alias("duration_hours"), F.col("extent_km").alias("spatial_extent_km"))
    out = ev.diagnostics(events, large=12)
    return out.withColumns({c: F.round(c, 6) for c in out.columns[6:]})


_NEARBY = f""", nearby AS (
  SELECT e.event, count(o.obs_id) AS nearby_detection_count FROM ev e LEFT JOIN members o
    ON o.event <> e.event AND o.latitude BETWEEN e.lat - 0.1 AND e.lat + 0.1 AND o.longitude BETWEEN e.lon - 0.1 AND e.lon + 0.1
    AND o.ts BETWEEN e.first - INTERVAL 24 HOUR AND e.last + INTERVAL 24 HOUR AND {haversine_sql('e.lat', 'e.lon', 'o.latitude', 'o.longitude')} <= 10 GROUP BY e.event)"""


@query("nearby_detections", with_views("obs", "members", "ev", body=_NEARBY + " SELECT * FROM nearby"))
def nearby_detections(spark, sf_dir):
    return triage.nearby_detections(lens.events(spark, sf_dir), lens.members(spark, sf_dir))


#: Context of an event number: whole-number stand-ins for land cover, distance, rain; some are missing.
def _facts(spark, sf_dir):
    e = F.col("event")
    some = lambda m, v: F.when(e % m != 0, v)
    base = lens.events(spark, sf_dir)
    return (
        base.select("event", "max_frp", F.col("n").alias("observation_count"))
        .join(triage.confidence_summary(lens.members(spark, sf_dir)), "event")
        .join(triage.nearby_detections(base, lens.members(spark, sf_dir)), "event")
        .withColumns({
            "vegetated_fraction": some(3, (e % 11) / F.lit(10.0)), "urban_fraction": some(4, (e % 9) / F.lit(8.0)), "settlement_distance_km": some(5, (e % 13) / F.lit(2.0)),
            "persistent_heat_source_match": some(2, (e % 17 == 0).cast("int")), "volcano_geothermal_distance_km": some(7, (e % 19) * F.lit(1.5)), "recent_rainfall_mm": some(6, (e % 29) * F.lit(1.0)),
        })
    )


_FACTS = _NEARBY + """, facts AS (
  SELECT e.event, c.mean_confidence, e.max_frp, e.n AS observation_count,
    CASE WHEN e.event % 3 <> 0 THEN (e.event % 11) / 10.0::DOUBLE END AS vegetated_fraction, CASE WHEN e.event % 4 <> 0 THEN (e.event % 9) / 8.0::DOUBLE END AS urban_fraction,
    CASE WHEN e.event % 5 <> 0 THEN (e.event % 13) / 2.0::DOUBLE END AS settlement_distance_km, CASE WHEN e.event % 2 <> 0 THEN (e.event % 17 = 0)::INTEGER END AS persistent_heat_source_match,
    CASE WHEN e.event % 7 <> 0 THEN (e.event % 19) * 1.5::DOUBLE END AS volcano_geothermal_distance_km, CASE WHEN e.event % 6 <> 0 THEN (e.event % 29) * 1.0::DOUBLE END AS recent_rainfall_mm,
    nearby_detection_count
  FROM ev e JOIN nearby USING (event) JOIN (SELECT event, avg(CASE confidence WHEN 'h' THEN 1.0 WHEN 'n' THEN 0.5 ELSE 0 END) AS mean_confidence FROM members GROUP BY event) c USING (event))"""


def _rule_sql() -> str:
    rows = []
    for nth, r in enumerate(triage.RULES):
        name = "confidence" if r.feature == "mean_confidence" else r.feature
        v = f"{r.feature}::DOUBLE"
        fire = f"{v} {r.fire[0]} {r.fire[1]}" if r.fire else "false"
        clear = f"{v} {r.clear[0]} {r.clear[1]}" if r.clear else "false"
        rows.append(f"""SELECT event, {nth} AS nth, '{r.rule_id}' AS rule_id, '{r.feature}' AS feature, {v} AS value,
  CASE WHEN {v} IS NULL THEN 'NOT_EVALUATED' WHEN {fire} THEN 'SUPPORTS_FIRE' WHEN {clear} THEN 'SUPPORTS_NON_FIRE' ELSE 'NEUTRAL' END AS effect,
  CASE WHEN {v} IS NULL THEN 0 WHEN {fire} THEN {r.fire[2] if r.fire else 0} WHEN {clear} THEN {r.clear[2] if r.clear else 0} ELSE 0 END AS points,
  CASE WHEN {v} IS NOT NULL THEN 'DERIVED_STAGE1_' || event || '_{name}' END AS evidence_id, CASE WHEN {v} IS NOT NULL THEN {0.65 if r.feature == "mean_confidence" else 0.82}::DOUBLE END AS quality FROM facts""")
    return ", rules AS (" + " UNION ALL ".join(rows) + ")"


_DECIDED = """, scores AS (
  SELECT event, sum(CASE WHEN effect = 'SUPPORTS_FIRE' THEN points ELSE 0 END)::BIGINT AS fire_score, sum(CASE WHEN effect = 'SUPPORTS_NON_FIRE' THEN points ELSE 0 END)::BIGINT AS non_fire_score,
    coalesce(string_agg(rule_id, ',' ORDER BY nth) FILTER (WHERE points > 0), '') AS decisive_rules, coalesce(string_agg(rule_id, ',' ORDER BY nth) FILTER (WHERE effect = 'NOT_EVALUATED'), '') AS missing_rules FROM rules GROUP BY event),
decided AS (SELECT *, CASE WHEN fire_score >= 4 AND non_fire_score < 4 THEN 'LIKELY_FIRE' WHEN non_fire_score >= 4 AND fire_score < 4 THEN 'LIKELY_NON_FIRE' ELSE 'AMBIGUOUS' END AS state FROM scores)"""
RULES_SQL = _FACTS + _rule_sql()
DECIDED_SQL = RULES_SQL + _DECIDED
DECIDED_ONLY = _DECIDED


def rules(spark, sf_dir):
    return triage.rule_evaluations(_facts(spark, sf_dir))


@query("triage_rules", with_views("obs", "members", "ev", body=RULES_SQL + " SELECT * FROM rules"))
def triage_rules(spark, sf_dir):
    return rules(spark, sf_dir)


def decided(spark, sf_dir):
    return triage.decisions(rules(spark, sf_dir))


@query("triage_decisions", with_views("obs", "members", "ev", body=DECIDED_SQL + " SELECT * FROM decided"))
def triage_decisions(spark, sf_dir):
    return decided(spark, sf_dir).withColumns({c: F.array_join(c, ",") for c in ("decisive_rules", "missing_rules")})


@query("triage_summary", with_views("obs", "members", "ev", body=DECIDED_SQL + """ SELECT s.state, count(d.event) AS events, (SELECT count(*) FROM decided WHERE state <> 'LIKELY_NON_FIRE') AS queue,
  round((SELECT count(*) FROM decided) / (SELECT count(*) FROM decided WHERE state <> 'LIKELY_NON_FIRE'), 4) AS queue_compression
FROM (VALUES ('LIKELY_FIRE'), ('AMBIGUOUS'), ('LIKELY_NON_FIRE')) s(state) LEFT JOIN decided d USING (state) GROUP BY s.state"""))
def triage_summary(spark, sf_dir):
    return triage.triage_summary(decided(spark, sf_dir))
