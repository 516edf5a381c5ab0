"""Registered queries and SQL: weather, raster, imagery."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe.operators import raster as rs
from emberframe.operators import scenes as sc
from emberframe.operators import weather as we
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


_GRID = """, grid AS (SELECT DISTINCT grid_id, grid_lat, grid_lon FROM weather),
placed AS (
  SELECT * FROM (SELECT ev.*, g.grid_id, row_number() OVER (PARTITION BY event ORDER BY (grid_lat - lat) * (grid_lat - lat) + (grid_lon - lon) * (grid_lon - lon), grid_lat, grid_lon) AS k FROM ev, grid g) WHERE k = 1)"""


GRID_SQL = _GRID


def placed(spark, sf_dir):
    return we.nearest_grid(lens.events(spark, sf_dir), lens.weather_hourly(spark, sf_dir))


@query("nearest_grid", with_views("obs", "members", "ev", "weather", body=_GRID + " SELECT event, grid_id FROM placed"))
def nearest_grid(spark, sf_dir):
    return placed(spark, sf_dir).select("event", "grid_id")


def _spans_sql(years: int) -> str:
    parts = [f"SELECT event, grid_id, '{n}' AS w, first + INTERVAL '{a} hours' AS s, first + INTERVAL '{b} hours' AS e FROM placed" for n, (a, b) in we.WINDOWS.items()]
    parts.append("SELECT event, grid_id, 'event_duration', first, last FROM placed")
    return ", spans AS (SELECT event, grid_id, w, y AS year, s - to_years(y::INTEGER) AS s, e - to_years(y::INTEGER) AS e FROM (" + " UNION ALL ".join(parts) + f"), (SELECT unnest(range({years + 1})) AS y))"


#: Windows by day, joined on grid point and day: whole days from daily sums, hours for the days at the ends.
_SUMS = """count(*) AS n, sum(precipitation) AS rain, max(temperature_2m) AS hot, sum(temperature_2m) AS tm, sum(relative_humidity_2m) AS rh, sum(wind_speed_10m) AS ws, sum(soil_moisture_0_to_7cm) AS sm,
    sum(wind_speed_10m * sin(radians(wind_direction_10m))) AS ys, sum(wind_speed_10m * cos(radians(wind_direction_10m))) AS xs"""


def _met_sql(name: str, source: str, years: str, sums: str) -> str:
    return f"""{name}_span AS MATERIALIZED (SELECT event, w, year, grid_id, s, e, unnest(generate_series(date_trunc('day', s), date_trunc('day', e - INTERVAL 1 MICROSECOND), INTERVAL 1 DAY)) AS d FROM spans WHERE {years} AND e > s),
{name}_hours AS MATERIALIZED (SELECT *, date_trunc('day', ts) AS d FROM {source}),
{name}_day AS MATERIALIZED (SELECT grid_id, d, {sums} FROM {name}_hours GROUP BY grid_id, d),
{name} AS MATERIALIZED (
  SELECT sp.event, sp.w, sp.year, h.* EXCLUDE (grid_id) FROM {name}_span sp JOIN {name}_day h ON h.grid_id = sp.grid_id AND h.d = sp.d WHERE sp.d >= s AND sp.d + INTERVAL 1 DAY <= e
  UNION ALL SELECT sp.event, sp.w, sp.year, sp.d, {sums} FROM {name}_span sp JOIN {name}_hours h ON h.grid_id = sp.grid_id AND h.d = sp.d WHERE NOT (sp.d >= s AND sp.d + INTERVAL 1 DAY <= e) AND h.ts >= sp.s AND h.ts < sp.e GROUP BY sp.event, sp.w, sp.year, sp.d)"""


_METRICS = ", " + _met_sql("met", "weather", "year = 0", _SUMS) + """,
metrics AS MATERIALIZED (SELECT event, w, round(sum(rain), 4) AS rainfall_mm, max(hot) AS max_temperature_c, sum(tm) / sum(n) AS mean_temperature_c, sum(rh) / sum(n) AS mean_relative_humidity, sum(ws) / sum(n) AS mean_wind_speed, sum(sm) / sum(n) AS mean_soil_moisture,
  date_diff('day', min(d), max(d)) + 1 - count(*) FILTER (WHERE round(rain, 6) >= 1) AS rain_free_days, CASE WHEN abs(sum(ys)) + abs(sum(xs)) > 1e-9 THEN (degrees(atan2(sum(ys), sum(xs))) + 360) % 360 END AS wind_direction_deg FROM met GROUP BY event, w)"""
_ANOMALY = ", " + _met_sql("past_met", "past_weather", "year > 0", "sum(precipitation) AS rain") + """,
past AS (SELECT event, w, year, round(sum(rain), 4) AS rain FROM past_met GROUP BY event, w, year),
base AS (SELECT event, w, sum(round(rain * 1e4)::BIGINT) / count(*) / 1e4 AS base FROM past GROUP BY event, w),
anomaly AS MATERIALIZED (SELECT sp.event, sp.w, CASE WHEN base <> 0 AND rainfall_mm IS NOT NULL THEN round_even((rainfall_mm - base) / base * 100, 1) END AS anomaly_pct FROM spans sp LEFT JOIN base b ON b.event = sp.event AND b.w = sp.w LEFT JOIN metrics m ON m.event = sp.event AND m.w = sp.w WHERE sp.year = 0)"""
_YEARS = 2
SPANS_SQL, METRICS_SQL = _spans_sql(0), _METRICS


def _spans(spark, sf_dir, years: int = 0):
    return we.windows(placed(spark, sf_dir), years)


def _metrics(spark, sf_dir, spans):
    return we.window_metrics(spans, lens.weather_hourly(spark, sf_dir))


def metrics(spark, sf_dir):
    return _metrics(spark, sf_dir, _spans(spark, sf_dir))


def _anomaly(spark, sf_dir, spans):
    hourly = lens.weather_hourly(spark, sf_dir).unionByName(lens.past_weather(spark, sf_dir), allowMissingColumns=True)
    return we.rainfall_anomaly(we.window_metrics(spans, hourly))


@query("weather_windows", with_views("obs", "members", "ev", "weather", body=_GRID + _spans_sql(0) + _METRICS + """
SELECT sp.event, sp.w AS window, sp.s AS start, sp.e AS "end", rainfall_mm, max_temperature_c, mean_temperature_c, mean_relative_humidity, mean_wind_speed, mean_soil_moisture, rain_free_days, round(wind_direction_deg, 3) AS wind_direction_deg FROM spans sp LEFT JOIN metrics USING (event, w)"""))
def weather_windows(spark, sf_dir):
    return _metrics(spark, sf_dir, _spans(spark, sf_dir)).drop("year").withColumn("wind_direction_deg", F.round("wind_direction_deg", 3))


@query("rainfall_anomaly", with_views("obs", "members", "ev", "weather", "past_weather", body=_GRID + _spans_sql(_YEARS) + _METRICS + _ANOMALY + " SELECT event, w AS window, anomaly_pct FROM anomaly"))
def rainfall_anomaly(spark, sf_dir):
    return _anomaly(spark, sf_dir, _spans(spark, sf_dir, _YEARS))


_DAILY = """, daily_source AS MATERIALIZED (SELECT grid_id, date_trunc('day', ts) AS d, sum(precipitation) + 0.5::DOUBLE AS rain, avg(temperature_2m) AS temperature, avg(relative_humidity_2m) AS humidity, avg(wind_speed_10m) AS wind FROM weather WHERE (day(ts) + grid_id) % 17 <> 0 GROUP BY grid_id, date_trunc('day', ts)),
dated AS (SELECT event, w, grid_id, unnest(generate_series(date_trunc('day', s), date_trunc('day', e), INTERVAL 1 DAY)) AS d FROM spans WHERE year = 0),
other AS MATERIALIZED (SELECT event, w, sum(rain) AS r, avg(temperature) AS t, avg(humidity) AS h, avg(wind) AS v FROM dated sp JOIN daily_source s ON s.grid_id = sp.grid_id AND s.d = sp.d GROUP BY event, w),
apart AS MATERIALIZED (SELECT o.event, o.w, round(round(rainfall_mm - r, 8) + 1e-9, 2) + 0 AS rain_diff, round(round(mean_temperature_c - t, 8) + 1e-9, 2) + 0 AS temperature_diff, round(round(mean_relative_humidity - h, 8) + 1e-9, 2) + 0 AS humidity_diff, round(round(mean_wind_speed - v, 8) + 1e-9, 2) + 0 AS wind_diff
  FROM other o LEFT JOIN metrics m ON m.event = o.event AND m.w = o.w)"""


def _daily(spark, sf_dir):
    """A daily source that differs from the hourly one and lacks some days."""
    h = lens.weather_hourly(spark, sf_dir).where((F.dayofmonth("ts") + F.col("grid_id")) % 17 != 0)
    return h.groupBy("grid_id", F.to_date("ts").alias("date")).agg((F.sum("precipitation") + 0.5).alias("rain"), F.avg("temperature_2m").alias("temperature"), F.avg("relative_humidity_2m").alias("humidity"), F.avg("wind_speed_10m").alias("wind"))


@query("source_disagreement", with_views("obs", "members", "ev", "weather", body=_GRID + _spans_sql(0) + _METRICS + _DAILY + " SELECT event, w AS window, rain_diff, temperature_diff, humidity_diff, wind_diff FROM apart"))
def source_disagreement(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    return we.disagreement(_metrics(spark, sf_dir, spans), spans, _daily(spark, sf_dir))


@query("weather_evidence", with_views("obs", "members", "ev", "weather", "past_weather", body=_GRID + _spans_sql(_YEARS) + _METRICS + _ANOMALY + _DAILY + """,
long AS (UNPIVOT (SELECT event, w, rainfall_mm, rain_free_days::DOUBLE AS rain_free_days, max_temperature_c, mean_relative_humidity, mean_wind_speed, wind_direction_deg, mean_soil_moisture FROM metrics)
  ON rainfall_mm, rain_free_days, max_temperature_c, mean_relative_humidity, mean_wind_speed, wind_direction_deg, mean_soil_moisture INTO NAME field VALUE value),
named AS (SELECT l.*, t.type, t.unit FROM long l JOIN (VALUES """ + ", ".join(f"('{c}', '{t}', '{u}')" for c, t, u in we.METRICS) + """) t(field, type, unit) USING (field)),
noted AS (SELECT n.*, array_to_string([x FOR x IN [CASE WHEN a.event IS NULL THEN 'no daily source for this window' END,
    CASE WHEN field = 'rainfall_mm' AND anomaly_pct IS NOT NULL THEN printf('%.1f', abs(anomaly_pct)) || CASE WHEN anomaly_pct >= 0 THEN ' % above' ELSE ' % below' END || ' the years before' END,
    CASE field WHEN 'rainfall_mm' THEN printf('daily source differs by %.2f mm', rain_diff) WHEN 'mean_relative_humidity' THEN printf('daily source differs by %.2f pct', humidity_diff) WHEN 'mean_wind_speed' THEN printf('daily source differs by %.2f m/s', wind_diff) END] IF x IS NOT NULL], '; ') AS limitations
  FROM named n LEFT JOIN apart a USING (event, w) LEFT JOIN anomaly USING (event, w))
SELECT 'ENV_WEATHER_' || event || '_' || w || '_' || type AS evidence_id, event, 'weather' AS category, w AS window, type, unit, CASE WHEN type <> 'wind_direction' THEN replace(type, '_', ' ') || ' ' || printf('%.2f', round_even(value, 2)) || ' ' || unit || ' during ' || w END AS observation,
  round(value, 3) AS value, limitations, CASE WHEN limitations <> '' THEN 0.6 ELSE 0.82 END::DOUBLE AS quality FROM noted"""))
def weather_evidence(spark, sf_dir):
    spans = _spans(spark, sf_dir, _YEARS)
    now = spans.where("year = 0")
    m = _metrics(spark, sf_dir, now)
    e = we.weather_evidence(m, _anomaly(spark, sf_dir, spans), we.disagreement(m, now, _daily(spark, sf_dir)))
    # a direction's second decimal hangs on the order of a sum
    return e.withColumns({"value": F.round("value", 3), "observation": F.when(F.col("type") != "wind_direction", F.col("observation")), "limitations": F.array_join("limitations", "; ")})


@query("weather_query_plan", with_views("obs", "members", "ev", body=""", b AS (SELECT count(*) AS events, min(west) AS w, min(south) AS s, max(east) AS e, max(north) AS n, min(first) AS f, max(last) AS l FROM ev),
g AS (SELECT *, ((greatest(ceil((n - s) / 0.15 - 1e-9), 1) + 1) * (greatest(ceil((e - w) / 0.15 - 1e-9), 1) + 1))::BIGINT AS grid_points FROM b)
SELECT events, grid_points, ceil(grid_points / 100)::BIGINT AS requests, (f - INTERVAL 2160 HOUR)::DATE AS from_day, greatest(l, f + INTERVAL 48 HOUR)::DATE AS to_day FROM g"""))
def weather_query_plan(spark, sf_dir):
    return we.query_plan(lens.events(spark, sf_dir))


@query("regular_grid", with_views("obs", "members", "ev", body=""", b AS (SELECT min(west) AS w, min(south) AS s, max(east) AS e, max(north) AS n FROM ev),
k AS (SELECT *, greatest(ceil((n - s) / 0.15 - 1e-9), 1)::BIGINT AS a, greatest(ceil((e - w) / 0.15 - 1e-9), 1)::BIGINT AS b FROM b)
SELECT r * (b + 1) + c AS grid_id, round(s + (n - s) * (r / a), 9) AS grid_lat, round(w + (e - w) * (c / b), 9) AS grid_lon FROM (SELECT *, unnest(range(b + 1)) AS c FROM (SELECT *, unnest(range(a + 1)) AS r FROM k))"""))
def regular_grid(spark, sf_dir):
    bounds = lens.events(spark, sf_dir).agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))
    return we.regular_grid(bounds).withColumns({c: F.round(c, 9) for c in ("grid_lat", "grid_lon")})


def variables(spark, sf_dir):
    return we.variable_evidence(placed(spark, sf_dir), lens.weather_hourly(spark, sf_dir))


@query("variable_evidence", with_views("obs", "members", "ev", "weather", body=_GRID + """,
spans AS (SELECT event, grid_id, 'current' AS w, first AS s, greatest(last, first + INTERVAL 2 HOUR) AS e FROM placed UNION ALL SELECT event, grid_id, 'T-7d', first - INTERVAL 168 HOUR, first FROM placed),
met AS MATERIALIZED (SELECT sp.event, sp.w, date_trunc('day', ts) AS d, h.* EXCLUDE (grid_id, grid_lat, grid_lon, ts), wind_speed_10m AS speed FROM spans sp JOIN weather h ON h.grid_id = sp.grid_id AND h.ts >= sp.s AND h.ts < sp.e),
long AS (UNPIVOT met ON precipitation, temperature_2m, relative_humidity_2m, wind_speed_10m, soil_moisture_0_to_7cm, wind_direction_10m INTO NAME variable VALUE value),
daily AS (SELECT event, w, variable, d, count(*) AS n, sum(value) AS total, min(value) AS least, max(value) AS most, sum(speed * sin(radians(value))) AS ys, sum(speed * cos(radians(value))) AS xs FROM long GROUP BY ALL)
SELECT event, w AS window, variable, CASE variable WHEN 'precipitation' THEN 'sum' WHEN 'wind_direction_10m' THEN 'circular' ELSE 'spread' END AS kind, sum(n)::BIGINT AS n, CASE WHEN variable = 'precipitation' THEN round_even(round(sum(total), 6), 2) END AS total,
  CASE WHEN variable NOT IN ('precipitation', 'wind_direction_10m') THEN round_even(round(sum(total) / sum(n), 8), 2) END AS mean, CASE WHEN variable NOT IN ('precipitation', 'wind_direction_10m') THEN round_even(min(least), 2) END AS least, CASE WHEN variable NOT IN ('precipitation', 'wind_direction_10m') THEN round_even(max(most), 2) END AS most,
  CASE WHEN variable = 'wind_direction_10m' AND abs(sum(ys)) + abs(sum(xs)) > 1e-9 THEN round_even((degrees(atan2(sum(ys), sum(xs))) + 360) % 360, 1) END AS direction,
  CASE WHEN variable = 'precipitation' THEN date_diff('day', min(d), max(d)) + 1 - count(*) FILTER (WHERE round(total, 6) >= 1) END AS rain_free_days FROM daily GROUP BY event, w, variable"""))
def variable_evidence(spark, sf_dir):
    return variables(spark, sf_dir)


# Raster: rows and columns round halves to even in both engines.
_T = "CAST(round_even(({o} - {c}) / 0.01::DOUBLE, 0) AS BIGINT)"
_ROW, _COL = "CAST(round_even((-2.4::DOUBLE - {0}) / 0.01::DOUBLE, 0) AS BIGINT)", "CAST(round_even(({0} - 115.0::DOUBLE) / 0.01::DOUBLE, 0) AS BIGINT)"
_PEAT = "value IN (1, 2)"


@query("raster_class", with_views("obs", "members", "ev", "raster", body=f"""
SELECT event, CASE WHEN r NOT BETWEEN 0 AND 259 OR c NOT BETWEEN 0 AND 259 THEN -1 WHEN value IS NULL OR value = 255 THEN 0 ELSE value END AS peat_class
FROM (SELECT event, {_ROW.format('lat')} AS r, {_COL.format('lon')} AS c FROM ev) LEFT JOIN raster ON row = r AND col = c"""))
def raster_class(spark, sf_dir):
    return rs.class_at(lens.events(spark, sf_dir), lens.raster(spark), rs.TRANSFORM).select("event", "peat_class")


_CELLS = "(-2.4::DOUBLE - row * 0.01::DOUBLE)", "(115.0::DOUBLE + col * 0.01::DOUBLE)"


@query("peat_radius", with_views("obs", "members", "ev", "raster", body=f""", near AS (
  SELECT event, value FROM ev JOIN raster ON row BETWEEN {_ROW.format('lat')} - 3 AND {_ROW.format('lat')} + 3 AND col BETWEEN {_COL.format('lon')} - 3 AND {_COL.format('lon')} + 3
  WHERE {haversine_sql('lat', 'lon', *_CELLS)} <= 2)
SELECT e.event, n.cells, n.peat_cells, round_even(n.peat_cells / n.cells, 4) AS peat_fraction FROM ev e LEFT JOIN (SELECT event, count(*) AS cells, count(*) FILTER (WHERE {_PEAT}) AS peat_cells FROM near GROUP BY event) n USING (event)"""))
def peat_radius(spark, sf_dir):
    return rs.radius_fraction(lens.events(spark, sf_dir), lens.raster(spark), rs.TRANSFORM, 2.0)


_CLASS = "CASE WHEN r NOT BETWEEN 0 AND 259 OR c NOT BETWEEN 0 AND 259 THEN -1 WHEN value IS NULL OR value = 255 THEN 0 ELSE value END"
_AT_EVENT = f"""at_event AS (SELECT event, {_CLASS} AS k FROM (SELECT event, {_ROW.format('lat')} AS r, {_COL.format('lon')} AS c FROM ev) LEFT JOIN raster ON row = r AND col = c)"""
_DISTANCE = f""", {_AT_EVENT},
best AS (SELECT event, min({haversine_sql('lat', 'lon', *_CELLS)}) AS d FROM ev, raster WHERE {_PEAT} AND row BETWEEN {_ROW.format('lat')} - 33 AND {_ROW.format('lat')} + 33 AND col BETWEEN {_COL.format('lon')} - 33 AND {_COL.format('lon')} + 33 GROUP BY event),
distances AS (SELECT e.event, CASE WHEN k IN (1, 2) THEN 0 WHEN d <= 35.2 THEN round_even(d, 2) END AS peat_distance_km FROM ev e JOIN at_event USING (event) LEFT JOIN best USING (event))"""


@query("peat_distance", with_views("obs", "members", "ev", "raster", body=_DISTANCE + " SELECT * FROM distances"))
def peat_distance(spark, sf_dir):
    return rs.distance_to_peat(lens.events(spark, sf_dir), lens.raster(spark), rs.TRANSFORM)


_FOOTPRINT = f""", sides AS (SELECT event, west, south, east, north, CASE WHEN north > south THEN greatest(round_even((north - south) * 111.32::DOUBLE / 1.1::DOUBLE, 0), 1) + 1 ELSE 1 END::BIGINT AS r,
  CASE WHEN east > west THEN greatest(round_even((east - west) * (111.32::DOUBLE * cos(radians((south + north) / 2))) / 1.1::DOUBLE, 0), 1) + 1 ELSE 1 END::BIGINT AS c FROM ev),
fewer AS (SELECT event, west, south, east, north, CASE WHEN r * c > 400 THEN greatest(floor(r * sqrt(400::DOUBLE / (r * c))), 1) ELSE r END::BIGINT AS m, CASE WHEN r * c > 400 THEN greatest(floor(c * sqrt(400::DOUBLE / (r * c))), 1) ELSE c END::BIGINT AS k FROM sides),
spots AS (SELECT event, south + (north - south) * (i / greatest(m - 1, 1)) AS lat, west + (east - west) * (j / greatest(k - 1, 1)) AS lon FROM (SELECT *, unnest(range(k)) AS j FROM (SELECT *, unnest(range(m)) AS i FROM fewer))),
spot_class AS (SELECT event, {_CLASS} AS k FROM (SELECT event, {_ROW.format('lat')} AS r, {_COL.format('lon')} AS c FROM spots) LEFT JOIN raster ON row = r AND col = c),
footprints AS (SELECT event, count(*) AS samples, count(*) FILTER (WHERE k = -1) AS outside, round_even(count(*) FILTER (WHERE k IN (1, 2)) / nullif(count(*) FILTER (WHERE k <> -1), 0), 4) AS peat_fraction, count(*) FILTER (WHERE k IN (1, 2)) > 0 AS any_peat FROM spot_class GROUP BY event)"""


@query("peat_footprint", with_views("obs", "members", "ev", "raster", body=_FOOTPRINT + " SELECT * FROM footprints"))
def peat_footprint(spark, sf_dir):
    return rs.footprint_fraction(lens.events(spark, sf_dir), lens.raster(spark), rs.TRANSFORM)


FOOTPRINT_SQL = _FOOTPRINT


def _circle(km: int, reach: int) -> str:
    return f"""near{km} AS (SELECT event, count(*) AS cells, count(*) FILTER (WHERE {_PEAT}) AS peat_cells FROM ev JOIN raster ON row BETWEEN {_ROW.format('lat')} - {reach} AND {_ROW.format('lat')} + {reach} AND col BETWEEN {_COL.format('lon')} - {reach} AND {_COL.format('lon')} + {reach}
  WHERE {haversine_sql('lat', 'lon', *_CELLS)} <= {km} GROUP BY event)"""


_CONTEXT = _DISTANCE + _FOOTPRINT + ", " + _circle(5, 6) + """, peat AS (SELECT e.event, any_peat, f.peat_fraction AS footprint_fraction, round_even(n.peat_cells / n.cells, 4) AS buffer_fraction, peat_distance_km,
  'mapped peat near an event is context, not a sign that peat burned' || CASE WHEN f.peat_fraction IS NULL THEN '; footprint outside the raster' ELSE '' END || CASE WHEN n.cells IS NULL THEN '; buffer outside the raster' WHEN n.cells < pi() * pow(5 / 1.1, 2) / 2 THEN '; buffer partly outside the raster' ELSE '' END
    || CASE WHEN peat_distance_km IS NULL THEN '; no peat within reach' ELSE '' END || CASE WHEN extent_km > 5 THEN '; event wider than its buffer' ELSE '' END AS limitations
  FROM ev e JOIN footprints f USING (event) LEFT JOIN near5 n USING (event) JOIN distances USING (event))"""


CONTEXT_SQL = _CONTEXT


@query("peat_context", with_views("obs", "members", "ev", "raster", body=_CONTEXT + " SELECT * FROM peat"))
def peat_context(spark, sf_dir):
    return rs.peat_context(lens.events(spark, sf_dir), lens.raster(spark), rs.TRANSFORM).withColumn("limitations", F.array_join("limitations", "; "))


@query("peat_evidence", with_views("obs", "members", "ev", "raster", body=_CONTEXT + """, rows AS (
  SELECT event, 'direct_intersection' AS kind, 'peat_intersection' AS type, CASE WHEN any_peat THEN 'footprint meets mapped peat' ELSE 'footprint meets no mapped peat' END AS observation, any_peat::INTEGER::DOUBLE AS value, 'bool' AS unit, 0.7::DOUBLE AS quality, limitations FROM peat
  UNION ALL SELECT event, 'footprint_fraction', 'peat_fraction', printf('%.1f%%', round_even(round(footprint_fraction * 1e4) / 10, 0) / 10) || ' of the footprint is mapped peat', footprint_fraction, 'fraction', 0.6, limitations FROM peat
  UNION ALL SELECT event, 'buffer_fraction', 'peat_fraction', printf('%.1f%%', round_even(round(buffer_fraction * 1e4) / 10, 0) / 10) || ' of the buffer is mapped peat', buffer_fraction, 'fraction', 0.7, limitations FROM peat
  UNION ALL SELECT event, 'distance_to_peat', 'distance_to_peat', 'nearest mapped peat at ' || printf('%.2f', peat_distance_km) || ' km', peat_distance_km, 'km', 0.7, limitations FROM peat)
SELECT 'ENV_PEAT_' || event || '_' || kind AS evidence_id, event, 'peat' AS category, type, observation, value, unit, quality, limitations FROM rows WHERE value IS NOT NULL"""))
def peat_evidence(spark, sf_dir):
    return rs.peat_evidence(rs.peat_context(lens.events(spark, sf_dir), lens.raster(spark), rs.TRANSFORM)).withColumn("limitations", F.array_join("limitations", "; "))


def _next_of_site(spark, sf_dir):
    e = lens.events(spark, sf_dir)
    a, b = e.select(F.col("event").alias("source"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1")), e.select(F.col("event").alias("target"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return a.join(b, F.col("source") + 10 == F.col("target"))


@query("peat_corridor", with_views("obs", "members", "ev", "raster", body=f""", p AS (
  SELECT a.event AS source, b.event AS target, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2, {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km FROM ev a JOIN ev b ON a.event + 10 = b.event),
q AS (SELECT *, CASE WHEN km = 0 THEN 1 ELSE greatest(ceil(km / 1.1::DOUBLE)::INTEGER + 1, 2) END AS n FROM p),
s AS (SELECT source, target, lat1 + (lat2 - lat1) * (i / greatest(n - 1, 1)) AS lat, lon1 + (lon2 - lon1) * (i / greatest(n - 1, 1)) AS lon FROM (SELECT *, unnest(range(n)) AS i FROM q)),
k AS (SELECT source, target, {_CLASS} AS k FROM (SELECT source, target, {_ROW.format('lat')} AS r, {_COL.format('lon')} AS c FROM s) LEFT JOIN raster ON row = r AND col = c)
SELECT source, target, count(*) AS samples, count(*) FILTER (WHERE k = -1) AS outside, round_even(count(*) FILTER (WHERE k IN (1, 2)) / nullif(count(*) FILTER (WHERE k <> -1), 0), 4) AS peat_fraction FROM k GROUP BY source, target"""))
def peat_corridor(spark, sf_dir):
    return rs.corridor_fraction(_next_of_site(spark, sf_dir), lens.raster(spark), rs.TRANSFORM)


# Scenes.
_SCENES = """, covered AS (SELECT e.event, e.first, e.last, s.* FROM ev e JOIN scenes s
  ON e.lon >= s.west AND e.lat >= s.south AND (e.lon < s.east OR footprint = 'bbox' AND e.lon = s.east) AND (e.lat < s.north OR footprint = 'bbox' AND e.lat = s.north) AND (gap IS NULL OR e.lon < gap - 0.1::DOUBLE OR e.lon >= gap + 0.1::DOUBLE)
  WHERE sensor <> 'S2' OR cloud <= 50),
sided AS (SELECT *, 'pre' AS position, epoch_us(first - acquired) / 3600e6 AS delta FROM covered WHERE acquired <= first UNION ALL SELECT *, 'post', epoch_us(acquired - last) / 3600e6 FROM covered WHERE acquired >= last),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event, sensor, position ORDER BY delta, cloud NULLS LAST, acquired, scene_id) AS k FROM sided) WHERE k = 1)"""


SCENES_SQL = _SCENES


def selected(spark, sf_dir):
    return sc.select_scenes(lens.events(spark, sf_dir), lens.scenes(spark, sf_dir))


@query("scene_selection", with_views("obs", "members", "ev", "scenes", body=_SCENES + " SELECT event, sensor, position, scene_id, acquired, round(delta, 6) AS delta_hours, cloud, footprint FROM chosen"))
def scene_selection(spark, sf_dir):
    return selected(spark, sf_dir)


@query("scene_slots", with_views("obs", "members", "ev", "scenes", body=_SCENES + """ SELECT event, max(CASE WHEN sensor = 'S1' AND position = 'pre' THEN scene_id END) AS s1_pre, max(CASE WHEN sensor = 'S1' AND position = 'post' THEN scene_id END) AS s1_post,
  max(CASE WHEN sensor = 'S2' AND position = 'pre' THEN scene_id END) AS s2_pre, max(CASE WHEN sensor = 'S2' AND position = 'post' THEN scene_id END) AS s2_post FROM chosen GROUP BY event"""))
def scene_slots(spark, sf_dir):
    return sc.four_slots(selected(spark, sf_dir))


@query("image_requests", with_views("obs", "members", "ev", "scenes", body=_SCENES + """, boxed AS (SELECT c.*, round_even(e.lon - 5 / (cos(radians(e.lat)) * 111.32::DOUBLE), 6) AS bw, round_even(e.lat - 5 / 111.32::DOUBLE, 6) AS bs, round_even(e.lon + 5 / (cos(radians(e.lat)) * 111.32::DOUBLE), 6) AS be, round_even(e.lat + 5 / 111.32::DOUBLE, 6) AS bn,
  strftime(date_trunc('day', acquired), '%Y-%m-%dT%H:%M:%SZ') AS day, strftime(date_trunc('day', acquired), '%Y-%m-%dT23:59:59Z') AS until, lower(sensor) || '-' || position AS asset FROM chosen c JOIN ev e USING (event))
SELECT event, sensor, position, scene_id, bw AS west, bs AS south, be AS east, bn AS north, day, until, asset, sha256(sensor || '|' || scene_id || '|' || day || '|' || until || '|' || printf('%.6f,%.6f,%.6f,%.6f', bw, bs, be, bn) || '|' || asset) AS request_sha256 FROM boxed"""))
def image_requests(spark, sf_dir):
    return sc.request_plan(selected(spark, sf_dir), lens.events(spark, sf_dir))
