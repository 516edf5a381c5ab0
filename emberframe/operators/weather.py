"""Weather at events: interval joins of event windows to hourly and daily tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.operators.components import materialise

#: Event-relative windows as (start, end) in hours, counted from the first detection; event_duration is first to last.
WINDOWS = {"T-90d": (-2160, 0), "T-30d": (-720, 0), "T-7d": (-168, 0), "T-72h": (-72, 0), "T-24h": (-24, 0), "T0_to_T+48h": (0, 48)}
#: Rain in millimetres from which a day counts as wet.
WET_DAY_MM = 1.0
#: A window's measures as (column, evidence type, unit).
METRICS = (
    ("rainfall_mm", "rainfall", "mm"),
    ("rain_free_days", "rainfall_free_days", "days"),
    ("max_temperature_c", "max_temperature", "degC"),
    ("mean_relative_humidity", "relative_humidity", "pct"),
    ("mean_wind_speed", "wind_speed", "m/s"),
    ("wind_direction_deg", "wind_direction", "deg"),
    ("mean_soil_moisture", "soil_moisture", "m3/m3"),
)


def nearest_grid(points: DataFrame, grid: DataFrame, lat: str = "lat", lon: str = "lon", key: str = "event") -> DataFrame:
    """``points`` with grid_id of the nearest grid point in degrees; ties go to the earlier in (lat, lon) order, no grid gives null.

    Points and grid meet over cells as wide as the grid's mean spacing.  An answer
    no further than a cell is final; points without one ask again over cells four
    times as wide, so grids of any size and shape are joined, never scanned.
    """
    cells = grid.select("grid_id", "grid_lat", "grid_lon").distinct()
    n, area = cells.agg(F.count("*"), (F.max("grid_lat") - F.min("grid_lat")) * (F.max("grid_lon") - F.min("grid_lon"))).first()
    reach = max((area or 0.0) / n, 1e-6) ** 0.5 if n > 1 else 512.0
    left, found = materialise(points.select(key, lat, lon).distinct()), None
    while n and reach <= 4 * 512.0 and not left.isEmpty():
        cell = lambda c, r=reach: F.floor(F.col(c) / r)
        around = lambda c, r=reach: F.explode(F.sequence(F.floor(F.col(c) / r) - 1, F.floor(F.col(c) / r) + 1))
        met = left.withColumns({"_cy": cell(lat), "_cx": cell(lon)}).join(cells.withColumn("_cy", around("grid_lat")).withColumn("_cx", around("grid_lon")), ["_cy", "_cx"])
        d2 = (F.col("grid_lat") - F.col(lat)) * (F.col("grid_lat") - F.col(lat)) + (F.col("grid_lon") - F.col(lon)) * (F.col("grid_lon") - F.col(lon))
        best = met.groupBy(key).agg(F.min(F.struct(d2.alias("d2"), "grid_lat", "grid_lon", "grid_id")).alias("g")).where(F.col("g.d2") <= reach * reach)
        got = materialise(best.select(key, F.col("g.grid_id").alias("grid_id")))
        found = got if found is None else found.unionByName(got)
        left = materialise(left.join(got, key, "left_anti"))
        reach *= 4
    if found is None:
        return points.withColumn("grid_id", F.lit(None).cast(grid.schema["grid_id"].dataType))
    return points.join(found, key, "left")


def regular_grid(boxes: DataFrame, step: float = 0.15) -> DataFrame:
    """(grid_id, grid_lat, grid_lon) of an even grid over a one-row table of bounds, with steps of at most ``step``; ids in (lat, lon) order."""
    count = lambda lo, hi: F.greatest(F.ceil((F.col(hi) - F.col(lo)) / step - 1e-9).cast("int"), F.lit(1)) + 1
    sized = boxes.select("west", "south", "east", "north", count("south", "north").alias("rows"), count("west", "east").alias("cols"))
    spread = sized.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    at = lambda lo, hi, k, n: F.col(lo) + (F.col(hi) - F.col(lo)) * (F.col(k) / (F.col(n) - 1))
    return spread.select((F.col("r").cast("long") * F.col("cols") + F.col("c")).alias("grid_id"), at("south", "north", "r", "rows").alias("grid_lat"), at("west", "east", "c", "cols").alias("grid_lon"))


def query_plan(events: DataFrame, step: float = 0.15, batch: int = 100) -> DataFrame:
    """One row: what weather a set of events takes: events, grid points of their bounds, requests of ``batch`` points, first and last day."""
    bounds = events.agg(F.count("*").alias("events"), F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"), F.min("first").alias("first"), F.max("last").alias("last"))
    points = regular_grid(bounds, step).agg(F.count("*").alias("grid_points"))
    span = min(h for h, _ in WINDOWS.values())
    return bounds.crossJoin(F.broadcast(points)).select(
        "events", "grid_points", F.ceil(F.col("grid_points") / batch).alias("requests"), F.to_date(F.col("first") + F.expr(f"INTERVAL '{span}' HOUR")).alias("from_day"), F.to_date(F.greatest("last", F.col("first") + F.expr("INTERVAL 48 HOURS"))).alias("to_day")
    )


def windows(events: DataFrame, years: int = 0) -> DataFrame:
    """(event, grid_id, window, year, start, end): half-open windows, and the same ones 1..years calendar years before."""
    span = lambda name, start, end: F.struct(F.lit(name).alias("window"), start.alias("start"), end.alias("end"))
    at = lambda h: F.col("first") + F.expr(f"INTERVAL '{h}' HOUR")
    rows = [span(name, at(start), at(end)) for name, (start, end) in WINDOWS.items()]
    rows.append(span("event_duration", F.col("first"), F.col("last")))
    out = events.select("event", "grid_id", F.explode(F.array(*rows)).alias("w")).withColumn("year", F.explode(F.sequence(F.lit(0), F.lit(years))))
    back = lambda c: c - F.make_ym_interval(F.col("year"))
    return out.select("event", "grid_id", "w.window", "year", back(F.col("w.start")).alias("start"), back(F.col("w.end")).alias("end"))


#: Sums, maxima and vectors of hourly rows that add up to a window's measures.
def _partials() -> list[Column]:
    weight, rad = F.coalesce(F.col("wind_speed_10m"), F.lit(0.0)), F.radians("wind_direction_10m")
    here = F.col("wind_direction_10m").isNotNull()
    return [
        F.count("*").alias("n"), F.coalesce(F.sum("precipitation"), F.lit(0.0)).alias("rain"), F.max("temperature_2m").alias("hot"),
        *(f for c, k in (("temperature_2m", "tm"), ("relative_humidity_2m", "rh"), ("wind_speed_10m", "ws"), ("soil_moisture_0_to_7cm", "sm")) for f in (F.sum(c).alias(k), F.count(c).alias(f"{k}_n"))),
        F.sum(F.when(here, weight * F.sin(rad))).alias("ys"), F.sum(F.when(here, weight * F.cos(rad))).alias("xs"), F.sum(F.when(here, weight)).alias("w"), F.sum(F.sin(rad)).alias("y1"), F.sum(F.cos(rad)).alias("x1"),
    ]


def _days(spans: DataFrame) -> DataFrame:
    """``spans`` once for every day they touch, with ``whole``: the day lies in the span from midnight to midnight."""
    last = F.date_trunc("day", F.greatest(F.col("start"), F.col("end") - F.expr("INTERVAL 1 MICROSECOND")))
    days = spans.withColumn("day", F.explode(F.sequence(F.date_trunc("day", "start"), last, F.expr("INTERVAL 1 DAY"))))
    return days.withColumn("whole", (F.col("day") >= F.col("start")) & (F.col("day") + F.expr("INTERVAL 1 DAY") <= F.col("end")))


def in_windows(spans: DataFrame, hourly: DataFrame) -> DataFrame:
    """Hourly rows of every window of the same grid point, joined on grid point and day."""
    rows = hourly.withColumn("day", F.date_trunc("day", "ts")).drop("grid_lat", "grid_lon")
    return _days(spans).join(rows, ["grid_id", "day"]).where((F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end")))


def _stretches(cut: DataFrame) -> DataFrame:
    """``cut`` (grid_id, _lo, _hi) once for each of its up to three stretches (_from, _to): the hours up to a midnight, whole days, the hours after a midnight."""
    lo, hi, day = F.col("_lo"), F.col("_hi"), F.expr("INTERVAL 1 DAY")
    first, last = F.date_trunc("day", lo), F.date_trunc("day", hi)
    after = F.when(lo == first, lo).otherwise(first + day)  # whole days begin here
    of = lambda start, end: F.when(start < end, F.struct(start.alias("_from"), end.alias("_to")))
    rows = F.array(of(lo, F.least(after, hi)), of(after, last), of(F.greatest(last, after), hi))
    return cut.withColumn("_s", F.explode(F.array_compact(rows))).select(*cut.columns, "_s.*")


def _stretch_sums(stretches: DataFrame, stamped: DataFrame, partials: list[Column], how: dict, rain: str, more: tuple[str, ...]) -> DataFrame:
    """Sums of every different stretch of ``stretches`` (grid_id, _from, _to): whole days from daily sums, others from hours."""
    on = ["grid_id", "_from", "_to"]
    one_day = lambda rows: rows.withColumns({"wet": (F.round(rain, 6) >= WET_DAY_MM).cast("long"), "from_day": F.col("day"), "to_day": F.col("day")})
    fold = [f(c).alias(c) for c, f in how.items()]
    each, midnight = stretches.select(*on).distinct(), lambda c: F.col(c) == F.date_trunc("day", c)
    whole = each.where(midnight("_from") & midnight("_to")).withColumn("day", F.explode(F.sequence(F.col("_from"), F.col("_to") - F.expr("INTERVAL 1 DAY"), F.expr("INTERVAL 1 DAY"))))
    daily = one_day(stamped.groupBy("grid_id", "day", *more).agg(*partials))
    hours = each.where(~(midnight("_from") & midnight("_to"))).withColumn("day", F.date_trunc("day", "_from"))
    hours = hours.join(stamped, ["grid_id", "day"]).where((F.col("ts") >= F.col("_from")) & (F.col("ts") < F.col("_to")))
    summed = whole.join(daily, ["grid_id", "day"]).groupBy(*on, *more).agg(*fold)
    return summed.unionByName(one_day(hours.groupBy(*on, "day", *more).agg(*partials)).drop("day"))


def _in_spans(spans: DataFrame, hourly: DataFrame, long: Callable[[DataFrame], DataFrame], partials: list[Column], how: dict, rain: str, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(``spans`` with _lo and _hi, sums by (grid_id, _lo, _hi, more)): spans that hold the same hours are added up once.

    ``long`` makes rows with ``more`` columns of the hourly ones, ``partials`` add
    them up, ``how`` adds partials up again.  Where all readings are of full hours,
    a span's ends may move up to the next one, so the number of different spans is
    that of hours and grid points, however many events there are.
    """
    how = how | {"wet": F.sum, "from_day": F.min, "to_day": F.max}
    even = hourly.agg(F.coalesce(F.bool_and(F.col("ts") == F.date_trunc("hour", "ts")), F.lit(False)).alias("_even"))
    up = lambda c: F.when(F.col("_even") & (F.col(c) > F.date_trunc("hour", c)), F.date_trunc("hour", c) + F.expr("INTERVAL 1 HOUR")).otherwise(F.col(c))
    cut = spans.crossJoin(F.broadcast(even)).withColumns({"_lo": up("start"), "_hi": up("end")}).drop("_even")
    stretches = _stretches(cut.select("grid_id", "_lo", "_hi").distinct())
    stamped = long(hourly.withColumn("day", F.date_trunc("day", "ts")).drop("grid_lat", "grid_lon"))
    sums = stretches.join(_stretch_sums(stretches, stamped, partials, how, rain, more), ["grid_id", "_from", "_to"])
    return cut, sums.groupBy("grid_id", "_lo", "_hi", *more).agg(*(f(c).alias(c) for c, f in how.items()))


def window_metrics(spans: DataFrame, hourly: DataFrame) -> DataFrame:
    """One row for every window: rain total, highest temperature, means, rain-free days, weighted wind direction; nulls without rows.

    A window with rows but no rain readings has 0 mm.  Days count from the first
    to the last day with rows, days in between without rows as dry.  Wind
    directions weigh by speed (null as 0), or alike if all speeds are 0.

    Hours are added up once for every grid point and day, days and the hours at the
    ends once for every different stretch of them; windows take their sums from there.
    """
    keys = ["event", "window", "year"]
    sums = ["n", "rain", "tm", "tm_n", "rh", "rh_n", "ws", "ws_n", "sm", "sm_n", "ys", "xs", "w", "y1", "x1"]
    cut, found = _in_spans(spans.select(*keys, "grid_id", "start", "end"), hourly, lambda rows: rows, _partials(), {c: F.sum for c in sums} | {"hot": F.max}, "rain")
    mean = lambda k: F.when(F.col(f"{k}_n") > 0, F.col(k) / F.col(f"{k}_n"))
    y, x = (F.when(F.col("w") > 0, F.col(a)).otherwise(F.col(b)) for a, b in (("ys", "y1"), ("xs", "x1")))
    found = found.select(
        "grid_id", "_lo", "_hi",
        F.round("rain", 4).alias("rainfall_mm"), F.col("hot").alias("max_temperature_c"), mean("tm").alias("mean_temperature_c"), mean("rh").alias("mean_relative_humidity"), mean("ws").alias("mean_wind_speed"), mean("sm").alias("mean_soil_moisture"),
        (F.datediff("to_day", "from_day") + 1 - F.col("wet")).cast("long").alias("rain_free_days"),
        F.when(F.abs(y) + F.abs(x) > 1e-9, F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))).alias("wind_direction_deg"),
    )
    on = ["grid_id", "_lo", "_hi"]
    return cut.join(found, on, "left").drop(*on)


def rainfall_anomaly(metrics: DataFrame) -> DataFrame:
    """(event, window, anomaly_pct): this year's rain against the mean of the years before; null without any or with a mean of 0."""
    past = F.col("year") > 0
    # ten-thousandths of a millimetre add up exactly in any order
    base = F.sum(F.when(past, F.round(F.col("rainfall_mm") * 1e4).cast("long"))) / F.count(F.when(past, F.col("rainfall_mm"))) / 1e4
    now = F.max(F.when(~past, F.col("rainfall_mm")))
    return metrics.groupBy("event", "window").agg(F.when((base != 0) & now.isNotNull(), F.bround((now - base) / base * 100.0, 1)).alias("anomaly_pct"))


def daily_in_windows(spans: DataFrame, daily: DataFrame) -> DataFrame:
    """Daily rows from the window's first to its last day, both included."""
    days = spans.withColumn("date", F.explode(F.sequence(F.to_date("start"), F.to_date("end"), F.expr("INTERVAL 1 DAY"))))
    return days.join(daily, ["grid_id", "date"])


def disagreement(metrics: DataFrame, spans: DataFrame, daily: DataFrame) -> DataFrame:
    """(event, window, rain_diff, temperature_diff, humidity_diff, wind_diff): hourly less daily source, two decimals, null where one has nothing.

    Only windows with daily rows have one.
    """
    # windows of the same days are added up once
    dated = spans.where("year = 0").select("event", "window", "grid_id", F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    on = ["grid_id", "start", "end"]
    found = daily_in_windows(dated.select(*on).distinct(), daily).groupBy(*on).agg(F.sum("rain").alias("r"), F.avg("temperature").alias("t"), F.avg("humidity").alias("h"), F.avg("wind").alias("w"))
    other = dated.join(found, on).drop(*on)
    # the ninth decimal settles halves alike whatever the order of a sum was
    diff = lambda a, b, name: (F.round(F.round(F.col(a) - (F.coalesce(b, F.lit(0.0)) if name == "rain_diff" else b), 8) + 1e-9, 2) + 0.0).alias(name)
    return metrics.where("year = 0").join(other, ["event", "window"]).select(
        "event", "window", diff("rainfall_mm", F.col("r"), "rain_diff"), diff("mean_temperature_c", F.col("t"), "temperature_diff"), diff("mean_relative_humidity", F.col("h"), "humidity_diff"), diff("mean_wind_speed", F.col("w"), "wind_diff")
    )


def weather_evidence(metrics: DataFrame, anomaly: DataFrame, apart: DataFrame) -> DataFrame:
    """Evidence rows of every measure that has a value: id, type, unit, observation, value, limitations, quality (0.6 with limitations, else 0.82).

    ``anomaly`` and ``apart`` (``rainfall_anomaly``, ``disagreement``) say what
    limits a value: rain unlike the years before, a daily source that tells otherwise or nothing at all.
    """
    j = metrics.where("year = 0").join(anomaly, ["event", "window"], "left").join(apart.withColumn("told", F.lit(True)), ["event", "window"], "left")
    unlike = F.when(F.col("anomaly_pct").isNotNull(), F.concat(F.format_string("%.1f", F.abs("anomaly_pct")), F.when(F.col("anomaly_pct") >= 0, " % above").otherwise(" % below"), F.lit(" the years before")))
    silent = F.when(F.col("told").isNull(), "no daily source for this window")
    diffs = {"rainfall_mm": "rain_diff", "mean_relative_humidity": "humidity_diff", "mean_wind_speed": "wind_diff"}

    def notes(column: str, unit: str) -> Column:
        other = F.when(F.col(diffs[column]).isNotNull(), F.format_string(f"daily source differs by %.2f {unit}", diffs[column])) if column in diffs else F.lit(None).cast("string")
        return F.array_compact(F.array(silent, unlike if column == "rainfall_mm" else F.lit(None).cast("string"), other))

    rows = F.array(*(F.struct(F.lit(t).alias("type"), F.lit(u).alias("unit"), F.col(c).cast("double").alias("value"), notes(c, u).alias("limitations")) for c, t, u in METRICS))
    long = j.select("event", "window", F.explode(rows).alias("r")).select("event", "window", "r.*").where("value is not null")
    return long.select(
        F.concat_ws("_", F.lit("ENV_WEATHER"), F.col("event").cast("string"), "window", "type").alias("evidence_id"), "event", F.lit("weather").alias("category"), "window", "type", "unit",
        F.concat(F.regexp_replace("type", "_", " "), F.lit(" "), F.format_string("%.2f", F.bround("value", 2)), F.lit(" "), F.col("unit"), F.lit(" during "), F.col("window")).alias("observation"),
        "value", "limitations", F.when(F.size("limitations") > 0, 0.6).otherwise(0.82).alias("quality"),
    )


def variable_evidence(events: DataFrame, hourly: DataFrame) -> DataFrame:
    """(event, window, variable, kind, n, total, mean, least, most, direction, rain_free_days) over two windows: current (at least two hours) and T-7d.

    Precipitation is summed, with its rain-free days; directions are averaged on
    the circle, by the speed of the same height if there is one and it isn't all
    0; others are described by mean, least and most.
    """
    start = F.array(
        F.struct(F.lit("current").alias("window"), F.col("first").alias("start"), F.greatest("last", F.col("first") + F.expr("INTERVAL 2 HOURS")).alias("end")),
        F.struct(F.lit("T-7d").alias("window"), (F.col("first") - F.expr("INTERVAL 168 HOURS")).alias("start"), F.col("first").alias("end")),
    )
    spans = events.select("event", "grid_id", F.explode(start).alias("w")).select("event", "grid_id", "w.*")
    names = [c for c in hourly.columns if c not in ("grid_id", "grid_lat", "grid_lon", "ts")]
    speed = lambda c: F.col(c.replace("direction", "speed")) if "direction" in c and c.replace("direction", "speed") in names else F.lit(None)
    each = F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value"), speed(c).cast("double").alias("speed")) for c in names))
    long = lambda rows: rows.select("grid_id", "day", "ts", F.explode(each).alias("v")).select("grid_id", "day", "ts", "v.*").where("value is not null")
    kind = F.when(F.col("variable").contains("precipitation"), "sum").when(F.col("variable").contains("direction"), "circular").otherwise("spread")
    rad, weight = F.radians("value"), F.coalesce("speed", F.lit(0.0))
    partials = [
        F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.sum(weight).alias("w"), F.sum(weight * F.sin(rad)).alias("ys"), F.sum(weight * F.cos(rad)).alias("xs"), F.sum(F.sin(rad)).alias("y1"), F.sum(F.cos(rad)).alias("x1"),
    ]
    how = {c: F.sum for c in ("n", "total", "w", "ys", "xs", "y1", "x1")} | {"least": F.min, "most": F.max}
    cut, sums = _in_spans(spans, hourly, long, partials, how, "total", ("variable",))
    y, x = (F.when(F.col("w") > 0, F.col(a)).otherwise(F.col(b)) for a, b in (("ys", "y1"), ("xs", "x1")))
    dry = F.datediff("to_day", "from_day") + 1 - F.col("wet")
    direction = F.when(F.abs(y) + F.abs(x) > 1e-9, F.bround(F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)), 1))
    on = ["grid_id", "_lo", "_hi"]
    found = sums.select(
        *on, "variable", "n", F.bround(F.round("total", 6), 2).alias("total"), F.bround(F.round(F.col("total") / F.col("n"), 8), 2).alias("mean"), F.bround("least", 2).alias("least"), F.bround("most", 2).alias("most"), direction.alias("direction"), dry.cast("long").alias("dry")
    )
    found = cut.join(found, on)
    only = lambda k, c, name: F.when(kind == k, F.col(c)).alias(name)
    return found.select("event", "window", "variable", kind.alias("kind"), "n", only("sum", "total", "total"), only("spread", "mean", "mean"), only("spread", "least", "least"), only("spread", "most", "most"), only("circular", "direction", "direction"), F.when(F.col("variable") == "precipitation", F.col("dry")).alias("rain_free_days"))
