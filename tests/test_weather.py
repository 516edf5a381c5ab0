"""Windows of weather: the same as hour by hour, added up once for windows of the same hours."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberframe.operators import weather

T0 = dt.datetime(2024, 1, 1)


def _hourly(spark, minute=0):
    i = F.col("id")
    at = F.timestamp_seconds(F.lit(1704067200 + 60 * minute) + (i % 400) * 3600)
    skip = ((i * 7) % 31) != 0
    cols = {"precipitation": (i % 9) / 4.0, "temperature_2m": 20 + (i % 13) * 0.5, "relative_humidity_2m": 50.0 + i % 17, "wind_speed_10m": F.when(i % 5 != 0, (i % 6) * 1.0), "wind_direction_10m": ((i * 37) % 360).cast("double"), "soil_moisture_0_to_7cm": F.lit(0.25)}
    return spark.range(800).where(skip).select(F.floor(i / 400).alias("grid_id"), F.lit(0.0).alias("grid_lat"), F.lit(0.0).alias("grid_lon"), at.alias("ts"), *(c.alias(n) for n, c in cols.items()))


def _spans(spark):
    ends = [(0, 0), (0, 24 * 60), (30, 45), (0, 60), (61, 24 * 60 + 61), (24 * 60, 4 * 24 * 60), (23 * 60 + 59, 24 * 60 + 1), (100, 9 * 24 * 60 + 7), (200, 100), (24 * 60, 24 * 60 + 90), (90, 48 * 60), (-500, 60), (10**6, 10**6 + 5)]
    rows = [(k, f"w{k}", 0, g, T0 + dt.timedelta(minutes=a), T0 + dt.timedelta(minutes=b)) for k, (a, b) in enumerate(ends) for g in (0, 1)]
    rows = [(k * 2 + r[3], *r[1:]) for k, r in enumerate(rows)] + [(1000, "none", 0, None, T0, T0 + dt.timedelta(days=2)), (1001, "far", 0, 9, T0, T0 + dt.timedelta(days=2))]
    return spark.createDataFrame(rows, "event long, window string, year int, grid_id long, start timestamp, end timestamp")


@pytest.mark.parametrize("minute", [0, 20])
def test_window_metrics_equal_hour_by_hour(spark, minute):
    hourly, spans = _hourly(spark, minute), _spans(spark)
    got = {r["event"]: r for r in weather.window_metrics(spans, hourly).collect()}
    rows = hourly.collect()
    assert len(got) == spans.count()
    for s in spans.collect():
        own = [r for r in rows if r["grid_id"] == s["grid_id"] and s["start"] <= r["ts"] < s["end"]]
        g = got[s["event"]]
        assert (g["start"], g["end"]) == (s["start"], s["end"])
        if not own:
            assert g["rainfall_mm"] is None and g["rain_free_days"] is None
            continue
        rain = {}
        for r in own:
            rain[r["ts"].date()] = rain.get(r["ts"].date(), 0) + r["precipitation"]
        assert g["rainfall_mm"] == pytest.approx(sum(rain.values())) and g["max_temperature_c"] == max(r["temperature_2m"] for r in own)
        assert g["mean_relative_humidity"] == pytest.approx(sum(r["relative_humidity_2m"] for r in own) / len(own))
        assert g["rain_free_days"] == (max(rain) - min(rain)).days + 1 - sum(v >= 1 for v in rain.values())


def test_windows_of_the_same_hours_are_added_up_once(spark, monkeypatch):
    seen, real = [], weather._stretch_sums
    monkeypatch.setattr(weather, "_stretch_sums", lambda stretches, *a: (seen.append(stretches), real(stretches, *a))[1])
    first = F.timestamp_seconds(F.lit(1704067200 + 7 * 86400) + (F.col("id") % 3000))  # within one hour
    events = spark.range(3000).select(F.col("id").alias("event"), F.lit(0).cast("long").alias("grid_id"), first.alias("first"), (first + F.expr("INTERVAL 30 HOURS")).alias("last"))
    spans = weather.windows(events)
    assert weather.window_metrics(spans, _hourly(spark)).count() == spans.count() == 21000
    weather.variable_evidence(events, _hourly(spark)).count()
    # one hour of a day: up to three stretches for each of seven and of two windows, twice (the hour itself and the next)
    assert [s.count() <= 3 * n * 2 for s, n in zip(seen, (7, 2), strict=True)] == [True, True]
