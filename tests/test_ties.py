"""Rows that tie, halves and full circles come out alike in query and SQL."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from emberframe.operators import raster
from emberframe.plans import catalog
from emberframe.sources import readers
from tests.compare import assert_same

SQL = catalog.oracle_sql()


def test_merged_keeps_the_first_in_confidence_from_any_frame(spark):
    rows = [(-1.0, 100.0, "2024-01-01", 455, "N", "VIIRS", c, f) for c, f in (("n", 3.0), ("l", 9.0), ("h", None), ("h", 7.0), ("h", 8.0))]
    schema = "latitude double, longitude double, acq_date string, acq_time int, satellite string, instrument string, confidence string, frp double"
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        a, b = (spark.createDataFrame(part, schema) for part in (order[:2], order[2:]))
        assert [tuple(r) for r in readers.merged(a, b).select("confidence", "frp").collect()] == [("h", 7.0)]


@pytest.mark.parametrize("folder", [False, True])
def test_live_feed_counts_a_key_once_whatever_its_power(spark, tmp_path, folder):
    at = dt.datetime(2024, 1, 30, 10, 30)
    # 62 apart in event_id and 101 * 97 in user_id: one place, satellite and minute
    rows = [(i * 62, at, 1 + i % 2 * 101 * 97, ("view", "purchase")[i % 3 == 0], 50.0 - i, "{}") for i in range(9)] + [(1, at, 7, "view", 2.5, "{}")]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    frame.toPandas().to_parquet(tmp_path / "one.parquet", coerce_timestamps="us")
    if folder:
        (tmp_path / "events.parquet").mkdir()
    (tmp_path / "one.parquet").rename(tmp_path / ("events.parquet/part.parquet" if folder else "events.parquet"))
    got = [tuple(r) for r in catalog.queries()["live_feed"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet{'/*' if folder else ''}')")
    assert got == con.execute(SQL["live_feed"]).fetchall() == [("2024-01-30", 2, 46.5)]


def test_percents_of_fractions_round_halves_to_even(spark):
    rows = [(i, True, k / 1e4, None, None, ["x"]) for i, k in enumerate((1385, 55, 145, 205, 1375, 10000, 2))]
    schema = "event long, any_peat boolean, footprint_fraction double, buffer_fraction double, peat_distance_km double, limitations array<string>"
    got = raster.peat_evidence(spark.createDataFrame(rows, schema)).where("type = 'peat_fraction'").orderBy("event")
    assert [r["observation"].split("%")[0] for r in got.select(F.col("observation")).collect()] == ["13.8", "0.6", "1.4", "2.0", "13.8", "100.0", "0.0"]


def test_chosen_wind_has_no_full_circle(spark):
    assert assert_same(catalog.queries()["chosen_wind"](spark, "/root/testdata/sf0.01"), SQL["chosen_wind"], "/root/testdata/sf0.01") > 0
