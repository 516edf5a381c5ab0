"""Raster algebra as joins on (row, col) of a cell table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.functions.geo import EARTH_KM, haversine_km, km_per_degree
from emberframe.operators.components import materialise


@dataclass(frozen=True)
class Transform:
    """Where cell (0, 0) lies; rows run south, columns east."""

    origin_lat: float
    origin_lon: float
    step: float
    rows: int
    cols: int

    def row(self, lat: Column) -> Column:
        """Nearest row; halves go to the even one."""
        return F.bround((F.lit(self.origin_lat) - lat) / self.step).cast("long")

    def col(self, lon: Column) -> Column:
        return F.bround((lon - F.lit(self.origin_lon)) / self.step).cast("long")

    def inside(self, row: Column, col: Column) -> Column:
        return row.between(0, self.rows - 1) & col.between(0, self.cols - 1)

    def lat(self, row: Column) -> Column:
        return F.lit(self.origin_lat) - row * self.step

    def lon(self, col: Column) -> Column:
        return F.lit(self.origin_lon) + col * self.step


#: The raster of the lens in ``plans.lens``.
TRANSFORM = Transform(-2.4, 115.0, 0.01, 260, 260)
NODATA, OUTSIDE = 255, -1
PEAT = (1, 2)


def class_at(points: DataFrame, raster: DataFrame, t: Transform, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``points`` with ``peat_class``: -1 outside the raster, 0 where it holds no data."""
    keyed = points.withColumns({"row": t.row(F.col(lat)), "col": t.col(F.col(lon))})
    got = keyed.join(raster.select("row", "col", "value"), ["row", "col"], "left")
    value = F.when(~t.inside(F.col("row"), F.col("col")), OUTSIDE).when(F.col("value").isNull() | (F.col("value") == NODATA), 0).otherwise(F.col("value"))
    return got.withColumn("peat_class", value.cast("int")).drop("row", "col", "value")


def is_peat(value: Column) -> Column:
    return value.isin(*PEAT)


def cells_within(points: DataFrame, raster: DataFrame, t: Transform, km: float) -> DataFrame:
    """Cells whose centre lies within ``km`` of each point: the point's columns, row, col, value, distance_km."""
    up, across = km_per_degree(F.col("lat"))
    dr, dc = F.ceil(F.lit(km) / up / t.step).cast("long"), F.ceil(F.lit(km) / across / t.step).cast("long")
    r0, c0 = t.row(F.col("lat")), t.col(F.col("lon"))
    clip = lambda lo, hi, n: F.sequence(F.greatest(lo, F.lit(0)), F.least(hi, F.lit(n - 1)))
    fits = (r0 + dr >= 0) & (r0 - dr <= t.rows - 1) & (c0 + dc >= 0) & (c0 - dc <= t.cols - 1)
    spread = points.where(fits).withColumn("row", F.explode(clip(r0 - dr, r0 + dr, t.rows))).withColumn("col", F.explode(clip(c0 - dc, c0 + dc, t.cols)))
    d = haversine_km(F.col("lat"), F.col("lon"), t.lat(F.col("row")), t.lon(F.col("col")))
    return spread.withColumn("distance_km", d).where(F.col("distance_km") <= km).join(raster.select("row", "col", "value"), ["row", "col"])


def radius_fraction(points: DataFrame, raster: DataFrame, t: Transform, km: float = 2.0) -> DataFrame:
    """(event, cells, peat_cells, peat_fraction) of the raster cells around each point."""
    n, p = F.count("*"), F.count_if(is_peat(F.col("value")))
    found = cells_within(points.select("event", "lat", "lon"), raster, t, km).groupBy("event").agg(n.alias("cells"), p.alias("peat_cells"))
    return points.select("event").join(found, "event", "left").withColumn("peat_fraction", F.bround(F.col("peat_cells") / F.col("cells"), 4))


#: Fixed value: kilometres within which the nearest peat is looked for.
SEARCH_KM = 35.2
#: Rows and columns of a block of the raster.
BLOCK = 16


def distance_to_peat(points: DataFrame, raster: DataFrame, t: Transform) -> DataFrame:
    """(event, peat_distance_km): 0 on a peat cell, else the way to the nearest peat cell within ``SEARCH_KM``, null beyond.

    Blocks of cells are known by the box around their peat.  A point weighs the
    blocks in reach by the least and the greatest distance that their box allows;
    only blocks that may hold something nearer than the best of the greatest
    distances are opened, so a point meets the peat of a few blocks.
    """
    at = materialise(class_at(points.select("event", "lat", "lon"), raster, t))
    on = at.where(is_peat(F.col("peat_class"))).select("event", F.lit(0.0).alias("peat_distance_km"))
    off = at.where(~is_peat(F.col("peat_class"))).select("event", "lat", "lon").where("lat is not null and lon is not null")
    part = lambda c: F.floor(c / BLOCK).cast("long")
    peat = raster.where(is_peat(F.col("value"))).select("row", "col", part(F.col("row")).alias("br"), part(F.col("col")).alias("bc"))
    blocks = peat.groupBy("br", "bc").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    up, across = km_per_degree(F.col("lat"))
    dr, dc = F.ceil(F.lit(SEARCH_KM) / up / t.step).cast("long"), F.ceil(F.lit(SEARCH_KM) / across / t.step).cast("long")
    r, c = t.row(F.col("lat")), t.col(F.col("lon"))
    near = off.withColumn("br", F.explode(F.sequence(part(r - dr), part(r + dr)))).withColumn("bc", F.explode(F.sequence(part(c - dc), part(c + dc)))).join(blocks, ["br", "bc"])
    north, south, west, east = t.lat(F.col("r0")), t.lat(F.col("r1")), t.lon(F.col("c0")), t.lon(F.col("c1"))
    gap = lambda x, lo, hi: F.greatest(lo - x, x - hi, F.lit(0.0))
    span = lambda x, lo, hi: F.greatest(hi - x, x - lo)
    widest, narrowest = (f(F.cos(F.radians(north)), F.cos(F.radians(south))) for f in (F.greatest, F.least))
    widest = F.when(south * north <= 0, 1.0).otherwise(widest)

    def arc(dlat: Column, dlon: Column, cosine: Column) -> Column:
        a = F.pow(F.sin(F.radians(dlat) / 2), 2) + F.cos(F.radians("lat")) * cosine * F.pow(F.sin(F.radians(dlon) / 2), 2)
        return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * 2 * EARTH_KM

    lat, lon = F.col("lat"), F.col("lon")
    bounded = near.withColumns({"low": arc(gap(lat, south, north), gap(lon, west, east), narrowest) - 1e-6, "high": arc(span(lat, south, north), span(lon, west, east), widest) + 1e-6})
    best = bounded.groupBy("event").agg(F.min("high").alias("best"))
    opened = bounded.join(best, "event").where((F.col("low") <= F.col("best")) & (F.col("low") <= SEARCH_KM)).select("event", "lat", "lon", "br", "bc")
    d = haversine_km(lat, lon, t.lat(F.col("row")), t.lon(F.col("col")))
    met = opened.join(peat, ["br", "bc"]).withColumn("d", d).where(F.col("d") <= SEARCH_KM)
    found = met.groupBy("event").agg(F.bround(F.min("d"), 2).alias("peat_distance_km"))
    return points.select("event").join(on.unionByName(found), "event", "left")


#: Fixed value: kilometres between samples of a line or a footprint.
SAMPLE_KM = 1.1
#: Fixed value: samples of a footprint beyond which they are spread wider.
FOOTPRINT_SAMPLES = 400


def _sampled(at: DataFrame, raster: DataFrame, t: Transform, *keys: str) -> DataFrame:
    """(keys, samples, outside, peat): samples (lat, lon) in all, beyond the raster, and on peat."""
    seen = class_at(at, raster, t)
    return seen.groupBy(*keys).agg(F.count("*").alias("samples"), F.count_if(F.col("peat_class") == OUTSIDE).alias("outside"), F.count_if(is_peat(F.col("peat_class"))).alias("peat"))


def _share() -> Column:
    """Share of peat among the samples within the raster; null if there are none."""
    within = F.col("samples") - F.col("outside")
    return F.when(within > 0, F.bround(F.col("peat") / within, 4))


def corridor_fraction(pairs: DataFrame, raster: DataFrame, t: Transform) -> DataFrame:
    """(source, target, samples, outside, peat_fraction) along the straight line between two points; one sample if they coincide."""
    km = haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    n = F.when(km == 0, 1).otherwise(F.greatest(F.ceil(km / SAMPLE_KM).cast("int") + 1, F.lit(2)))
    along = pairs.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    f = F.col("i") / F.greatest(F.col("n") - 1, F.lit(1))
    at = along.select("source", "target", (F.col("lat1") + (F.col("lat2") - F.col("lat1")) * f).alias("lat"), (F.col("lon1") + (F.col("lon2") - F.col("lon1")) * f).alias("lon"))
    return _sampled(at, raster, t, "source", "target").select("source", "target", "samples", "outside", _share().alias("peat_fraction"))


def footprint_fraction(boxes: DataFrame, raster: DataFrame, t: Transform) -> DataFrame:
    """(event, samples, outside, peat_fraction, any_peat) on an even grid of samples over each box; samples beyond the raster don't count."""
    up, across = km_per_degree((F.col("south") + F.col("north")) / 2)

    def points(lo: str, hi: str, km: Column) -> Column:
        return F.when(F.col(hi) > F.col(lo), F.greatest(F.bround((F.col(hi) - F.col(lo)) * km / SAMPLE_KM).cast("int"), F.lit(1)) + 1).otherwise(1)

    n = boxes.select("event", "west", "south", "east", "north", points("south", "north", up).alias("r"), points("west", "east", across).alias("c"))
    cells = F.col("r").cast("long") * F.col("c")
    fewer = lambda k: F.when(cells > FOOTPRINT_SAMPLES, F.greatest(F.floor(F.col(k) * F.sqrt(F.lit(float(FOOTPRINT_SAMPLES)) / cells)).cast("int"), F.lit(1))).otherwise(F.col(k))
    n = n.select("event", "west", "south", "east", "north", fewer("r").alias("rows"), fewer("c").alias("cols"))
    spread = n.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    place = lambda lo, hi, k, m: F.col(lo) + (F.col(hi) - F.col(lo)) * (F.col(k) / F.greatest(F.col(m) - 1, F.lit(1)))
    at = spread.select("event", place("south", "north", "i", "rows").alias("lat"), place("west", "east", "j", "cols").alias("lon"))
    return _sampled(at, raster, t, "event").select("event", "samples", "outside", _share().alias("peat_fraction"), (F.col("peat") > 0).alias("any_peat"))


#: Fixed value: the limitation that every statement about peat carries.
NO_INFERENCE = "mapped peat near an event is context, not a sign that peat burned"


def peat_context(events: DataFrame, raster: DataFrame, t: Transform, buffer_km: float = 5.0) -> DataFrame:
    """(event, any_peat, footprint_fraction, buffer_fraction, peat_distance_km, limitations) of every event (lat, lon, box, extent_km)."""
    foot = footprint_fraction(events, raster, t).select("event", "any_peat", F.col("peat_fraction").alias("footprint_fraction"))
    circle = radius_fraction(events, raster, t, buffer_km).select("event", "cells", F.col("peat_fraction").alias("buffer_fraction"))
    j = events.select("event", "extent_km").join(foot, "event").join(circle, "event").join(distance_to_peat(events, raster, t), "event")
    expected = 3.141592653589793 * (buffer_km / SAMPLE_KM) ** 2
    notes = F.array_compact(F.array(
        F.lit(NO_INFERENCE),
        F.when(F.col("footprint_fraction").isNull(), "footprint outside the raster"),
        F.when(F.col("cells").isNull(), "buffer outside the raster").when(F.col("cells") < expected / 2, "buffer partly outside the raster"),
        F.when(F.col("peat_distance_km").isNull(), "no peat within reach"),
        F.when(F.col("extent_km") > buffer_km, "event wider than its buffer"),
    ))
    return j.select("event", "any_peat", "footprint_fraction", "buffer_fraction", "peat_distance_km", notes.alias("limitations"))


def peat_evidence(context: DataFrame) -> DataFrame:
    """Evidence rows of a peat context: evidence_id, event, category, type, observation, value, unit, quality, limitations; null measures have none."""
    # a fraction's ten-thousandths are whole, so halves are told exactly
    percent = lambda c: F.format_string("%.1f%%", F.bround(F.round(F.col(c) * 1e4) / 10) / 10)
    rows = (
        ("direct_intersection", "peat_intersection", F.when(F.col("any_peat"), "footprint meets mapped peat").otherwise("footprint meets no mapped peat"), F.col("any_peat").cast("double"), "bool", 0.7),
        ("footprint_fraction", "peat_fraction", F.concat(percent("footprint_fraction"), F.lit(" of the footprint is mapped peat")), F.col("footprint_fraction"), "fraction", 0.6),
        ("buffer_fraction", "peat_fraction", F.concat(percent("buffer_fraction"), F.lit(" of the buffer is mapped peat")), F.col("buffer_fraction"), "fraction", 0.7),
        ("distance_to_peat", "distance_to_peat", F.concat(F.lit("nearest mapped peat at "), F.format_string("%.2f", "peat_distance_km"), F.lit(" km")), F.col("peat_distance_km"), "km", 0.7),
    )
    long = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(t).alias("type"), o.alias("observation"), v.alias("value"), F.lit(u).alias("unit"), F.lit(q).alias("quality")) for k, t, o, v, u, q in rows)))
    return context.select("event", "limitations", long.alias("r")).where("r.value is not null").select(
        F.concat_ws("_", F.lit("ENV_PEAT"), F.col("event").cast("string"), "r.kind").alias("evidence_id"), "event", F.lit("peat").alias("category"), "r.type", "r.observation", "r.value", "r.unit", "r.quality", "limitations"
    )


def crop(raster: DataFrame, t: Transform, west: float, south: float, east: float, north: float, pad_deg: float = 1.0) -> tuple[DataFrame, Transform]:
    """The cells around a box, renumbered, and where they lie; row and column bounds reach the scan as filters."""
    from math import ceil, floor

    r0, r1 = max(0, floor((t.origin_lat - north - pad_deg) / t.step)), min(t.rows - 1, ceil((t.origin_lat - south + pad_deg) / t.step))
    c0, c1 = max(0, floor((west - pad_deg - t.origin_lon) / t.step)), min(t.cols - 1, ceil((east + pad_deg - t.origin_lon) / t.step))
    if r1 < r0 or c1 < c0:
        raise ValueError("the box lies outside the raster")
    cut = raster.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1)).withColumns({"row": F.col("row") - r0, "col": F.col("col") - c0})
    return cut, Transform(t.origin_lat - r0 * t.step, t.origin_lon + c0 * t.step, t.step, r1 - r0 + 1, c1 - c0 + 1)


def downsampled(raster: DataFrame, factor: int = 4) -> DataFrame:
    """(row, col, peat): blocks of factor x factor cells, peat if any cell is."""
    return raster.groupBy(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(F.bool_or(is_peat(F.col("value"))).alias("peat"))


def rectangles(blocks: DataFrame) -> DataFrame:
    """(row, from_col, to_col): runs of adjacent peat blocks in each row."""
    island = F.col("col") - F.row_number().over(Window.partitionBy("row").orderBy("col"))
    return blocks.where("peat").withColumn("i", island).groupBy("row", "i").agg(F.min("col").alias("from_col"), F.max("col").alias("to_col")).drop("i")
