"""Range joins on the globe as equi-joins over cells.

Left rows go to their own cell, right rows to the nine cells around theirs; the
exact predicate follows as a residual condition.  The plan is a merge join on the
cell, never a nested loop and never a broadcast: rows that go to the cells around
are many times those of their table, by whose size Spark would plan.  Hot cells are
ordinary skewed join keys, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions.evidence import hours_between
from emberframe.functions.geo import EARTH_KM, KM_PER_DEGREE, planar_km


def mean_latitude(points: DataFrame, lat: str = "latitude") -> DataFrame:
    """One row: the mean latitude over the whole table, exact to the fifth decimal of the inputs and so free of row order."""
    return points.agg((F.sum(F.round(F.col(lat) * 1e5).cast("long")) / F.count(lat) / 1e5).alias("ref_lat"))


def projected(points: DataFrame, lat: str = "latitude", lon: str = "longitude", ref_lat: float | None = None) -> DataFrame:
    """``points`` with x_km and y_km at the table's mean latitude, or at a fixed one that tables taken apart share."""
    if ref_lat is not None:
        x, y = planar_km(F.col(lat), F.col(lon), F.lit(ref_lat))
        return points.withColumns({"x_km": x, "y_km": y})
    x, y = planar_km(F.col(lat), F.col(lon), F.col("ref_lat"))
    return points.crossJoin(F.broadcast(mean_latitude(points, lat))).withColumns({"x_km": x, "y_km": y}).drop("ref_lat")


def _around(cell: Column) -> Column:
    return F.explode(F.sequence(cell - 1, cell + 1))


def _unit(at: tuple[str, str], tag: str) -> dict[str, Column]:
    """The unit vector towards (lat, lon), as three columns."""
    lat, lon = F.radians(at[0]), F.radians(at[1])
    return {f"{tag}x": F.cos(lat) * F.cos(lon), f"{tag}y": F.cos(lat) * F.sin(lon), f"{tag}z": F.sin(lat)}


def pairs_within(points: DataFrame, radius_km: float, hours: float | None = None, keys: tuple[str, ...] = (), key: str = "obs_id", of: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, distance_km, gap_hours) for all unordered pairs a < b no further apart than both bounds (inclusive).

    With ``of``, rows like those of ``points``, all pairs of one of these as ``a``
    and another row of ``points`` as ``b``.

    ``points`` has ``key``, x_km, y_km and ts; pairs are formed within equal
    ``keys``.  With ``hours`` the cells get a time axis too, which keeps places
    that burn again and again from multiplying candidates.
    """
    cell = lambda c, size: F.floor(F.col(c) / size)
    on = [*keys, "cx", "cy", *["ct"] * (hours is not None)]

    def celled(rows: DataFrame) -> DataFrame:
        out = rows.select(*keys, F.col(key).alias("id"), "x_km", "y_km", "ts", *carry, cell("x_km", radius_km).alias("cx"), cell("y_km", radius_km).alias("cy"))
        return out if hours is None else out.withColumn("ct", F.floor(F.unix_micros("ts") / (hours * 3600e6)))

    right = celled(points)
    base = right if of is None else celled(of)
    # the side that goes to the cells around: with ``of`` the fewer rows
    spread = lambda rows: reduce(lambda d, c: d.withColumn(c, _around(F.col(c))), on[len(keys) :], rows)
    base, right = (base, spread(right)) if of is None else (spread(base), right)
    left = base.select(*on, F.col("id").alias("a"), F.col("x_km").alias("ax"), F.col("y_km").alias("ay"), F.col("ts").alias("at"), *(F.col(c).alias(f"{c}_a") for c in carry))
    right = right.select(*on, F.col("id").alias("b"), "x_km", "y_km", "ts", *(F.col(c).alias(f"{c}_b") for c in carry))
    dx, dy = F.col("ax") - F.col("x_km"), F.col("ay") - F.col("y_km")
    gap = F.abs(hours_between(F.col("at"), F.col("ts")))
    other = F.col("a") < F.col("b") if of is None else F.col("a") != F.col("b")
    met = left.join(right.hint("merge"), on).where(other & (dx * dx + dy * dy <= radius_km * radius_km))
    out = met.select(*keys, "a", "b", F.sqrt(dx * dx + dy * dy).alias("distance_km"), gap.alias("gap_hours"), *(f"{c}_{side}" for c in carry for side in "ab"))
    return out if hours is None else out.where(F.col("gap_hours") <= hours)


def _cells(radius_km: float) -> tuple[Callable, ...]:
    """(band, cell, cells beside) of a (lat, lon); the latter two in the band ``_cy``."""
    up = radius_km / KM_PER_DEGREE * 1.02

    def parts(band: Column) -> Column:
        edge = F.greatest(F.abs(band * up), F.abs((band + 1) * up)) + up
        return F.when(edge >= 89.0, 1).otherwise(F.greatest(F.floor(F.cos(F.radians(edge)) * (360.0 / up)), F.lit(1))).cast("long")

    band = lambda at: F.floor(F.col(at[0]) / up)
    cell = lambda at: F.floor((F.col(at[1]) + 180.0) * parts(F.col("_cy")) / 360.0)
    beside = lambda at: F.array_distinct(F.transform(F.sequence(cell(at) - 1, cell(at) + 1), lambda c: F.pmod(c, parts(F.col("_cy")))))
    return band, lambda at: F.pmod(cell(at), parts(F.col("_cy"))), beside


def own_cell(rows: DataFrame, radius_km: float, at: tuple[str, str]) -> DataFrame:
    """``rows`` with their own cell (_cy, _cx) of ``near``."""
    band, cell, _ = _cells(radius_km)
    return rows.withColumn("_cy", band(at)).withColumn("_cx", cell(at))


def around_cells(rows: DataFrame, radius_km: float, at: tuple[str, str]) -> DataFrame:
    """``rows`` in their own cell (_cy, _cx) of ``near`` (``own``) and in those around it."""
    band, cell, beside = _cells(radius_km)
    home = rows.withColumn("_cy", band(at)).withColumn("_hx", cell(at)).withColumnRenamed("_cy", "_hy")
    spread = home.withColumn("_cy", _around(F.col("_hy"))).withColumn("_cx", F.explode(beside(at)))
    return spread.withColumn("own", (F.col("_cy") == F.col("_hy")) & (F.col("_cx") == F.col("_hx"))).drop("_hy", "_hx")


def near(left: DataFrame, right: DataFrame, radius_km: float, left_at: tuple[str, str], right_at: tuple[str, str], hours: float | None = None, left_in: tuple[str, str] | None = None, right_in: tuple[str, str] | None = None) -> DataFrame:
    """All columns of left and right rows whose (lat, lon) may be within ``radius_km``; the caller adds the exact predicate.

    Cells are bands of latitude, cut in longitude into equal parts no narrower
    than the radius at the band's edge nearest the pole (and at the bands beside
    it); they wrap at the antimeridian, and a band that reaches a pole is one cell.
    With ``hours`` the rows' time spans (``left_in``, ``right_in``) must lie within
    so many hours as well: a left row goes to every period of that length that its
    span touches, a right row to those around too, and a pair counts in the first
    period that both have.

    Cells hold several times the pairs that are near.  Those too far apart go by the
    squared chord between unit vectors, computed once a row, before anything costly.
    """
    band, cell, beside = _cells(radius_km)
    probe = left.withColumn("_cy", band(left_at)).withColumn("_cx", cell(left_at))
    build = right.withColumn("_cy", _around(band(right_at))).withColumn("_cx", F.explode(beside(right_at)))
    on = ["_cy", "_cx"]
    probe, build = probe.withColumns(_unit(left_at, "_l")), build.withColumns(_unit(right_at, "_r"))
    chord = reduce(Column.__add__, ((F.col(f"_l{c}") - F.col(f"_r{c}")) * (F.col(f"_l{c}") - F.col(f"_r{c}")) for c in "xyz"))
    may = chord <= (radius_km / EARTH_KM) ** 2 * 1.0002 + 1e-12  # an arc is longer than its chord; the margin is for rounding
    helpers = [*on, *(f"_{side}{c}" for side in "lr" for c in "xyz")]
    if hours is None:
        return probe.join(build.hint("merge"), on).where(may).drop(*helpers)
    period = lambda c: F.floor(F.unix_micros(F.col(c)) / (hours * 3600e6))
    probe = probe.withColumn("_lt", period(left_in[0])).withColumn("_ct", F.explode(F.sequence(F.col("_lt"), period(left_in[1]))))
    build = build.withColumn("_rt", period(right_in[0]) - 1).withColumn("_ct", F.explode(F.sequence(F.col("_rt"), period(right_in[1]) + 1)))
    return probe.join(build.hint("merge"), [*on, "_ct"]).where((F.col("_ct") == F.greatest("_lt", "_rt")) & may).drop(*helpers, "_ct", "_lt", "_rt")
