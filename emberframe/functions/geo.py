"""Distances, bearings and polygon predicates as Column expressions (degrees, kilometres)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
KM_PER_DEGREE = 111.32


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; the root is clamped at 1."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.asin(F.sqrt(F.least(F.lit(1.0), a))) * (2 * EARTH_KM)


def planar_km(lat: Column, lon: Column, ref_lat: Column) -> tuple[Column, Column]:
    """(x, y) of an equirectangular projection at a reference latitude."""
    return F.radians(lon) * EARTH_KM * F.cos(F.radians(ref_lat)), F.radians(lat) * EARTH_KM


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 to 360 clockwise from north."""
    d = F.radians(lon2 - lon1)
    a, b = F.radians(lat1), F.radians(lat2)
    return degrees_360(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))))


def degrees_360(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    """Smallest angle between two bearings, 0 to 180."""
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def local_offset_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> tuple[Column, Column]:
    """(east, north) from point 1 to point 2 at their mean latitude."""
    return F.radians(lon2 - lon1) * EARTH_KM * F.cos(F.radians((lat1 + lat2) / 2)), F.radians(lat2 - lat1) * EARTH_KM


def km_per_degree(lat: Column) -> tuple[Column, Column]:
    """(a degree of latitude, a degree of longitude) at a latitude."""
    return F.lit(KM_PER_DEGREE), F.cos(F.radians(lat)) * KM_PER_DEGREE


def in_bbox(lat: Column, lon: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    return lon.between(west, east) & lat.between(south, north)


def boxes_overlap(a: Column, b: Column) -> Column:
    """Two structs with west, south, east, north share a point."""
    return (a["west"] <= b["east"]) & (a["east"] >= b["west"]) & (a["south"] <= b["north"]) & (a["north"] >= b["south"])


def buffered(box: Column, km: Column | float, lat: Column) -> Column:
    """A box grown by ``km`` on each side, kept within the globe; the longitude step is taken at ``lat``."""
    km = F.lit(km) if isinstance(km, (int, float)) else km
    up, across = km / KM_PER_DEGREE, km / (F.greatest(F.cos(F.radians(lat)), F.lit(0.01)) * KM_PER_DEGREE)
    return F.struct(
        F.greatest(box["west"] - across, F.lit(-180.0)).alias("west"),
        F.greatest(box["south"] - up, F.lit(-90.0)).alias("south"),
        F.least(box["east"] + across, F.lit(180.0)).alias("east"),
        F.least(box["north"] + up, F.lit(90.0)).alias("north"),
    )


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd rule over a closed ring of [lon, lat] positions."""

    def crosses(i: Column) -> Column:
        ax, ay = F.element_at(F.element_at(ring, i), 1), F.element_at(F.element_at(ring, i), 2)
        bx, by = F.element_at(F.element_at(ring, i + 1), 1), F.element_at(F.element_at(ring, i + 1), 2)
        return ((ay > lat) != (by > lat)) & (lon < (bx - ax) * (lat - ay) / F.when(by == ay, F.lit(None)).otherwise(by - ay) + ax)

    flips = F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(0), lambda n, i: n + F.when(crosses(i), 1).otherwise(0))
    return F.when(F.size(ring) >= 4, flips % 2 == 1).otherwise(False)


def in_polygon(lat: Column, lon: Column, rings: Column) -> Column:
    """Inside the first ring and outside all further ones (holes)."""
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
    return in_ring(lat, lon, F.element_at(rings, 1)) & ~F.exists(holes, lambda h: in_ring(lat, lon, h))


def ring_area(ring: Column) -> Column:
    """Signed shoelace area in square degrees."""
    at = lambda i, k: F.element_at(F.element_at(ring, i), k)
    return F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(0.0), lambda s, i: s + at(i, 1) * at(i + 1, 2) - at(i + 1, 1) * at(i, 2)) / 2


def circle(lat: Column, lon: Column, km: Column, points: int = 64) -> Column:
    """Closed ring of [lon, lat] around a point; longitudes wrap at the antimeridian."""
    d, phi, lam = km / EARTH_KM, F.radians(lat), F.radians(lon)

    def at(i: Column) -> Column:
        turn = i * (2 * 3.141592653589793 / points)
        la = F.asin(F.sin(phi) * F.cos(d) + F.cos(phi) * F.sin(d) * F.cos(turn))
        lo = lam + F.atan2(F.sin(turn) * F.sin(d) * F.cos(phi), F.cos(d) - F.sin(phi) * F.sin(la))
        return F.array(F.pmod(F.degrees(lo) + 540.0, F.lit(360.0)) - 180.0, F.degrees(la))

    ring = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)
    return F.concat(ring, F.array(F.element_at(ring, 1)))


#: Kilometres an hour of the spread model: ahead of the wind, against it, across it.
HEAD_KMH, BACK_KMH, FLANK_KMH = 5.0, 1.0, 2.5


def envelope(lat: Column, lon: Column, hours: Column, wind_from: Column, head: float = HEAD_KMH, back: float = BACK_KMH, flank: float = FLANK_KMH) -> Column:
    """Wind-oriented ellipse after some hours: axes, heading, and its centre ahead of the origin; null without a wind."""
    downwind = degrees_360(wind_from + 180.0)
    ahead, behind, across = hours * head, hours * back, hours * flank
    shift = (ahead - behind) / 2
    up, side = F.cos(F.radians(downwind)) * shift, F.sin(F.radians(downwind)) * shift
    return F.when(
        wind_from.isNotNull() & (hours >= 0),
        F.struct(
            lat.alias("origin_lat"),
            lon.alias("origin_lon"),
            downwind.alias("heading"),
            ((ahead + behind) / 2).alias("half_length"),
            across.alias("half_width"),
            (lat + F.degrees(up / EARTH_KM)).alias("centre_lat"),
            (lon + F.degrees(side / (F.cos(F.radians(lat)) * EARTH_KM))).alias("centre_lon"),
            shift.alias("shift"),
        ),
    )


def in_envelope(shape: Column, lat: Column, lon: Column, tolerance_km: float = 0.0) -> Column:
    """Whether a point lies in the ellipse grown by a tolerance; a shape without extent is a disc of the tolerance."""
    east, north = local_offset_km(shape["origin_lat"], shape["origin_lon"], lat, lon)
    turn = F.radians(shape["heading"])
    along = east * F.sin(turn) + north * F.cos(turn)
    across = east * F.cos(turn) - north * F.sin(turn)
    a, b = shape["half_length"] + tolerance_km, shape["half_width"] + tolerance_km
    disc = F.hypot(along, across) <= tolerance_km
    ahead = along - shape["shift"]
    return F.when((a <= 0) | (b <= 0), disc).otherwise((ahead / a) * (ahead / a) + (across / b) * (across / b) <= 1.0)


def capped(shape: Column, reach_km: float = 5.0) -> Column:
    """The ellipse scaled down evenly so that it reaches no further than ``reach_km`` from its origin (for drawing)."""
    reach = shape["half_length"] + F.abs(shape["shift"])
    scale = F.when(reach > reach_km, reach_km / reach).otherwise(1.0)
    return F.struct(scale.alias("scale"), (shape["half_length"] * scale).alias("half_length"), (shape["half_width"] * scale).alias("half_width"), (shape["shift"] * scale).alias("shift"))


def envelope_ring(shape: Column, points: int = 48) -> Column:
    """Closed ring of [lon, lat] of an ellipse; a position's longitude is taken at the mean of its latitude and the origin's."""
    turn = F.radians(shape["heading"])

    def at(i: Column) -> Column:
        t = i * (2 * 3.141592653589793 / points)
        along, across = F.cos(t) * shape["half_length"] + shape["shift"], F.sin(t) * shape["half_width"]
        north, east = along * F.cos(turn) - across * F.sin(turn), along * F.sin(turn) + across * F.cos(turn)
        lat = shape["origin_lat"] + F.degrees(north / EARTH_KM)
        return F.array(shape["origin_lon"] + F.degrees(east / (F.cos(F.radians((shape["origin_lat"] + lat) / 2)) * EARTH_KM)), lat)

    ring = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)
    return F.concat(ring, F.array(F.element_at(ring, 1)))
