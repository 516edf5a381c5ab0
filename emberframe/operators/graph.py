"""Relations between events: candidate pairs, edge features, states, and map queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions.evidence import circular_mean, hours_between, interval_gap_hours, interval_order
from emberframe.functions.geo import KM_PER_DEGREE, angle_between, bearing_deg, degrees_360, envelope, haversine_km, in_envelope
from emberframe.operators.blocks import counted_around
from emberframe.operators.components import materialise
from emberframe.operators.relations import counted_edges
from emberframe.operators.spatial import near

#: Reach of candidate pairs, buffer around an event, and speed classes in km/h.
PAIR_KM, PAIR_HOURS, BUFFER_KM = 50.0, 720.0, 2.0
SPEED_COMPATIBLE, SPEED_WEAK = 5.0, 20.0
#: The search for the nearest begins no closer than this part of its reach.
NEAREST_STEPS = 4096
#: Extents up to this many kilometres are one class; each further class is twice as wide.
NARROW_KM = 4.0
PEAT_CONTEXT = 0.5
WIND_TOLERANCE_DEG = 60.0
#: States of a relation that is not settled.
OPEN = ("UNRESOLVED", "RELATED_POSSIBLE")


def _side(events: DataFrame, tag: str, *more: str) -> DataFrame:
    return events.select(*(F.col(c).alias(f"{c}_{tag}") for c in ("event", "lat", "lon", "first", "last", "extent_km", *more)))


def _measured(met: DataFrame) -> DataFrame:
    d = haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    span = [F.col(c) for c in ("first_a", "last_a", "first_b", "last_b")]
    buffers = F.col("extent_km_a") / 2 + F.col("extent_km_b") / 2 + 2 * BUFFER_KM
    return met.withColumns({"distance_km": d, "gap_hours": interval_gap_hours(*span), "ordering": interval_order(*span)}).withColumn("buffers_overlap", F.col("distance_km") <= buffers)


_AT = ("lat_a", "lon_a"), ("lat_b", "lon_b")


def close_pairs(events: DataFrame, km: float, hours: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """Unordered pairs event_a < event_b whose centroids and times both lie within the bounds, with both sides' ``carry``."""
    met = near(_side(events, "a", *carry), _side(events, "b", *carry), km, *_AT, hours=hours, left_in=("first_a", "last_a"), right_in=("first_b", "last_b"))
    # a difference in latitude alone rules out a third of the candidates
    met = met.where((F.col("event_a") < F.col("event_b")) & (F.abs(F.col("lat_a") - F.col("lat_b")) * KM_PER_DEGREE <= km * 1.02))
    return _measured(met).where((F.col("distance_km") <= km) & (F.col("gap_hours") <= hours))


def overlapping_pairs(events: DataFrame, carry: tuple[str, ...] = (), beyond_km: float | None = None) -> DataFrame:
    """Unordered pairs whose buffers overlap, at any time, with both sides' ``carry``; with ``beyond_km`` only those further apart.

    How far a buffer reaches depends on the wider event of a pair, so events are
    taken by classes of extent, each joined over cells of its own reach with
    those no wider: one wide event doesn't widen everyone's cells.
    """
    width = F.greatest(F.ceil(F.log2(F.greatest(F.col("extent_km"), F.lit(NARROW_KM)) / NARROW_KM)), F.lit(0)).cast("int")
    sized = events.withColumn("width", width)
    out = None
    for k in sorted(r.width for r in sized.select("width").distinct().collect()):  # at most one class for each doubling
        if beyond_km is not None and NARROW_KM * 2.0**k + 2 * BUFFER_KM <= beyond_km:
            continue
        met = near(_side(sized.where(F.col("width") == k), "a", *carry), _side(sized.where(F.col("width") <= k), "b", "width", *carry), NARROW_KM * 2.0**k + 2 * BUFFER_KM, *_AT)
        met = met.where((F.col("width_b") < k) & (F.col("event_a") != F.col("event_b")) | (F.col("event_a") < F.col("event_b"))).drop("width_b")
        part = _measured(_in_order(met)).where("buffers_overlap")
        part = part if beyond_km is None else part.where(F.col("distance_km") > beyond_km)
        out = part if out is None else out.unionByName(part)
    return _measured(_side(events, "a", *carry).crossJoin(_side(events, "b", *carry)).where("false")) if out is None else out


def _in_order(met: DataFrame) -> DataFrame:
    """Pairs with the lesser event as a."""
    swap = F.col("event_a") > F.col("event_b")
    names = [c[:-2] for c in met.columns if c.endswith("_a")]
    return met.select(*(F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{x}") for x, y in ("ab", "ba") for c in names))


def touching_pairs(events: DataFrame, km: float = PAIR_KM, hours: float = PAIR_HOURS, carry: tuple[str, ...] = ()) -> DataFrame:
    """The pairs of ``event_pairs`` that have a ``marked`` event (a column of ``events``), in any order; only these are looked at."""
    carry = (*carry, "marked")
    met = near(_side(events.where("marked"), "a", *carry), _side(events, "b", *carry), km, *_AT, hours=hours, left_in=("first_a", "last_a"), right_in=("first_b", "last_b"))
    once = (F.col("event_a") < F.col("event_b")) | ((F.col("event_a") > F.col("event_b")) & ~F.col("marked_b"))
    met = met.where(once & (F.abs(F.col("lat_a") - F.col("lat_b")) * KM_PER_DEGREE <= km * 1.02))
    close = _measured(met).where((F.col("distance_km") <= km) & (F.col("gap_hours") <= hours))
    return close.where("not buffers_overlap").unionByName(overlapping_pairs(events, carry).where("marked_a or marked_b"))


def _unordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(event_a, event_b) of pairs of two different events, each once."""
    return pairs.select(F.least(a, b).alias("event_a"), F.greatest(a, b).alias("event_b")).where("event_a <> event_b").distinct()


def _given(pairs: DataFrame, events: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (event_a, event_b) measured like those that are found; one with an unknown end is dropped."""
    return _measured(pairs.join(_side(events, "a", *carry), "event_a").join(_side(events, "b", *carry), "event_b"))


def _found(km: float, hours: float) -> Column:
    """Whether ``event_pairs`` finds a measured pair by itself."""
    near_both = (F.col("distance_km") <= km) & (F.col("gap_hours") <= hours)
    return F.coalesce(F.col("buffers_overlap") | (near_both & ~F.col("buffers_overlap")), F.lit(False))


def event_pairs(events: DataFrame, km: float = PAIR_KM, hours: float = PAIR_HOURS, explicit: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Unordered pairs a < b that are close in space and time, have overlapping buffers, or are in ``explicit`` (a, b).

    event_a, event_b, distance_km, gap_hours, ordering, buffers_overlap and both
    sides' columns, ``carry`` too.  Explicit pairs come in any order; one with an
    unknown end is dropped.  Whether one is found anyway is told by its measures,
    so the pairs, whose number grows with the square of the events, are not shuffled.
    """
    found = close_pairs(events, km, hours, carry).where("not buffers_overlap").unionByName(overlapping_pairs(events, carry))
    if explicit is None:
        return found
    return found.unionByName(_given(_unordered(explicit, "a", "b"), events, carry).where(~_found(km, hours)))


def neighbours(events: DataFrame, km: float = 50.0, days: float = 30.0) -> DataFrame:
    """(event, neighbour, distance_km, gap_hours), in both directions."""
    p = close_pairs(events, km, days * 24).select("event_a", "event_b", "distance_km", "gap_hours")
    return p.toDF("event", "neighbour", "distance_km", "gap_hours").union(p.select("event_b", "event_a", "distance_km", "gap_hours"))


def nearby_and_recurrence(events: DataFrame) -> DataFrame:
    """(event, nearby_events, recurrences): others within 10 km and 72 h; others within 2 km that ended before this began."""
    counted = counted_around(events, 10.0, 72.0, 2.0)
    return events.select("event").join(counted, "event", "left").na.fill(0, ["nearby_events", "recurrences"])


def _by_itself(c: Column) -> Column:
    """``c``, by a function of arrays: its projection is compiled apart from the join.  With the join it made one method too long for the JVM to compile."""
    return F.element_at(F.transform(F.array(c), lambda x: x), 1)


def _speed_class(ordering: Column, speed: Column) -> Column:
    return F.when(ordering == "OVERLAPPING", "NOT_EVALUATED").when(speed <= SPEED_COMPATIBLE, "COMPATIBLE").when(speed <= SPEED_WEAK, "WEAK").otherwise("INCOMPATIBLE")


def wind_of_evidence(evidence: DataFrame) -> DataFrame:
    """(event, wind_from, wind_kmh): direction and mean speed of the current window's weather evidence; events without a direction have no row.

    ``evidence``: event, window, variable, mean, direction.
    """
    now = evidence.where("window = 'current'")
    pick = lambda name, c: F.max(F.when(F.col("variable") == name, F.col(c)))
    return now.groupBy("event").agg(pick("wind_direction_10m", "direction").alias("wind_from"), pick("wind_speed_10m", "mean").alias("wind_kmh")).where("wind_from is not null")


def wind_of_windows(metrics: DataFrame) -> DataFrame:
    """(event, wind_from, wind_kmh, wind_window): from the event's own window, else the first one that knows a direction.

    ``metrics``: event, window, start, wind_direction_deg and mean_wind_speed (m/s);
    the order of windows is that of their starts, earliest first.
    """
    order = F.struct((F.col("window") != "event_duration").alias("other"), "start", "window")
    chosen = F.min_by(F.struct("window", "wind_direction_deg", "mean_wind_speed"), order).alias("w")
    return metrics.where("wind_direction_deg is not null").groupBy("event").agg(chosen).select("event", degrees_360(F.col("w.wind_direction_deg")).alias("wind_from"), (F.col("w.mean_wind_speed") * 3.6).alias("wind_kmh"), F.col("w.window").alias("wind_window"))


def wind_of_samples(samples: DataFrame) -> DataFrame:
    """(event, wind_from): circular mean of an event's samples, weighted by speed (1 where it is unknown or 0).

    A sample's direction and speed may stand in any of the columns direction_from_deg,
    direction_deg, dominant_wind_direction_deg and speed_kmh, wind_speed_kmh,
    mean_wind_speed_ms; samples that aren't finite or have a negative speed are dropped.
    """
    first = lambda *names: F.coalesce(*(F.col(n).cast("double") for n in names if n in samples.columns), F.lit(None).cast("double"))
    ms = F.col("mean_wind_speed_ms").cast("double") * 3.6 if "mean_wind_speed_ms" in samples.columns else F.lit(None).cast("double")
    s = samples.select("event", first("direction_from_deg", "direction_deg", "dominant_wind_direction_deg").alias("d"), F.coalesce(first("speed_kmh", "wind_speed_kmh"), ms).alias("v"))
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    ok = s.where(F.col("d").isNotNull() & finite("d") & (F.col("v").isNull() | (finite("v") & (F.col("v") >= 0))))
    return ok.groupBy("event").agg(circular_mean(F.col("d"), F.when(F.col("v") > 0, F.col("v")).otherwise(1.0)).alias("wind_from")).where("wind_from is not null")


def chosen_wind(explicit: DataFrame, results: DataFrame, samples: DataFrame) -> DataFrame:
    """(event, wind_from, wind_kmh, wind_source): a wind that was given, else one that an earlier result holds, else the mean of samples.

    Each table: event, wind_from and optionally wind_kmh; rows without a direction don't count.
    """
    out = None
    for nth, (name, rows) in enumerate((("explicit", explicit), ("result", results), ("samples", samples))):
        speed = F.col("wind_kmh") if "wind_kmh" in rows.columns else F.lit(None)
        one = rows.where(F.col("wind_from").isNotNull() & ~F.isnan("wind_from")).select("event", F.struct(F.lit(nth).alias("nth"), degrees_360(F.col("wind_from")).alias("wind_from"), speed.cast("double").alias("wind_kmh"), F.lit(name).alias("wind_source")).alias("w"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("event").agg(F.min("w").alias("w")).select("event", "w.wind_from", "w.wind_kmh", "w.wind_source")


def _listed(df: DataFrame, c: str) -> Column:
    return (F.col(c) if c in df.columns else F.lit(None)).cast("array<string>").alias(c)


#: What a source's and a target's sides carry.
_CARRY = ("wind_from", "wind_kmh", "wind_ids", "episode")


def _known(events: DataFrame, wind: DataFrame, peat: DataFrame, episodes: DataFrame, recurrence: DataFrame | None) -> tuple[DataFrame, ...]:
    """(events with what is known of each and the ``others`` that are named with it, named pairs, peat, recurrence by pair) of what ``edges`` is given."""
    blown = wind.select("event", "wind_from", (F.col("wind_kmh") if "wind_kmh" in wind.columns else F.lit(None).cast("double")).alias("wind_kmh"), _listed(wind, "wind_ids"))
    peat = materialise(peat.select("source", "target", "peat_fraction", _listed(peat, "peat_ids")))
    named, known = _unordered(peat, "source", "target"), None
    if recurrence is not None:
        known = recurrence.select(F.least("a", "b").alias("event_a"), F.greatest("a", "b").alias("event_b"), "recurrence").groupBy("event_a", "event_b")
        known = materialise(known.agg(F.bool_or("recurrence").alias("recurrence")).withColumn("explicit", F.lit(True)))
        named = named.union(_unordered(known, "event_a", "event_b")).distinct()
    named = materialise(named)
    both = named.union(named.select("event_b", "event_a")).toDF("event", "other")
    others = both.groupBy("event").agg(F.collect_list("other").alias("others"))
    own = events.select("event", "lat", "lon", "first", "last", "extent_km").join(blown, "event", "left").join(episodes.select("event", "episode"), "event", "left")
    return materialise(own.join(others, "event", "left")), named, peat, known


def _ends(pairs: DataFrame, *more: str) -> DataFrame:
    """Measured pairs from the earlier event to the later, with what is known of both."""
    flip = (F.col("ordering") == "B_BEFORE_A") | ((F.col("ordering") == "OVERLAPPING") & (F.col("event_a") > F.col("event_b")))
    pick = lambda c, s, t: F.when(flip, F.col(f"{c}_{t}")).otherwise(F.col(f"{c}_{s}"))
    return pairs.select(
        *(pick(c, "a", "b").alias(n) for c, n in (("event", "source"), ("lat", "lat1"), ("lon", "lon1"), ("first", "first1"), *((c, c) for c in _CARRY[:3]), ("episode", "episode_source"))),
        *(pick(c, "b", "a").alias(n) for c, n in (("event", "target"), ("lat", "lat2"), ("lon", "lon2"), ("first", "first2"), ("episode", "episode_target"))),
        "event_a", "event_b", F.when(F.col("ordering") == "OVERLAPPING", "OVERLAPPING").otherwise("A_BEFORE_B").alias("ordering"), "distance_km", "gap_hours", "buffers_overlap", *more,
    )


def _told(own: DataFrame, named: DataFrame, peat: DataFrame, known: DataFrame | None) -> DataFrame:
    """The pairs that a source names, as far as they are edges."""
    told = _given(named, own, _CARRY)
    told = told.withColumns({"recurrence": F.lit(None).cast("boolean"), "explicit": F.lit(None).cast("boolean")}) if known is None else told.join(known, ["event_a", "event_b"], "left")
    told = told.where(_found(PAIR_KM, PAIR_HOURS) | F.coalesce("explicit", F.lit(False)))
    return _ends(told, "recurrence").join(peat, ["source", "target"], "left")


def _unnamed(pairs: DataFrame, peat: DataFrame) -> DataFrame:
    """The pairs of a search that no source names."""
    searched = pairs.where(~F.coalesce(F.array_contains("others_a", F.col("event_b")), F.lit(False)))
    return _ends(searched).withColumns({"recurrence": F.lit(None).cast("boolean"), "peat_fraction": F.lit(None).cast(peat.schema["peat_fraction"].dataType), "peat_ids": F.lit(None).cast("array<string>")})


def edges(events: DataFrame, wind: DataFrame, peat: DataFrame, episodes: DataFrame, recurrence: DataFrame | None = None) -> DataFrame:
    """One row per candidate pair, from the earlier event to the later, with its features, state and evidence ids.

    ``wind`` (event, wind_from and optionally wind_kmh, wind_ids), ``peat`` (source, target,
    peat_fraction and optionally peat_ids), ``episodes`` (event, episode) and ``recurrence`` (a, b,
    recurrence; in any order, candidates whatever their distance) may lack rows: a
    missing source leaves the feature null, which never counts as a no.  Events
    whose times overlap have no direction, so no wind features.  ``wind_ids`` and
    ``peat_ids``, ids of the evidence behind them, follow the supporting statements.

    ``wind`` and ``episodes`` have one row an event and join the events, not the
    pairs.  Pairs that ``peat`` or ``recurrence`` name are taken from there: events
    know which of theirs are, so that the search leaves these out.  The pairs of
    the search are thus neither shuffled nor written before the caller sums them up.
    """
    own, named, peat, known = _known(events, wind, peat, episodes, recurrence)
    return _featured(_unnamed(event_pairs(own, carry=(*_CARRY, "others")), peat).unionByName(_told(own, named, peat, known)))


def edges_touching(events: DataFrame, wind: DataFrame, peat: DataFrame, episodes: DataFrame, recurrence: DataFrame | None, marked: DataFrame) -> DataFrame:
    """Those of ``edges`` that have one of the events of ``marked`` (event) as an end, and some that a source names."""
    own, named, peat, known = _known(events, wind, peat, episodes, recurrence)
    picked = marked.select("event").distinct().withColumn("marked", F.lit(True))
    own = materialise(own.join(picked, "event", "left").withColumn("marked", F.coalesce("marked", F.lit(False))))
    return _featured(_unnamed(touching_pairs(own, carry=(*_CARRY, "others")), peat).unionByName(_told(own, named, peat, known)))


def map_of_selections(events: DataFrame, wind: DataFrame, peat: DataFrame, episodes: DataFrame, recurrence: DataFrame | None, selections: list[DataFrame], km: float = 50.0) -> list[DataFrame]:
    """``map_edges`` of each of ``selections`` (event), from those edges alone that it can hold: between selected events, and to context events."""
    own, named, peat, known = _known(events, wind, peat, episodes, recurrence)
    told, out = _told(own, named, peat, known), []
    for selected in selections:
        around = materialise(context_of_selection(events, selected, km))
        between = event_pairs(own.join(selected.select("event"), "event", "left_semi"), carry=(*_CARRY, "others"))
        beside = _given(_unordered(around, "event", "nearest_selected"), own, (*_CARRY, "others")).where(_found(PAIR_KM, PAIR_HOURS))
        out.append(map_edges(_featured(_unnamed(between.unionByName(beside), peat).unionByName(told)), events, selected, km, around))
    return out


def edge_counts(events: DataFrame, wind: DataFrame, peat: DataFrame, episodes: DataFrame, recurrence: DataFrame | None = None, progress: bool = False) -> DataFrame:
    """(event, edges, open, evaluated, outside): what ``edges`` of the same tables add up to by event, without writing them.

    ``edges`` counts those that touch an event and ``open`` those of them that are not
    settled; ``evaluated`` and ``outside``, with ``progress``, an event's targets that
    its envelope was held against and those outside of it.  Events without edges have no row.

    Pairs of the search are counted inside tasks.  Those that a source names and those
    further apart than the search looks, whose buffers overlap, are taken as rows.
    """
    own, named, peat, known = _known(events, wind, peat, episodes, recurrence)
    rows = _told(own, named, peat, known)
    if not own.where((F.col("extent_km") + 2 * BUFFER_KM > PAIR_KM)).isEmpty():
        rows = _unnamed(overlapping_pairs(own, (*_CARRY, "others"), PAIR_KM), peat).unionByName(rows)
    e = _featured(rows).select("source", "target", F.col("state").isin(*OPEN).cast("long").alias("open"), F.col("inside").isNotNull().cast("long").alias("evaluated"), F.coalesce(~F.col("inside"), F.lit(False)).cast("long").alias("outside"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    side = lambda c, *more: F.struct(F.col(c).alias("event"), one.alias("edges"), F.col("open"), *more)
    by_end = e.select(F.explode(F.array(side("source", F.col("evaluated"), F.col("outside")), side("target", zero.alias("evaluated"), zero.alias("outside")))).alias("x")).select("x.*")
    counted = counted_edges(own, PAIR_KM, PAIR_HOURS, BUFFER_KM, WIND_TOLERANCE_DEG, (SPEED_COMPATIBLE, SPEED_WEAK), progress)
    return counted.unionByName(by_end).groupBy("event").agg(*(F.sum(c).alias(c) for c in ("edges", "open", "evaluated", "outside")))


def _featured(p: DataFrame) -> DataFrame:
    """Pairs with their features, state and evidence ids."""
    apart = F.col("ordering") != "OVERLAPPING"
    angle = angle_between(F.col("bearing"), degrees_360(F.col("wind_from") + 180.0))
    shape = envelope(F.col("lat1"), F.col("lon1"), hours_between(F.col("first1"), F.col("first2")), F.col("wind_from"))
    p = p.withColumns({
        "bearing": bearing_deg(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")),
        "shared_episode": F.col("episode_source") == F.col("episode_target"),
        "speed_kmh": _by_itself(F.when(F.col("gap_hours") > 0, F.col("distance_km") / F.col("gap_hours"))),
        "envelope": F.when(apart, shape),
    }).withColumns({"angle": _by_itself(F.when(apart, angle)), "inside": in_envelope(F.col("envelope"), F.col("lat2"), F.col("lon2"))})
    p = p.withColumn("inside", F.when(F.col("envelope").isNotNull(), F.col("inside")))
    spread = F.when(F.col("inside").isNull(), _speed_class(F.col("ordering"), F.col("speed_kmh"))).when(F.col("inside"), "COMPATIBLE").otherwise("INCOMPATIBLE")
    p = p.withColumns({
        "compatibility": spread,
        "alignment": F.round(F.cos(F.radians("angle")), 6),
        "downwind": F.when(F.col("wind_kmh").isNull() | (F.col("wind_kmh") > 0), F.col("angle") <= WIND_TOLERANCE_DEG),
    })
    yes = lambda c: F.coalesce(c, F.lit(False))
    context = F.col("buffers_overlap") | yes(F.col("peat_fraction") >= PEAT_CONTEXT) | yes(F.col("shared_episode")) | yes(F.col("recurrence"))
    conflict, upwind = yes(~F.col("downwind")), yes(F.col("alignment") <= -0.5)
    state = (
        F.when(~apart & ~F.col("buffers_overlap") & ~yes(F.col("shared_episode")), "INDEPENDENT_PLAUSIBLE")
        .when(~apart, "UNRESOLVED")
        .when((F.col("compatibility") == "COMPATIBLE") & ~conflict & ~upwind, "PROPAGATION_COMPATIBLE")
        .when((F.col("compatibility") == "WEAK") & context & ~conflict, "PROPAGATION_WEAK")
        .when((F.col("compatibility") == "INCOMPATIBLE") & (conflict | upwind), "UNRESOLVED")
        .when((F.col("compatibility") == "INCOMPATIBLE") & context, "RELATED_POSSIBLE")
        .when(F.col("compatibility") == "INCOMPATIBLE", "INDEPENDENT_PLAUSIBLE")
        .when(context, "RELATED_POSSIBLE")
        .otherwise("UNRESOLVED")
    )
    # Names of the statements for or against a relation; the last column says which (null: neither).
    told = {
        "GEOGRAPHIC_DISTANCE": F.lit(True),
        "ELAPSED_TIME": F.lit(True),
        "PROPAGATION_COMPATIBILITY": F.when(F.col("compatibility").isin("COMPATIBLE", "WEAK"), True).when(F.col("compatibility") == "INCOMPATIBLE", False),
        "EVENT_BUFFER_OVERLAP": F.col("buffers_overlap"),
        "WIND_ALIGNMENT": F.col("alignment") >= 0,
        "DIRECTIONAL_COMPATIBILITY": F.col("downwind"),
        "PEAT_CORRIDOR_FRACTION": F.col("peat_fraction") >= PEAT_CONTEXT,
        "SHARED_ENVIRONMENTAL_EPISODE": F.col("shared_episode"),
        "HISTORICAL_RECURRENCE": F.col("recurrence"),
    }
    name = lambda k: F.concat_ws("_", F.lit("DERIVED_GRAPH"), F.col("source").cast("string"), F.col("target").cast("string"), F.lit(k))
    ids = lambda wanted: F.array_compact(F.array(*(F.when(c if wanted else ~c, name(k)) for k, c in told.items())))
    sources = (F.coalesce(c, F.array().cast("array<string>")) for c in ("wind_ids", "peat_ids"))
    return p.withColumns({"state": state, "supporting": F.array_distinct(F.concat(ids(True), *sources)), "contradicting": ids(False)}).select(
        "source", "target", "distance_km", "gap_hours", "ordering", "bearing", "alignment", "downwind", "buffers_overlap", "peat_fraction", "shared_episode", "recurrence", "speed_kmh",
        *(F.col(f"envelope.{c}").alias(c) for c in ("heading", "half_length", "half_width", "shift")), "inside", "compatibility", "state", "supporting", "contradicting",
    )


def explanations(e: DataFrame) -> DataFrame:
    """Evidence rows of edges: id, source event, state and a sentence about it."""
    said = (
        F.when(F.col("state") == "PROPAGATION_COMPATIBLE", "order and speed fit spread over the surface")
        .when(F.col("state") == "PROPAGATION_WEAK", "spread is possible, the evidence for it weak")
        .when(F.col("state") == "RELATED_POSSIBLE", "the events share surroundings, not a path")
        .when(F.col("state") == "INDEPENDENT_PLAUSIBLE", "nothing ties the events together")
        .otherwise("what is known does not settle it")
    )
    return e.select(F.concat_ws("_", F.lit("DERIVED_GRAPH"), F.col("source").cast("string"), F.col("target").cast("string")).alias("evidence_id"), F.col("source").alias("event"), F.lit("graph").alias("category"), F.col("state").alias("type"), said.alias("observation"), F.round("distance_km", 3).alias("value"))


def incident(e: DataFrame, events: DataFrame) -> DataFrame:
    """(event, source, target, outgoing): the edges that touch each of ``events`` (event)."""
    ends = e.select("source", "target", F.explode(F.array(F.struct(F.col("source").alias("event"), F.lit(True).alias("outgoing")), F.struct(F.col("target").alias("event"), F.lit(False).alias("outgoing")))).alias("x"))
    return ends.select("x.event", "source", "target", "x.outgoing").join(events.select("event").distinct(), "event", "left_semi")


def grouped_by_source(e: DataFrame) -> DataFrame:
    """(source, n, targets): the edges folded onto their source events, by target."""
    return e.groupBy("source").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("target", "state"))), lambda x: x["target"]).alias("targets"))


def unresolved_signal(e: DataFrame, events: DataFrame) -> DataFrame:
    """(event, edges, signal): share of unsettled relations among an event's edges, 0 without edges."""
    ends = e.select(F.explode(F.array("source", "target")).alias("event"), "state").groupBy("event").agg(F.count("*").alias("edges"), F.count_if(F.col("state").isin(*OPEN)).alias("open"))
    return signal_of_counts(ends, events)


def signal_of_counts(counts: DataFrame, events: DataFrame) -> DataFrame:
    """``unresolved_signal`` from what ``edge_counts`` gives."""
    ends = counts.select("event", "edges", "open")
    return events.select("event").join(ends, "event", "left").select("event", F.coalesce("edges", F.lit(0)).alias("edges"), (F.coalesce("open", F.lit(0)) / F.greatest(F.coalesce("edges", F.lit(0)), F.lit(1))).alias("signal"))


def progression(e: DataFrame) -> DataFrame:
    """(source, evaluated, outside, outside_targets, result): whether an event's later neighbours lie within its envelope."""
    a = e.groupBy("source").agg(
        F.count("inside").alias("evaluated"), F.count_if(~F.col("inside")).alias("outside"), F.sort_array(F.collect_list(F.when(~F.col("inside"), F.col("target")))).alias("outside_targets")
    )
    return a.withColumn("result", _progress())


def _progress() -> Column:
    return F.when(F.col("evaluated") == 0, "NOT_EVALUATED").when(F.col("outside") == 0, "COMPATIBLE").when(F.col("outside") < F.col("evaluated"), "PARTIAL").otherwise("INCOMPATIBLE")


def progression_of_counts(counts: DataFrame) -> DataFrame:
    """(source, evaluated, outside, result) of the events that an envelope was held against, from what ``edge_counts`` gives with ``progress``."""
    return counts.where("evaluated > 0").select(F.col("event").alias("source"), "evaluated", "outside", _progress().alias("result"))


def context_of_selection(events: DataFrame, selected: DataFrame, km: float = 50.0) -> DataFrame:
    """(event, nearest_selected, distance_km): unselected events near the selection, each with its nearest selected one.

    Events ask within the mean spacing of the selection first: an answer found there
    is final.  Those without one ask again four times as far, up to ``km``, so the
    pairs that are looked at follow the number of events, not its square.
    """
    chosen = events.join(selected.select("event"), "event", "left_semi").select(F.col("event").alias("s"), F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    chosen, left = materialise(chosen), materialise(events.join(selected.select("event"), "event", "left_anti").select("event", "lat", "lon"))
    n, high, wide = chosen.agg(F.count("*"), F.max("slat") - F.min("slat"), F.max("slon") - F.min("slon")).first()
    area = (high or 0.0) * (wide or 0.0) * KM_PER_DEGREE * KM_PER_DEGREE
    reach, found = min(km, max((area / n) ** 0.5, km / NEAREST_STEPS)) if n else km, None
    while True:
        met = near(left, chosen, reach, ("lat", "lon"), ("slat", "slon")).withColumn("distance_km", haversine_km(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon"))).where(F.col("distance_km") <= reach)
        got = met.groupBy("event").agg(F.min(F.struct("distance_km", "s")).alias("m")).select("event", F.col("m.s").alias("nearest_selected"), "m.distance_km")
        last = reach >= km
        got = got if last and found is None else materialise(got)
        found = got if found is None else found.unionByName(got)
        if last:
            return found
        left = materialise(left.join(got.select("event"), "event", "left_anti"))
        if left.isEmpty():
            return found
        reach = min(km, reach * 4)


def map_edges(e: DataFrame, events: DataFrame, selected: DataFrame, km: float = 50.0, around: DataFrame | None = None) -> DataFrame:
    """(a, b, distance_km, state, computed): computed edges of the selection, and distance edges to context events (``around``, if it is known) that have none."""
    around = (context_of_selection(events, selected, km) if around is None else around).select(F.least("event", "nearest_selected").alias("a"), F.greatest("event", "nearest_selected").alias("b"), "distance_km")
    real = e.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), F.col("distance_km").alias("real_km"), "state")
    picked = selected.select("event")
    both = real.join(picked, F.col("a") == F.col("event"), "left_semi").join(picked, F.col("b") == F.col("event"), "left_semi")
    ctx = around.join(real, ["a", "b"], "left").select("a", "b", F.coalesce("real_km", "distance_km").alias("distance_km"), F.coalesce("state", F.lit("DISTANCE_ONLY")).alias("state"), F.col("state").isNotNull().alias("computed"))
    return both.select("a", "b", F.col("real_km").alias("distance_km"), "state", F.lit(True).alias("computed")).union(ctx)


def tagged_edges(focus: DataFrame, selection: DataFrame, selected: DataFrame, km: float = 50.0) -> DataFrame:
    """(a, b, distance_km, state, computed, origin): edges of the event in focus and of the selection, as ``map_edges`` gives them.

    The focus wins where both have a pair; edges over ``km`` go, and so do those
    between two selected events that rest on distance alone.
    """
    pairs = focus.withColumn("origin", F.lit("focus")).unionByName(selection.join(focus.select("a", "b"), ["a", "b"], "left_anti").withColumn("origin", F.lit("selection")))
    chosen = lambda c: selected.select(F.col("event").alias(c), F.lit(True).alias(f"chosen_{c}"))
    j = pairs.join(chosen("a"), "a", "left").join(chosen("b"), "b", "left")
    both = F.coalesce(F.col("chosen_a") & F.col("chosen_b"), F.lit(False))
    return j.where((F.col("distance_km") <= km) & (~both | F.col("computed"))).select("a", "b", "distance_km", "state", "computed", "origin")


def visible_envelopes(e: DataFrame, selected: DataFrame, focus: int | None = None) -> DataFrame:
    """(source, target): compatible edges with an envelope whose source is selected or that touch the event in focus."""
    shown = e.where((F.col("state") == "PROPAGATION_COMPATIBLE") & F.col("half_length").isNotNull())
    marked = shown.join(selected.select(F.col("event").alias("source"), F.lit(True).alias("chosen")).distinct(), "source", "left")
    touches = F.lit(False) if focus is None else (F.col("source") == focus) | (F.col("target") == focus)
    return marked.where(F.coalesce("chosen", F.lit(False)) | touches).select("source", "target")
