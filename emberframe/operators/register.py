"""The audit register: scopes, filters, order and paging, evidence packs, report figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.functions.geo import boxes_overlap, buffered, haversine_km, in_bbox, in_polygon, in_ring, ring_area
from emberframe.operators.order import running
from emberframe.operators.spatial import near

MAX_PAGE, DEFAULT_PAGE = 2000, 500
RELATIONS = ("INSIDE_SCOPE", "BOUNDARY_INTERSECTING", "EXTERNAL_CONTEXT")


def scope_problems(scopes: DataFrame) -> DataFrame:
    """(audit, ring, problem) for every ring that can't be used: too short, open, out of range, without area."""
    r = F.posexplode("rings").alias("ring", "positions")
    long = scopes.select("audit", r)
    p = F.col("positions")
    lon, lat = lambda x: F.element_at(x, 1), lambda x: F.element_at(x, 2)
    odd = F.exists(p, lambda x: F.isnan(lon(x)) | F.isnan(lat(x)) | ~lon(x).between(-180, 180) | ~lat(x).between(-90, 90))
    problem = (
        F.when(F.size(p) < 4, "fewer than four positions")
        .when(F.element_at(p, 1) != F.element_at(p, -1), "not closed")
        .when(odd, "position out of range")
        .when(F.abs(ring_area(p)) < 1e-12, "no area")
    )
    return long.select("audit", "ring", problem.alias("problem")).where(F.col("problem").isNotNull())


def scope_bounds(scopes: DataFrame) -> DataFrame:
    """(audit, west, south, east, north, area) of the outer rings."""
    outer = F.element_at("rings", 1)
    xs, ys = F.transform(outer, lambda x: F.element_at(x, 1)), F.transform(outer, lambda x: F.element_at(x, 2))
    return scopes.select("audit", F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"), F.abs(ring_area(outer)).alias("area"))


def in_scopes(events: DataFrame, scopes: DataFrame) -> DataFrame:
    """(audit, event, relation, in_scope_or_buffer) of every event near a scope.

    The outer ring decides (holes don't count); the box tells intersection; the
    buffer is a box grown by the scope's kilometres.  Events outside the buffer
    of a scope and apart from its box have no row: they are external context.
    Scopes are joined to events over cells of half a degree.
    """
    box = F.col("box")
    sc = scopes.withColumn("buffer", buffered(box, F.col("buffer_km"), (box["south"] + box["north"]) / 2))
    cell = lambda c: F.floor(c / 0.5).cast("int")
    span = lambda a, b: F.explode(F.sequence(cell(a), cell(b)))
    sc = sc.withColumn("cx", span(F.col("buffer.west"), F.col("buffer.east"))).withColumn("cy", span(F.col("buffer.south"), F.col("buffer.north")))
    ev = events.withColumn("ebox", F.struct("west", "south", "east", "north"))
    ev = ev.withColumn("cx", span(F.col("west"), F.col("east"))).withColumn("cy", span(F.col("south"), F.col("north")))
    met = ev.join(sc.select("audit", "rings", "box", "buffer", "cx", "cy"), ["cx", "cy"]).dropDuplicates(["audit", "event"])
    inside = in_ring(F.col("lat"), F.col("lon"), F.element_at("rings", 1))
    touches = boxes_overlap(F.col("ebox"), F.col("box"))
    b = F.col("buffer")
    relation = F.when(inside, RELATIONS[0]).when(touches, RELATIONS[1]).otherwise(RELATIONS[2])
    near_it = inside | touches | in_bbox(F.col("lat"), F.col("lon"), b["west"], b["south"], b["east"], b["north"])
    return met.select("audit", "event", relation.alias("relation"), near_it.alias("in_scope_or_buffer")).where("in_scope_or_buffer")


def review_bounds(start: Column, end: Column) -> tuple[Column, Column]:
    """A review period as timestamps: bare dates mean the whole day; what can't be read doesn't bound."""
    last = F.try_to_timestamp(end.cast("string"))
    last = F.when(F.length(end.cast("string")) <= 10, last + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")).otherwise(last)
    return F.try_to_timestamp(start.cast("string")), last


def filtered(events: DataFrame, bbox: tuple[float, float, float, float] | None = None, since=None, until=None, state: str | None = None, min_frp: float | None = None, first_day=None) -> DataFrame:
    """Register filter: centroid in a box, times that overlap [since, until], state, power (null fails), exact first day; all optional."""
    out = events
    if bbox:
        out = out.where(in_bbox(F.col("lat"), F.col("lon"), *map(F.lit, bbox)))
    if since is not None:
        out = out.where(F.col("last") >= F.lit(since).cast("timestamp"))
    if until is not None:
        out = out.where(F.col("first") <= F.lit(until).cast("timestamp"))
    if state is not None:
        out = out.where(F.col("state") == state)
    if min_frp is not None:
        out = out.where(F.col("max_frp") >= min_frp)
    if first_day is not None:
        out = out.where(F.to_date("first") == F.lit(first_day).cast("date"))
    return out


SORT_KEYS = {"first": "first", "last": "last", "observations": "n", "max_frp": "max_frp", "extent": "extent_km", "hours": "hours", "state": "state", "event": "event"}


#: Rows up to the end of a page that one sort may hold; pages beyond are found by number.
SHALLOW = 10_000


def page(events: DataFrame, key: str = "first", descending: bool = False, limit: int = DEFAULT_PAGE, offset: int = 0, shallow: int = SHALLOW) -> DataFrame:
    """One page in a fixed order, with the number of all rows as ``total``: nulls lowest, text without regard to case, ties by event.

    A page far down is cut out of the numbered order of the whole table, so that no
    task holds the rows before it.
    """
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"a page holds 1 to {MAX_PAGE} rows and starts at 0 or later")
    name = SORT_KEYS[key]
    col = F.lower(name) if dict(events.dtypes).get(name) == "string" else F.col(name)
    order = [col.desc_nulls_last() if descending else col.asc_nulls_first(), F.col("event").asc()]
    counted = events.crossJoin(F.broadcast(events.agg(F.count("*").alias("total"))))
    if offset + limit <= shallow:
        return counted.orderBy(*order).offset(offset).limit(limit)
    return running(counted, order, name="_place").where(F.col("_place").between(offset + 1, offset + limit)).orderBy("_place").drop("_place")


def register_rows(events: DataFrame, decided: DataFrame) -> DataFrame:
    """What a list of events shows, without rules and evidence; an unknown sensor mix is null, not empty."""
    d = decided.select("event", "state", "fire_score", "non_fire_score", (F.col("state") != "LIKELY_NON_FIRE").alias("needs_review"), "decisive_rules")
    e = events.select(
        "event", "first", "last", F.bround("hours", 2).alias("duration_hours"), "n", "lat", "lon", "west", "south", "east", "north", F.bround("extent_km", 3).alias("extent_km"), "max_frp", F.bround("mean_frp", 2).alias("mean_frp"),
        F.when(F.size("sensor_mix") > 0, F.col("sensor_mix")).alias("sensor_mix"),
    )
    return e.join(d, "event")


def found(events: DataFrame, detail: DataFrame, ids: DataFrame) -> DataFrame:
    """(event columns, rules, evaluated): the asked events that exist, each with its detail rows folded in rule order."""
    per = detail.join(ids.select("event").distinct(), "event", "left_semi").groupBy("event").agg(F.array_sort(F.collect_list(F.struct("nth", "rule_id", "effect", "points"))).alias("rules"), F.count("value").alias("evaluated"))
    return events.join(ids.select("event").distinct(), "event", "left_semi").join(per, "event", "left")


def without_detail(events: DataFrame, detail: DataFrame) -> DataFrame:
    """Served events whose detail is missing; a register is ready if there are none."""
    return events.select("event").join(detail.select("event").distinct(), "event", "left_anti")


def overlay(events: DataFrame, members: DataFrame, start, end, day=None) -> DataFrame:
    """(event, lat, lon, frp, confidence, acq_date, acq_time): observations of the register's events within the review dates, or of one of its days."""
    o = members.where(F.col("acq_date").between(F.lit(start), F.lit(end)))
    o = o if day is None else o.where(F.col("acq_date") == F.lit(day))
    return o.join(events.select("event"), "event", "left_semi").select("event", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "frp", "confidence", "acq_date", "acq_time")


def event_bounds(events: DataFrame) -> DataFrame:
    """One row: the box and the times of a set of events."""
    return events.agg(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"), F.min("first").alias("first"), F.max("last").alias("last"))


def largest(events: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` events with most observations, by (number, first detection, id)."""
    return events.orderBy(F.desc("n"), "first", "event").limit(n)


def review_queue(routed: DataFrame) -> DataFrame:
    """One row: events, those for human review, those that the first stage left open, and the register's compression by that stage."""
    queue = F.count_if(F.col("state") != "LIKELY_NON_FIRE")
    return routed.agg(F.count("*").alias("events"), F.count_if(F.col("route") == "HUMAN_REVIEW").alias("review_queue"), queue.alias("stage1_queue"), F.bround(F.count("*") / F.when(queue > 0, queue), 4).alias("compression"))


#: Fields of weather (seven windows of seven measures) and of peat that an event can have.
WEATHER_FIELDS, PEAT_FIELDS = 49, 4


def completeness(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """(event, weather_fields, peat_fields, completeness): how many of the possible fields of evidence (event, category) are there."""
    per = evidence.groupBy("event").agg(F.count_if(F.col("category") == "weather").alias("weather_fields"), F.count_if(F.col("category") == "peat").alias("peat_fields"))
    j = events.select("event").join(per, "event", "left").na.fill(0, ["weather_fields", "peat_fields"])
    return j.withColumn("completeness", F.bround((F.col("weather_fields") + F.col("peat_fields")) / (WEATHER_FIELDS + PEAT_FIELDS), 4))


#: Categories of optional evidence.
ENRICHMENT = ("peat", "weather", "imagery")


def sufficiency(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """(event, present, missing, reason): which kinds of optional evidence an event has, and a sentence about it."""
    have = evidence.where(F.col("category").isin(*ENRICHMENT)).groupBy("event").agg(F.collect_set("category").alias("c"))
    j = events.select("event").join(have, "event", "left").withColumn("c", F.coalesce("c", F.array().cast("array<string>")))
    kinds = F.array(*map(F.lit, ENRICHMENT))
    there, gone = F.filter(kinds, lambda k: F.array_contains("c", k)), F.filter(kinds, lambda k: ~F.array_contains("c", k))
    reason = F.when(F.size(there) == 0, "detections and screening only").otherwise(F.concat(F.lit("detections, screening, "), F.array_join(there, ", ")))
    return j.select("event", F.array_join(there, ",").alias("present"), F.array_join(gone, ",").alias("missing"), F.when(F.size(gone) == 0, reason).otherwise(F.concat(reason, F.lit("; missing: "), F.array_join(gone, ", "))).alias("reason"))


#: Sources, limits and versions that evidence rows of each kind state.
DETECTIONS, SCOPE, COMPLEXITY_JOB, ROUTING, PRIORITY_JOB = "satellite detections", "audit scope and event centroid", "complexity job", "review routing", "priority job"
NOT_RUN = "no enrichment run has evaluated this yet"
LIMITS = {
    "chronology": "times of detection say nothing about ignition",
    "observation_count": "detections of one event are not fires of their own",
    "frp_summary": "radiative power is neither burned area nor intensity on the ground",
    "scope": "lying in a scope is context, not responsibility",
    "complexity": f"{NOT_RUN}; missing evidence is not low complexity",
    "priority": "priority orders reviews and says nothing about fault",
}
VERSIONS = {"scope": "scope-relation-1", "complexity": "complexity-1", "priority": "priority-1"}
VIEW = ("evidence_id", "category", "type", "observation", "source", "time_window", "value", "quality", "limitations", "algorithm_version", "raw_reference")


def evidence_view(events: DataFrame, derived: DataFrame, relations: DataFrame, complexity_names: tuple[str, ...], factor_names: tuple[str, ...], routing: DataFrame) -> DataFrame:
    """All evidence of events, one row each, with the columns of ``VIEW``; ``limitations`` is an array.

    Observed rows (times, number, power), the stored derived ones with what they
    state (event, evidence_id, category, type, value, quality, and any further
    column of the view), the relation to the scope, and a row for every complexity
    field and priority factor.  Of the factors the routed ones (``routing``: event,
    factor, signal, reason) have a value and their reason; fields and factors that
    nothing evaluated are there without a value and with quality 0, so that what
    was not evaluated can be told from a no.
    """
    name = lambda *parts: F.concat_ws("_", *(F.lit(x) if isinstance(x, str) else x for x in parts))
    event = F.col("event").cast("string")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    power = lambda c: F.format_string("%.2f", F.bround(F.coalesce(c, F.lit(0.0)), 2))
    window = events.select("event", F.concat_ws(" to ", stamp("first"), stamp("last")).alias("time_window"))

    def row(i, category, kind, observation, source, value, quality, limits, version=None):
        text = lambda x: F.lit(x) if isinstance(x, str) or x is None else x
        limits = F.array(*(F.lit(x) for x in limits)) if limits else F.array().cast("array<string>")
        return F.struct(
            i.alias("evidence_id"), F.lit(category).alias("category"), text(kind).alias("type"), text(observation).alias("observation"), F.lit(source).alias("source"), F.col("time_window"),
            text(value).cast("string").alias("value"), text(quality).cast("double").alias("quality"), limits.alias("limitations"), F.lit(version).cast("string").alias("algorithm_version"), event.alias("raw_reference"),
        )

    timed = events.join(window, "event")
    observed = timed.select("event", F.explode(F.array(
        row(name("OBSERVED", event, "chronology"), "thermal", "chronology", F.concat(F.lit("detected from "), stamp("first"), F.lit(" to "), stamp("last")), DETECTIONS, F.col("time_window"), F.lit(0.82), [LIMITS["chronology"]]),
        row(name("OBSERVED", event, "observations"), "thermal", "observation_count", F.concat(F.col("n").cast("string"), F.lit(" linked detections")), DETECTIONS, F.col("n"), F.lit(0.82), [LIMITS["observation_count"]]),
        row(name("OBSERVED", event, "frp"), "thermal", "frp_summary", F.concat(F.lit("mean "), power(F.col("mean_frp")), F.lit(" MW, at most "), power(F.col("max_frp")), F.lit(" MW")), DETECTIONS, power(F.col("max_frp")), F.lit(0.82), [LIMITS["frp_summary"]]),
    )).alias("r")).select("event", "r.*")
    placed = window.join(relations.select("event", "relation"), "event", "left").withColumn("relation", F.coalesce("relation", F.lit(RELATIONS[2])))
    scope = placed.select("event", row(name("DERIVED_SCOPE", event, "relation"), "scope", "scope_relation", F.concat(F.lit("the centroid is "), F.col("relation")), SCOPE, F.col("relation"), F.lit(1.0), [LIMITS["scope"]], VERSIONS["scope"]).alias("r")).select("event", "r.*")
    kinds = {f.name: f.dataType for f in observed.schema.fields}
    stored = derived.join(window, "event").withColumn("value", F.when(F.col("value").cast("string") != "null", F.col("value").cast("string")))
    stored = stored.select("event", *((F.col(c) if c in stored.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in VIEW))
    stored = stored.withColumns({"limitations": F.coalesce("limitations", F.array().cast("array<string>")), "raw_reference": F.coalesce("raw_reference", event)})
    dim = window.select("event", "time_window", F.explode(F.array(*map(F.lit, complexity_names))).alias("field"))
    missing = dim.join(derived.where("category = 'fire-complexity'").select("event", F.col("type").alias("field")), ["event", "field"], "left_anti")
    gaps = missing.select("event", row(name("DERIVED_COMPLEXITY", event, F.col("field")), "fire-complexity", F.col("field"), f"not evaluated: {NOT_RUN}", COMPLEXITY_JOB, None, F.lit(0.0), LIMITS["complexity"].split("; "), VERSIONS["complexity"]).alias("r")).select("event", "r.*")
    factors = window.select("event", "time_window", F.explode(F.array(*map(F.lit, factor_names))).alias("factor")).join(routing.select("event", "factor", "signal", "reason"), ["event", "factor"], "left")
    told = F.col("signal").isNotNull()
    made = lambda rows, *r: rows.select("event", row(name("DERIVED_PRIORITY", event, F.col("factor")), "investigation-priority", F.col("factor"), *r, VERSIONS["priority"]).alias("r")).select("event", "r.*")
    routed_ = made(factors.where(told), F.col("reason"), ROUTING, F.format_string("%.4f", F.bround("signal", 4)), F.lit(1.0), [LIMITS["priority"]])
    rest = made(factors.where(~told), f"not evaluated: {NOT_RUN}", PRIORITY_JOB, None, F.lit(0.0), [NOT_RUN, LIMITS["priority"]])
    out = observed
    for more in (stored, scope, gaps, routed_, rest):
        out = out.unionByName(more)
    return out


def report_counts(events: DataFrame, pack: DataFrame, enough: DataFrame) -> DataFrame:
    """(audit, identified, reviewed, noted, insufficient, not_run): counts of a report; ``enough`` (event, sufficiency), pack (audit, event, note, analysed)."""
    total = events.agg(F.count("*").alias("identified"))
    j = pack.join(events.select("event"), "event", "left_semi").join(enough.select("event", "sufficiency"), "event", "left")
    a = j.groupBy("audit").agg(F.count("*").alias("reviewed"), F.count_if(F.col("note") != "").alias("noted"), F.count_if(F.col("sufficiency") == "INSUFFICIENT").alias("insufficient"), F.count_if(~F.col("analysed")).alias("not_run"))
    return a.crossJoin(F.broadcast(total)).select("audit", "identified", "reviewed", "noted", "insufficient", "not_run")


def review_days(scopes: DataFrame, members: DataFrame) -> DataFrame:
    """(audit, day): days of a scope's review period on which anything was observed."""
    days = scopes.select("audit", F.explode(F.sequence("start", "end", F.expr("INTERVAL 1 DAY"))).alias("day"))
    return days.join(members.select(F.to_date("acq_date").alias("day")).distinct(), "day", "left_semi")


def workload(events: DataFrame, observations: DataFrame, placed: DataFrame, manual_minutes: float, seconds_per_event: float) -> DataFrame:
    """One row: observations, events, those in scope, minutes by hand and by machine for the latter, and the reduction in percent."""
    one = observations.agg(F.count("*").alias("observations")).crossJoin(F.broadcast(events.agg(F.count("*").alias("events")))).crossJoin(F.broadcast(placed.agg(F.count_distinct("event").alias("in_scope"))))
    by_hand, by_machine = F.col("in_scope") * manual_minutes, F.col("in_scope") * seconds_per_event / 60.0
    ratio = lambda a, b: F.bround(F.col(a) / F.when(F.col(b) > 0, F.col(b)), 2)
    return one.select("observations", "events", "in_scope", ratio("observations", "events").alias("observation_compression"), ratio("events", "in_scope").alias("scope_compression"), by_hand.alias("manual_minutes"), F.bround(by_machine, 2).alias("automated_minutes"), F.bround((1 - by_machine / F.when(by_hand > 0, by_hand)) * 100, 1).alias("percent_reduction"))


def clean_detections(obs: DataFrame, land: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Detections in a box, on land (``land``: polygon, rings, box; joined over cells of half a degree) and not of low confidence."""
    cell = lambda c: F.floor(c / 0.5).cast("int")
    span = lambda a, b: F.explode(F.sequence(cell(a), cell(b)))
    sides = land.select("rings", "box").withColumn("cx", span(F.col("box.west"), F.col("box.east"))).withColumn("cy", span(F.col("box.south"), F.col("box.north")))
    o = obs.where(in_bbox(F.col("latitude"), F.col("longitude"), *map(F.lit, bbox)) & ~F.col("confidence").isin("l", "low"))
    o = o.withColumn("cx", cell(F.col("longitude"))).withColumn("cy", cell(F.col("latitude")))
    held = o.join(sides, ["cx", "cy"]).where(in_polygon(F.col("latitude"), F.col("longitude"), F.col("rings")))
    return obs.join(held.select("obs_id").distinct(), "obs_id", "left_semi")


def active_days(events: DataFrame) -> DataFrame:
    """(day, events, observations): events whose times touch a day."""
    days = F.explode(F.sequence(F.to_date("first"), F.to_date("last"), F.expr("INTERVAL 1 DAY"))).alias("day")
    return events.select("event", "n", days).groupBy("day").agg(F.count("*").alias("events"), F.sum("n").alias("observations"))


def scope_summary(placed: DataFrame, events: DataFrame) -> DataFrame:
    """(audit, events, observations, inside, intersecting, external, first, last) of the events in each scope or its buffer."""
    j = placed.join(events.select("event", "n", "first", "last"), "event")
    return j.groupBy("audit").agg(
        F.count("*").alias("events"), F.sum("n").alias("observations"), *(F.count_if(F.col("relation") == r).alias(c) for r, c in zip(RELATIONS, ("inside", "intersecting", "external"), strict=True)), F.min("first").alias("first"), F.max("last").alias("last")
    )


def progression_chain(raw: DataFrame, events: DataFrame, placed: DataFrame, routed: DataFrame, pack: DataFrame, narrowed: bool = False) -> DataFrame:
    """One row: raw -> qualified -> events -> in scope -> for human review -> selected, with the compressions.

    ``events`` (event, n) are the register's.  For a narrowed register the raw
    count is unknown (null), and qualified detections are those of its events.
    """
    own = lambda rows: rows.join(events.select("event"), "event", "left_semi")
    a = raw.agg(F.count("*").alias("raw"), F.count_if(F.coalesce(~F.col("confidence").isin("l", "low"), F.lit(True))).alias("qualified"))
    b = events.agg(F.count("*").alias("events"), F.coalesce(F.sum("n"), F.lit(0)).alias("held"))
    c = own(placed).agg(F.count_distinct("event").alias("in_scope"))
    d = own(routed).agg(F.count_if(F.col("route") == "HUMAN_REVIEW").alias("for_review"))
    e = pack.agg(F.count_distinct("event").alias("selected"))
    one = a
    for more in (b, c, d, e):
        one = one.crossJoin(F.broadcast(more))  # one row each
    one = one.withColumns({"raw": F.lit(None).cast("long"), "qualified": F.col("held")}) if narrowed else one
    ratio = lambda x, y: F.bround(F.col(x) / F.when(F.col(y) > 0, F.col(y)), 2)
    return one.select(
        "raw", "qualified", "events", "in_scope", "for_review", "selected", F.lit(narrowed).alias("narrowed"),
        ratio("qualified", "events").alias("observations_per_event"), ratio("events", "in_scope").alias("scope_compression"),
    )


def pack_state(log: DataFrame) -> DataFrame:
    """(audit, event, added_at, updated_at, note): current evidence packs from a log of add and remove actions (seq orders it).

    An event keeps the time it was first added since it was last removed.
    """
    w = Window.partitionBy("audit", "event").orderBy("seq")
    removed = F.sum(F.when(F.col("action") == "remove", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = log.withColumn("run", removed).withColumn("now", F.max("run").over(Window.partitionBy("audit", "event")))
    live = runs.where((F.col("run") == F.col("now")) & (F.col("action") == "add"))
    return live.groupBy("audit", "event").agg(F.min("at").alias("added_at"), F.max("at").alias("updated_at"), F.max_by("note", "seq").alias("note"))


def pack_report(pack: DataFrame, events: DataFrame, evidence: DataFrame) -> DataFrame:
    """(audit, events, noted, observations, evidence_rows, categories, chronology) of each pack; events without evidence count too."""
    per = evidence.groupBy("event").agg(F.count("*").alias("rows"), F.collect_set("category").alias("cats"))
    j = pack.join(events.select("event", "n", "first"), "event").join(per, "event", "left")
    return j.groupBy("audit").agg(
        F.count("*").alias("events"), F.count_if(F.col("note") != "").alias("noted"), F.sum("n").alias("observations"), F.sum(F.coalesce("rows", F.lit(0))).alias("evidence_rows"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("cats", F.array().cast("array<string>")))))), ",").alias("categories"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "event"))), lambda x: x["event"].cast("string")), ",").alias("chronology"),
    )


def report_details(pack: DataFrame, events: DataFrame, analyses: DataFrame, questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(audit, part, event, text): what a report lists beside its counts, a row each.

    ``not_run``: the pack's events without an analysis (audit, event).
    ``unresolved_question`` and ``verification``: what analyses leave open or ask to be
    checked (audit, event, kind, question).  ``algorithm_version``: the versions
    behind the pack's evidence (event, algorithm_version), without an event.
    Events that are not in the register don't count.
    """
    own = pack.select("audit", "event").distinct().join(events.select("event"), "event", "left_semi")
    done = analyses.select("audit", "event").distinct()
    row = lambda rows, part, event, text: rows.select("audit", part.alias("part"), event.cast("long").alias("event"), text.cast("string").alias("text"))
    nothing = F.lit(None)
    asked = questions.where(F.col("question").isNotNull() & F.col("kind").isin("unresolved_question", "verification")).join(own.join(done, ["audit", "event"]), ["audit", "event"], "left_semi")
    versions = own.join(evidence.where("algorithm_version is not null").select("event", "algorithm_version").distinct(), "event").select("audit", "algorithm_version").distinct()
    return (
        row(own.join(done, ["audit", "event"], "left_anti"), F.lit("not_run"), F.col("event"), nothing)
        .unionByName(row(asked, F.col("kind"), F.col("event"), F.col("question")))
        .unionByName(row(versions, F.lit("algorithm_version"), nothing, F.col("algorithm_version")))
    )


def usable_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence with a value and an id; of repeated ids of an event the first layer's row."""
    ok = evidence.where(F.col("value").isNotNull() & (F.coalesce("evidence_id", F.lit("")) != ""))
    return ok.withColumn("_n", F.row_number().over(Window.partitionBy("event", "evidence_id").orderBy("layer", "value"))).where("_n = 1").drop("_n")


def folded(old: DataFrame, new: DataFrame, categories: list[str]) -> DataFrame:
    """Evidence after an enrichment run: rows of the run's categories are replaced for the events it covers, others stay; running twice changes nothing."""
    done = new.select("event").distinct()
    touched = F.coalesce(F.col("category").isin(categories), F.lit(False))
    return old.where(~touched).unionByName(old.where(touched).join(done, "event", "left_anti")).unionByName(new, allowMissingColumns=True)


def availability(events: DataFrame, evidence: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """(event, category, rows, available) for every event and category."""
    grid = events.select("event", F.explode(F.array(*map(F.lit, categories))).alias("category"))
    counts = evidence.groupBy("event", "category").agg(F.count("*").alias("rows"))
    return grid.join(counts, ["event", "category"], "left").select("event", "category", F.coalesce("rows", F.lit(0)).alias("rows"), (F.coalesce("rows", F.lit(0)) > 0).alias("available"))


def roads_near(events: DataFrame, roads: DataFrame, km: float) -> DataFrame:
    """(event, roads, nearest_km): road centres (road, la, lo) within a distance of each event that has any."""
    met = near(events.select("event", "lat", "lon"), roads, km, ("lat", "lon"), ("la", "lo")).withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo")))
    return met.where(F.col("km") <= km).groupBy("event").agg(F.count("*").alias("roads"), F.min("km").alias("nearest_km"))


def status_table(events: DataFrame, bbox: tuple[float, float, float, float], since: str, state: str) -> DataFrame:
    """Events of a box and state first seen since a day, with ``place`` by falling score, an unknown score as -1."""
    rows = events.where(in_bbox(F.col("lat"), F.col("lon"), *map(F.lit, bbox)) & (F.col("first") >= F.lit(since).cast("timestamp")) & (F.col("state") == state))
    return running(rows, [F.coalesce("score", F.lit(-1)).desc(), F.col("event").asc()], name="place")
