"""Event reconstruction: observations linked in space and time, summarised and named."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.functions.evidence import hours_between
from emberframe.functions.geo import haversine_km
from emberframe.operators.blocks import linked_by_class
from emberframe.operators.components import connected_components, materialise
from emberframe.operators.order import at_shares
from emberframe.operators.spatial import pairs_within, projected

#: Bounds that keep the pair list linear in the rows.
MAX_RADIUS_KM, MAX_HOURS = 50.0, 720.0
DEFAULT_RADIUS_KM, DEFAULT_HOURS = 2.0, 72.0


def check_thresholds(radius_km: float, hours: float) -> None:
    if not 0 < radius_km <= MAX_RADIUS_KM:
        raise ValueError(f"the radius must be over 0 and at most {MAX_RADIUS_KM} km")
    if not 0 < hours <= MAX_HOURS:
        raise ValueError(f"the time bound must be over 0 and at most {MAX_HOURS} h")


def qualified(obs: DataFrame) -> DataFrame:
    """Observations without those of low confidence."""
    return obs.where(~F.col("confidence").isin("l", "low") | F.col("confidence").isNull())


def accepted_pairs(obs: DataFrame, radius_km: float = DEFAULT_RADIUS_KM, hours: float = DEFAULT_HOURS, ref_lat: float | None = None) -> DataFrame:
    check_thresholds(radius_km, hours)
    return pairs_within(projected(obs, ref_lat=ref_lat), radius_km, hours)


def _bundled(obs: DataFrame, radius_km: float, hours: float, ref_lat: float | None) -> DataFrame:
    """``obs`` with x_km, y_km and ``bundle``: the least obs_id of a cell so small, in space and in time, that all its observations are linked."""
    side = radius_km / 2**0.5
    cell = {"_cx": F.floor(F.col("x_km") / side), "_cy": F.floor(F.col("y_km") / side), "_ct": F.floor(F.unix_micros("ts") / (hours * 3600e6))}
    placed = projected(obs, ref_lat=ref_lat).withColumns(cell)
    # an observation without a place or time is a bundle of its own
    least = placed.groupBy(*cell).agg(F.min("obs_id").alias("bundle"))
    return placed.join(least, [*cell], "left").drop(*cell).withColumn("bundle", F.coalesce("bundle", "obs_id"))


def _linked(bundled: DataFrame, radius_km: float, hours: float) -> DataFrame:
    """(bundle_a, bundle_b, links, gap_hours, distance_km): accepted pairs added up by the bundles of their ends, so that no pair is written."""
    check_thresholds(radius_km, hours)
    pairs = pairs_within(bundled, radius_km, hours, carry=("bundle",))
    return pairs.groupBy("bundle_a", "bundle_b").agg(F.count("*").alias("links"), F.max("gap_hours").alias("gap_hours"), F.max("distance_km").alias("distance_km"))


def _clusters(linked: DataFrame) -> DataFrame:
    """(bundle, cluster) of the bundles that are linked to others."""
    found = connected_components(linked.where("bundle_a <> bundle_b"), "bundle_a", "bundle_b")
    least = found.groupBy("root").agg(F.min("vertex").alias("cluster"))
    return found.join(least, "root").select(F.col("vertex").alias("bundle"), "cluster")


def clustered(obs: DataFrame, radius_km: float = DEFAULT_RADIUS_KM, hours: float = DEFAULT_HOURS, ref_lat: float | None = None) -> DataFrame:
    """(obs_id, cluster): the least obs_id that is reached over accepted pairs; singletons are their own."""
    check_thresholds(radius_km, hours)
    bundled = materialise(_bundled(obs.select("obs_id", "latitude", "longitude", "ts"), radius_km, hours, ref_lat))
    labels = _clusters(_linked(bundled, radius_km, hours))
    return bundled.join(labels, "bundle", "left").select("obs_id", F.coalesce("cluster", "bundle").alias("cluster"))


def natural_key() -> Column:
    return F.concat_ws(",", F.format_string("%.5f", "latitude"), F.format_string("%.5f", "longitude"), F.col("acq_date").cast("string"), F.col("acq_time").cast("string"))


def key_digests(members: DataFrame, by: str) -> DataFrame:
    """(by, digest): SHA-1 of each group's keys, sorted and joined by |.

    Keys come sorted and are hashed as they pass, so a group of any size takes no
    more memory than a batch; only its own order ties it to one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out: list[tuple] = []
            for group, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is None or group != now:
                    if digest is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = group, hashlib.sha1(key.encode())
                else:
                    digest.update(b"|" + key.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], batch.schema.field(0).type), pa.array([d for _, d in out])], [by, "digest"])
            kind = batch.schema.field(0).type
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([digest.hexdigest()])], [by, "digest"])

    keyed = members.select(by, natural_key().alias("key")).repartition(by).sortWithinPartitions(by, "key")
    return keyed.mapInArrow(run, f"{by} {members.schema[by].dataType.simpleString()}, digest string")


def event_name(first: Column, digest: Column) -> Column:
    """Content-addressed id: date of the first detection and ten hex digits of the digest of the members' keys."""
    return F.concat(F.lit("FE-"), F.date_format(first, "yyyyMMdd"), F.lit("-"), F.substring(digest, 1, 10))


def sensor_combination() -> Column:
    return F.when(F.col("satellite").isNotNull() | F.col("instrument").isNotNull(), F.concat_ws("/", "satellite", "instrument"))


def summarised(members: DataFrame, by: str = "cluster") -> DataFrame:
    """One row per group of observations: times, centroid, box, extent, power, sensors, name."""
    a = members.groupBy(by).agg(
        F.min("obs_id").alias("least_obs"),
        F.min("ts").alias("first_detection"),
        F.max("ts").alias("last_detection"),
        F.count("*").alias("observation_count"),
        # whole hundred-thousandths of a degree add up exactly in any order
        (F.sum(F.round(F.col("latitude") * 1e5).cast("long")) / F.count("*") / 1e5).alias("lat"),
        (F.sum(F.round(F.col("longitude") * 1e5).cast("long")) / F.count("*") / 1e5).alias("lon"),
        F.min("longitude").alias("west"),
        F.min("latitude").alias("south"),
        F.max("longitude").alias("east"),
        F.max("latitude").alias("north"),
        F.max("frp").alias("max_frp"),
        (F.sum(F.round(F.col("frp") * 1e4).cast("long")) / F.count("frp") / 1e4).alias("mean_frp"),
        F.sort_array(F.collect_set(sensor_combination())).alias("sensor_mix"),
    )
    return a.join(key_digests(members, by), by).select(
        by,
        event_name(F.col("first_detection"), F.col("digest")).alias("event_id"),
        "least_obs",
        "first_detection",
        "last_detection",
        hours_between(F.col("first_detection"), F.col("last_detection")).alias("duration_hours"),
        "observation_count",
        "lat",
        "lon",
        "west",
        "south",
        "east",
        "north",
        haversine_km(F.col("south"), F.col("west"), F.col("north"), F.col("east")).alias("spatial_extent_km"),
        "max_frp",
        "mean_frp",
        "sensor_mix",
    )


def reconstruct(obs: DataFrame, radius_km: float = DEFAULT_RADIUS_KM, hours: float = DEFAULT_HOURS, ref_lat: float | None = None) -> DataFrame:
    """Events of a table of observations, with the statistics of their links, by first detection."""
    check_thresholds(radius_km, hours)
    bundled = materialise(_bundled(obs, radius_km, hours, ref_lat))
    linked = materialise(_linked(bundled, radius_km, hours))
    labels = materialise(_clusters(linked))
    events = summarised(bundled.join(labels, "bundle", "left").withColumn("cluster", F.coalesce("cluster", "bundle")))
    of = linked.withColumnRenamed("bundle_a", "bundle").join(labels, "bundle", "left").groupBy(F.coalesce("cluster", "bundle").alias("cluster"))
    links = of.agg(F.sum("links").alias("link_count"), F.max("gap_hours").alias("max_link_gap_hours"), F.max("distance_km").alias("max_link_distance_km"))
    out = events.join(links, "cluster", "left").withColumn("link_count", F.coalesce("link_count", F.lit(0)))
    return out.orderBy("first_detection", "least_obs")


def run_totals(obs: DataFrame, radius_km: float = DEFAULT_RADIUS_KM, hours: float = DEFAULT_HOURS) -> DataFrame:
    """One row: pairs within the radius, accepted, rejected by time, widest accepted."""
    check_thresholds(radius_km, hours)
    ok = F.col("gap_hours") <= hours
    return pairs_within(projected(obs), radius_km).agg(
        F.count("*").alias("pairs_in_radius"),
        F.count_if(ok).alias("accepted"),
        F.count_if(~ok).alias("rejected_by_time"),
        F.max(F.when(ok, F.col("distance_km"))).alias("widest_km"),
        F.max(F.when(ok, F.col("gap_hours"))).alias("longest_gap_hours"),
    )


def lobes(members: DataFrame, lobe_km: float = 1.0, cluster_km: float = DEFAULT_RADIUS_KM) -> DataFrame:
    """Spatial parts of each event, largest first: event, lobe, nth, number, times, duration, extent, centroid, power.

    Points of one event within ``lobe_km`` at the event's own mean latitude hang
    together; time plays no part.
    """
    if not 0 < lobe_km < cluster_km:
        raise ValueError("lobes must be narrower than the links of the clusters")
    from emberframe.functions.geo import planar_km

    ref = members.groupBy("event").agg((F.sum(F.round(F.col("latitude") * 1e5).cast("long")) / F.count("*") / 1e5).alias("ref_lat"))
    x, y = planar_km(F.col("latitude"), F.col("longitude"), F.col("ref_lat"))
    placed = members.join(ref, "event").withColumns({"x_km": x, "y_km": y})
    found = connected_components(pairs_within(placed, lobe_km, keys=("event",)))
    least = found.groupBy("root").agg(F.min("vertex").alias("lobe"))
    labels = found.join(least, "root").select(F.col("vertex").alias("obs_id"), "lobe")
    parts = members.join(labels, "obs_id", "left").withColumn("lobe", F.coalesce("lobe", "obs_id"))
    n = F.count("*")
    out = parts.groupBy("event", "lobe").agg(
        n.alias("observation_count"), F.min("ts").alias("first_detection"), F.max("ts").alias("last_detection"), F.max("frp").alias("max_frp"),
        *((F.sum(F.round(F.col(c) * 1e5).cast("long")) / n / 1e5).alias(k) for c, k in (("latitude", "lat"), ("longitude", "lon"))),
        F.min("longitude").alias("_w"), F.min("latitude").alias("_s"), F.max("longitude").alias("_e"), F.max("latitude").alias("_n"),
    )
    measures = {"duration_hours": hours_between(F.col("first_detection"), F.col("last_detection")), "spatial_extent_km": haversine_km(F.col("_s"), F.col("_w"), F.col("_n"), F.col("_e"))}
    out = out.withColumns(measures).drop("_w", "_s", "_e", "_n")
    nth = F.row_number().over(Window.partitionBy("event").orderBy(F.desc("observation_count"), "first_detection", "lobe"))
    return out.withColumn("nth", nth)


def threshold_sweep(obs: DataFrame, radii: tuple[float, ...], hours: tuple[float, ...], large: int = 100) -> DataFrame:
    """(radius_km, hours, events, singletons, large_events, largest, accepted_pairs) for every combination.

    Pairs are counted and joined up inside tasks, which send only the links that
    hold their rows together.  The least bounds are clustered first, for all.  Radii
    come in rising order, and each starts from the clusters of the one before, so
    a link takes part once; the time bounds are labelled together: a vertex is
    numbered by its place among them.  Of a radius only what is joined is written.
    """
    check_thresholds(max(radii), max(hours))
    check_thresholds(min(radii), min(hours))
    radii, hours = sorted(set(map(float, radii))), sorted(set(map(float, hours)))
    n = len(hours)
    met = materialise(linked_by_class(projected(obs), radii, hours))
    kinds = F.count("*").alias("clusters"), F.sum("n").alias("members"), F.count_if(F.col("n") >= large).alias("large_events"), F.max("n").alias("largest")

    def moved(links: DataFrame, move: DataFrame) -> DataFrame:
        for v in "ab":
            links = links.join(move.select(F.col("vertex").alias(v), "root"), v, "left").withColumn(v, F.coalesce("root", v)).drop("root")
        return links.where("a <> b")

    base = materialise(connected_components(met.where("i = 0 and j = 0 and a is not null")))
    before = materialise(base.groupBy("root").agg(F.count("*").alias("n")))
    changes = before.agg(*kinds).select(F.lit(0).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("j"), *("clusters", "members", "large_events", "largest"))
    moves, sizes = [], []
    for i in range(len(radii)):
        links = moved(met.where((F.col("i") == i) & (F.col("i") + F.col("j") > 0) & F.col("a").isNotNull()), base)
        if i == 0:  # these hold for the larger time bounds too
            links = links.withColumn("j", F.explode(F.sequence(F.col("j"), F.lit(n - 1).cast("long"))))
        links = links.select(*((F.col(v) * n + F.col("j")).alias(v) for v in "ab"))
        for move in moves:
            links = moved(links, move)
        found = connected_components(links)
        moves.append(materialise(found))
        # rows of each cluster that is joined to others: null for a single row
        ends = moves[-1].withColumn("of", F.expr(f"vertex div {n}")).join(before.select(F.col("root").alias("of"), "n"), "of", "left")
        for size in sizes:
            ends = ends.join(size.select(F.col("root").alias("vertex"), F.col("n").alias("_n")), "vertex", "left").withColumn("n", F.coalesce("_n", "n")).drop("_n")
        size = ends.groupBy("root").agg(F.sum(F.coalesce("n", F.lit(1))).alias("n"), F.count("n").alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("m"), F.count_if(F.col("n") >= large).alias("l"))
        sizes.append(materialise(size))
        made = sizes[-1].groupBy(F.pmod("root", F.lit(n)).alias("j")).agg(*kinds, *(F.sum(c).alias(c) for c in "cml"))
        gone = {name: F.col(name) - F.col(c) for name, c in (("clusters", "c"), ("members", "m"), ("large_events", "l"))}
        changes = changes.unionByName(made.withColumns(gone).withColumn("i", F.lit(i)).drop(*"cml"))
    upto = changes.withColumn("i", F.explode(F.sequence(F.col("i"), F.lit(len(radii) - 1))))
    linked = upto.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("clusters", "members", "large_events")), F.max("largest").alias("largest"))
    accepted = met.where("a is null").groupBy("i", "j").agg(F.sum("pairs").alias("accepted_pairs"))
    cells = F.array(*(F.struct(F.lit(r).alias("radius_km"), F.lit(h).alias("hours"), F.lit(i).alias("i"), F.lit(j).alias("j")) for i, r in enumerate(radii) for j, h in enumerate(hours)))
    grid = obs.sparkSession.range(1).select(F.explode(cells).alias("c")).select("c.*")
    total = obs.agg(F.count("*").alias("total"))
    joined = grid.join(linked, ["i", "j"], "left").join(accepted, ["i", "j"], "left").crossJoin(F.broadcast(total))
    single = F.col("total") - F.coalesce("members", F.lit(0))
    largest = F.coalesce("largest", F.when(F.col("total") > 0, 1).otherwise(0))
    return joined.select("radius_km", "hours", (single + F.coalesce("clusters", F.lit(0))).alias("events"), single.alias("singletons"), (F.coalesce("large_events", F.lit(0)) + (single if large <= 1 else 0)).alias("large_events"), largest.alias("largest"), F.coalesce("accepted_pairs", F.lit(0)).alias("accepted_pairs"))


def checksummed(members: DataFrame) -> DataFrame:
    """(event, observation_count, checksum) of members: sums of their keys' hashes, the same in any order."""
    h = F.xxhash64(natural_key())
    return members.groupBy("event").agg(F.count("*").alias("observation_count"), F.struct(F.sum(h.cast("decimal(38,0)")).alias("total"), F.bit_xor(h).alias("folded")).alias("checksum"))


def membership_problems(events: DataFrame, members: DataFrame) -> DataFrame:
    """(event, problem, stored, found): events whose stored members are not those that they were made of.

    ``events`` is ``checksummed`` of the members at the time; ``found`` counts the
    members that are stored now.  ``unknown_event``: members of an event that is
    not stored; ``no_members``; ``count``; ``members``: as many, but others.
    """
    now = checksummed(members).select(F.col("event").alias("of"), F.col("observation_count").alias("found"), F.col("checksum").alias("now"))
    both = events.join(now, F.col("event") == F.col("of"), "full")
    problem = (
        F.when(F.col("event").isNull(), "unknown_event").when(F.col("of").isNull(), "no_members").when(F.col("observation_count") != F.col("found"), "count").when(F.col("checksum") != F.col("now"), "members")
    )
    told = both.select(F.coalesce("event", "of").alias("event"), problem.alias("problem"), F.coalesce("observation_count", F.lit(0)).alias("stored"), F.coalesce("found", F.lit(0)).alias("found"))
    return told.where("problem is not null")


def diagnostics(events: DataFrame, large: int = 100) -> DataFrame:
    """One row: totals, compression, singletons, and five-number spreads of the main measures."""
    n, seen = F.count("*"), F.sum("observation_count")
    measures = ["observation_count", "duration_hours", "spatial_extent_km"]
    a = events.agg(
        n.alias("events"),
        seen.alias("observations"),
        F.when(n > 0, seen / n).alias("compression"),
        F.count_if(F.col("observation_count") == 1).alias("singletons"),
        F.count_if(F.col("observation_count") >= large).alias("large_events"),
        F.when(seen > 0, F.coalesce(F.sum(F.when(F.col("observation_count") >= large, F.col("observation_count"))), F.lit(0)) / seen).alias("large_share"),
        *(f(c).alias(f"{c}_{name}") for c in measures for name, f in (("min", F.min), ("mean", F.avg), ("max", F.max))),
    )
    middle = at_shares(events, measures, {"median": 0.5, "p90": 0.9})
    pick = lambda c, s: F.max(F.when(F.col("column") == c, F.col(s))).alias(f"{c}_{s}")
    middle = middle.agg(*(pick(c, s) for c in measures for s in ("median", "p90")))
    flat = [f"{c}_{f}" for c in measures for f in ("min", "median", "mean", "p90", "max")]
    return a.crossJoin(F.broadcast(middle)).select("events", "observations", "compression", "singletons", "large_events", "large_share", *flat)
