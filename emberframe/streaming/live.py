"""The live feed as Structured Streaming: parse, window, de-duplicate, snapshot, fold into events."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.functions.evidence import observed_at
from emberframe.operators import events as ev
from emberframe.operators.components import materialise
from emberframe.operators.spatial import pairs_within, projected
from emberframe.sources.readers import NATURAL_KEY, OBSERVATIONS, merged

LATENESS = "24 hours"


def parsed(rows: DataFrame) -> DataFrame:
    """Usable detections: bad coordinates and unreadable times go, missing power is 0, missing confidence 'unknown'."""
    ok = F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)
    out = rows.where(ok).withColumns({"frp": F.coalesce("frp", F.lit(0.0)), "confidence": F.coalesce("confidence", F.lit("unknown")), "ts": observed_at(F.col("acq_date"), F.col("acq_time"))})
    return out.where("ts is not null")


def feed(spark: SparkSession, path: str) -> DataFrame:
    """Stream of landed CSV files; a file whose header doesn't match (an error page, say) fails the query instead of reading as empty."""
    raw = spark.readStream.schema(OBSERVATIONS).option("header", True).option("enforceSchema", False).csv(path)
    return parsed(raw)


def deduplicated(stream: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Detections that overlapping fetches repeat within a day are kept once; state is dropped behind the watermark.

    Which of a key's rows comes first hangs on tasks; with ``more`` columns those that differ
    in them all pass, for ``merged`` to choose among what landed.
    """
    return stream.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark([*NATURAL_KEY, *more])


def within_day(rows: DataFrame, now) -> DataFrame:
    """Snapshot view: the last 24 hours before ``now``, without an upper bound."""
    return rows.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.expr("INTERVAL 24 HOURS"))


#: Minutes that a stored snapshot is served for.
SERVED_MINUTES = 15


def store_snapshot(rows: DataFrame, path: str, now: str) -> None:
    """The last day's detections, each once, with the time they were stored, as a new snapshot.

    The snapshot goes to a folder of its own; what is served changes by one row
    appended to ``pointers``, so a reader gets the snapshot before or this one, never
    a part, and one that broke off half way is never served.
    """
    folder = f"{path}/snapshots/{uuid.uuid4().hex}"
    stamped = merged(within_day(rows, now)).withColumn("stored_at", F.lit(now).cast("timestamp"))
    stamped.write.parquet(folder)
    rows.sparkSession.range(1).select(F.lit(now).cast("timestamp").alias("stored_at"), F.lit(folder).alias("folder")).write.mode("append").parquet(f"{path}/pointers")


def served(spark: SparkSession, path: str) -> DataFrame | None:
    """The snapshot stored last; None before the first."""
    try:
        newest = spark.read.parquet(f"{path}/pointers").orderBy(F.desc("stored_at"), "folder").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return newest and spark.read.parquet(newest["folder"])


def refresh_snapshot(batch: DataFrame, path: str, now: str) -> None:
    """A snapshot of a batch together with what was served before; as ``writeStream.foreachBatch`` of this, a batch run twice changes nothing."""
    before = served(batch.sparkSession, path)
    store_snapshot(batch if before is None else batch.unionByName(before.drop("stored_at")), path, now)


def fresh(stored_at: Column, now: Column) -> Column:
    """Whether a snapshot needs no new fetch yet."""
    return now - F.expr(f"INTERVAL {SERVED_MINUTES} MINUTES") <= stored_at


def fold_into_events(batch: DataFrame, known: DataFrame, ref_lat: float, radius_km: float = ev.DEFAULT_RADIUS_KM, hours: float = ev.DEFAULT_HOURS) -> tuple[DataFrame, DataFrame]:
    """(members, superseded) after a batch of new detections.

    ``known``: obs_id, event_id and the observation's columns.  Only the new
    detections look for partners, and only events with a member near one of them
    are clustered again; event ids follow from the members, so (old_id, new_id)
    tells what became of those that grew or merged.  All batches must project at
    the same ``ref_lat``; a rebuild at that latitude gives the same events.
    """
    ev.check_thresholds(radius_km, hours)
    columns = known.drop("event_id").columns
    new = batch.join(known.select("obs_id"), "obs_id", "left_anti").select(*columns)
    at = lambda rows: projected(rows, ref_lat=ref_lat)
    met = pairs_within(at(known), radius_km, hours, of=at(new)).select(F.col("b").alias("obs_id")).distinct()
    again = materialise(known.join(met, "obs_id", "left_semi").select("event_id").distinct())
    part = materialise(known.join(again, "event_id", "left_semi").select(*columns).unionByName(new))
    members = part.join(ev.clustered(part, radius_km, hours, ref_lat), "obs_id")
    names = ev.summarised(members).select("cluster", "event_id")
    fresh = members.join(names, "cluster").drop("cluster").select(*known.columns)
    moved = known.join(again, "event_id", "left_semi").select("obs_id", F.col("event_id").alias("old_id")).join(fresh.select("obs_id", F.col("event_id").alias("new_id")), "obs_id")
    kept = known.join(again, "event_id", "left_anti")
    return kept.unionByName(fresh), moved.where("old_id <> new_id").select("old_id", "new_id").distinct()
