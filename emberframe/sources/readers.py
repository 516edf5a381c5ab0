"""Readers of landed files: detections, weather, imagery catalogues, rasters, hydrology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.functions.evidence import observed_at

#: Columns of a landed file of detections.
OBSERVATIONS = T.StructType(
    [
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("bright_ti4", T.DoubleType()),
        T.StructField("scan", T.DoubleType()),
        T.StructField("track", T.DoubleType()),
        T.StructField("acq_date", T.StringType()),
        T.StructField("acq_time", T.IntegerType()),
        T.StructField("satellite", T.StringType()),
        T.StructField("instrument", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("bright_ti5", T.DoubleType()),
        T.StructField("frp", T.DoubleType()),
        T.StructField("daynight", T.StringType()),
        T.StructField("type", T.IntegerType()),
    ]
)
#: What makes a detection the same one in two fetches.
NATURAL_KEY = ["latitude", "longitude", "acq_date", "acq_time", "satellite", "instrument"]


def detections(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Detections from CSV files with a header; columns may lack, order may differ; rows without coordinates go."""
    raw = spark.read.option("header", True).csv(path)
    have = {c.lower(): c for c in raw.columns}
    if not {"latitude", "longitude"} <= set(have):
        raise ValueError(f"not a table of detections: columns {raw.columns}")
    cols = [(F.col(have[f.name]).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in OBSERVATIONS]
    out = raw.select(*cols).where("latitude is not null and longitude is not null")
    if bbox:
        out = out.where(F.col("longitude").between(bbox[0], bbox[2]) & F.col("latitude").between(bbox[1], bbox[3]))
    if since:
        out = out.where(F.col("acq_date") >= since)
    if until:
        out = out.where(F.col("acq_date") <= until)
    return out.withColumn("ts", observed_at(F.col("acq_date"), F.col("acq_time")))


#: The first line of a table of detections.
HEADER = ",".join(f.name for f in OBSERVATIONS)


def checked_detections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(detections, rejects) of CSV files in the feed's column order; rejects are (file, line, reason), and nothing is dropped unsaid.

    A file without the header, an error page say, is rejected whole.  Rows are
    rejected for a wrong number of fields, coordinates that are none, or a time
    that can't be read.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.rtrim("value").alias("line")).where("line <> ''")
    is_header = F.col("line") == HEADER
    tables = lines.where(is_header).select("file").distinct().withColumn("table", F.lit(True))
    rows = lines.where(~is_header).join(tables, "file", "left")
    text = ", ".join(f"{f.name} string" for f in OBSERVATIONS)
    raw = F.from_csv("line", text)
    typed = F.struct(*(raw[f.name].try_cast(f.dataType).alias(f.name) for f in OBSERVATIONS))
    rows = rows.withColumn("d", typed).withColumn("ts", observed_at(F.col("d.acq_date"), F.col("d.acq_time")))
    placed = F.col("d.latitude").between(-90, 90) & F.col("d.longitude").between(-180, 180)
    reason = (
        F.when(F.col("table").isNull(), "not a table of detections")
        .when(F.size(F.split("line", ",", -1)) != len(OBSERVATIONS), "wrong number of fields")
        .when(~F.coalesce(placed, F.lit(False)), "no coordinates")
        .when(F.col("ts").isNull(), "unreadable time")
    )
    told = rows.withColumn("reason", reason)
    return told.where("reason is null").select("d.*", "ts"), told.where("reason is not null").select("file", "line", "reason")


def availability(spark: SparkSession, path: str) -> DataFrame:
    """(data_id, min_date, max_date): which days the archive holds of each sensor, from CSV files with a header."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select("data_id", F.to_date("min_date").alias("min_date"), F.to_date("max_date").alias("max_date")).where("data_id is not null")


def historical(landed: DataFrame, start: str, end: str, region: tuple[float, float, float, float]) -> DataFrame:
    """Detections of [start, end], each once, with ``in_region``: inside the analysis box, its edges included."""
    days = landed.where(F.col("acq_date").between(start, end))
    west, south, east, north = region
    inside = F.col("longitude").between(west, east) & F.col("latitude").between(south, north)
    return merged(days).withColumn("in_region", inside)


def geojson_by_date(spark: SparkSession, path: str, keep_low: bool = False) -> DataFrame:
    """Detections from JSON documents {date: FeatureCollection}; those of low confidence go unless ``keep_low`` (for the raw count)."""
    schema = "map<string, struct<features: array<struct<geometry: struct<coordinates: array<double>>, properties: struct<acq_datetime: string, frp: double, confidence: string, satellite: string, instrument: string>>>>>"
    days = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("day", "c"))
    f = days.select("day", F.explode("c.features").alias("f"))
    f = f if keep_low else f.where(F.coalesce(F.lower("f.properties.confidence"), F.lit("")) != "low")
    t = F.try_to_timestamp(F.col("f.properties.acq_datetime"))
    return f.select(
        F.element_at("f.geometry.coordinates", 2).alias("latitude"), F.element_at("f.geometry.coordinates", 1).alias("longitude"), F.coalesce(F.date_format(t, "yyyy-MM-dd"), F.col("day")).alias("acq_date"),
        (F.hour(t) * 100 + F.minute(t)).alias("acq_time"), "f.properties.frp", "f.properties.confidence", "f.properties.satellite", "f.properties.instrument", t.alias("ts"),
    )


#: Most days that one request of the archive takes.
MAX_DAYS = 5


def date_windows(spark: SparkSession, start: str, end: str, days: int = 5) -> DataFrame:
    """(window_start, window_end): inclusive windows of ``days`` days, 1 to ``MAX_DAYS`` of them, that cover [start, end]."""
    days = min(max(days, 1), MAX_DAYS)
    if start > end:
        raise ValueError("the range ends before it starts")
    first = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"INTERVAL {days} DAYS"))).alias("window_start")
    return spark.range(1).select(first).select("window_start", F.least(F.date_add("window_start", days - 1), F.lit(end).cast("date")).alias("window_end"))


#: Times that a window is asked for, and days after its end from which the archive revises it no more.
TRIES, STABLE_AFTER_DAYS = 3, 7


def fetch_ledger(windows: DataFrame, tries: DataFrame, today: str) -> DataFrame:
    """(window_start, window_end, attempts, status, rows, error, final) of every window.

    ``tries``: window_start, attempt (from 1), rows, error.  The first try without an
    error counts, whatever it found: a window without detections is ``ok`` with 0
    rows.  Only one whose ``TRIES`` tries all raised is ``failed``, with the last
    error; one that was never tried is ``pending``.  ``final``: the archive revises it no more.
    """
    asked = tries.where(F.col("attempt").between(1, TRIES))
    good = F.col("error").isNull()
    a = asked.groupBy("window_start").agg(
        F.min(F.when(good, F.struct("attempt", F.coalesce("rows", F.lit(0)).alias("rows")))).alias("hit"), F.max("attempt").alias("tried"), F.max(F.struct("attempt", "error")).alias("last")
    )
    status = F.when(F.col("hit").isNotNull(), "ok").when(F.col("tried").isNotNull(), "failed").otherwise("pending")
    return windows.join(a, "window_start", "left").select(
        "window_start", "window_end", F.coalesce("hit.attempt", "tried", F.lit(0)).alias("attempts"), status.alias("status"), F.coalesce("hit.rows", F.lit(0)).cast("long").alias("rows"),
        F.when(F.col("hit").isNull(), F.col("last.error")).alias("error"), (F.col("window_end") <= F.date_sub(F.lit(today).cast("date"), STABLE_AFTER_DAYS)).alias("final"),
    )


def merged(*frames: DataFrame, keys: list[str] = NATURAL_KEY) -> DataFrame:
    """Union of frames by column name without repeats of the natural key (its columns that are there).

    Of rows that repeat a key the one first in confidence stays, then in the other
    columns in their order, nulls last, whatever frame or task they come from.
    """
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    keys = [k for k in keys if k in out.columns]
    rest = sorted((c for c in out.columns if c not in keys), key=lambda c: c != "confidence")
    if not keys or not rest:
        return out.dropDuplicates(keys or None)
    order = F.struct(*(F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("value")) for c in rest))
    kept = out.groupBy(*keys).agg(F.min(order).alias("_first"))
    return kept.select(*(F.col(c) if c in keys else F.col(f"_first.col{rest.index(c) + 1}.value").alias(c) for c in out.columns))


def hourly_weather(spark: SparkSession, path: str, variables: list[str]) -> DataFrame:
    """Hourly rows from JSON documents that hold a start, an interval in seconds and one array per variable; the end is exclusive."""
    schema = "grid_id long, latitude double, longitude double, start long, end long, interval long, " + ", ".join(f"{v} array<float>" for v in variables)
    raw = spark.read.schema(schema).json(path, multiLine=True)
    long = raw.select("*", F.posexplode(F.arrays_zip(*variables)).alias("i", "v"))
    long = long.withColumn("sec", F.col("start") + F.col("i") * F.col("interval")).where("sec < end")
    clean = lambda c: F.when(~F.isnan(c), c.cast("double"))
    return long.select("grid_id", F.col("latitude").alias("grid_lat"), F.col("longitude").alias("grid_lon"), F.timestamp_seconds("sec").alias("ts"), *(clean(F.col(f"v.{v}")).alias(v) for v in variables))


def daily_weather(spark: SparkSession, path: str, parameters: list[str], fill: float = -999.0) -> DataFrame:
    """(file path, date, one column per parameter) from JSON {properties: {parameter: {name: {yyyymmdd: value}}}}; the fill value is null."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.get_json_object("value", "$.properties.parameter").alias("p"))
    long = raw.select("file", F.explode(F.from_json("p", "map<string, map<string, double>>")).alias("name", "days")).select("file", "name", F.explode("days").alias("day", "value"))
    long = long.select("file", "name", F.to_date("day", "yyyyMMdd").alias("date"), F.when(F.col("value") != fill, F.col("value")).alias("value"))
    return long.groupBy("file", "date").pivot("name", parameters).agg(F.first("value"))


def catalogue(spark: SparkSession, path: str, limit: int = 20, lines: bool = False) -> DataFrame:
    """Imagery items as JSON text, one row each; a page that may have been cut off (full, or with a next link) fails the query.

    A file is a page, or with ``lines`` a page a line, so that very many pages need no file each.
    """
    page = spark.read.text(path, wholetext=not lines).select(F.col("value").alias("page"))
    items = F.from_json(F.get_json_object("page", "$.features"), "array<string>")
    alone = F.array(F.col("page"))
    rows = F.coalesce(items, F.from_json("page", "array<string>"), alone)
    links = F.from_json(F.get_json_object("page", "$.links"), "array<struct<rel: string>>")
    cut_off = (F.size(rows) >= limit) | F.coalesce(F.exists(links, lambda x: x["rel"] == "next"), F.lit(False))
    checked = F.when(cut_off, F.raise_error(F.lit("a page of the catalogue is cut off"))).otherwise(rows)
    return page.select(F.explode(checked).alias("item"))


def granules(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(granule, time, links) of catalogue pages {feed: {entry: [...]}}, one a file or one a line; links without an address go."""
    schema = "feed struct<entry: array<struct<id: string, time_start: string, links: array<struct<href: string>>>>>"
    entry = spark.read.text(path, wholetext=not lines).select(F.explode(F.from_json("value", schema)["feed"]["entry"]).alias("e"))
    links = F.transform(F.filter("e.links", lambda x: F.coalesce(x["href"], F.lit("")) != ""), lambda x: x["href"])
    return entry.select(F.col("e.id").alias("granule"), F.to_timestamp("e.time_start").alias("time"), F.coalesce(links, F.array().cast("array<string>")).alias("links"))


def within(items: DataFrame, bbox: tuple[float, float, float, float], since: str, until: str, sensor: str | None = None) -> DataFrame:
    """Catalogue items (``scenes.scene_fields``) whose box meets another, acquired in [since, until], of one sensor if asked."""
    west, south, east, north = (F.element_at("bbox", i) for i in (1, 2, 3, 4))
    met = (west <= bbox[2]) & (east >= bbox[0]) & (south <= bbox[3]) & (north >= bbox[1]) & F.col("acquired").between(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp"))
    return items.where(met if sensor is None else met & (F.col("sensor") == sensor))


def world_file(spark: SparkSession, path: str) -> DataFrame:
    """One row of a raster's transform from six lines, decimal commas allowed."""
    lines = F.split(F.trim(F.translate("value", ",", ".")), r"\s+")
    names = ("step_x", "skew_y", "skew_x", "step_y", "lon", "lat")
    return spark.read.text(path, wholetext=True).select(*(F.element_at(lines, i + 1).cast("double").alias(n) for i, n in enumerate(names)))


#: Valid ranges of the hydrology measures.
HYDROLOGY = {
    "surface_soil_moisture_m3_m3": (0.0, 1.0),
    "root_zone_soil_moisture_m3_m3": (0.0, 1.0),
    "depth_to_water_table_from_surface_in_peat_m": (-5.0, 0.15),
    "free_surface_water_on_peat_flux_kg_m2_s": (-0.001, 0.001),
}


def valid(value: Column, low: float, high: float) -> Column:
    """The value if it is finite, no fill (9990 and beyond) and within the range, else null."""
    return F.when(~F.isnan(value) & (F.abs(value) < 9990) & value.between(low, high), value)


def hydrology(rows: DataFrame, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Grid rows inside a box with at least one usable measure; unusable ones are null."""
    out = rows.where(F.col("longitude").between(bbox[0], bbox[2]) & F.col("latitude").between(bbox[1], bbox[3])) if bbox else rows
    out = out.withColumns({c: valid(F.col(c), *r) for c, r in HYDROLOGY.items()})
    return out.where(F.coalesce(*HYDROLOGY).isNotNull())


def variable_availability(rows: DataFrame, names: list[str]) -> DataFrame:
    """(variable, rows, available) for each named column."""
    a = rows.agg(*(F.count(c).alias(c) for c in names))
    return a.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).alias("rows"), (F.col(c) > 0).alias("available")) for c in names))).alias("x")).select("x.*")


def source_status(counts: DataFrame, expected: list[str]) -> DataFrame:
    """(source, rows, status): PASS with rows, FAIL with none, SKIPPED where nothing landed."""
    want = counts.sparkSession.createDataFrame([(s,) for s in expected], "source string")
    return want.join(counts, "source", "left").select("source", F.coalesce("rows", F.lit(0)).alias("rows"), F.when(F.col("rows").isNull(), "SKIPPED").when(F.col("rows") > 0, "PASS").otherwise("FAIL").alias("status"))


def tile_key(lat: Column, lon: Column, step: int = 3) -> Column:
    """Name of the land-cover tile (lower left corner) that holds a point."""
    la, lo = F.floor(lat / step) * step, F.floor(lon / step) * step
    return F.concat(F.when(la < 0, "S").otherwise("N"), F.lpad(F.abs(la).cast("string"), 2, "0"), F.when(lo < 0, "W").otherwise("E"), F.lpad(F.abs(lo).cast("string"), 3, "0"))
