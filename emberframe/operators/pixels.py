"""Image jobs over pixel tables (image, x, y, bands)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(pixels: DataFrame, grey: str = "grey", least: float = 0.05) -> DataFrame:
    """(image, pixels, coverage, missing): share of pixels that aren't black; under ``least`` the image counts as missing."""
    a = pixels.groupBy("image").agg(F.count("*").alias("pixels"), F.avg((F.col(grey) > 0).cast("double")).alias("coverage"))
    return a.withColumn("missing", F.col("coverage") < least)


def _unit(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def optical_composite(pixels: DataFrame) -> DataFrame:
    """red, green, blue of 0..1 from bands b12, b08, b04 (gain 2.5); black without data."""
    band = lambda c: F.when(F.col("mask") == 0, 0.0).otherwise(_unit(F.col(c) * 2.5))
    return pixels.select("image", "x", "y", band("b12").alias("red"), band("b08").alias("green"), band("b04").alias("blue"))


def radar_composite(pixels: DataFrame) -> DataFrame:
    """red, green, blue from backscatter: VV -20..0 dB, VH -25..-5 dB, VV-VH 0..15 dB."""
    db = lambda c: F.log10(F.greatest(F.col(c), F.lit(1e-6))) * 10.0
    stretch = lambda v, lo, hi: F.when(F.col("mask") == 0, 0.0).otherwise(_unit((v - lo) / (hi - lo)))
    return pixels.select("image", "x", "y", stretch(db("vv"), -20.0, 0.0).alias("red"), stretch(db("vh"), -25.0, -5.0).alias("green"), stretch(db("vv") - db("vh"), 0.0, 15.0).alias("blue"))


def display_stretch(pixels: DataFrame, column: str = "vv") -> DataFrame:
    """(image, x, y, display): dB values between an image's 2nd and 98th percentile as 0..255; unusable 0, a flat image 128."""
    db = F.when(F.col(column) > 0, F.log10(column) * 10.0)
    marked = pixels.withColumn("db", db)
    ends = marked.groupBy("image").agg(F.percentile("db", 0.02).alias("lo"), F.percentile("db", 0.98).alias("hi"))
    j = marked.join(ends, "image")
    value = F.when(F.col("db").isNull(), 0).when(F.col("hi") <= F.col("lo"), 128).otherwise(F.floor(_unit((F.col("db") - F.col("lo")) / (F.col("hi") - F.col("lo"))) * 255.0))
    return j.select("image", "x", "y", value.cast("int").alias("display"))
