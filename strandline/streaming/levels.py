"""Structured Streaming over level readings (an extension beyond the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.series import level_bands


def hourly_peaks(readings: DataFrame, late: str = "2 hours") -> DataFrame:
    """Highest level of each series and hour; readings later than the watermark are dropped, state is bounded by it."""
    return readings.withWatermark("ts", late).groupBy("series", F.window("ts", "1 hour")).agg(F.max("level").alias("peak")).select("series", F.col("window.start").alias("hour"), "peak")


def flooded_counts(peaks: DataFrame, levels: DataFrame) -> DataFrame:
    """Features whose connecting level (h, static table) each reading reaches; a stream-static join by level band."""
    bands = level_bands(levels)
    most = F.broadcast(bands.agg(F.max("most").alias("most")))  # one row
    at = peaks.join(most, F.lit(True)).withColumn("band", F.least(F.floor(F.col("peak") / 50), F.col("most")))
    return at.join(bands.select("band", "flooded"), "band").select("series", "hour", "peak", "flooded")
