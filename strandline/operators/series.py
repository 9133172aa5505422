"""Tide series: peaks, windows, interpolation, forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_peak(series: DataFrame, keys: list[str], time: str = "ts", level: str = "level") -> DataFrame:
    """Highest level of each series and when it was first reached."""
    return series.groupBy(*keys).agg(F.max(level).alias("peak"), F.min_by(time, F.struct((-F.col(level)).alias("l"), time)).alias("at"))


def intervals(series: DataFrame, keys: list[str], time: str = "t", level: str = "level") -> DataFrame:
    """Consecutive points as pieces [t0, t1) with both levels; the last piece is open."""
    w = Window.partitionBy(*keys).orderBy(time)
    return series.select(*keys, F.col(time).alias("t0"), F.col(level).alias("l0"), F.lead(time).over(w).alias("t1"), F.lead(level).over(w).alias("l1"), F.row_number().over(w).alias("piece"))


def interpolated(queries: DataFrame, series: DataFrame, key: str, width: int) -> DataFrame:
    """queries (key, q) with the linear level at q, clamped to the series' ends; null for an empty series.

    Pieces are spread over time bins of ``width``, so the range join is an equi-join on bins.
    """
    span = series.groupBy(key).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    asked = queries.join(span, key, "left").withColumn("u", F.least(F.greatest("q", "lo"), "hi"))
    pieces = intervals(series, [key]).withColumn("bin", F.explode(F.sequence(F.floor(F.col("t0") / width), F.floor(F.coalesce(F.col("t1") - 1, F.col("t0")) / width))))
    asked = asked.withColumn("bin", F.floor(F.col("u") / width))
    right = pieces.select(F.col(key).alias("p_key"), F.col("bin").alias("p_bin"), "t0", "l0", "t1", "l1")
    inside = (F.col(key) == F.col("p_key")) & (F.col("bin") == F.col("p_bin")) & (F.col("u") >= F.col("t0")) & (F.col("u") < F.coalesce("t1", F.col("t0") + 1))
    share = (F.col("u") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    return asked.join(right, inside, "left").select(*queries.columns, F.when(F.col("t1").isNull(), F.col("l0")).otherwise(F.col("l0") + share * (F.col("l1") - F.col("l0"))).alias("level"))


def best_window(days: DataFrame, key: list[str], value: str, length: int, day: str = "day") -> DataFrame:
    """The run of ``length`` consecutive rows with the largest sum of ``value``; the earliest of equal ones."""
    w = Window.partitionBy(*key).orderBy(day).rowsBetween(0, length - 1)
    sums = days.select(*key, day, F.sum(value).over(w).alias("total"), F.count(F.lit(1)).over(w).alias("n")).where(F.col("n") == length)
    return sums.groupBy(*key).agg(F.max("total").alias("total"), F.min_by(day, F.struct((-F.col("total")).alias("t"), day)).alias("start"))


def forecast(series: DataFrame, now: Column, hours: int = 168) -> DataFrame:
    """Points from now on for some hours, both ends included (now is a parameter, never the clock)."""
    return series.where((F.col("ts") >= now) & (F.col("ts") <= now + F.expr(f"interval {hours} hours")))


def level_bands(levels: DataFrame, h: str = "h", step: int = 50) -> DataFrame:
    """band, flooded, most: how many of ``levels`` a reading in each band of ``step`` reaches, for all bands from the lowest h to the
    highest (``most``); readings above that reach as many as it does. A row a step that occurs is all that one task orders."""
    steps = levels.where(F.col(h).isNotNull()).groupBy(F.floor(F.col(h) / step).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    up = Window.orderBy("band")
    until = F.coalesce(F.lead("band").over(up) - 1, F.col("band"))
    steps = steps.select("band", F.sum("n").over(up).alias("flooded"), until.alias("until"), F.max("band").over(Window.partitionBy(F.lit(0))).alias("most"))
    return steps.select(F.explode(F.sequence("band", "until")).alias("band"), "flooded", "most")
