"""Readers of the text formats: fixed-width tide tables, census tables, elevation text tiles, feature collections, city models."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a tide line (fixed values): 24 hourly heights of 3 characters, then YY MM DD and the station.
HOURS, HEIGHT_WIDTH, DATE_AT, STATION_AT, CENTURY_PIVOT = 24, 3, 73, 79, 50


def two_digit_year(year: Column) -> Column:
    return F.when(year < CENTURY_PIVOT, year + 2000).otherwise(year + 1900)


def tide_lines(lines: DataFrame, station: str, strict: bool = False) -> DataFrame:
    """day, hour, cm from fixed-width lines (column ``value``) of a station.

    Lines of other stations or of too few characters are skipped. Blank heights are skipped; with ``strict`` they
    count as 0 and a line with any height that is no number is rejected as a whole.
    """
    text = F.col("value")
    field = lambda i: F.trim(F.substring(text, 1 + i * HEIGHT_WIDTH, HEIGHT_WIDTH))
    cm = F.array(*(field(i) for i in range(HOURS)))
    date = [F.trim(F.substring(text, DATE_AT + 2 * k, 2)).try_cast("int") for k in range(3)]
    day = F.try_make_timestamp(two_digit_year(date[0]), date[1], date[2], F.lit(0), F.lit(0), F.lit(0)).cast("date") if hasattr(F, "try_make_timestamp") else F.make_date(two_digit_year(date[0]), date[1], date[2])
    rows = lines.where((F.length(text) >= STATION_AT + len(station) - 1) & (F.substring(text, STATION_AT, len(station)) == station)).select(day.alias("day"), cm.alias("cm")).where("day is not null")
    if strict:
        rows = rows.withColumn("cm", F.transform("cm", lambda x: F.when(x == "", "0").otherwise(x))).where(F.forall("cm", lambda x: x.try_cast("int").isNotNull()))
    return rows.select("day", F.posexplode("cm").alias("hour", "cm")).select("day", "hour", F.col("cm").try_cast("int").alias("cm")).where("cm is not null")


def census_table(spark: SparkSession, path: str, encoding: str = "cp932") -> DataFrame:
    """Raw rows (line number, fields) of delimited files in an encoding that the CSV reader does not take.

    Files are read whole as binary rows and decoded by the tasks, a file at a time.
    """
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import io

        for batch in batches:
            for content in batch["content"]:
                rows = list(csv.reader(io.StringIO(bytes(content).decode(encoding).lstrip("﻿"))))
                yield pd.DataFrame({"line": range(len(rows)), "fields": rows})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, "line int, fields array<string>")


def census_values(rows: DataFrame, names: list[str], header_lines: int = 2) -> DataFrame:
    """key and integer columns: 'X' is suppressed (null), '-' is 0, other texts are an error; short rows and totals
    (empty key) are dropped. ``suppressed`` if any of the first four values is null; age_unknown is the residual."""
    def number(x: Column) -> Column:
        return F.when(x == "X", F.lit(None)).when(x == "-", F.lit(0)).when(x.try_cast("long").isNotNull(), x.try_cast("long")).otherwise(F.raise_error(F.concat(F.lit("not a count: "), x)).cast("long"))

    good = rows.where((F.col("line") >= header_lines) & (F.size("fields") >= len(names) + 1) & (F.trim(F.col("fields")[0]) != ""))
    out = good.select(F.trim(F.col("fields")[0]).alias("key"), *(number(F.trim(F.col("fields")[i + 1])).alias(n) for i, n in enumerate(names)))
    some = F.lit(False)
    for n in names[:4]:
        some = some | F.col(n).isNull()
    rest = F.col(names[0]) - sum((F.col(n) for n in names[1:4]), F.lit(0))
    return out.withColumns({"suppressed": some, "age_unknown": rest})


def elevation_tile(lines: DataFrame) -> DataFrame:
    """row, col, metres of comma-separated elevation rows (row, value); 'e' is no data."""
    cells = lines.select("row", F.posexplode(F.split("value", ",")).alias("col", "text"))
    return cells.select("row", "col", F.when(F.trim("text") != "e", F.col("text").try_cast("double")).alias("metres"))


def positions(text: Column, size: int = 3) -> Column:
    """White-space separated numbers as arrays of ``size``."""
    numbers = F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.cast("double"))
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(numbers) / size).cast("int") - 1), lambda i: F.slice(numbers, i * size + 1, F.lit(size)))


def outer_rings(rings: Column, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """Rings of at least four (lat, lon, z) positions whose box meets a box, as lon, lat, z."""
    turned = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[1].alias("x"), p[0].alias("y"), p[2].alias("z"))))
    axis = lambda r, k: F.transform(r, lambda p: p[k])
    meets = lambda r: (F.array_min(axis(r, "x")) <= xmax) & (F.array_max(axis(r, "x")) >= xmin) & (F.array_min(axis(r, "y")) <= ymax) & (F.array_max(axis(r, "y")) >= ymin)
    return F.filter(turned, lambda r: (F.size(r) >= 4) & meets(r))


CITY_SCHEMA = "_id string, usage string, measuredHeight double, storeysAboveGround int, lod0RoofEdge string, lod1Solid string, function string, sectionType string, lod1MultiSurface string"


def city_objects(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Buildings or roads of city-model XML: an id, attributes and the ring text (roof edge, else solid, else surface)."""
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(CITY_SCHEMA).load(path)
    ring = F.coalesce("lod0RoofEdge", "lod1Solid", "lod1MultiSurface")
    return raw.select(F.col("_id").alias("gml_id"), "usage", "measuredHeight", "storeysAboveGround", "function", "sectionType", positions(ring).alias("ring"))


def feature_collection(spark: SparkSession, path: str, crs: str) -> DataFrame:
    """properties (map) and geometry (JSON text) of GeoJSON features; another CRS is an error; unreliable ones go."""
    raw = spark.read.option("multiLine", True).schema("crs struct<properties: struct<name: string>>, features array<struct<properties: map<string, string>, geometry: string>>").json(path)
    checked = raw.select(F.assert_true(F.coalesce(F.col("crs.properties.name") == crs, F.lit(False)), F.lit(f"the CRS is not {crs}")).alias("ok"), F.explode("features").alias("f"))
    return checked.where("ok is null").select("f.properties", "f.geometry").where(F.coalesce(F.col("properties")["unreliable"], F.lit("false")) != "true")


def pits_of(features: DataFrame) -> DataFrame:
    """pit_id, x, y, spill, area in m2 of pit features: the spill level from the properties, else the point's height."""
    point = F.from_json("geometry", "coordinates array<double>")["coordinates"]
    p = F.col("properties")
    return features.select(p["pit_id"].cast("int").alias("pit_id"), point[0].alias("x"), point[1].alias("y"), F.coalesce(p["spill_elev_m_tp"].cast("double"), F.get(point, F.lit(2))).alias("spill"), (p["area_ha"].cast("double") * 10000).alias("area"))


def point_buffer(text: Column) -> Column:
    """Sections of a circle summary with defaults for what is missing."""
    return F.from_json(text, "id string, lon double, lat double, radii map<string, struct<pop: bigint, buildings: bigint, roads: bigint>>")
