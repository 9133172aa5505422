"""Tile codecs: heights, connection levels and flow as four bytes a cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET, PER_METRE, LEVEL_STEP, FILL_LEAST = 32768.0, 256, 0.05, 0.01


def pack_height(metres: Column) -> Column:
    """r, g, b: 1/256 m above -32768 m; all zero for no data."""
    v = F.when(metres.isNotNull() & ~F.isnan(metres), F.floor((metres + OFFSET) * PER_METRE)).otherwise(0).cast("long")
    return F.struct(F.shiftright(v, 16).bitwiseAND(255).alias("r"), F.shiftright(v, 8).bitwiseAND(255).alias("g"), v.bitwiseAND(255).alias("b"))


def unpack_height(r: Column, g: Column, b: Column) -> Column:
    v = r * 65536 + g * 256 + b
    return F.when(v != 0, v / float(PER_METRE) - OFFSET)


def pack_level(metres: Column) -> Column:
    """Alpha: the sweep's step + 1, 0 for never reached."""
    return F.when(metres.isNotNull(), F.least(F.greatest(F.bround(metres / LEVEL_STEP, 0) + 1, F.lit(1.0)), F.lit(255.0))).otherwise(0.0).cast("long")


def unpack_level(a: Column) -> Column:
    return F.when(a > 0, F.bround((a - 1) * LEVEL_STEP, 2))


def pack_accumulation(cells: Column, most: Column) -> Column:
    return F.bround(255 * F.log1p(cells) / F.log1p(F.greatest(most, F.lit(1.0))), 0).cast("long")


def unpack_accumulation(r: Column, most: Column) -> Column:
    return F.expm1(r / 255.0 * F.log1p(F.greatest(most, F.lit(1.0))))


def pack_fill(metres: Column) -> Column:
    """The sweep's step + 1 of a fill depth above 1 cm, else 0."""
    return F.when(metres > FILL_LEAST, pack_level(metres)).otherwise(0).cast("long")
