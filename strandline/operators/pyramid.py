"""Pyramids of byte tiles: heights and connecting levels as four bytes a pixel, all zooms in one pass over the cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import codec


def pyramid(cells: DataFrame, zooms: int, side: int = 256) -> DataFrame:
    """zoom, ty, tx, pixels: ``side`` squared pixels by row, each r, g, b (height) and a (connecting level) of one cell.

    ``cells`` has row, col, elev and h in mm. A pixel of zoom z stands for 2^z by 2^z cells and shows the one at (or just beyond)
    their middle; cells without data or not there are zero bytes. Tiles without any data are left out.
    """
    steps = F.array(*(F.when((F.col("row") % (1 << z) == (1 << z) // 2) & (F.col("col") % (1 << z) == (1 << z) // 2), F.lit(z)) for z in range(zooms)))
    at = cells.withColumn("zoom", F.explode(F.array_compact(steps)))
    size = F.pow(F.lit(2.0), F.col("zoom"))
    row, col = F.floor(F.col("row") / size), F.floor(F.col("col") / size)
    height, level = codec.pack_height(F.col("elev") / 1000.0), codec.pack_level(F.col("h") / 1000.0)
    byte = lambda v: F.lpad(F.hex(v), 2, "0")
    pixel = at.select("zoom", F.floor(row / side).alias("ty"), F.floor(col / side).alias("tx"), (row % side * side + col % side).cast("int").alias("place"), height.alias("p"), level.alias("a"), (F.col("elev").isNotNull() | F.col("h").isNotNull()).alias("data"))
    pixel = pixel.select("zoom", "ty", "tx", "data", F.struct("place", F.concat(byte(F.col("p.r")), byte(F.col("p.g")), byte(F.col("p.b")), byte(F.col("a"))).alias("v")).alias("pixel"))
    tiles = pixel.where("data").groupBy("zoom", "ty", "tx").agg(F.map_from_entries(F.collect_list("pixel")).alias("pixels"))  # a tile's
    whole = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.coalesce(F.try_element_at("pixels", i), F.lit("00000000")))
    return tiles.select("zoom", "ty", "tx", F.unhex(F.array_join(whole, "")).alias("pixels"))


def unpacked(tiles: DataFrame, side: int = 256) -> DataFrame:
    """zoom, row, col, elev, h (mm) of the pixels of tiles that show data."""
    at = tiles.select("zoom", "ty", "tx", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.hex(F.substring("pixels", i * 4 + 1, F.lit(4))))).alias("place", "v"))
    part = lambda k: F.conv(F.substring("v", 2 * k + 1, 2), 16, 10).cast("long")
    elev, h = codec.unpack_height(part(0), part(1), part(2)), codec.unpack_level(part(3))
    place = [(F.col("ty") * side + F.floor(F.col("place") / side)).alias("row"), (F.col("tx") * side + F.col("place") % side).alias("col")]
    return at.where("v <> '00000000'").select("zoom", *place, F.round(elev * 1000, 0).cast("long").alias("elev"), F.round(h * 1000, 0).cast("long").alias("h"))
