"""Exact distances to the nearest seed of a grid: columns by windows, rows by the lower envelope of parabolas."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIELD = "row long, col long, d2 long, seed_row long, seed_col long"


def _envelope(cols: list[int], seeds: list[int | None], row: int) -> list[tuple[int, int, int] | None]:
    """For each column of a row (ascending) the least (x - c)^2 + (row - seed row of c)^2 over columns c, with c and that row;
    of equal ones the smaller column."""
    stack: list[tuple[int, int, int]] = []  # column, squared height, first column where it is the least, times nothing
    begins: list[float] = []
    for c, s in zip(cols, seeds, strict=True):
        if s is None:
            continue
        g = (row - s) ** 2
        while stack:
            c0, g0, _ = stack[-1]
            meet = ((g + c * c) - (g0 + c0 * c0)) / (2 * (c - c0))
            if len(stack) > 1 and meet <= begins[-1]:
                stack.pop()
                begins.pop()
                continue
            begins.append(meet)
            break
        else:
            begins.append(float("-inf"))
        stack.append((c, g, s))
    out: list[tuple[int, int, int] | None] = []
    k = 0
    for x in cols:
        if not stack:
            out.append(None)
            continue
        while k + 1 < len(stack) and begins[k + 1] < x:
            k += 1
        c, g, s = stack[k]
        out.append(((x - c) ** 2 + g, s, c))
    return out


def seed_field(cells: DataFrame, seed: str = "seed") -> DataFrame:
    """row, col, d2, seed_row, seed_col: the squared distance in cells of every cell to its nearest seed, and that seed (null
    without any). Of equally near seeds the one in the smaller column counts, then the smaller row.

    A task holds a row of the grid or passes along a column; there is no radius and no search.
    """
    down = Window.partitionBy("col").orderBy("row")
    own = F.when(F.col(seed), F.col("row"))
    above = F.last(own, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(own, ignorenulls=True).over(down.rowsBetween(0, Window.unboundedFollowing))
    near = cells.select("row", "col", above.alias("above"), below.alias("below"))
    first = F.col("below").isNull() | (F.col("row") - F.col("above") <= F.col("below") - F.col("row"))
    near = near.select("row", "col", F.when(F.col("above").isNotNull() & first, F.col("above")).otherwise(F.col("below")).alias("s"))

    def along(table: pa.Table) -> pa.Table:
        table = table.sort_by("col")
        row, cols = table.column("row")[0].as_py(), table.column("col").to_pylist()
        found = _envelope(cols, table.column("s").to_pylist(), row)
        d2, s, c = ([None if f is None else f[i] for f in found] for i in range(3))
        return pa.table({"row": pa.array([row] * len(cols), pa.int64()), "col": pa.array(cols, pa.int64()), "d2": pa.array(d2, pa.int64()), "seed_row": pa.array(s, pa.int64()), "seed_col": pa.array(c, pa.int64())})

    return near.groupBy("row").applyInArrow(along, FIELD)


def without_gaps(cells: DataFrame, seed: str = "seed") -> DataFrame:
    """row, col, seed: the cells of a grid, and one more wherever a row of its range crosses a column with seeds, so that
    ``seed_field`` finds the seeds of every column in every row."""
    ends = cells.agg(F.min("row").alias("lo"), F.max("row").alias("hi"))
    columns = cells.where(F.col(seed)).select("col").distinct()
    more = columns.join(F.broadcast(ends), F.lit(True)).select(F.explode(F.sequence("lo", "hi")).alias("row"), "col", F.lit(False).alias(seed))  # one row
    return cells.select("row", "col", seed).unionByName(more).groupBy("row", "col").agg(F.max(seed).alias(seed))


def within(cells: DataFrame, mask: str, radius: float) -> DataFrame:
    """row, col, grown: the mask grown by a disk of ``radius`` cells."""
    field = seed_field(cells, mask)
    return field.select("row", "col", F.coalesce(F.col("d2") <= radius * radius, F.lit(False)).alias("grown"))


def gradient(field: DataFrame) -> DataFrame:
    """row, col, d, d_row, d_col: the distance and its central differences, one-sided at the grid's edge."""
    d = field.select("row", "col", F.sqrt("d2").alias("d"))
    out = d
    for name, a, b in (("d_row", 1, 0), ("d_col", 0, 1)):
        after = d.select((F.col("row") - a).alias("row"), (F.col("col") - b).alias("col"), F.col("d").alias("after"))
        before = d.select((F.col("row") + a).alias("row"), (F.col("col") + b).alias("col"), F.col("d").alias("before"))
        out = out.join(after, ["row", "col"], "left").join(before, ["row", "col"], "left")
        both = F.col("after").isNotNull() & F.col("before").isNotNull()
        slope = (F.coalesce("after", "d") - F.coalesce("before", "d")) / F.when(both, 2.0).otherwise(1.0)
        out = out.withColumn(name, slope).drop("after", "before")
    return out


def first_section(levels: DataFrame, field: DataFrame, inland: float, cell: float, sea: float, land: float) -> DataFrame:
    """row, col, from_x, from_y, to_x, to_y: the line through the first of the lowest cells (row, col, h) that lie more than ``inland``
    cells from a seed, along the gradient of the distance: ``sea`` metres against it and ``land`` metres on; northwards where it has none.

    x and y are metres from the grid's upper left corner, y growing to the north. No cell inland gives no row.
    """
    slopes = gradient(field)
    low = levels.where(F.col("h").isNotNull()).join(slopes, ["row", "col"]).where(F.col("d") > inland)
    at = low.agg(F.min(F.struct("h", "row", "col", "d_row", "d_col")).alias("f")).where("f IS NOT NULL").select("f.*")
    n = F.hypot("d_col", "d_row")
    flat = F.coalesce(n < 1e-9, F.lit(True))
    east, north = F.when(flat, 0.0).otherwise(F.col("d_col") / n), F.when(flat, 1.0).otherwise(-F.col("d_row") / n)
    x, y = (F.col("col") + 0.5) * cell, (F.col("row") + 0.5) * -cell
    line = {"from_x": x - east * sea, "from_y": y - north * sea, "to_x": x + east * land, "to_y": y + north * land}
    return at.select("row", "col", *(F.round(v, 1).alias(k) for k, v in line.items()))
