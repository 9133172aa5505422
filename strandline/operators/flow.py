"""Surface flow on grids: filled heights, steepest directions, accumulation, basins and pits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.iterate import checkpointed, components
from strandline.operators.order import numbered
from strandline.operators.raster import EIGHT, least_levels, neighbours


def outlets(cells: DataFrame) -> DataFrame:
    """Cells with data at the grid's border or beside a cell without data."""
    ends = cells.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    around = neighbours(cells.where(F.col("elev").isNotNull()), EIGHT).groupBy("row", "col").agg(F.count("n_elev").alias("around"))
    out = cells.where(F.col("elev").isNotNull()).join(around, ["row", "col"], "left").join(F.broadcast(ends), F.lit(True))
    border = (F.col("row") == F.col("r0")) | (F.col("row") == F.col("r1")) | (F.col("col") == F.col("c0")) | (F.col("col") == F.col("c1"))
    return out.select("row", "col", "elev", (border | (F.coalesce("around", F.lit(0)) < 8)).alias("outlet"))


def filled(cells: DataFrame, tile: int = 256) -> DataFrame:
    """row, col, elev, fill: the least level at which water leaves a cell over its eight neighbours (at least elev)."""
    flagged = outlets(cells).select("row", "col", "elev", F.when(F.col("outlet"), F.col("elev").cast("double")).alias("h"))
    levels = least_levels(flagged, quantised=False, connectivity=8, tile=tile)
    return levels.select("row", "col", F.col("elev").cast("long").alias("elev"), F.greatest("h", "elev").cast("long").alias("fill"))


def directions(cells: DataFrame, value: str = "elev") -> DataFrame:
    """row, col, value, to_row, to_col: the steepest lower neighbour, ties in the order of EIGHT; null for sinks."""
    near = neighbours(cells.where(F.col(value).isNotNull()).select("row", "col", value), EIGHT, value)
    length = F.when(F.col("k") < 4, 1.0).otherwise(math.sqrt(2))
    slope = (F.col(value) - F.col(f"n_{value}")) / length
    best = near.where(slope > 0).groupBy("row", "col").agg(F.max_by(F.struct("n_row", "n_col"), F.struct(slope.alias("s"), (-F.col("k")).alias("k"))).alias("n"))
    return cells.where(F.col(value).isNotNull()).select("row", "col", value).join(best, ["row", "col"], "left").select("row", "col", value, F.col("n.n_row").alias("to_row"), F.col("n.n_col").alias("to_col"))


#: Facets as (side, corner) offsets in the order that decides ties (fixed values of the method).
FACETS = (((0, 1), (-1, 1)), ((-1, 0), (-1, 1)), ((-1, 0), (-1, -1)), ((0, -1), (-1, -1)), ((0, -1), (1, -1)), ((1, 0), (1, -1)), ((1, 0), (1, 1)), ((0, 1), (1, 1)))


def facet_directions(cells: DataFrame, value: str = "elev") -> DataFrame:
    """Two receivers and their shares by the steepest of eight triangular facets (angles clamped to the facet)."""
    near = neighbours(cells.where(F.col(value).isNotNull()).select("row", "col", value), EIGHT, value)
    around = near.groupBy("row", "col", value).agg(F.map_from_entries(F.collect_list(F.struct("k", f"n_{value}"))).alias("z"))  # at most 8
    e0, facets = F.col(value), []
    for side, corner in FACETS:
        e1, e2 = (F.try_element_at("z", F.lit(EIGHT.index(o))) for o in (side, corner))
        s1, s2 = e0 - e1, e1 - e2
        angle = F.atan2(s2.cast("double"), s1.cast("double"))
        clamped = F.least(F.greatest(angle, F.lit(0.0)), F.lit(math.pi / 4))
        slope = F.when(angle < 0, s1.cast("double")).when(angle > math.pi / 4, (e0 - e2) / math.sqrt(2)).otherwise(F.hypot(s1, s2))
        point = lambda o: F.struct((F.col("row") + o[0]).alias("row"), (F.col("col") + o[1]).alias("col"))
        share = clamped / (math.pi / 4)
        facets.append(F.when(e1.isNotNull() & e2.isNotNull() & (slope > 0), F.struct(slope.alias("slope"), (-F.lit(len(facets))).alias("order"), point(side).alias("to1"), (1 - share).alias("p1"), point(corner).alias("to2"), share.alias("p2"))))
    return around.withColumn("f", F.array_max(F.array(*facets))).select("row", "col", value, "f.slope", F.col("f.to1").alias("to1"), F.col("f.p1").alias("p1"), F.col("f.to2").alias("to2"), F.col("f.p2").alias("p2"))


def accumulated(edges: DataFrame, weights: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """node, acc: own weight plus all that flows in along edges (a, b, share) of an acyclic graph.

    Parcels move one edge a round and meet by aggregation, so a round has at most one row a node.
    """
    moving = checkpointed(weights.select("node", F.col("w").cast("double")))
    edges = checkpointed(edges)
    total = moving
    for i in range(most_rounds):
        moving = checkpointed(moving.join(edges, moving.node == edges.a).groupBy(F.col("b").alias("node")).agg(F.sum(F.col("w") * F.col("share")).alias("w")))
        if not moving.limit(1).count():
            return total.groupBy("node").agg(F.sum("w").alias("acc"))
        total = total.unionByName(moving)
        if i % 8 == 7:
            total = checkpointed(total.groupBy("node").agg(F.sum("w").alias("w")))
    raise RuntimeError("the graph has a cycle or a longer path than allowed")


def accumulated_paths(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """node, acc like ``accumulated`` where at most one edge (a, b) leaves a node and takes all: jumps double, so rounds
    grow with the logarithm of the longest path. After a round acc holds what comes from less than 2^round edges away."""
    jump = checkpointed(edges.select("a", "b"))
    most, step = jump.count() + 1, 1
    acc = checkpointed(weights.groupBy("node").agg(F.sum(F.col("w").cast("double")).alias("acc")))
    while step <= 2 * most:
        if not jump.limit(1).count():
            return acc
        far = acc.join(jump, F.col("node") == F.col("a")).select(F.col("b").alias("node"), "acc")
        acc = checkpointed(acc.unionByName(far).groupBy("node").agg(F.sum("acc").alias("acc")))
        jump = checkpointed(jump.join(jump.select(F.col("a").alias("b"), F.col("b").alias("far")), "b").select("a", F.col("far").alias("b")))
        step *= 2
    raise RuntimeError("the graph has a cycle")


def terminals(edges: DataFrame, nodes: DataFrame, most_rounds: int = 64) -> DataFrame:
    """node, root: the end of each node's path along single edges (a, b), by pointer doubling."""
    jump = checkpointed(nodes.select("node").join(edges.select(F.col("a").alias("node"), "b"), "node", "left").select("node", F.coalesce("b", "node").alias("root")))
    for _ in range(most_rounds):
        far = jump.select(F.col("node").alias("root"), F.col("root").alias("far"))
        now = checkpointed(jump.join(far, "root").select("node", F.col("root").alias("was"), F.col("far").alias("root")))
        jump = now.select("node", "root")
        if not now.where("was <> root").limit(1).count():
            return jump
    raise RuntimeError("the graph has a cycle")


def pits(fill: DataFrame, least: int = 10) -> DataFrame:
    """row, col, elev, fill, pit: components (8 neighbours) of cells filled by more than ``least`` mm; pit is the
    rank of a component's first cell in row-major order."""
    wet = fill.where(F.col("fill") - F.col("elev") > least).withColumn("node", F.col("row") * 1_000_000_000 + F.col("col"))
    pairs = neighbours(wet.select("row", "col", "node"), EIGHT, "node").where("node < n_node")
    roots = components(wet.select("node"), pairs.select(F.col("node").alias("a"), F.col("n_node").alias("b")))
    numbers = numbered(roots.select("root").distinct(), [F.col("root")], "pit")
    return wet.join(roots, "node").join(numbers, "root").select("row", "col", "elev", "fill", "pit")


def pit_stats(pit_cells: DataFrame, cell_area: float) -> DataFrame:
    depth = F.col("fill") - F.col("elev")
    return pit_cells.groupBy("pit").agg(
        (F.count(F.lit(1)) * cell_area).alias("area"), F.max(depth).alias("depth"), F.sum(depth).alias("volume"), F.max("fill").alias("spill"), F.max("elev").alias("top"), F.min("elev").alias("bottom"),
    )


def pour_points(pit_cells: DataFrame, cells: DataFrame) -> DataFrame:
    """For each pit the rim cell nearest to the spill level with the lowest cell outside it; ties by position."""
    rim = neighbours_of(pit_cells.select("row", "col", "pit", "fill"), cells)
    inside = pit_cells.select(F.col("row").alias("n_row"), F.col("col").alias("n_col"), F.col("pit").alias("n_pit"))
    rim = rim.join(inside, ["n_row", "n_col"], "left").where(F.col("n_pit").isNull() | (F.col("n_pit") != F.col("pit")))
    order = F.struct(F.abs(F.col("n_elev") - F.col("fill")).alias("d"), F.col("n_elev").alias("z"), "row", "col")
    return rim.groupBy("pit").agg(F.min_by(F.struct("row", "col", F.col("n_elev").alias("outside")), order).alias("p")).select("pit", "p.row", "p.col", "p.outside")


def neighbours_of(some: DataFrame, cells: DataFrame) -> DataFrame:
    """Neighbours with data (n_row, n_col, n_elev) of some cells."""
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in EIGHT))
    out = some.withColumn("s", F.explode(steps)).withColumns({"n_row": F.col("row") + F.col("s.a"), "n_col": F.col("col") + F.col("s.b")}).drop("s")
    return out.join(cells.where(F.col("elev").isNotNull()).select(F.col("row").alias("n_row"), F.col("col").alias("n_col"), F.col("elev").alias("n_elev")), ["n_row", "n_col"])


def border_lengths(labels: DataFrame) -> DataFrame:
    """a, b, n: how many cell sides two labels share (4 neighbours)."""
    pairs = neighbours(labels, ((0, 1), (1, 0)), "label").where(F.col("label") != F.col("n_label"))
    return pairs.groupBy(F.least("label", "n_label").alias("a"), F.greatest("label", "n_label").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def drain_order(cells: DataFrame, column: str) -> DataFrame:
    """cells with their place: highest first, then by row and column."""
    return numbered(cells, [F.desc(column), F.col("row"), F.col("col")], "place")
