"""Walking networks: graphs from lines, bounded shortest paths, partly reached edges, upstream closures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import distance, polygons
from strandline.operators.iterate import checkpointed


def edge_table(edges: DataFrame) -> DataFrame:
    """i < j with the least weight; loops are dropped."""
    return edges.where("i <> j").groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.min("w").alias("w"))


def snapped_graph(points: DataFrame, tolerance: float) -> DataFrame:
    """Edges between snapped nodes of polylines (line, seq, x, y): i, j as 'gx:gy' keys, w the distance of the grid nodes."""
    node = F.concat_ws(":", *(F.bround(F.col(k) / tolerance, 0).cast("long").cast("string") for k in ("x", "y")))
    along = Window.partitionBy("line").orderBy("seq")
    snapped = points.select("line", "seq", node.alias("i"), *((F.bround(F.col(k) / tolerance, 0) * tolerance).alias(f"s{k}") for k in ("x", "y")))
    pairs = snapped.withColumns({"j": F.lead("i").over(along), "tx": F.lead("sx").over(along), "ty": F.lead("sy").over(along)}).where("j is not null")
    return edge_table(pairs.select("i", "j", F.hypot(F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy")).alias("w")))


def shortest(edges: DataFrame, sources: DataFrame, most: float, most_rounds: int = 10_000) -> DataFrame:
    """node, d: least cost from sources (node, d) along edges (i, j, w) up to ``most``.

    A source beyond the bound keeps its cost but is not followed. Only nodes whose cost fell are followed in the
    next round, and candidates meet by aggregation.
    """
    both = checkpointed(edges.select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("w").cast("double")).unionByName(edges.select(F.col("j").alias("a"), F.col("i").alias("b"), F.col("w").cast("double"))))
    best = checkpointed(sources.groupBy("node").agg(F.min("d").cast("double").alias("d")))
    front = best
    for _ in range(most_rounds):
        step = front.where(F.col("d") <= most).join(both, front.node == both.a).groupBy(F.col("b").alias("node")).agg(F.min(F.col("d") + F.col("w")).alias("n"))
        now = best.join(step.where(F.col("n") <= most), "node", "full").select("node", F.least("d", "n").alias("d"), F.coalesce(F.col("n") < F.col("d"), F.col("n").isNotNull()).alias("fell"))
        now = checkpointed(now)
        best, front = now.select("node", "d"), now.where("fell").select("node", "d")
        if not front.limit(1).count():
            return best
    raise RuntimeError("paths did not settle")


def reached_edges(edges: DataFrame, reach: DataFrame, most: float) -> DataFrame:
    """i, j, w, from_i, from_j: the share of an edge that is reached from either end; whole edges have 1 and 0. Edges without
    length are whole if an end is reached."""
    a, b = (reach.select(F.col("node").alias(k), F.col("d").alias(f"d{k}")) for k in ("i", "j"))
    out = edges.join(a, "i", "left").join(b, "j", "left")
    share = lambda d: F.when(F.col("w") != 0, F.try_divide(most - F.col(d), F.col("w"))).when(F.col(d) <= most, 1.0)
    part = lambda d: F.least(F.greatest(F.coalesce(share(d), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    out = out.withColumns({"fi": part("di"), "fj": part("dj")}).where("fi > 0 or fj > 0")
    whole = F.col("fi") + F.col("fj") >= 1
    return out.select("i", "j", "w", F.when(whole, 1.0).otherwise(F.col("fi")).alias("from_i"), F.when(whole, 0.0).otherwise(F.col("fj")).alias("from_j"))


def upstream(down: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node: everything that drains to a start over downstream links (node, to; one a node), the start included.

    Jumps double: after a round the parts hold all that is less than 2^round links away, so rounds grow with the logarithm of
    the longest path and no row is written twice.
    """
    jump = checkpointed(down.select("node", "to"))
    most, step = jump.count() + 1, 1
    parts = [checkpointed(starts.select(F.col("node").alias("start"), "node").distinct())]
    while step <= 2 * most:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        far = checkpointed(out.join(jump, F.col("to") == out["node"]).select("start", jump["node"]))
        if not far.limit(1).count():
            return out
        parts.append(far)
        jump = checkpointed(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to")))
        step *= 2
    raise RuntimeError("the links have a cycle")


def main_channel(donors: DataFrame, starts: DataFrame) -> DataFrame:
    """start, i, node: from each start upwards, always to the donor (a flows to b) with the most accumulation ``acc``,
    ties to the smaller ``k``. Jumps double, so rounds grow with the logarithm of the longest channel."""
    jump = checkpointed(donors.groupBy(F.col("b").alias("node")).agg(F.max_by("a", F.struct("acc", (-F.col("k")).alias("k"))).alias("up")))
    most, step = jump.count() + 1, 1
    out = checkpointed(starts.select(F.col("node").alias("start"), F.lit(0).cast("long").alias("i"), "node"))
    while step <= 2 * most:
        far = checkpointed(out.join(jump, "node").select("start", (F.col("i") + step).alias("i"), F.col("up").alias("node")))
        if not far.limit(1).count():
            return out.withColumn("i", F.col("i").cast("int"))
        out = checkpointed(out.unionByName(far))
        jump = checkpointed(jump.join(jump.select(F.col("node").alias("up"), F.col("up").alias("far")), "up").select("node", F.col("far").alias("up")))
        step *= 2
    raise RuntimeError("a channel has a cycle")


def isochrone_outline(parts: DataFrame, cell: float, radius: float) -> DataFrame:
    """label, shell, ring, area, place, row, col: the outline, in metres (row: y, col: x), of all within ``radius`` of the reached
    parts of streets (x1, y1, x2, y2), on a grid of ``cell`` metres.

    Streets become cells by points half a cell apart, the field of distances to them is exact, and only cells near streets exist.
    """
    steps = F.greatest(F.ceil(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / (cell / 2)), F.lit(1)).cast("int")
    at = parts.withColumn("n", steps).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    on = lambda a, b: F.floor((F.col(a) + (F.col(b) - F.col(a)) * F.col("i") / F.col("n")) / cell).cast("long")
    seeds = checkpointed(at.select(on("y1", "y2").alias("row"), on("x1", "x2").alias("col")).distinct())
    reach = int(radius // cell) + 1
    near = F.sequence(F.lit(-reach), F.lit(reach))
    tall = seeds.withColumn("d", F.explode(near)).select((F.col("row") + F.col("d")).alias("row"), "col").distinct()
    grid = tall.withColumn("d", F.explode(near)).select("row", (F.col("col") + F.col("d")).alias("col")).distinct()
    grid = grid.join(seeds.withColumn("seed", F.lit(True)), ["row", "col"], "left").withColumn("seed", F.coalesce("seed", F.lit(False)))
    low = grid.agg(F.min("row"), F.min("col")).first()  # rings number their cells from 0
    down, right = (low[0], low[1]) if low[0] is not None else (0, 0)
    grown = distance.within(grid, "seed", radius / cell).where("grown").select((F.col("row") - down).alias("row"), (F.col("col") - right).alias("col"), F.lit(1).alias("v"))
    rings = polygons.outlines(checkpointed(grown), "v")
    return rings.withColumns({"row": (F.col("row") + down) * cell, "col": (F.col("col") + right) * cell, "area": F.col("area") * cell * cell})
