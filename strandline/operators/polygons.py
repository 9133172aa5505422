"""Joins of points, lines and polygons by position: inside, within a distance, shared area with a circle, burnt cells.

Shapes are arrays of vertices (structs x, y). Every join is an equi-join on the grid bins that the shapes' boxes meet,
with the exact predicate on what shares a bin.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import geo
from strandline.operators.iterate import checkpointed, components
from strandline.operators.spatial import bin_of, bins_of_box


def box_of(shape: Column, margin: float = 0.0) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(shape, lambda v: v["x"]), F.transform(shape, lambda v: v["y"])
    return F.array_min(xs) - margin, F.array_min(ys) - margin, F.array_max(xs) + margin, F.array_max(ys) + margin


def within_rings(points: DataFrame, zones: DataFrame, size: float) -> DataFrame:
    """Pairs of points (x, y) and zones (ring) with the point inside the ring, its boundary excluded."""
    left = points.withColumn("bin", bin_of(F.col("x"), F.col("y"), size))
    right = zones.withColumn("bin", F.explode(bins_of_box(*box_of(F.col("ring")), size)))
    return left.join(right, "bin").where(geo.strictly_inside(F.col("x"), F.col("y"), F.col("ring"))).drop("bin")


def burnt(zones: DataFrame, margin: float = 0.0) -> DataFrame:
    """row, col, d and the zone's columns for the cells (unit squares) whose centre is in a zone's ring (d = 0) or no
    further than ``margin`` from it."""
    xmin, ymin, xmax, ymax = box_of(F.col("ring"), margin)
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo - 0.5).cast("long"), F.ceil(hi).cast("long")))
    out = zones.withColumn("col", span(xmin, xmax)).withColumn("row", span(ymin, ymax))
    x, y = F.col("col") + 0.5, F.col("row") + 0.5
    inside = geo.in_ring(x, y, F.col("ring"))
    if margin <= 0:  # centres on a ring's right and upper edges are outside
        return out.where(inside).withColumn("d", F.lit(0.0))
    return out.withColumn("d", F.when(inside, 0.0).otherwise(geo.path_distance(x, y, geo.edges(F.col("ring"))))).where(F.col("d") <= margin)


def shapes_within(left: DataFrame, right: DataFrame, distance: float, left_key: str, right_key: str) -> DataFrame:
    """left_key, right_key, d: pairs of shapes (left: shape, right: other; arrays of segments a, b) that are no further
    apart than ``distance``; touching and crossing ones have 0. A pair may share several bins and is compared once."""
    size = F.lit(float(max(distance, 1.0)) * 2)

    def binned(df: DataFrame, key: str, shape: str, margin: float) -> DataFrame:
        ends = F.flatten(F.transform(shape, lambda e: F.array(e["a"], e["b"])))
        return df.select(key, F.explode(bins_of_box(*box_of(ends, margin), size)).alias("bin"))

    pairs = binned(left, left_key, "shape", distance).join(binned(right, right_key, "other", 0.0), "bin").select(left_key, right_key).distinct()
    both = pairs.join(left.select(left_key, "shape"), left_key).join(right.select(right_key, "other"), right_key)
    return both.withColumn("d", geo.paths_distance(F.col("shape"), F.col("other"))).where(F.col("d") <= distance).select(left_key, right_key, "d")


def counts_within(left: DataFrame, right: DataFrame, distances: Sequence[int], left_key: str, right_key: str) -> DataFrame:
    """left_key, n<k> for each of the ``distances``: how many right shapes are no further than k from a left one, which has a row if
    that is so for the largest k. Shapes that are alike are compared once and counted as often as they come."""
    one = checkpointed(left.groupBy("shape").agg(F.min(left_key).alias("l_one")))
    others = checkpointed(right.groupBy("other").agg(F.min(right_key).alias("r_one"), F.count(F.lit(1)).alias("n")))
    pairs = shapes_within(one.hint("merge"), others.hint("merge"), max(distances), "l_one", "r_one").join(others.select("r_one", "n").hint("merge"), "r_one")
    counts = pairs.groupBy("l_one").agg(*(F.sum(F.when(F.col("d") <= k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in distances))
    found = one.hint("merge").join(counts, "l_one").drop("l_one")
    return left.select(left_key, "shape").join(found.hint("merge"), "shape").groupBy(left_key).agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in distances))


def circle_shares(zones: DataFrame, cx: float, cy: float, radius: float) -> DataFrame:
    """Zones (ring) with the exact area that they share with a circle (overlap) and its share of the zone (fraction)."""
    out = zones.where(geo.box_distance(F.lit(cx), F.lit(cy), *box_of(F.col("ring"))) < radius)
    out = out.withColumn("overlap", geo.circle_area(F.col("ring"), cx, cy, radius)).where("overlap > 1e-9")
    return out.withColumn("fraction", F.least(F.greatest(F.col("overlap") / geo.ring_area(F.col("ring")), F.lit(0.0)), F.lit(1.0)))


def region_rings(cells: DataFrame, label: str) -> DataFrame:
    """label, ring, sides, area: the boundary rings of labelled cells (unit squares, 4 neighbours); areas of holes are
    negative.

    A side between two labels runs with its cell on the left from corner to corner, and two sides follow each other
    where one ends and the other of its label begins; where two could follow, the sharper left turn does, so regions
    that touch at a corner stay apart. Rings are the components of this relation, and areas add up side by side.
    """
    border, follows = _sides(cells, label)
    roots = components(border.select("node"), follows.select(F.col("node").alias("a"), "b"))
    area = (F.col("c0") * F.col("r1") - F.col("c1") * F.col("r0")) / -2.0
    return border.join(roots, "node").groupBy("label", F.col("root").alias("ring")).agg(F.count(F.lit(1)).alias("sides"), F.sum(area).alias("area"))


def _sides(cells: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Border sides (label, node, k, r0, c0, r1, c1, row, col) with their cell on the left, and which follows which (node, b)."""
    turns = (((0, 1), (1, 1), (0, 1)), ((-1, 0), (0, 1), (0, 0)), ((0, -1), (0, 0), (1, 0)), ((1, 0), (1, 0), (1, 1)))
    some = cells.where(F.col(label).isNotNull()).select("row", "col", F.col(label).alias("label"))
    point = lambda p: ((F.col("row") + p[0]), (F.col("col") + p[1]))
    sides = F.array(*(F.struct(F.lit(k).alias("k"), *(x.alias(n) for n, x in zip(("n_row", "n_col", "r0", "c0", "r1", "c1"), (*point(o), *point(a), *point(b)), strict=True))) for k, (o, a, b) in enumerate(turns)))
    every = some.withColumn("s", F.explode(sides)).select("row", "col", "label", "s.*")
    beside = some.select(F.col("row").alias("n_row"), F.col("col").alias("n_col"), F.col("label").alias("n_label"))
    border = every.join(beside, ["n_row", "n_col"], "left").where(F.col("n_label").isNull() | (F.col("n_label") != F.col("label")))
    border = checkpointed(border.select("label", "k", "r0", "c0", "r1", "c1", "row", "col", ((F.col("row") * (1 << 29) + F.col("col")) * 4 + F.col("k")).alias("node")))
    nxt = border.select(F.col("label").alias("m_label"), F.col("r0").alias("m_r"), F.col("c0").alias("m_c"), F.col("k").alias("m_k"), F.col("node").alias("m_node"))
    met = border.join(nxt, (F.col("label") == F.col("m_label")) & (F.col("r1") == F.col("m_r")) & (F.col("c1") == F.col("m_c")))
    return border, met.groupBy("node").agg(F.min_by("m_node", (F.col("m_k") - F.col("k") + 3) % 4).alias("b"))  # left turns have k + 1


def ring_places(follows: DataFrame, most_rounds: int = 64) -> DataFrame:
    """node, ring, place: each node's ring (its smallest node) and its place from there along ``follows`` (node, b).

    The smallest node within 2^round steps ahead is known after a round; then steps to the ring's node add up by the same
    doubling, so rounds grow with the logarithm of the longest ring.
    """
    jump = checkpointed(follows.select("node", F.col("b").alias("at"), F.least("node", "b").alias("low")))
    for _ in range(most_rounds):
        ahead = jump.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("low").alias("far"))
        now = checkpointed(jump.join(ahead, "at").select("node", F.col("next").alias("at"), F.col("low").alias("was"), F.least("low", "far").alias("low")))
        jump = now.drop("was")
        if not now.where("low <> was").limit(1).count():
            break
    rings = checkpointed(jump.select("node", F.col("low").alias("ring")))
    steps = checkpointed(follows.join(rings, "node").select("node", "ring", F.when(F.col("b") != F.col("ring"), F.col("b")).alias("at"), F.lit(1).cast("long").alias("left")))
    while steps.where("at IS NOT NULL").limit(1).count():
        ahead = steps.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("left").alias("more"))
        steps = checkpointed(steps.join(ahead, "at", "left").select("node", "ring", F.col("next").alias("at"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
    length = steps.where(F.col("node") == F.col("ring")).select("ring", F.col("left").alias("length"))
    return steps.join(length, "ring").select("node", "ring", (F.col("length") - F.col("left")).alias("place"))


def outlines(cells: DataFrame, label: str, least_area: float = 0.0) -> DataFrame:
    """label, shell, ring, area, place, row, col: the corners of the rings around labelled regions (unit squares, 4 neighbours) in
    order, shells with their region on the left, holes (negative area) with the shell they lie in.

    Straight runs give no corner. Regions whose shell covers less than ``least_area`` are left out with their holes.
    """
    border, follows = _sides(cells, label)
    placed = checkpointed(border.join(ring_places(follows), "node"))
    area = F.sum((F.col("c0") * F.col("r1") - F.col("c1") * F.col("r0")) / -2.0)
    rings = placed.groupBy("ring").agg(area.alias("area"), F.min(F.struct("row", "col")).alias("cell"))
    # a region has one shell, whose holes are the other rings of the region's cells
    some = cells.where(F.col(label).isNotNull()).select("row", "col", F.col(label).alias("v"), (F.col("row") * (1 << 29) + F.col("col")).alias("node"))
    beside = some.select((F.col("row") - 1).alias("row"), "col", F.col("v").alias("w"), F.col("node").alias("b")).unionByName(some.select("row", (F.col("col") - 1).alias("col"), F.col("v").alias("w"), F.col("node").alias("b")))
    regions = components(some.select("node"), some.join(beside, ["row", "col"]).where("v = w").select(F.col("node").alias("a"), "b"))
    rings = rings.withColumn("node", F.col("cell.row") * (1 << 29) + F.col("cell.col")).join(regions, "node").select("ring", "area", F.col("root").alias("region"))
    shells = rings.where("area > 0").select("region", F.col("ring").alias("shell"), F.col("area").alias("covers"))
    rings = checkpointed(rings.join(shells, "region").where(F.col("covers") >= least_area).select("ring", "area", "shell"))
    last = placed.groupBy("ring").agg(F.max_by("k", "place").alias("last"))
    before = placed.select("ring", (F.col("place") + 1).alias("place"), F.col("k").alias("k_before"))
    turned = placed.join(rings, "ring").join(last, "ring").join(before, ["ring", "place"], "left").where(F.coalesce("k_before", "last") != F.col("k"))
    return turned.select("label", "shell", "ring", "area", "place", F.col("r0").alias("row"), F.col("c0").alias("col"))


def simplified(corners: DataFrame, tolerance: float) -> DataFrame:
    """The corners of ``outlines`` without those that matter least: within a ring, the corner of the smallest triangle with its two
    neighbours goes first, as long as that is below ``tolerance`` squared and four corners stay. A ring is a task's unit."""

    def thin(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        rows, cols = table.column("row").to_pylist(), table.column("col").to_pylist()
        n = len(rows)
        before, after, alive, version = [i - 1 for i in range(n)], [(i + 1) % n for i in range(n)], [True] * n, [0] * n
        before[0] = n - 1

        def size(i: int) -> float:
            a, b = before[i], after[i]
            return abs((rows[a] - rows[i]) * (cols[b] - cols[i]) - (rows[b] - rows[i]) * (cols[a] - cols[i])) / 2

        heap = [(size(i), i, 0) for i in range(n)]
        heapq.heapify(heap)
        left = n
        while heap and left > 4:
            s, i, v = heapq.heappop(heap)
            if not alive[i] or v != version[i]:
                continue
            if s >= tolerance * tolerance:
                break
            alive[i], left = False, left - 1
            a, b = before[i], after[i]
            after[a], before[b] = b, a
            for j in (a, b):
                version[j] += 1
                heapq.heappush(heap, (size(j), j, version[j]))
        return table.filter(pa.array(alive))

    schema = ", ".join(f"{n} {t}" for n, t in corners.dtypes)
    return corners.groupBy("ring").applyInArrow(thin, schema)
