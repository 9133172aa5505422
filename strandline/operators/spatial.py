"""Joins by position: points in polygons, distances within a bound, nearest features, overlay with circles.

Distance joins are equi-joins on grid bins with a residual predicate, so they shuffle by bin instead of comparing
all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import geo
from strandline.operators.iterate import checkpointed


def bins_of_box(xmin, ymin, xmax, ymax, size: float) -> Column:
    """All bins (struct bx, by) that a box meets."""
    xs = F.sequence(F.floor(xmin / size).cast("long"), F.floor(xmax / size).cast("long"))
    ys = F.sequence(F.floor(ymin / size).cast("long"), F.floor(ymax / size).cast("long"))
    return F.flatten(F.transform(xs, lambda i: F.transform(ys, lambda j: F.struct(i.alias("bx"), j.alias("by")))))


def bin_of(x, y, size: float) -> Column:
    return F.struct(F.floor(x / size).cast("long").alias("bx"), F.floor(y / size).cast("long").alias("by"))


def within_boxes(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Pairs of points (x, y) and boxes (xmin, ymin, xmax, ymax) with the point strictly inside."""
    left = points.withColumn("bin", bin_of(F.col("x"), F.col("y"), size))
    right = boxes.withColumn("bin", F.explode(bins_of_box(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), size)))
    inside = (F.col("x") > F.col("xmin")) & (F.col("x") < F.col("xmax")) & (F.col("y") > F.col("ymin")) & (F.col("y") < F.col("ymax"))
    return left.join(right, "bin").where(inside).drop("bin")


def assign_area(points: DataFrame, areas: DataFrame, size: float, key: str = "id", area_key: str = "area") -> DataFrame:
    """Each point once, with the smallest key of the areas around it, or ''. The boundary is outside."""
    found = within_boxes(points.select(key, "x", "y"), areas, size).groupBy(key).agg(F.min(area_key).alias(area_key))
    return points.join(found, key, "left").withColumn(area_key, F.coalesce(area_key, F.lit("")))


def near_pairs(left: DataFrame, right: DataFrame, distance: float) -> DataFrame:
    """Pairs of points (l: x, y; r: rx, ry) within a distance, with the distance d; every pair once."""
    span = [F.floor(F.col(k) / distance).cast("long") for k in ("x", "y")]
    a = left.withColumn("bx", F.explode(F.sequence(span[0] - 1, span[0] + 1))).withColumn("by", F.explode(F.sequence(span[1] - 1, span[1] + 1)))
    b = right.withColumns({"bx": F.floor(F.col("rx") / distance).cast("long"), "by": F.floor(F.col("ry") / distance).cast("long")})
    d = F.sqrt((F.col("x") - F.col("rx")) * (F.col("x") - F.col("rx")) + (F.col("y") - F.col("ry")) * (F.col("y") - F.col("ry")))
    return a.join(b, ["bx", "by"]).withColumn("d", d).where(F.col("d") <= distance).drop("bx", "by")


def nearest(left: DataFrame, right: DataFrame, distance: float, key: str = "id", other: str = "rid") -> DataFrame:
    """key, other, d: each left point's nearest right point within a distance; ties to the smaller id. Points at one place are
    searched once."""
    found = _nearest_place(left.select("x", "y").distinct(), _places(right, F.min(other).alias(other)), distance, other)
    return _of_points(left, found, key, other, "inner")


def counts_within(left: DataFrame, right: DataFrame, distances: Sequence[int], key: str = "id") -> DataFrame:
    """key, n<k> for each of the ``distances``: how many right points are no further than k from a left one. Points at one place
    are compared once and counted as often as they come."""
    to = checkpointed(_places(right, F.count(F.lit(1)).alias("n")))
    pairs = near_pairs(left.select("x", "y").distinct(), to.hint("merge"), max(distances))
    counts = pairs.groupBy("x", "y").agg(*(F.sum(F.when(F.col("d") <= k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in distances))
    out = left.select(key, "x", "y").join(counts.hint("merge"), ["x", "y"], "left")
    return out.groupBy(key).agg(*(F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"n{k}") for k in distances))


def _places(right: DataFrame, what: Column) -> DataFrame:
    return right.groupBy("rx", "ry").agg(what)


def _nearest_place(at: DataFrame, to: DataFrame, distance: float, other: str) -> DataFrame:
    """x, y, other, d: the nearest of some places (rx, ry, other) for each place at which there is one within a distance."""
    pairs = near_pairs(at, to.hint("merge"), distance)
    return pairs.groupBy("x", "y").agg(F.min(F.struct("d", other)).alias("m")).select("x", "y", f"m.{other}", "m.d")


def _of_points(left: DataFrame, found: DataFrame, key: str, other: str, how: str) -> DataFrame:
    """key, other, d: what was found for places (x, y) as rows of the points there."""
    out = left.select(key, "x", "y").join(found.hint("merge"), ["x", "y"], how)
    return out.groupBy(key).agg(F.min(F.when(F.col("d").isNotNull(), F.struct("d", other))).alias("m")).select(key, f"m.{other}", "m.d")


def nearest_anywhere(left: DataFrame, right: DataFrame, first: float, key: str = "id", other: str = "rid", most_rounds: int = 40) -> DataFrame:
    """Nearest without a bound: the search radius doubles for the points that have found none yet. Points without a
    position have no nearest one (null).

    The first radius is ``first`` or, where places are dense, what holds some dozen of them on average, so pairs grow with the
    places and not with their square.
    """
    to = checkpointed(_places(right.where("rx is not null and ry is not null"), F.min(other).alias(other)))
    n, wide, high = to.agg(F.count(F.lit(1)), F.max("rx") - F.min("rx"), F.max("ry") - F.min("ry")).first()
    if not n:
        return left.select(key, F.lit(None).cast("long").alias(other), F.lit(None).cast("double").alias("d"))
    apart = max(math.sqrt(wide * high / n), wide / n, high / n)
    radius = max(min(first, 2 * apart), first / 64)
    todo = checkpointed(left.where("x is not null and y is not null").select("x", "y").distinct())
    out = None
    for _ in range(most_rounds):
        found = checkpointed(_nearest_place(todo, to, radius, other))
        out = found if out is None else out.unionByName(found)
        todo = checkpointed(todo.join(found.select("x", "y").hint("merge"), ["x", "y"], "left_anti"))
        if todo.isEmpty():
            return _of_points(left, out, key, other, "left")
        radius *= 2
    raise RuntimeError("some points are further from all others than the radius has grown to")


def circle_overlap(boxes: DataFrame, cx: float, cy: float, radius: float) -> DataFrame:
    """Boxes with the exact area they share with a circle (overlap) and its share of the box (fraction, 0 to 1)."""

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x0, x1, y0, y1 = ((batch[k].to_numpy(float) - o) / radius for k, o in (("xmin", cx), ("xmax", cx), ("ymin", cy), ("ymax", cy)))
            yield batch.assign(overlap=radius * radius * (_corner(x1, y1) - _corner(x0, y1) - _corner(x1, y0) + _corner(x0, y0)))

    schema = ", ".join(f"`{n}` {t}" for n, t in boxes.dtypes) + ", overlap double"
    close = boxes.where(geo.box_distance(F.lit(cx), F.lit(cy), F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")) < radius)
    out = close.mapInPandas(shared, schema).where("overlap > 0")
    area = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    return out.withColumn("fraction", F.least(F.greatest(F.col("overlap") / area, F.lit(0.0)), F.lit(1.0)))


def _corner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Area of the unit disk left of x and below y."""
    x, y = np.clip(x, -1, 1), np.clip(y, -1, 1)
    half = lambda t: 0.5 * (t * np.sqrt(1 - t * t) + np.arcsin(t))  # noqa: E731  integral of sqrt(1 - t^2)
    edge = np.sqrt(np.maximum(1 - y * y, 0))
    a, b = np.minimum(x, -edge), np.clip(x, -edge, edge)
    c = np.maximum(x, edge)
    caps = (half(a) - half(-1.0)) + (half(c) - half(edge))  # where the column's top is the circle
    full = 2 * caps
    full = np.where(y >= 0, full, 0.0)
    middle = (y * (b + edge)) + (half(b) - half(-edge))
    return full + middle


def transect(lines: DataFrame, step: float, most: int = 2000) -> DataFrame:
    """id, i, x, y: evenly spaced samples of straight lines (x1, y1, x2, y2), 2 to ``most`` of them."""
    n = F.least(F.greatest(F.ceil(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / step) + 1, F.lit(2)), F.lit(most)).cast("int")
    out = lines.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = F.col("i") / (F.col("n") - 1)
    return out.select("id", "i", (F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("y"))


def hulls(points: DataFrame, group: str) -> DataFrame:
    """Convex hulls (counter-clockwise vertices from the lowest x) of groups of points (x, y).

    Only each x's lowest and highest point can be a vertex, so groups are aggregated by x before they meet.
    """
    ends = points.groupBy(group, "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("x")
        pts = sorted({*zip(rows["x"], rows["lo"], strict=True), *zip(rows["x"], rows["hi"], strict=True)})

        def half(order):
            out: list[tuple[float, float]] = []
            for p in order:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                    out.pop()
                out.append(p)
            return out[:-1] if len(out) > 1 else out

        ring = half(pts) + (half(pts[::-1]) if len(pts) > 1 else [])
        return pd.DataFrame({group: rows[group].iloc[0], "i": range(len(ring)), "x": [float(p[0]) for p in ring], "y": [float(p[1]) for p in ring]})

    kind = dict(points.dtypes)[group]
    return ends.groupBy(group).applyInPandas(chain, f"{group} {kind}, i int, x double, y double")


def clip_area(ring: Column, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """Area of a ring (x, y structs) clipped to a box, one box side after another."""

    def side(points: Column, inside, cut) -> Column:
        def step(e: Column) -> Column:
            a, b = e["a"], e["b"]
            crossing = cut(a, b)
            return F.when(inside(a) & inside(b), F.array(b)).when(inside(a), F.array(crossing)).when(inside(b), F.array(crossing, b)).otherwise(F.slice(F.array(b), 1, 0))

        return F.flatten(F.transform(geo.edges(points), step))

    def at_x(v: float):
        return lambda a, b: F.struct(F.lit(v).alias("x"), (a["y"] + (b["y"] - a["y"]) * (v - a["x"]) / F.when(b["x"] != a["x"], b["x"] - a["x"])).alias("y"))

    def at_y(v: float):
        return lambda a, b: F.struct((a["x"] + (b["x"] - a["x"]) * (v - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"])).alias("x"), F.lit(v).alias("y"))

    for inside, cut in ((lambda p: p["x"] >= xmin, at_x(xmin)), (lambda p: p["x"] <= xmax, at_x(xmax)), (lambda p: p["y"] >= ymin, at_y(ymin)), (lambda p: p["y"] <= ymax, at_y(ymax))):
        # each stage's ring is bound once, so that the expression does not grow with the sides
        ring = _bound(ring, side, inside, cut)
    return F.element_at(F.transform(F.array(ring), lambda r: F.when(F.size(r) > 2, geo.ring_area(r)).otherwise(0.0)), 1)


def _bound(ring: Column, side, inside, cut) -> Column:
    return F.element_at(F.transform(F.array(ring), lambda r: F.when(F.size(r) > 0, side(r, inside, cut)).otherwise(r)), 1)


def top_by(df: DataFrame, partition: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group in an order."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("_place") <= n).drop("_place")


