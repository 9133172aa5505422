"""Column functions of plane and web-map geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6378137.0
#: Metres in a degree of latitude and longitude for short distances (fixed values).
DEGREE_LAT, DEGREE_LON = 110950.0, 111320.0


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * EARTH


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * EARTH


def mercator_lat(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / EARTH)) - math.pi / 2)


def tile_x(lon: Column, zoom: int) -> Column:
    """Fractional column of the tile pyramid."""
    return (lon + 180.0) / 360.0 * (1 << zoom)


def tile_y(lat: Column, zoom: int) -> Column:
    return (1 - mercator_y(lat) / (math.pi * EARTH)) / 2 * (1 << zoom)


def tile_bounds(x: Column, y: Column, zoom: int) -> Column:
    side = 2 * math.pi * EARTH / (1 << zoom)
    half = math.pi * EARTH
    return F.struct((x * side - half).alias("xmin"), (half - (y + 1) * side).alias("ymin"), ((x + 1) * side - half).alias("xmax"), (half - y * side).alias("ymax"))


def degrees_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between near points given in degrees."""
    return F.hypot((lon2 - lon1) * DEGREE_LON * F.cos(F.radians((lat1 + lat2) / 2)), (lat2 - lat1) * DEGREE_LAT)


def box_distance(x: Column, y: Column, xmin, ymin, xmax, ymax) -> Column:
    """Distance of a point from a box (0 inside)."""
    return F.hypot(F.greatest(xmin - x, x - xmax, F.lit(0.0)), F.greatest(ymin - y, y - ymax, F.lit(0.0)))


def in_circle(x: Column, y: Column, cx: Column, cy: Column, radius) -> Column:
    return (x - cx) * (x - cx) + (y - cy) * (y - cy) <= radius * radius


def boxes_overlap(a: tuple, b: tuple) -> Column:
    """Boxes as (xmin, ymin, xmax, ymax) columns; touching counts."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def edges(ring: Column) -> Column:
    """Pairs of a closed ring's consecutive vertices (x, y structs); the ring may repeat its first vertex."""
    return F.transform(F.sequence(F.lit(1), F.size(ring)), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, F.when(i == F.size(ring), 1).otherwise(i + 1)).alias("b")))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule; the lower and left edges are inside, the others not."""
    crossed = F.filter(edges(ring), lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.when(e["b"]["y"] != e["a"]["y"], e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]))
    return F.size(crossed) % 2 == 1


def ring_area(ring: Column) -> Column:
    return F.abs(F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))) / 2


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    length = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.when(length > 0, F.least(F.greatest(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / length, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.hypot(x - (ax + t * (bx - ax)), y - (ay + t * (by - ay)))


def strictly_inside(x: Column, y: Column, ring: Column) -> Column:
    """Inside by the even-odd rule and on no edge."""
    def on(e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        return (cross == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    return in_ring(x, y, ring) & ~F.exists(edges(ring), on)


def path_distance(x: Column, y: Column, path: Column) -> Column:
    """Distance of a point from the nearest of some segments (structs a, b)."""
    return F.array_min(F.transform(path, lambda e: segment_distance(x, y, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])))


def paths_distance(left: Column, right: Column) -> Column:
    """Distance of two lines or outlines given as segments (structs a, b): 0 where they cross or touch, or where one holds
    the other's first vertex."""
    def side(a: Column, b: Column, p: Column) -> Column:
        return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])

    def apart(e: Column, f: Column) -> Column:
        crossed = (side(e["a"], e["b"], f["a"]) * side(e["a"], e["b"], f["b"]) < 0) & (side(f["a"], f["b"], e["a"]) * side(f["a"], f["b"], e["b"]) < 0)
        ends = [segment_distance(p["x"], p["y"], s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]) for p, s in ((e["a"], f), (e["b"], f), (f["a"], e), (f["b"], e))]
        return F.when(crossed, 0.0).otherwise(F.least(*ends))

    def holds(outer: Column, inner: Column) -> Column:
        p = F.element_at(inner, 1)["a"]
        closed = F.element_at(outer, 1)["a"] == F.element_at(outer, -1)["b"]
        return closed & in_ring(p["x"], p["y"], F.transform(outer, lambda e: e["a"]))

    nearest = F.array_min(F.transform(left, lambda e: F.array_min(F.transform(right, lambda f: apart(e, f)))))
    return F.when(holds(left, right) | holds(right, left), 0.0).otherwise(nearest)


def circle_area(ring: Column, cx: float, cy: float, radius: float) -> Column:
    """Area that a ring shares with a circle: for each edge the part inside the circle spans a triangle with the centre
    and the parts outside span sectors, signed by direction."""
    def turn(ux, uy, vx, vy) -> Column:
        return F.atan2(ux * vy - uy * vx, ux * vx + uy * vy)

    def of(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"] - cx, e["a"]["y"] - cy, e["b"]["x"] - cx, e["b"]["y"] - cy
        dx, dy = bx - ax, by - ay
        a, b = dx * dx + dy * dy, ax * dx + ay * dy
        root = F.sqrt(F.greatest(b * b - a * (ax * ax + ay * ay - radius * radius), F.lit(0.0)))
        meets = (a > 0) & (root > 0)
        at = lambda t: F.when(meets, F.least(F.greatest(t / F.when(a > 0, a), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        s, t = at(-b - root), at(-b + root)
        px, py, qx, qy = ax + s * dx, ay + s * dy, ax + t * dx, ay + t * dy
        return radius * radius * (turn(ax, ay, px, py) + turn(qx, qy, bx, by)) + px * qy - py * qx

    return F.abs(F.aggregate(edges(ring), F.lit(0.0), lambda total, e: total + of(e))) / 2


def separated(ring: Column, xmin, ymin, xmax, ymax) -> Column:
    """Whether some edge normal of a convex ring parts it from a box (the box's own axes are the bounding boxes)."""
    def apart(e: Column) -> Column:
        nx, ny = e["b"]["y"] - e["a"]["y"], e["a"]["x"] - e["b"]["x"]
        project = lambda px, py: nx * px + ny * py
        own = F.transform(ring, lambda v: project(v["x"], v["y"]))
        box = F.array(*(project(px, py) for px in (xmin, xmax) for py in (ymin, ymax)))
        return (F.array_max(own) < F.array_min(box)) | (F.array_max(box) < F.array_min(own))

    xs, ys = F.transform(ring, lambda v: v["x"]), F.transform(ring, lambda v: v["y"])
    axes = (F.array_max(xs) < xmin) | (F.array_min(xs) > xmax) | (F.array_max(ys) < ymin) | (F.array_min(ys) > ymax)
    return axes | F.exists(edges(ring), apart)


def local_frame(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """East and north metres of a point from an origin, by the series of the ellipsoid's degree lengths."""
    p = math.radians(lat0)
    north = 111132.92 - 559.82 * math.cos(2 * p) + 1.175 * math.cos(4 * p) - 0.0023 * math.cos(6 * p)
    east = 111412.84 * math.cos(p) - 93.5 * math.cos(3 * p) + 0.118 * math.cos(5 * p)
    return (lon - lon0) * east, (lat - lat0) * north


def metres_per_pixel(lat: Column, zoom: Column) -> Column:
    return F.cos(F.radians(lat)) * (2 * math.pi * EARTH) / (256 * F.pow(F.lit(2.0), zoom))


def screen_error(spacing: Column, distance: Column, height: float, fov_degrees: float) -> Column:
    """Pixels that a point spacing covers at a distance."""
    return spacing * height / (2 * F.greatest(distance, F.lit(1.0)) * math.tan(math.radians(fov_degrees) / 2))


def rounded_ring(ring: Column, decimals: int) -> Column:
    return F.transform(ring, lambda v: F.struct(F.bround(v["x"], decimals).alias("x"), F.bround(v["y"], decimals).alias("y")))
