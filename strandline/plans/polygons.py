"""Joins with real outlines: zones that are no boxes, roads that are lines, buildings that are polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline import testbed as tb
from strandline.functions import geo
from strandline.operators import polygons, raster
from strandline.operators.iterate import shared_folder
from strandline.plans import vectors
from strandline.sources import parsers

QUERIES: dict = {}
ORACLES: dict = {}
c = F.col
#: Corners of a zone around its nation's square: an L for odd nations, a diamond that overlaps its neighbours for even ones.
CORNERS = {1: ((0, 0), (160, 0), (160, 70), (90, 70), (90, 190), (0, 190)), 0: ((100, -30), (230, 100), (100, 230), (-30, 100))}
#: The same as edges (zone, ax, ay, bx, b_y) in SQL.
EDGES = ", ".join(f"({odd}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for odd, ring in CORNERS.items() for a, b in zip(ring, (*ring[1:], ring[0]), strict=True))
ZONE = f"ze as (select n_nationkey as zone, ((n_nationkey % 5) * 200 + x1)::double as ax, ((n_nationkey // 5) * 200 + y1)::double as ay, ((n_nationkey % 5) * 200 + x2)::double as bx, ((n_nationkey // 5) * 200 + y2)::double as b_y from nation join (values {EDGES}) as e(odd, x1, y1, x2, y2) on n_nationkey % 2 = odd)"
#: Points p(id, x, y) strictly inside of zones: an odd number of edges to the right and none through the point.
INSIDE = "pz as (select p.id, zone from p join ze on true group by p.id, zone having count(*) filter ((ay > y) <> (b_y > y) and x < (bx - ax) * (y - ay)::double / nullif(b_y - ay, 0) + ax) % 2 = 1 and count(*) filter ((bx - ax) * (y - ay) = (b_y - ay) * (x - ax) and x between least(ax, bx) and greatest(ax, bx) and y between least(ay, b_y) and greatest(ay, b_y)) = 0)"
SEGMENT = "sqrt(pow({x} - (ax + {t} * (bx - ax)), 2) + pow({y} - (ay + {t} * (b_y - ay)), 2))"


def _distance(x: str, y: str) -> str:
    t = f"least(greatest((({x} - ax) * (bx - ax) + ({y} - ay) * (b_y - ay))::double / nullif((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay), 0), 0), 1)"
    return SEGMENT.format(x=x, y=y, t=f"coalesce({t}, 0)")


def _register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return add


def zones(spark, sf_dir):
    """zone, ring."""
    east, south = (c("n_nationkey") % 5) * 200, F.floor(c("n_nationkey") / 5) * 200
    rings = {k: F.array(*(F.struct((east + x).cast("double").alias("x"), (south + y).cast("double").alias("y")) for x, y in v)) for k, v in CORNERS.items()}
    return tb.table(spark, sf_dir, "nation").select(c("n_nationkey").cast("long").alias("zone"), F.when(c("n_nationkey") % 2 == 1, rings[1]).otherwise(rings[0]).alias("ring"))


@_register("j01_points_in_rings", f"with {tb.FEATURES_SQL}, {ZONE}, p as (select id, x, y from fc), {INSIDE} select p.id, coalesce(min(zone), -1) as zone from p left join pz using (id) group by 1")
def points_in_rings(spark, sf_dir):
    f = tb.features(spark, sf_dir).select("id", "x", "y")
    hits = polygons.within_rings(f, zones(spark, sf_dir), 200.0).groupBy("id").agg(F.min("zone").alias("zone"))
    return f.select("id").join(hits, "id", "left").select("id", F.coalesce("zone", F.lit(-1)).alias("zone"))


#: Zones on the cell grid: a tenth of their size.
SMALL = "zs as (select zone, ax / 10.0::double as ax, ay / 10.0::double as ay, bx / 10.0::double as bx, b_y / 10.0::double as b_y from ze)"
NEAR_CELL = f"{tb.cells_sql()}, {ZONE}, {SMALL}, cz as (select row, col, zone, count(*) filter ((ay > row + 0.5) <> (b_y > row + 0.5) and col + 0.5 < (bx - ax) * (row + 0.5 - ay) / nullif(b_y - ay, 0) + ax) % 2 = 1 as inside, min({_distance('(col + 0.5)', '(row + 0.5)')}) as d from cell join zs on true group by 1, 2, 3)"


def _small(spark, sf_dir):
    return zones(spark, sf_dir).select("zone", F.transform("ring", lambda v: F.struct((v["x"] / 10).alias("x"), (v["y"] / 10).alias("y"))).alias("ring"))


@_register("j03_burn_rings", f"with {NEAR_CELL} select row, col, max(zone) as zone from cz where inside group by 1, 2")
def burn_rings(spark, sf_dir):
    hit = polygons.burnt(_small(spark, sf_dir)).groupBy("row", "col").agg(F.max("zone").alias("zone"))
    return tb.cells(spark, sf_dir).select("row", "col").join(hit, ["row", "col"])


@_register("j04_ring_around_rings", f"with {NEAR_CELL} select row, col, round(min(case when inside then 0 else d end), 6) as d from cz group by 1, 2 having min(case when inside then 0 else d end) between 1e-9 and 1")
def ring_around_rings(spark, sf_dir):
    near = polygons.burnt(_small(spark, sf_dir), 1.0).groupBy("row", "col").agg(F.min("d").alias("d")).where("d > 1e-9")
    return tb.cells(spark, sf_dir).select("row", "col").join(near, ["row", "col"]).select("row", "col", F.round("d", 6).alias("d"))


#: Roads as lines between two points and buildings as boxes of 20 by 10; distances by the ends of all pairs of sides.
LINES = "rl as (select s_suppkey as road, s_suppkey * 6151 % 1000 as rx1, s_suppkey * 3571 % 1000 as ry1, s_suppkey * 6151 % 1000 + s_suppkey % 7 * 10 - 30 as rx2, s_suppkey * 3571 % 1000 + s_suppkey % 5 * 10 - 20 as ry2 from supplier)"
SIDES = "bs as (select id, x + x1 as ax, y + y1 as ay, x + x2 as bx, y + y2 as b_y from fc join (values (0, 0, 20, 0), (20, 0, 20, 10), (20, 10, 0, 10), (0, 10, 0, 0)) as e(x1, y1, x2, y2) on true where kind = 'building')"


def _apart(p: str, q: str) -> str:
    """Distance of segment a-b from segment (p)-(q), 0 if they cross."""
    (px, py), (qx, qy) = p, q
    side = lambda ax, ay, bx, b_y, x, y: f"(({bx} - {ax}) * ({y} - {ay}) - ({b_y} - {ay}) * ({x} - {ax}))"
    crossed = f"{side('ax', 'ay', 'bx', 'b_y', px, py)} * {side('ax', 'ay', 'bx', 'b_y', qx, qy)} < 0 and {side(px, py, qx, qy, 'ax', 'ay')} * {side(px, py, qx, qy, 'bx', 'b_y')} < 0"
    t = lambda x, y: f"coalesce(least(greatest((({x} - {px}) * ({qx} - {px}) + ({y} - {py}) * ({qy} - {py}))::double / nullif(pow({qx} - {px}, 2) + pow({qy} - {py}, 2), 0), 0), 1), 0)"
    back = lambda x, y: f"sqrt(pow({x} - ({px} + {t(x, y)} * ({qx} - {px})), 2) + pow({y} - ({py} + {t(x, y)} * ({qy} - {py})), 2))"
    return f"case when {crossed} then 0 else least({_distance(px, py)}, {_distance(qx, qy)}, {back('ax', 'ay')}, {back('bx', 'b_y')}) end"


ROAD_NEAR = f"{tb.FEATURES_SQL}, {LINES}, {SIDES}, rb as (select road, id, min({_apart(('rx1', 'ry1'), ('rx2', 'ry2'))}) as d, count(*) filter ((ay > ry1) <> (b_y > ry1) and rx1 < (bx - ax) * (ry1 - ay)::double / nullif(b_y - ay, 0) + ax) % 2 = 1 as holds from rl join bs on ax between least(rx1, rx2) - 60 and greatest(rx1, rx2) + 60 and ay between least(ry1, ry2) - 60 and greatest(ry1, ry2) + 60 group by 1, 2 having count(*) = 4)"


def road_lines(spark, sf_dir):
    p = lambda x, y: F.struct(c(x).cast("double").alias("x"), c(y).cast("double").alias("y"))
    ends = tb.table(spark, sf_dir, "supplier").selectExpr("s_suppkey as road", "s_suppkey * 6151 % 1000 as x1", "s_suppkey * 3571 % 1000 as y1", "s_suppkey * 6151 % 1000 + s_suppkey % 7 * 10 - 30 as x2", "s_suppkey * 3571 % 1000 + s_suppkey % 5 * 10 - 20 as y2")
    return ends.select("road", F.array(F.struct(p("x1", "y1").alias("a"), p("x2", "y2").alias("b"))).alias("shape"))


def building_rings(spark, sf_dir):
    ring = F.array(*(F.struct((c("x") + x).cast("double").alias("x"), (c("y") + y).cast("double").alias("y")) for x, y in ((0, 0), (20, 0), (20, 10), (0, 10))))
    return tb.features(spark, sf_dir).where("kind = 'building'").select("id", ring.alias("ring"))


@_register("j05_line_frontage", f"with {ROAD_NEAR} select road, count(*) filter (d <= 2) as n2, count(*) filter (d <= 5) as n5, count(*) filter (d <= 10) as n10 from (select road, id, case when holds then 0 else d end as d from rb) where d <= 10 group by road")
def line_frontage(spark, sf_dir):
    b = building_rings(spark, sf_dir).select("id", geo.edges(c("ring")).alias("other"))
    return polygons.counts_within(road_lines(spark, sf_dir), b, (2, 5, 10), "road", "id")


ZONE_PAIRS = f"{ZONE}, zp as (select a.zone as i, b.zone as j, min({_apart(('px', 'py'), ('qx', 'qy'))}) as d from ze a join (select zone, ax as px, ay as py, bx as qx, b_y as qy from ze) b on a.zone < b.zone group by 1, 2)"


@_register("j06_ring_pairs", f"with {ZONE_PAIRS} select i, j, round(d, 6) as d from zp where d <= 45")
def ring_pairs(spark, sf_dir):
    z = zones(spark, sf_dir)
    left = z.select(c("zone").alias("i"), geo.edges(c("ring")).alias("shape"))
    right = z.select(c("zone").alias("j"), geo.edges(c("ring")).alias("other"))
    return polygons.shapes_within(left, right, 45.0, "i", "j").where("i < j").select("i", "j", F.round("d", 6).alias("d"))


CX, CY, RADIUS = vectors.CIRCLE


def _shared(edge: str) -> str:
    """SQL for the area that rings (zone, ax, ay, bx, b_y) share with the circle: triangles inside, sectors outside."""
    return (
        f"e0 as (select zone, ax - {CX} as ux, ay - {CY} as uy, bx - ax as dx, b_y - ay as dy, ax * b_y - bx * ay as cross_ from {edge}), "
        f"e1 as (select *, dx * dx + dy * dy as a, ux * dx + uy * dy as b, sqrt(greatest(pow(ux * dx + uy * dy, 2) - (dx * dx + dy * dy) * (ux * ux + uy * uy - {RADIUS * RADIUS}), 0)) as r from e0), "
        "e2 as (select *, case when a > 0 and r > 0 then least(greatest((-b - r) / a, 0), 1) else 0 end as s, case when a > 0 and r > 0 then least(greatest((-b + r) / a, 0), 1) else 0 end as t from e1), "
        "e3 as (select zone, cross_, ux, uy, ux + dx as vx, uy + dy as vy, ux + s * dx as px, uy + s * dy as py, ux + t * dx as qx, uy + t * dy as qy from e2), "
        f"sh as (select zone, abs(sum({RADIUS * RADIUS} * (atan2(ux * py - uy * px, ux * px + uy * py) + atan2(qx * vy - qy * vx, qx * vx + qy * vy)) + px * qy - py * qx)) / 2 as overlap, abs(sum(cross_)) / 2 as area from e3 group by zone)"
    )


@_register("j07_circle_rings", f"with {ZONE}, {_shared('ze')} select zone, round(overlap, 4) as overlap, round(least(overlap / area, 1), 6) as fraction from sh where overlap > 1e-6")
def circle_rings(spark, sf_dir):
    out = polygons.circle_shares(zones(spark, sf_dir), CX, CY, RADIUS).where("overlap > 1e-6")
    return out.select("zone", F.round("overlap", 4).alias("overlap"), F.round("fraction", 6).alias("fraction"))


#: The boxes of vectors.AREA as edges.
BOXES = f"{vectors.AREA}, be as (select area as zone, xmin as ax, ymin as ay, xmax as bx, ymin as b_y from area union all select area, xmax, ymin, xmax, ymax from area union all select area, xmax, ymax, xmin, ymax from area union all select area, xmin, ymax, xmin, ymin from area)"
ORACLES["j07_circle_overlap"] = f"with {BOXES}, {_shared('be')} select zone as area, round(overlap, 4) as overlap, round(least(overlap / area, 1), 6) as fraction from sh where overlap > 1e-6"


@_register("g01_structure", f"with {tb.cells_sql()} select a.row, a.col, count(*) filter (abs(a.row - b.row) + abs(a.col - b.col) = 1) as n4, count(*) as n8 from cell a join cell b on greatest(abs(a.row - b.row), abs(a.col - b.col)) = 1 group by 1, 2")
def structure(spark, sf_dir):
    """Neighbours of every cell in both connectivity structures; any other one is an error."""
    cells = tb.cells(spark, sf_dir).select("row", "col", F.lit(1).alias("v"))
    n4, n8 = (raster.neighbours(cells, raster.structure(k), "v").groupBy("row", "col").agg(F.count(F.lit(1)).alias(f"n{k}")) for k in (4, 8))
    return n8.join(n4, ["row", "col"], "left").select("row", "col", F.coalesce("n4", F.lit(0)).alias("n4"), "n8")


@_register("g21_region_rings")
def region_rings(spark, sf_dir):
    """Rings around the cells above 1,500 mm: sides and areas (holes negative)."""
    mask = tb.cells(spark, sf_dir).select("row", "col", F.when(c("elev") > 1500, 1).alias("high"))
    return polygons.region_rings(mask, "high").select("ring", "sides", "area")


@_register("g21_outline_corners", f"with {tb.cells_sql()}, m as (select row, col, coalesce(elev > 1500, false) as v from cell), q as (select r.row, r.col, bool_or(m.v and m.row = r.row - 1 and m.col = r.col - 1) as nw, bool_or(m.v and m.row = r.row - 1 and m.col = r.col) as ne, bool_or(m.v and m.row = r.row and m.col = r.col - 1) as sw, bool_or(m.v and m.row = r.row and m.col = r.col) as se from (select distinct row + a as row, col + b as col from m, (select unnest([0, 1]) as a), (select unnest([0, 1]) as b)) r join m on m.row between r.row - 1 and r.row and m.col between r.col - 1 and r.col group by 1, 2) select row, col, count(*) as corners from (select *, unnest(case when nw = se and ne = sw and nw <> ne then [1, 2] else [1] end) as twice from q) where not (nw = ne and sw = se) and not (nw = sw and ne = se) group by 1, 2")
def outline_corners(spark, sf_dir):
    """Where the outlines of the cells above 1,500 mm turn: where regions touch at a corner, both do."""
    mask = tb.cells(spark, sf_dir).select("row", "col", F.when(c("elev") > 1500, 1).alias("high"))
    return polygons.outlines(mask, "high").groupBy("row", "col").agg(F.count(F.lit(1)).alias("corners"))


@_register("a34_outline_rings")
def outline_rings(spark, sf_dir):
    """Outlines of the closed cover above 2,800 mm, shells of four cells or more with their holes, thinned to one cell; rings are
    compared with their masks in tests."""
    mask = tb.cells(spark, sf_dir).select("row", "col", F.coalesce(c("elev") > 2800, F.lit(False)).cast("int").alias("v"))
    cover = raster.closing(mask, 1, "v").select("row", "col", F.when(c("v") == 1, 1).alias("v"))
    thin = polygons.simplified(polygons.outlines(cover, "v", 4.0), 1.0)
    return thin.groupBy("shell", "ring", "area").agg(F.count(F.lit(1)).alias("corners"))


def _written(lines, spark, kind: str) -> str:
    """City models in the shared folder, one a code."""
    import uuid

    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    whole = lines.groupBy("code").agg(F.array_join(F.collect_list("value"), "\n").alias("value"))  # one asset's features
    whole = whole.select("code", F.concat(F.lit("<CityModel>\n"), c("value"), F.lit("\n</CityModel>")).alias("value"))
    whole.repartition("code").write.partitionBy("code").text(path)
    return path


def _city_text(f, tag: str, ring_tag: str, extra):
    at = lambda dx, dy: F.concat_ws(" ", (c("y") + dy).cast("string"), (c("x") + dx).cast("string"), F.lit("0"))
    ring = F.concat_ws(" ", at(0, 0), at(20, 0), at(20, 10), at(0, 10), at(0, 0))
    return f.select("code", F.concat(F.lit(f'<{tag} id="b'), c("id").cast("string"), F.lit('">'), extra, F.lit(f"<{ring_tag}>"), ring, F.lit(f"</{ring_tag}></{tag}>")).alias("value"))


@_register("s04_city_buildings", f"with {tb.FEATURES_SQL} select 'b' || id as gml_id, usage, 5 as points, (y + 10)::double as third_lat, (x + 20)::double as third_lon from fc where kind = 'building'")
def city_buildings(spark, sf_dir):
    """Buildings of city-model XML, by roof edge, else by solid."""
    f = tb.features(spark, sf_dir).where("kind = 'building'")
    usage = F.concat(F.lit("<usage>"), c("usage"), F.lit("</usage>"))
    text = _city_text(f.where("id % 2 = 0"), "Building", "lod0RoofEdge", usage).unionByName(_city_text(f.where("id % 2 = 1"), "Building", "lod1Solid", usage))
    b = parsers.city_objects(spark, _written(text, spark, "buildings"), "Building")
    return b.select("gml_id", "usage", F.size("ring").alias("points"), c("ring")[2][0].alias("third_lat"), c("ring")[2][1].alias("third_lon"))


@_register("s05_city_roads", f"with {tb.FEATURES_SQL} select 'b' || id as gml_id, cast(section as varchar) as section_type, 5 as points, x::double as first_lon from fc where kind = 'road'")
def city_roads(spark, sf_dir):
    f = tb.features(spark, sf_dir).where("kind = 'road'")
    section = F.concat(F.lit("<sectionType>"), c("section").cast("string"), F.lit("</sectionType>"))
    r = parsers.city_objects(spark, _written(_city_text(f, "Road", "lod1MultiSurface", section), spark, "roads"), "Road")
    return r.select("gml_id", c("sectionType").alias("section_type"), F.size("ring").alias("points"), c("ring")[0][1].alias("first_lon"))


@_register("s09_reliable_features", f"with {tb.FEATURES_SQL} select cast(id as varchar) as id, cast(x as double) as x, cast(y as double) as y from fc where not (section in (2, 3, 5, 6))")
def reliable_features(spark, sf_dir):
    """Features of GeoJSON collections, one a code, that are not marked as unreliable."""
    import uuid

    flag = F.when(c("section").isin(2, 3, 5, 6), "true").otherwise("false")
    feature = F.struct(F.struct(c("id").cast("string").alias("id"), flag.alias("unreliable")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(c("x").cast("double"), c("y").cast("double")).alias("coordinates")).alias("geometry"))
    crs = F.struct(F.struct(F.lit("EPSG:6669").alias("name")).alias("properties"))
    whole = tb.features(spark, sf_dir).groupBy("code").agg(F.collect_list(feature).alias("features"))  # one asset's features
    path = f"{shared_folder(spark)}/features-{uuid.uuid4().hex}"
    whole.select("code", F.to_json(F.struct(crs.alias("crs"), "features")).alias("value")).repartition("code").write.partitionBy("code").text(path)
    f = parsers.feature_collection(spark, path, "EPSG:6669")
    at = F.from_json("geometry", "coordinates array<double>")["coordinates"]
    return f.select(c("properties")["id"].alias("id"), at[0].alias("x"), at[1].alias("y"))
