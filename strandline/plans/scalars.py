"""Column functions applied to the test bed, one query an operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline import testbed as tb
from strandline.functions import codec, flood, geo, rain

QUERIES: dict = {}
ORACLES: dict = {}
c = F.col


def _add(name: str, columns, sql: dict[str, str], levels: bool = True, keys: tuple[str, ...] = ("id", "level"), more: str = "") -> None:
    """Register ``keys`` plus computed columns over features (at each level), and the SQL of the same columns."""
    keys = keys if levels else ("id",)

    def query(spark, sf_dir: str):
        base = (tb.scenarios if levels else tb.features)(spark, sf_dir)
        return base.select(*keys, *(v.alias(k) for k, v in columns().items()))

    QUERIES[name] = query
    ORACLES[name] = f"with {tb.SCENARIO_SQL if levels else tb.FEATURES_SQL}{more} select {', '.join(keys)}, {', '.join(f'{v} as {k}' for k, v in sql.items())} from {'fs' if levels else 'fc'}"


D1, D2 = "coalesce(greatest(level - ground, 0), 0)", "(case when h2 >= 0 and h2 <= level then coalesce(greatest(level - ground, 0), 0) else 0 end)"
WET1, WET2 = "coalesce(h1 >= 0 and h1 <= level, false)", "coalesce(h2 >= 0 and h2 <= level, false)"


def _classes(x: str, limits: tuple[int, ...]) -> str:
    return " + ".join(f"(case when {x} >= {n} then 1 else 0 end)" for n in limits)


_add("p01_reached", lambda: {"wet": flood.reached(c("h1"), c("level")), "wet_m": flood.reached_metres((c("h1") / 1000.0).cast("float").cast("double"), c("level") / 1000.0)}, {"wet": WET1, "wet_m": WET1})
_add("p02_depth", lambda: {"depth": flood.depth_connected(c("ground"), c("h1"), c("level"))}, {"depth": D2.replace("h2", "h1")})
_add("p03_depth_simple_connected", lambda: {"simple": flood.depth_simple(c("ground"), c("level")), "connected": flood.depth_connected(c("ground"), c("h2"), c("level"))}, {"simple": D1, "connected": D2})
_add("p04_floor_bucket", lambda: {"bucket": flood.floor_bucket(flood.depth_simple(c("ground"), c("level")))}, {"bucket": f"case when {D1} >= 500 then 'above' when {D1} > 0 then 'under' else 'dry' end"})
_add("p05_passability", lambda: {"road_class": flood.depth_class(c("level") - c("ground"), flood.PASSABILITY).cast("long")}, {"road_class": f"case when ground is not null then {_classes('(level - ground)', (100, 300, 500))} end"})
_add("p06_traffic_class", lambda: {"traffic": flood.depth_class(c("level") - c("ground"), flood.TRAFFIC).cast("long")}, {"traffic": f"case when ground is not null then {_classes('(level - ground)', (100, 150, 300))} end"})
_add("p07_regulation", lambda: {"regulation": flood.regulation(flood.depth_simple(c("ground"), c("level")), c("frontage"))}, {"regulation": f"case when {D1} <= 0 then 'none' when {D1} >= 150 then 'stop' when coalesce(frontage >= 1, false) then 'consider' else 'slow' end"})
CHANGED = f"case when kind = 'road' then ({_classes(D1, (100, 300, 500))}) <> ({_classes(D2, (100, 300, 500))}) else ({D1} > 0) <> ({D2} > 0) end"
_add("p08_decision_changed", lambda: {"changed": flood.decision_changed(c("kind"), flood.depth_simple(c("ground"), c("level")), flood.depth_connected(c("ground"), c("h2"), c("level")))}, {"changed": CHANGED})
UNRELIABLE = "(section in (2, 3, 5, 6) or water > 0.5)"
_add("p09_decision_interactive", lambda: {"changed": flood.decision_changed_interactive(c("kind"), flood.depth_simple(c("ground"), c("level")), flood.depth_connected(c("ground"), c("h2"), c("level")), c("h1"), c("h2"), flood.unreliable_reason(c("section"), c("water")).isNotNull(), F.lit(False))}, {"changed": f"not {UNRELIABLE} and h1 is not null and h2 is not null and ({CHANGED})"})
_add("p10_ponded", lambda: {"ponded": flood.ponded(c("ground"), c("h1"), c("level"))}, {"ponded": f"coalesce(ground < level, false) and not {WET1}"})
_add("p11_assumption_steps", lambda: {"steps": flood.assumption_steps(c("h1"), c("h2"), c("ground"), c("level")).cast("long")}, {"steps": " + ".join(f"cast(coalesce({x} <= level, false) as int)" for x in ("h1", "h2", "ground"))})
_add("p12_diff_state", lambda: {"state": flood.diff_state(flood.reached(c("h1"), c("level")), flood.reached(c("h2"), c("level"))).cast("long")}, {"state": f"case when {WET1} and {WET2} then 1 when {WET2} then 2 when {WET1} then 3 else 0 end"})
_add("p13_survey_target", lambda: {"target": flood.survey_target(c("h1"), c("h2"), c("ground"), c("level"), flood.unreliable_reason(c("section"), c("water")).isNotNull())}, {"target": f"coalesce(not {UNRELIABLE} and h1 > level and h2 <= level and ground <= level, false)"})
TEXTS = "case id % 6 when 0 then '' when 1 then 'inf' when 2 then 'NaN' when 3 then cast(id as varchar) || '.75' when 4 then '-' || cast(id as varchar) || '.25' else 'x' end"
_add("p14_finite", lambda: {"value": flood.finite(F.expr(TEXTS.replace("varchar", "string")))}, {"value": f"case when isfinite(try_cast({TEXTS} as double)) then try_cast({TEXTS} as double) end"}, levels=False)
_add("m23_int_through_float", lambda: {"value": flood.int_through_float(F.expr(TEXTS.replace("varchar", "string")))}, {"value": f"case when isfinite(try_cast({TEXTS} as double)) then cast(trunc(try_cast({TEXTS} as double)) as bigint) end"}, levels=False)
_add("p15_unreliable", lambda: {"reason": flood.unreliable_reason(c("section"), c("water"))}, {"reason": "case when section in (2, 3, 5, 6) then 'not_on_ground' when water > 0.5 then 'mostly_water' end"}, levels=False)
D1C = D2.replace("h2", "h1")
_add("p16_display_class", lambda: {"class": flood.display_class(c("ground"), c("h1"), c("level"))}, {"class": f"case when {D1C} >= 500 then 'above' when {D1C} > 0 then 'under' when coalesce(ground < level, false) and not {WET1} then 'ponded' else 'dry' end"})
SURFACES = "case id % 6 when 0 then 'diff' when 1 then 'diff_src' when 2 then 'diff_res' when 3 then 'drainage' when 4 then 'assumption' else 'pointcloud' end"
_add("p17_surface_pair", lambda: {"from_cond": flood.surface_pair(F.expr(SURFACES))["from_cond"], "to_cond": flood.surface_pair(F.expr(SURFACES))["to_cond"]}, {
    "from_cond": "case id % 6 when 0 then 'baseline' when 1 then 'baseline' when 2 then 'control' when 3 then 'highres' when 4 then 'highres' else 'pointcloud' end",
    "to_cond": "case id % 6 when 0 then 'highres' when 1 then 'control' when 2 then 'highres' when 3 then 'highres' when 4 then 'highres' else 'pointcloud' end",
}, levels=False)
_add("p18_surface_fallback", lambda: {"cond": flood.surface_fallback(F.expr("case when id % 2 = 0 then 'pointcloud' else 'control' end"), F.when(c("id") % 3 == 0, F.array(F.lit("baseline"), F.lit("control"))).when(c("id") % 3 == 1, F.array(F.lit("highres"))).otherwise(F.array().cast("array<string>")))}, {"cond": "case when id % 3 = 0 then (case when id % 2 = 0 then 'baseline' else 'control' end) when id % 3 = 1 then 'highres' end"}, levels=False)
_add("p19_tide_datum", lambda: {"level_mm": flood.tide_to_level(c("id") % 300)}, {"level_mm": "round_even(cast((id % 300) * 10.0 as double) + 124.31, 2)"}, levels=False)
_add("p20_display_datum", lambda: {"older": flood.to_older_datum(c("ground")), "newer": flood.to_newer_datum(c("ground"))}, {"older": "round_even(cast(ground as double) + 190.31, 2)", "newer": "round_even(cast(ground as double) - 190.31, 2)"}, levels=False)
_add("p21_level_nudge", lambda: {"moved": flood.nudged(c("level"), c("section") * 100 - 300, F.lit(3000))}, {"moved": "cast(least(greatest(level + section * 100 - 300, 0), 2000) as bigint)"})
_add("m09_decision_band", lambda: dict(zip(("lo", "hi"), flood.decision_band(c("h1"), c("h2")), strict=True)), {"lo": "case when h1 <> h2 then least(h1, h2) end", "hi": "case when h1 <> h2 then greatest(h1, h2) end"}, levels=False)
_add("m12_asset_fallback", lambda: {"asset": F.coalesce(F.when(c("h1").isNotNull(), F.concat(F.lit("flow_pointcloud_"), c("id").cast("string"))), F.when(c("h2").isNotNull(), F.concat(F.lit("flow_highres_"), c("id").cast("string"))))}, {"asset": "case when h1 is not null then 'flow_pointcloud_' || cast(id as varchar) when h2 is not null then 'flow_highres_' || cast(id as varchar) end"}, levels=False)

# codecs: heights in quarter metres are exact in binary
M = "cast(ground as double) / 1000"
PACKED = f"cast(floor(({M} + 32768) * 256) as bigint)"
_add("p22_height_codec", lambda: {**{k: codec.pack_height(c("ground") / 1000.0)[k] for k in "rgb"}, "a": codec.pack_level(c("h1") / 1000.0)}, {
    "r": f"case when ground is null then 0 else ({PACKED} >> 16) & 255 end", "g": f"case when ground is null then 0 else ({PACKED} >> 8) & 255 end", "b": f"case when ground is null then 0 else {PACKED} & 255 end",
    "a": "case when h1 is null then 0 else least(greatest(h1 // 50 + 1, 1), 255) end",
}, levels=False)
_add("p22_height_decode", lambda: {"height": codec.unpack_height(F.lit(128) + c("id") % 2, c("section"), c("frontage")), "level_m": codec.unpack_level(c("section"))}, {
    "height": "case when frontage is not null then ((128 + id % 2) * 65536 + section * 256 + frontage) / 256.0::double - 32768 end", "level_m": "case when section > 0 then round_even((section - 1) * 0.05::double, 2) end",
}, levels=False)
_add("p23_flow_codec", lambda: {"r": codec.pack_accumulation(c("id").cast("double"), F.lit(20000.0)), "b": codec.pack_fill(c("section") * 0.25), "cells": F.bround(codec.unpack_accumulation(c("section") * 30, F.lit(20000.0)), 4)}, {
    "r": "cast(round_even(255 * ln(1 + cast(id as double)) / ln(20001.0::double), 0) as bigint)", "b": "case when section > 0 then section * 5 + 1 else 0 end", "cells": "round_even(exp(section * 30 / 255.0::double * ln(20001.0::double)) - 1, 4)",
}, levels=False)

# web map and plane geometry on small degrees and metres
LON, LAT = "(135.0 + cast(x as double) / 1000)", "(35.0 + cast(y as double) / 1000)"


def _lon():
    return 135.0 + c("x").cast("double") / 1000


def _lat():
    return 35.0 + c("y").cast("double") / 1000


_add("p24_mercator_tiles", lambda: {"tx": F.floor(geo.tile_x(_lon(), 12)), "ty": F.floor(geo.tile_y(_lat(), 12)), "mx": F.bround(geo.mercator_x(_lon()), 2), "lat_back": F.bround(geo.mercator_lat(geo.mercator_y(_lat())), 6)}, {
    "tx": f"cast(floor(({LON} + 180) / 360 * 4096) as bigint)", "ty": f"cast(floor((1 - ln(tan(pi() / 4 + radians({LAT}) / 2)) / pi()) / 2 * 4096) as bigint)",
    "mx": f"round_even(radians({LON}) * 6378137.0::double, 2)", "lat_back": f"round_even({LAT}, 6)",
}, levels=False)
_add("p24_tile_bounds", lambda: {k: F.bround(geo.tile_bounds(c("section"), c("section") + 1, 4)[k], 1) for k in ("xmin", "ymin", "xmax", "ymax")}, {
    k: f"round_even({v}, 1)" for k, v in {"xmin": "section * s.side - s.half", "ymin": "s.half - (section + 2) * s.side", "xmax": "(section + 1) * s.side - s.half", "ymax": "s.half - (section + 1) * s.side"}.items()
}, levels=False)
ORACLES["p24_tile_bounds"] += ", (select 2 * pi() * 6378137.0::double / 16 as side, pi() * 6378137.0::double as half) s"
_add("p25_degrees_distance", lambda: {"metres": F.bround(geo.degrees_distance(_lon(), _lat(), F.lit(135.5), F.lit(35.5)), 4)}, {"metres": f"round_even(sqrt(pow((135.5 - {LON}) * 111320.0::double * cos(radians(({LAT} + 35.5) / 2)), 2) + pow((35.5 - {LAT}) * 110950.0::double, 2)), 4)"}, levels=False)
_add("p31_box_distance", lambda: {"edge": F.bround(geo.box_distance(c("x"), c("y"), F.lit(300), F.lit(200), F.lit(700), F.lit(600)), 6)}, {"edge": "round_even(sqrt(pow(greatest(300 - x, x - 700, 0), 2) + pow(greatest(200 - y, y - 600, 0), 2)), 6)"}, levels=False)


def _ring(*points):
    return F.array(*(F.struct(F.lit(float(px)).alias("x"), F.lit(float(py)).alias("y")) for px, py in points))


_add("p32_circle_box_convex", lambda: {"in_circle": geo.in_circle(c("x"), c("y"), F.lit(500), F.lit(500), 250), "overlaps": geo.boxes_overlap((c("x"), c("y"), c("x") + 50, c("y") + 50), (F.lit(300), F.lit(300), F.lit(400), F.lit(400))), "meets_diamond": ~geo.separated(_ring((500, 300), (700, 500), (500, 700), (300, 500)), c("x"), c("y"), c("x") + 50, c("y") + 50)}, {
    "in_circle": "(x - 500) * (x - 500) + (y - 500) * (y - 500) <= 62500", "overlaps": "x <= 400 and 300 <= x + 50 and y <= 400 and 300 <= y + 50",
    "meets_diamond": "greatest(x - 500, 500 - (x + 50), 0) + greatest(y - 500, 500 - (y + 50), 0) <= 200",
}, levels=False)
_add("p33_in_ring", lambda: {"inside": geo.in_ring(c("x").cast("double"), c("y").cast("double"), _ring((100, 100), (900, 100), (900, 900), (500, 500), (100, 900))), "area": geo.ring_area(_ring((100, 100), (900, 100), (900, 900), (500, 500), (100, 900)))}, {
    "inside": "y >= 100 and x >= 100 and x < 900 and case when y < 500 then true when y < 900 then (x < 1000 - y or x >= y) else false end", "area": "480000.0::double",
}, levels=False)
_add("p34_local_frame", lambda: dict(zip(("east", "north"), (F.bround(v, 3) for v in geo.local_frame(_lon(), _lat(), 135.0, 35.0)), strict=True)), {
    "east": f"round_even(({LON} - 135) * (111412.84::double * cos(radians(35)) - 93.5::double * cos(3 * radians(35)) + 0.118::double * cos(5 * radians(35))), 3)",
    "north": f"round_even(({LAT} - 35) * (111132.92::double - 559.82::double * cos(2 * radians(35)) + 1.175::double * cos(4 * radians(35)) - 0.0023::double * cos(6 * radians(35))), 3)",
}, levels=False)
_add("p38_rounded_ring", lambda: {"x1": geo.rounded_ring(F.array(F.struct((c("x") / 7.0).alias("x"), (c("y") / 7.0).alias("y"))), 2)[0]["x"], "y1": geo.rounded_ring(F.array(F.struct((c("x") / 7.0).alias("x"), (c("y") / 7.0).alias("y"))), 2)[0]["y"]}, {"x1": "round_even(x / 7.0::double, 2)", "y1": "round_even(y / 7.0::double, 2)"}, levels=False)
_add("m16_screen_error", lambda: {"pixels": F.bround(geo.screen_error(c("section") * 0.5, c("x").cast("double"), 900.0, 60.0), 6)}, {"pixels": "round_even(section * 0.5::double * 900 / (2 * greatest(x, 1) * tan(radians(30))), 6)"}, levels=False)
_add("m17_metres_per_pixel", lambda: {"m": F.bround(geo.metres_per_pixel(_lat(), c("section") + 10), 6)}, {"m": f"round_even(cos(radians({LAT})) * (2 * pi() * 6378137.0::double) / (256 * pow(2, section + 10)), 6)"}, levels=False)
_add("m18_client_mercator", lambda: {"mx": F.bround(geo.mercator_x(_lon()), 3), "my": F.bround(geo.mercator_y(_lat()), 3)}, {"mx": f"round_even(radians({LON}) * 6378137.0::double, 3)", "my": f"round_even(ln(tan(pi() / 4 + radians({LAT}) / 2)) * 6378137.0::double, 3)"}, levels=False)

# rain
RAIN, HOURS = "cast(x as double)", "cast(section as double)"
INTENSITY = f"(0.6::double * {RAIN} / 300 + 0.4::double * (case when section > 0 then {RAIN} / section else 0 end) / 50)"
_add("p26_effective_rain", lambda: {"mm": F.bround(rain.effective(c("x").cast("double"), c("water") * 2), 6), "rate": F.bround(rain.rate(c("x").cast("double"), c("section").cast("double")), 6)}, {"mm": f"round_even({RAIN} * least(greatest(water * 2, 0), 1), 6)", "rate": f"round_even(case when section > 0 then {RAIN} / section else 0 end, 6)"}, levels=False)
_add("p27_intensity", lambda: {"strength": F.bround(rain.intensity(c("x").cast("double"), c("section").cast("double")), 6)}, {"strength": f"round_even({INTENSITY}, 6)"}, levels=False)
_add("p28_relative_risk", lambda: {"risk": F.bround(rain.relative_risk(rain.intensity(c("x").cast("double"), c("section").cast("double")), c("water"), c("water") / 3), 6)}, {"risk": f"round_even(case when {INTENSITY} > 0 then {INTENSITY} * (water + 0.6::double * least(2 * (water / 3), 1)) else 0 end, 6)"}, levels=False)
_add("p29_rain_validation", lambda: {"rain_mm": rain.validated(c("x") - 100.0, c("section") * 15.0)["rain_mm"], "hours": rain.validated(c("x") - 100.0, c("section") * 15.0)["hours"], "errors": F.array_join(rain.validated(c("x") - 100.0, c("section") * 15.0)["errors"], ",")}, {
    "rain_mm": "round_even(least(greatest(x - 100.0::double, 0), 600), 1)", "hours": "round_even(least(greatest(section * 15.0::double, 1), 72), 0)",
    "errors": "concat_ws(',', case when x < 100 then 'rain_low' when x > 700 then 'rain_high' end, case when section * 15 < 1 then 'hours_low' when section * 15 > 72 then 'hours_high' end)",
}, levels=False)
