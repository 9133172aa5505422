"""Column functions of static-level flooding. Levels and heights are integer millimetres; null is no data or never reached."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP, LEVEL_MOST, FLOOR = 50, 3000, 500
#: Depth classes of passability and of traffic (fixed values, mm); a road is closed from STOP.
PASSABILITY, TRAFFIC, STOP = (100, 300, 500), (100, 150, 300), 150
#: Road sections that are not on the ground, and the share of water cells from which a footprint is unreliable.
OFF_GROUND, WATER_SHARE = (2, 3, 5, 6), 0.5
#: Datum constants in mm: shift of the older datum, zero of the tide table.
DATUM_SHIFT, TIDE_ZERO = -190.31, 124.31


def step_up(mm: Column, step: int = STEP) -> Column:
    """The next level of the sweep at or above a height."""
    return (F.ceil(mm / F.lit(float(step))) * step).cast("long")


def reached(h: Column, level: Column) -> Column:
    """Connected at a level; null and negative heights never are."""
    return F.coalesce((h >= 0) & (h <= level), F.lit(False))


def reached_metres(h: Column, tide: Column, step: float = 0.05) -> Column:
    """The same for float metres: heights snap to the sweep first, so that widened single precision compares equal."""
    sound = h.isNotNull() & ~F.isnan(h) & (F.abs(h) < float("inf"))
    snapped = F.bround(h / step, 0) * step
    return F.coalesce(sound & (snapped >= 0) & (snapped <= tide + 1e-9), F.lit(False))


def depth_simple(ground: Column, level: Column) -> Column:
    return F.coalesce(F.greatest(level - ground, F.lit(0)), F.lit(0)).cast("long")


def depth_connected(ground: Column, h: Column, level: Column) -> Column:
    return F.when(reached(h, level), depth_simple(ground, level)).otherwise(0).cast("long")


def floor_bucket(depth: Column) -> Column:
    return F.when(depth >= FLOOR, "above").when(depth > 0, "under").otherwise("dry")


def depth_class(depth: Column, limits: tuple[int, ...]) -> Column:
    """How many limits a depth has reached (null stays null)."""
    return F.when(depth.isNotNull(), sum((F.when(depth >= x, 1).otherwise(0) for x in limits), F.lit(0)))


def regulation(depth: Column, frontage: Column) -> Column:
    """none / stop / consider / slow by depth and the number of buildings within 5 m."""
    return F.when(F.coalesce(depth, F.lit(0)) <= 0, "none").when(depth >= STOP, "stop").when(F.coalesce(frontage >= 1, F.lit(False)), "consider").otherwise("slow")


def decision_changed(kind: Column, depth1: Column, depth2: Column) -> Column:
    """Analysis mode: buildings by wet or dry, roads by passability class; missing heights are depth 0."""
    a, b = F.coalesce(depth1, F.lit(0)), F.coalesce(depth2, F.lit(0))
    return F.when(kind == "road", depth_class(a, PASSABILITY) != depth_class(b, PASSABILITY)).otherwise((a > 0) != (b > 0))


def decision_changed_interactive(kind: Column, depth1: Column, depth2: Column, h1: Column, h2: Column, unreliable: Column, same: Column) -> Column:
    """Interactive mode: never for unreliable features, equal conditions or a missing height."""
    return ~unreliable & ~same & h1.isNotNull() & h2.isNotNull() & decision_changed(kind, depth1, depth2)


def decision_band(h1: Column, h2: Column) -> list[Column]:
    """Levels [lo, hi) at which two conditions disagree; null if equal or one is never reached."""
    differ = h1.isNotNull() & h2.isNotNull() & (h1 != h2)
    return [F.when(differ, F.least(h1, h2)), F.when(differ, F.greatest(h1, h2))]


def ponded(ground: Column, h: Column, level: Column) -> Column:
    """Below the level but not connected."""
    return F.coalesce(ground < level, F.lit(False)) & ~reached(h, level)


def assumption_steps(h1: Column, h2: Column, ground: Column, level: Column) -> Column:
    return sum((F.coalesce(x <= level, F.lit(False)).cast("int") for x in (h1, h2, ground)), F.lit(0))


def diff_state(wet1: Column, wet2: Column) -> Column:
    """0 dry, 1 wet in both, 2 newly wet, 3 newly dry."""
    return F.when(wet1 & wet2, 1).when(wet2, 2).when(wet1, 3).otherwise(0)


def survey_target(s1: Column, s2: Column, ground: Column, level: Column, unreliable: Column) -> Column:
    """Wet only through drains: above the level overland (which must be known), within it with outfalls."""
    return F.coalesce(~unreliable & (s1 > level) & (s2 <= level) & (ground <= level), F.lit(False))


def finite(text: Column) -> Column:
    """A number from text; blanks, infinities and not-a-number are null."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def int_through_float(text: Column) -> Column:
    x = finite(text)
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("long")


def unreliable_reason(section: Column, water: Column) -> Column:
    return F.when(section.isin(*OFF_GROUND), "not_on_ground").when(water > WATER_SHARE, "mostly_water")


def display_class(ground: Column, h: Column, level: Column) -> Column:
    depth = depth_connected(ground, h, level)
    return F.when(depth >= FLOOR, "above").when(depth > 0, "under").when(ponded(ground, h, level), "ponded").otherwise("dry")


def surface_pair(surface: Column) -> Column:
    """The conditions that a surface compares; views without a comparison have the same one twice."""
    pair = lambda a, b: F.struct(F.lit(a).alias("from_cond"), F.lit(b).alias("to_cond"))
    return (
        F.when(surface == "diff", pair("baseline", "highres")).when(surface == "diff_src", pair("baseline", "control")).when(surface == "diff_res", pair("control", "highres"))
        .when(surface.isin("drainage", "assumption"), pair("highres", "highres")).otherwise(F.struct(surface.alias("from_cond"), surface.alias("to_cond")))
    )


def surface_fallback(wanted: Column, available: Column, default: str = "highres") -> Column:
    """The wanted condition if it is available, else the default, else the first there is, else null."""
    return F.when(F.array_contains(available, wanted), wanted).when(F.array_contains(available, default), F.lit(default)).otherwise(F.get(available, F.lit(0)))


def tide_to_level(cm: Column) -> Column:
    """Tide-table centimetres above the table's zero to mm of the newer datum."""
    return F.bround(cm * 10.0 + TIDE_ZERO, 2)


def to_older_datum(mm: Column) -> Column:
    return F.bround(mm - DATUM_SHIFT, 2)


def to_newer_datum(mm: Column) -> Column:
    return F.bround(mm + DATUM_SHIFT, 2)


def nudged(level: Column, delta: Column, most: Column) -> Column:
    """A moved level: within 0 and the scale's end, which is at most 2 m, in whole mm."""
    return F.bround(F.least(F.greatest(level + delta, F.lit(0)), F.least(most, F.lit(2000))), 0).cast("long")
