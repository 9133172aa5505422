"""Column functions of rainfall scenarios (mm, hours)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits and scales of the relative risk (fixed values).
RAIN_MOST, HOURS_LEAST, HOURS_MOST, SCALE_RAIN, SCALE_RATE = 600.0, 1.0, 72.0, 300.0, 50.0


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def effective(rain: Column, share: Column) -> Column:
    return rain * clamp(share)


def rate(rain: Column, hours: Column) -> Column:
    return F.when(hours > 0, rain / hours).otherwise(0.0)


def intensity(rain: Column, hours: Column) -> Column:
    """Total and rate, weighted; without an upper end."""
    return 0.6 * rain / SCALE_RAIN + 0.4 * rate(rain, hours) / SCALE_RATE


def relative_risk(strength: Column, accumulation: Column, fill: Column) -> Column:
    return F.when(strength > 0, strength * (clamp(accumulation) + 0.6 * clamp(2 * fill))).otherwise(0.0)


def validated(rain: Column, hours: Column) -> Column:
    """Clamped and rounded inputs with the list of what was wrong."""
    errors = F.array_compact(F.array(
        F.when(rain.isNull() | F.isnan(rain), "rain_missing").when(rain < 0, "rain_low").when(rain > RAIN_MOST, "rain_high"),
        F.when(hours.isNull() | F.isnan(hours), "hours_missing").when(hours < HOURS_LEAST, "hours_low").when(hours > HOURS_MOST, "hours_high"),
    ))
    some = lambda x, lo, hi, d: F.bround(clamp(F.coalesce(F.when(~F.isnan(x), x), F.lit(lo)), lo, hi), d)
    return F.struct(some(rain, 0.0, RAIN_MOST, 1).alias("rain_mm"), some(hours, HOURS_LEAST, HOURS_MOST, 0).alias("hours"), errors.alias("errors"))
