"""Travel seconds, shares, climate units and sentinels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the data model: no path within the cutoff, and the largest time that is one.
UNREACHABLE, MAX_SECONDS = 65535, 65534
WALK_KMH = 5.0


def _seconds(length_m: Column, speed_mps: Column, default_m: float) -> Column:
    raw = F.ceil(F.coalesce(length_m, F.lit(default_m)) / F.greatest(speed_mps, F.lit(0.1)))
    return F.least(F.greatest(F.coalesce(raw, F.lit(MAX_SECONDS)), F.lit(0)), F.lit(MAX_SECONDS)).cast("int")


def drive_seconds(length_m: Column, kmh: Column) -> Column:
    return _seconds(length_m, F.greatest(kmh, F.lit(1.0)) / 3.6, 20.0)


def walk_seconds(length_m: Column) -> Column:
    return _seconds(length_m, F.lit(WALK_KMH / 3.6), 15.0)


def lean_bucket(share: Column) -> Column:
    """0 to 4 by fifths of the vote share."""
    out = F.when(share < 0.2, 0)
    for k, edge in enumerate((0.4, 0.6, 0.8), 1):
        out = out.when(share < edge, k)
    return out.when(share.isNotNull(), 4).cast("smallint")


def c_to_f(c: Column) -> Column:
    return c * 9 / 5 + 32


def mm_to_in(mm: Column) -> Column:
    return mm / 25.4


def quantize(value: Column, scale: float = 0.1, signed: bool = True) -> Column:
    """Half-up multiples of scale; unsigned ones are not below zero. Out of range gives null."""
    steps = F.round(value / scale)
    if signed:
        return steps.try_cast("smallint")
    return F.when(F.greatest(steps, F.lit(0.0)) <= UNREACHABLE, F.greatest(steps, F.lit(0.0)).try_cast("int"))


def dequantize(steps: Column, scale: float = 0.1) -> Column:
    return steps * scale


def climate_label(summer: Column, winter: Column, ppt: Column, ppt_jul: Column, ppt_dec: Column) -> Column:
    """Fixed thresholds in °F and inches; the first that holds gives the label."""
    rules = [
        ((summer < 60) & (winter < 30), "Arctic Cold"),
        ((summer >= 65) & (winter < 32) & (ppt > 20), "Cold Seasonal"),
        (summer.between(70, 80) & winter.between(32, 45) & ppt.between(25, 50), "Mild Continental"),
        ((summer < 70) & (winter > 35) & (ppt > 35), "Cool Maritime"),
        ((summer > 80) & (winter > 45) & (ppt > 40), "Warm Humid"),
        ((ppt < 10) & (summer > 80), "Hot Dry (Desert)"),
        ((ppt >= 10) & (ppt < 20) & summer.between(75, 85), "Warm Semi-Arid"),
        ((ppt < 30) & (ppt_dec > ppt_jul) & (summer > 75), "Mediterranean Mild"),
        (summer.between(60, 75) & (winter < 35), "Mountain Mixed"),
    ]
    return F.coalesce(*[F.when(test, F.lit(label)) for test, label in rules], F.lit("Unclassified"))


def mode_code(mode: Column) -> Column:
    return F.when(F.lower(mode) == "walk", 2).otherwise(0).cast("smallint")


def reachable(seconds: Column) -> Column:
    """Null for the sentinel."""
    return F.nullif(seconds, F.lit(UNREACHABLE))


def minutes(seconds: Column) -> Column:
    return F.round(seconds / 60).cast("int")


def minute_bucket(seconds: Column) -> Column:
    return F.when(seconds <= 600, 10).when(seconds <= 1200, 20).when(seconds <= 1800, 30).otherwise(60)


def half_even(value: Column, places: int) -> Column:
    """Rounded to `places` decimals, halves to the even neighbour."""
    return F.bround(value, places)


def sparkline(values: Column) -> Column:
    """Values scaled to 0..1 between their least and greatest; all 0.5 where these are equal; nulls stay null."""
    low, high = F.array_min(values), F.array_max(values)
    return F.transform(values, lambda x: F.when(high > low, (x - low) / (high - low)).otherwise(F.when(x.isNotNull(), F.lit(0.5))))


def row_stats(values: Column) -> dict[str, Column]:
    """Mean, least, greatest and sum of an array, nulls left out."""
    some = F.filter(values, lambda x: x.isNotNull())
    total = F.aggregate(some, F.lit(0.0), lambda a, x: a + x)
    return {
        "mean": F.when(F.size(some) > 0, total / F.size(some)),
        "min": F.array_min(some),
        "max": F.array_max(some),
        "sum": total,
    }
