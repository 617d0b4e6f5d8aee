"""Column functions over temperatures, brackets, forecast eras, hours and places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first day of each forecast version.
VERSIONS = (("1970-01-01", "v3.2"), ("2020-09-29", "v4.0"), ("2023-01-17", "v4.1"), ("2024-05-15", "v4.2"), ("2025-04-15", "v4.3"), ("2026-05-04", "v5.0"))
SEGMENT = "2026-05-04"
WINDOW_HOURS = range(18, 271, 12)
EARTH_KM = 6371.0


def whole(t: Column) -> Column:
    """Whole degrees, half to even."""
    return F.rint(t).cast("int")


def even_bracket(f: Column) -> Column:
    low = f - F.pmod(f, F.lit(2))
    return F.when(f <= 75, "tail_below").when(f >= 94, "tail_above").when(f.isNotNull(), F.concat(F.lit("between_"), low.cast("string"), F.lit("-"), (low + 1).cast("string")))


def label_high(raw: Column) -> Column:
    v = raw.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def version(date: Column) -> Column:
    out = F.lit(None).cast("string")
    for first, name in VERSIONS:
        out = F.when(date >= F.lit(first).cast("date"), name).otherwise(out)
    return F.coalesce(out, F.when(date.isNotNull(), VERSIONS[0][1]))


def era_band(date: Column) -> Column:
    return F.when(date < F.lit(SEGMENT).cast("date"), "v4_retrospective").when(date.isNotNull(), "v5_prospective")


def level_count(date: Column) -> Column:
    return F.when(date < F.lit(SEGMENT).cast("date"), 99).when(date.isNotNull(), 21)


def max_product(cycle_hour: Column, hour: Column) -> Column:
    """Maximum and minimum alternate by cycle: whole days after 18 come from 12Z, half days from 00Z."""
    offset = hour - 18
    return (offset >= 0) & (F.pmod(offset, F.lit(12)) == 0) & (cycle_hour == F.when(F.pmod(offset, F.lit(24)) == 0, 12).otherwise(0))


def max_hour(cycle: Column, day: Column) -> Column:
    """The forecast hour whose 18-hour maximum window is that of the day, for a cycle in epoch seconds; else null."""
    hours = (day * 86400 + 30 * 3600 - cycle) / 3600
    cycle_hour = F.pmod(cycle, F.lit(86400)) / 3600
    good = hours.between(min(WINDOW_HOURS), max(WINDOW_HOURS)) & max_product(cycle_hour, hours)
    return F.when(good, hours.cast("int"))


def kelvin_f(k: Column) -> Column:
    return (k - 273.15) * 9.0 / 5.0 + 32.0


def longitude(lon: Column) -> Column:
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(longitude(lon2) - longitude(lon1)) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def sub_era(date: Column, split: str) -> Column:
    return F.when(date < F.lit(split).cast("date"), "early").when(date.isNotNull(), "late")
