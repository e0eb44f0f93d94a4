"""Times, places, units and battery arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from amperelake.common import IST_OFFSET_MS, MINUTE_MS

EARTH_KM = 6371.0
KM_PER_MILE = 1.609344
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"


def minute_start(ms: Column) -> Column:
    return ms - F.pmod(ms, F.lit(MINUTE_MS))


def hour_start(ms: Column) -> Column:
    return ms - F.pmod(ms, F.lit(3_600_000))


def local_minute(ms: Column) -> Column:
    """Minute of the local day (UTC+05:30)."""
    return F.pmod(F.floor((ms + IST_OFFSET_MS) / MINUTE_MS), F.lit(1440)).cast("int")


def local_weekday(ms: Column) -> Column:
    """Day of the local week, Monday 0."""
    return F.pmod(F.floor((ms + IST_OFFSET_MS) / 86_400_000) + 3, F.lit(7)).cast("int")


def within_shift(minute: Column, start: Column, end: Column) -> Column:
    """Whether a minute of the day is in [start, end), over midnight where end is before start."""
    return F.when(start <= end, (minute >= start) & (minute < end)).otherwise((minute >= start) | (minute < end))


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


#: What a road is longer than the straight line.
ROAD_FACTOR = 1.3


def road_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return distance_km(lat1, lon1, lat2, lon2) * ROAD_FACTOR


def share_to_reach(km: Column, wh_per_km: Column, capacity_kwh: Column) -> Column:
    """Per cent of the pack that a distance takes; null without a capacity."""
    return F.when(capacity_kwh > 0, km * wh_per_km / 1000 / capacity_kwh * 100)


def ohm_per_volt(kohm: Column, volt: Column) -> Column:
    """Isolation per volt; null at a volt or less."""
    return F.when(volt > 1, kohm * 1000 / volt)


def half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("long")


def power_levels(top: Column, n: int) -> Column:
    """n evenly spaced levels from 0 to `top`."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(top * i / (n - 1), 3))


def geohash(lat: Column, lon: Column, precision: int = 6) -> Column:
    """Base-32 cell of a place: longitude and latitude halved in turn, five halvings a letter."""
    n = 5 * precision
    lon_bits, lat_bits = (n + 1) // 2, n // 2
    cell = lambda x, lo, hi, bits: F.least(F.floor((x - lo) / (hi - lo) * (1 << bits)), F.lit((1 << bits) - 1)).cast("long")
    x, y = cell(lon, -180.0, 180.0, lon_bits), cell(lat, -90.0, 90.0, lat_bits)
    out = []
    for c in range(precision):
        v = F.lit(0)
        for b in range(5 * c, 5 * c + 5):
            src, left = (x, lon_bits - 1 - b // 2) if b % 2 == 0 else (y, lat_bits - 1 - b // 2)
            v = v * 2 + F.shiftright(src, left).bitwiseAND(1).cast("int")
        out.append(F.substring(F.lit(GEOHASH), v + 1, F.lit(1)))
    return F.concat(*out)


def interpolate(x: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear over sorted points, flat beyond them."""
    out = F.lit(points[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:]))):
        out = F.when(x < x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x <= points[0][0], F.lit(points[0][1])).otherwise(out)


def current_for_power(volt: Column, ohm: Column, watt: Column) -> Column:
    """The smaller current at which a source with inner resistance gives a power: V I - R I^2 = P; at most V / 2R."""
    root = F.sqrt(F.greatest(volt * volt - 4 * ohm * watt, F.lit(0.0)))
    return (volt - root) / (2 * ohm)


def progress(start: Column, end: Column, now: Column) -> Column:
    """Share of the way from start to end, in [0, 1]; 1 where they fall together."""
    return F.when(end <= start, F.when(now >= start, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (now - start) / (end - start))))
