"""Column functions on positions and local time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radius in km, streets per straight line, hours that local time is ahead of UTC.
RADIUS_KM, ROAD_FACTOR, UTC_HOURS = 6371.0, 1.3, 3
#: Speed limits in km/h within the home city and elsewhere; minutes of grace.
HOME_KMH, OPEN_KMH, GRACE_MIN = 90.0, 130.0, 10.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def local(ts: Column) -> Column:
    """Local wall-clock time of an instant."""
    return ts + F.expr(f"INTERVAL {UTC_HOURS} HOURS")


def minutes_between(a: Column, dwell_min: Column, b: Column) -> Column:
    """Minutes from the end of a stay to the next sighting; may be negative."""
    return (F.unix_micros(b) - F.unix_micros(a)) / 60e6 - F.coalesce(dwell_min, F.lit(0))


def needed_kmh(km: Column, gap_min: Column) -> Column:
    """Speed that a trip needs."""
    return F.when(km == 0, 0.0).otherwise(km / F.greatest(gap_min, F.lit(0.5)) * 60)


def feasible(km: Column, gap_min: Column, both_home: Column) -> Column:
    """Whether the distance can be driven in the gap and its grace."""
    limit = F.when(both_home, HOME_KMH).otherwise(OPEN_KMH)
    return km <= limit * F.greatest(gap_min + GRACE_MIN, F.lit(0.0)) / 60


def mean_clock_minutes(minutes: Column) -> Column:
    """Aggregate: circular mean of minutes of the day."""
    angle = minutes * (2 * 3.141592653589793 / 1440)
    mean = F.atan2(F.sum(F.sin(angle)), F.sum(F.cos(angle))) * (1440 / (2 * 3.141592653589793))
    return ((mean % 1440) + 1440) % 1440


def regularity(hits: Column, observed: Column) -> Column:
    """Confidence that a place is visited regularly."""
    return F.when((hits == 0) | (observed == 0), 0.0).otherwise(F.least(F.lit(0.95), hits / observed * (1 - F.exp(-hits / 5))))
