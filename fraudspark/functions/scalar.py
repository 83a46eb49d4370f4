"""Column expressions without state: rounding, distance, local time, one-hots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fraudspark.schemas import (
    CATEGORIES,
    DAY_MS,
    IST_OFFSET_MS,
    MAX_GAP_SECONDS,
)

EARTH_KM = 6371.0


def half_up(c: Column, digits: int) -> Column:
    """Round half up in plain double arithmetic, so that other engines can repeat it exactly."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / F.lit(scale)


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), c))


def flag(c: Column) -> Column:
    """Boolean to 1.0 / 0.0; null counts as false."""
    return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat = F.sin((p2 - p1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(p1) * F.cos(p2) * half_lon * half_lon
    # A null place must stay null: ``least`` would turn it into half the globe.
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def local_ms(ts_ms: Column) -> Column:
    return ts_ms + F.lit(IST_OFFSET_MS)


def hour_local(ts_ms: Column) -> Column:
    return F.pmod(local_ms(ts_ms), F.lit(DAY_MS)) / F.lit(3_600_000.0)


def weekday_local(ts_ms: Column) -> Column:
    """Monday = 0; day 0 of the epoch was a Thursday."""
    return F.pmod(F.floor(local_ms(ts_ms) / F.lit(DAY_MS)) + 3, F.lit(7))


def days_between(later_ms: Column, earlier_ms: Column) -> Column:
    return (later_ms - earlier_ms) / F.lit(float(DAY_MS))


def age_days(later_ms: Column, earlier_ms: Column) -> Column:
    """Days since ``earlier_ms``, never negative, 0 when it is unknown."""
    return F.coalesce(
        F.greatest(F.lit(0.0), days_between(later_ms, earlier_ms)), F.lit(0.0)
    )


def gap_seconds(ts_ms: Column, prev_ms: Column) -> Column:
    """Seconds since the previous event, between 0 and 30 days; 30 days when there is none."""
    # least and greatest skip nulls, so the missing case comes first.
    return F.when(prev_ms.isNull(), F.lit(MAX_GAP_SECONDS)).otherwise(
        clamp((ts_ms - prev_ms) / F.lit(1000.0), 0.0, MAX_GAP_SECONDS)
    )


def speed_kmh(distance: Column, gap: Column) -> Column:
    hours = F.greatest(gap / 3600.0, F.lit(1.0) / F.lit(60.0))
    return F.when(
        distance > 0, F.least(F.lit(5000.0), distance / hours)
    ).otherwise(F.lit(0.0))


def category_onehots(category: Column) -> list[Column]:
    return [flag(category == c).alias(f"cat_{c}") for c in CATEGORIES]


def category_name(index: Column) -> Column:
    return F.element_at(
        F.array(*[F.lit(c) for c in CATEGORIES]), index.cast("int") + 1
    )


def sum_columns(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)
